"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import columns, compare, dbscan, joins, kmeans, neighbours, projection, regression, stats, ward
from panelwright.operators import thresholds as th
from panelwright.operators.running import running_sums
from panelwright.plans import base
from panelwright.plans.base import FEATURES, THRESHOLDS, day_text, load, real, whole
from panelwright.session import materialise, scratch_path
from panelwright.sources import csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- sources and sinks -------------------------------------------------------------------------


@query
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    source = load(spark, sf_dir, "customer")
    exported = source.select(
        F.col("c_custkey").alias("Customer Key"),
        F.col("c_name").alias("Name: full"),
        F.col("c_acctbal").alias("Balance (1.0) + residual"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("Segment"),
    )
    csv.write_csv(exported, path)
    return csv.read_csv(spark, path, exported.schema, sanitize=True)


@query
def csv_multiline(spark, sf_dir):
    path = scratch_path(spark, "documents-csv")
    source = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    csv.write_csv(source, path)
    back = csv.read_csv(spark, path, source.schema, multi_line=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), whole(F.length("text")).alias("n"), "lang")


@query
def csv_marked(spark, sf_dir):
    """Files that begin with a byte-order mark and end each line in a comma."""
    path = scratch_path(spark, "marked-csv")
    source = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")

    header = "\ufeff" + ",".join(f'"{c}"' for c in source.columns) + ","

    def lines(batches):
        yield pd.DataFrame({"value": [header]})
        for batch in batches:
            yield pd.DataFrame({"value": [f'"{k}","{n}","{b}",' for k, n, b in batch.itertuples(index=False)]})

    source.mapInPandas(lines, "value string").write.text(path)
    return csv.read_csv(spark, path, source.schema, trailing_comma=True)


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "clusters-csv")
    result = base.features(spark, sf_dir).withColumn("cluster", base.label_a()).dropna(subset=["cluster"])
    csv.write_csv(result, path, partition_by=["cluster"])
    schema = "entity bigint, total double, bad double, span double, long_span double"
    back = csv.read_csv(spark, path, schema)
    return back.select("entity", real("total"), real("bad"), real("span"), real("long_span"), whole("cluster")).toDF(
        "entity", "total", "bad", "span", "long_span", "cluster"
    )


# --- projection, rename, cast, filter ----------------------------------------------------------


@query
def project_cols(spark, sf_dir):
    awkward = columns.rename(load(spark, sf_dir, "lineitem"), {"l_tax": "Tax (1.0) + levy"})
    picked = columns.project(awkward, ["l_orderkey", "l_linenumber", "Tax (1.0) + levy", "l_returnflag"])
    return columns.rename(picked, {"Tax (1.0) + levy": "tax"}).withColumn("l_linenumber", whole("l_linenumber"))


@query
def drop_cols(spark, sf_dir):
    return columns.drop(load(spark, sf_dir, "orders"), ["o_orderdate", "o_orderpriority", "not_there"])


@query
def rename_cols(spark, sf_dir):
    renamed = columns.rename(
        load(spark, sf_dir, "supplier"), {"s_acctbal": "supplier_balance", "s_name": "supplier", "not_there": "x"}
    )
    return renamed.withColumn("s_nationkey", whole("s_nationkey"))


@query
def project_position(spark, sf_dir):
    return columns.project_slice(load(spark, sf_dir, "part"), 2, 4).groupBy("p_name", "p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def cast_date(spark, sf_dir):
    text = load(spark, sf_dir, "orders").select("o_orderkey", day_text("o_orderdate").alias("day"))
    dated = columns.parse_date(text, "day")
    return dated.select("o_orderkey", whole(F.year("day")).alias("y"), whole(F.dayofyear("day")).alias("d"))


@query
def filter_ne(spark, sf_dir):
    return columns.exclude(load(spark, sf_dir, "events"), "event_type", ["view"]).select(
        "event_id", "user_id", "event_type"
    )


@query
def filter_not_in(spark, sf_dir):
    kept = columns.exclude(load(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    aggregates = load(spark, sf_dir, "nation").filter("n_regionkey = 0").select("n_nationkey")
    return columns.exclude(kept, "c_nationkey", aggregates).select(
        "c_custkey", whole("c_nationkey").alias("c_nationkey"), "c_mktsegment"
    )


@query
def filter_in(spark, sf_dir):
    kept = columns.keep(load(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "R"])
    rich = load(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey")
    return columns.keep(kept, "l_orderkey", rich).select(
        "l_orderkey", whole("l_linenumber").alias("l_linenumber"), "l_returnflag"
    )


@query
def assert_unique_key(spark, sf_dir):
    return columns.repeated_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey"])


# --- enrichment, thresholds --------------------------------------------------------------------


@query
def dim_enrich(spark, sf_dir):
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price")
    )
    suppliers = load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.avg("s_acctbal").alias("supplier_balance")
    )
    enriched = joins.enrich(
        base.panel(spark, sf_dir),
        [
            joins.Dimension(customer, "entity", "c_custkey"),
            joins.Dimension(orders, "entity", "o_custkey"),
            joins.Dimension(nation, "c_nationkey", "n_nationkey"),
            joins.Dimension(region, "n_regionkey", "r_regionkey"),
            joins.Dimension(suppliers, "c_nationkey", "s_nationkey"),
        ],
    )
    return enriched.select(
        "entity",
        day_text("day").alias("day"),
        real("total_metric").alias("total_metric"),
        real("c_acctbal").alias("c_acctbal"),
        "c_mktsegment",
        "n_name",
        "r_name",
        "n_orders",
        real("mean_price", 6).alias("mean_price"),
        real("supplier_balance", 6).alias("supplier_balance"),
    )


@query
def threshold_counter(spark, sf_dir):
    run = base.running(spark, sf_dir)
    return run.select(
        "entity",
        day_text("day").alias("day"),
        real("total_metric").alias("total_metric"),
        *[th.bucket_name(t) for t in THRESHOLDS],
        *[whole(th.counter_name(t)).alias(th.counter_name(t)) for t in THRESHOLDS],
    )


@query
def counter_timestamps(spark, sf_dir):
    """Counters over moments of few, busy entities, which are cut into blocks of time."""
    moments = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("entity"), F.col("ts").alias("at")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("added")
    )
    run = running_sums(moments, ["entity"], "at", {"total": F.col("added")})
    counted = th.threshold_counters(run, "entity", "at", "total", (1000, 20000), buckets=False)
    return counted.select(
        "entity", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), real("total").alias("total"),
        whole("day_1000").alias("day_1000"), whole("day_20000").alias("day_20000"),
    )


@query
def first_crossing(spark, sf_dir):
    return th.first_crossing(base.running(spark, sf_dir), 1000).select(
        "entity",
        day_text("day").alias("day"),
        real("total_metric").alias("total_metric"),
        whole("day_100").alias("day_100"),
        whole("day_500").alias("day_500"),
    )


@query
def threshold_durations(spark, sf_dir):
    run = base.running(spark, sf_dir)
    section = th.cross_section(run, "day", base.last_day(spark, sf_dir), reached=100).select("entity", "total_metric")
    spans = th.durations(run, "entity", THRESHOLDS)
    joined = th.with_durations(section, spans, "entity")
    names = [c for c in joined.columns if c.startswith("days_")]
    return joined.select(
        "entity", real("total_metric").alias("total_metric"), *[whole(c).alias(c) for c in names]
    )


@query
def durations_as_of(spark, sf_dir):
    spans = th.durations(base.running(spark, sf_dir), "entity", THRESHOLDS, time="day", as_of="2024-01-10")
    return spans.select("entity", *[whole(c).alias(c) for c in spans.columns if c != "entity"])


@query
def asof_cross_section(spark, sf_dir):
    return th.cross_section(base.running(spark, sf_dir), "day", base.last_day(spark, sf_dir), reached=100).select(
        "entity", day_text("day").alias("day"), real("total_metric").alias("total_metric"), whole("total_bad").alias("total_bad")
    )


@query
def day_n_cross_section(spark, sf_dir):
    return th.day_n_section(base.running(spark, sf_dir), 100, 10, "total_metric", 500).select(
        "entity", day_text("day").alias("day"), real("total_metric").alias("total_metric"), whole("total_bad").alias("total_bad")
    )


@query
def significant_entities(spark, sf_dir):
    section = th.cross_section(base.running(spark, sf_dir), "day", base.last_day(spark, sf_dir), reached=100)
    return th.significant(section, "total_metric", 2500).select(
        "entity", real("total_metric").alias("total_metric"), whole("day_1000").alias("day_1000")
    )


# --- descriptive -------------------------------------------------------------------------------


@query
def cluster_profile(spark, sf_dir):
    labelled = kmeans_labelled(spark, sf_dir)
    measures = ["total", "bad", "span", "long_span"]
    strict = stats.profile(labelled, "cluster", measures).withColumn("nulls", F.lit("propagate"))
    loose = stats.profile(labelled, "cluster", measures, nulls="skip").withColumn("nulls", F.lit("skip"))
    return strict.unionByName(loose).select(
        whole("cluster").alias("cluster"), "nulls", "rows", *[real(f"mean_{m}", 6).alias(f"mean_{m}") for m in measures]
    )


@query
def table_summary(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"
    ).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    lines = lines.withColumn("l_shipdate", F.to_date("l_shipdate"))
    summary = stats.table_summary(lines, by=["l_linestatus"])
    return summary.select(
        "l_linestatus", "column", "type", "rows", "nulls", *[real(c).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")]
    )


@query
def corr_matrix(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    matrix = stats.corr_matrix(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return matrix.select("a", "b", real("r", 6).alias("r"))


@query
def corr_prune(spark, sf_dir):
    wide = base.features(spark, sf_dir).withColumn("twice", F.col("total") * 2 + F.col("bad"))
    judged = stats.corr_prune(stats.corr_matrix(wide, [*FEATURES, "twice"]), 0.95)
    return judged.select("column", real("mean_abs_r", 6).alias("mean_abs_r"), "keep")


@query
def standardize(spark, sf_dir):
    scaled = stats.standardize(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return scaled.select("o_orderkey", real("o_totalprice", 6).alias("o_totalprice"))


# --- regression --------------------------------------------------------------------------------

LINE_MODEL = regression.model("l_extendedprice", "l_quantity", "l_discount")


def coefficient_view(fit, by=(), digits=4):
    return regression.coefficients(fit, by).select(
        *by, "term", whole("position").alias("position"), *[real(c, digits).alias(c) for c in ("estimate", "std_error", "t")]
    )


def figures_view(fit, by=()):
    return regression.model_figures(fit, by).select(
        *by, "n", "dropped", whole("df").alias("df"), *[real(c).alias(c) for c in ("sigma", "r2", "adj_r2", "f")]
    )


def day_ten(spark, sf_dir):
    section = th.day_n_section(base.running(spark, sf_dir), 100, 10, "total_metric", 500)
    predictors = base.entity_predictors(spark, sf_dir)
    return joins.left_join(section, predictors, [("entity", "entity_key")])


@query
def ols_fit(spark, sf_dir):
    return coefficient_view(regression.ols(load(spark, sf_dir, "lineitem"), LINE_MODEL))


CATALOGUE = {
    "one": regression.model("l_extendedprice", "l_quantity"),
    "two": LINE_MODEL,
    "crossed": regression.model("l_extendedprice", regression.crossed("l_quantity", "l_tax")),
}


@query
def ols_catalogue(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return coefficient_view(regression.ols_catalogue({n: (lines, m) for n, m in CATALOGUE.items()}), ["model"])


@query
def ols_by_group(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    fit = regression.ols(lines, LINE_MODEL, by=["l_returnflag"])
    return figures_view(fit, ["l_returnflag"])


@query
def ols_interaction(spark, sf_dir):
    spec = regression.model("total_metric", regression.crossed("balance", "n_orders"))
    return coefficient_view(regression.ols(day_ten(spark, sf_dir), spec))


@query
def ols_by_section(spark, sf_dir):
    run = base.running(spark, sf_dir)
    sections = th.label_sections(
        {
            "day 10": th.day_n_section(run, 100, 10, "total_metric", 500),
            "as of": th.significant(th.cross_section(run, "day", base.last_day(spark, sf_dir), reached=100), "total_metric", 2500),
        }
    )
    fit = regression.ols(sections, regression.model("total_bad", "total_metric"), by=["section"])
    return coefficient_view(fit, ["section"], 6)


@query
def ols_summary(spark, sf_dir):
    fit = regression.ols(day_ten(spark, sf_dir), regression.model("total_bad", "total_metric"))
    return fit.select(
        "term", *[real(c, 6).alias(c) for c in ("estimate", "std_error", "t", "p", "sigma", "r2", "adj_r2", "f", "f_p")],
        "n", "dropped", whole("df").alias("df"),
    )


@query
def ols_residuals(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    spec = regression.model("l_extendedprice", "l_quantity")
    fit = regression.ols(lines, spec, by=["l_returnflag"])
    q = regression.residual_quantiles(lines, spec, fit, by=["l_returnflag"])
    return q.select("l_returnflag", *[real(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query
def ols_rank_deficient(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + 1)
    fit = regression.ols(lines, regression.model("l_extendedprice", "l_quantity", "twice"), by=["l_linestatus"])
    return coefficient_view(fit, ["l_linestatus"])


# --- clustering --------------------------------------------------------------------------------


def scaled_features(spark, sf_dir):
    stored = materialise(base.features(spark, sf_dir), "features")
    return materialise(stats.standardize(stored, FEATURES), "scaled-features")


def centres_view(fits):
    return fits.centres.select(
        whole("k").alias("k"), whole("cluster").alias("cluster"), "size", real("withinss").alias("withinss"),
        *[real(F.get("centre", F.lit(i))).alias(f) for i, f in enumerate(fits.features)],
    )


@query
def kmeans_fit(spark, sf_dir):
    return centres_view(kmeans.kmeans_sweep(scaled_features(spark, sf_dir), "entity", FEATURES, [4]))


@query
def elbow_table(spark, sf_dir):
    fits = kmeans.kmeans_sweep(scaled_features(spark, sf_dir), "entity", FEATURES, range(2, 10))
    return kmeans.elbow(fits).select(whole("k").alias("k"), real("wss").alias("wss"))


STARTS = 5


def both_features(spark, sf_dir):
    """Stored features, and the same standardised; the panel is computed once."""
    stored = materialise(base.features(spark, sf_dir), "features")
    return stored, materialise(stats.standardize(stored, FEATURES), "scaled-features")


def fitted_four(scaled):
    """Centres and labels of k-means with four clusters."""
    centres = kmeans.kmeans_sweep(scaled, "entity", FEATURES, [4], starts=STARTS).of(4)
    return centres, kmeans.assign(scaled, FEATURES, centres).select("entity", "cluster")


def kmeans_labelled(spark, sf_dir):
    stored, scaled = both_features(spark, sf_dir)
    return materialise(compare.attach_labels(stored, fitted_four(scaled)[1], "entity"), "labelled")


@query
def kmeans_assign(spark, sf_dir):
    _, labels = fitted_four(both_features(spark, sf_dir)[1])
    return labels.select("entity", whole("cluster").alias("cluster"))


@query
def cluster_wss(spark, sf_dir):
    labelled = kmeans_labelled(spark, sf_dir)
    return kmeans.cluster_wss(labelled, "cluster", FEATURES).select(
        whole("cluster").alias("cluster"), "size", real("withinss").alias("withinss")
    )


@query
def cluster_join(spark, sf_dir):
    stored, scaled = both_features(spark, sf_dir)
    small = stored.filter("total < 4000").select("entity")
    labels = columns.keep(fitted_four(scaled)[1], "entity", small)
    return compare.attach_labels(stored, labels, "entity", only_labelled=True).select(
        "entity", real("total").alias("total"), whole("cluster").alias("cluster")
    )


@query
def cluster_split(spark, sf_dir):
    labelled = kmeans_labelled(spark, sf_dir)
    return compare.part(labelled, "cluster", 2).select("entity", real("total").alias("total"), real("bad").alias("bad"))


@query
def outlier_table(spark, sf_dir):
    table = materialise(base.features(spark, sf_dir), "features")
    outliers = table.filter("total >= 4000").select("entity")
    labels = columns.exclude(table, "entity", outliers).withColumn("cluster", base.label_a()).select("entity", "cluster")
    return columns.keep(compare.attach_labels(table, labels, "entity"), "entity", outliers).select(
        "entity", real("total").alias("total"), whole("cluster").alias("cluster")
    )


@query
def pca_projection(spark, sf_dir):
    table = materialise(base.features(spark, sf_dir).withColumn("cluster", base.label_b()), "features")
    return projection.pca_projection(table, "entity", FEATURES, keep=["cluster"]).select(
        "entity", real("pc1").alias("pc1"), real("pc2").alias("pc2"), whole("cluster").alias("cluster")
    )


@query
def pca_two_columns(spark, sf_dir):
    return projection.pca_projection(base.features(spark, sf_dir), "entity", ["total", "span"]).select(
        "entity", real("pc1").alias("pc1"), real("pc2").alias("pc2")
    )


@query
def pairwise_distance(spark, sf_dir):
    scaled = both_features(spark, sf_dir)[1]
    found = kmeans.centre_distances(scaled, "entity", FEATURES, fitted_four(scaled)[0])
    return found.select("entity", whole("cluster").alias("cluster"), real("distance").alias("distance"))


@query
def nearest_entities(spark, sf_dir):
    """The five nearest other entities of each, in six features."""
    table = materialise(base.exact_features(spark, sf_dir), "exact-features")
    found = neighbours.nearest(table, "entity", base.EXACT, 5, invalid="skip")
    return found.select("entity", whole("rank").alias("rank"), "neighbour", real("distance").alias("distance"))


@query
def partners_with_missing(spark, sf_dir):
    """Distances over the coordinates that both entities have; the span to 3000 and others are missing at times."""
    table = base.exact_features(spark, sf_dir).withColumns({
        "span": F.when(F.col("entity") % 5 != 1, F.col("span")),
        "bad": F.when(F.col("entity") % 7 != 2, F.col("bad")),
        "total": F.when(F.col("entity") % 11 != 3, F.col("total")),
    })
    missing = ("total", "bad", "span", "long_span")
    table = materialise(table.select("entity", *missing), "features-with-missing")
    found = neighbours.partners_with_missing(table, "entity", missing, 3.0)
    return found.select(
        "entity", whole("present").alias("present"), "comparable", "near", "nearest", real("distance").alias("distance")
    )


def dbscan_view(labels):
    return labels.select("entity", whole("cluster").alias("cluster"), "is_core")


@query
def dbscan_fit(spark, sf_dir):
    return dbscan_view(dbscan.dbscan(scaled_features(spark, sf_dir), "entity", FEATURES, 0.5, 4))


@query
def dbscan_six(spark, sf_dir):
    stored = materialise(base.six_features(spark, sf_dir), "six-features")
    scaled = materialise(stats.standardize(stored, base.SIX), "scaled-six-features")
    return dbscan_view(dbscan.dbscan(scaled, "entity", base.SIX, 1.3, 4))


@query
def dbscan_sweep(spark, sf_dir):
    grid = [(0.5, 4), (0.8, 4), (0.5, 3)]
    found = dbscan.dbscan_sweep(scaled_features(spark, sf_dir), "entity", FEATURES, grid)
    return found.select("eps", whole("min_pts").alias("min_pts"), whole("cluster").alias("cluster"), "size", "cores")


@query
def ward_merges(spark, sf_dir):
    tree = ward.ward_tree(scaled_features(spark, sf_dir), "entity", FEATURES)
    return ward.numbered(tree).select("step", "left", "right", real("height").alias("height"), "size")


@query
def ward_cut(spark, sf_dir):
    table = scaled_features(spark, sf_dir)
    tree = ward.ward_tree(table, "entity", FEATURES)
    return ward.cut(table, "entity", tree, 4).select("entity", whole("cluster").alias("cluster"))


@query
def ward_matrix(spark, sf_dir):
    """What each join brings together: single rows below zero, earlier joins above."""
    table = scaled_features(spark, sf_dir)
    matrix = ward.merge_matrix(table, "entity", ward.ward_tree(table, "entity", FEATURES))
    return matrix.select("step", whole("first").alias("first"), whole("second").alias("second"), real("height").alias("height"), "size")


@query
def ward_order(spark, sf_dir):
    """Places of the entities along the drawn tree."""
    table = scaled_features(spark, sf_dir)
    return ward.leaf_order(table, "entity", ward.ward_tree(table, "entity", FEATURES))


@query
def ward_elbow(spark, sf_dir):
    table = materialise(base.features(spark, sf_dir), "features")
    tree = ward.ward_tree(table, "entity", FEATURES)
    return ward.elbow(tree, range(1, 11)).select(whole("k").alias("k"), real("wss").alias("wss"))


# --- comparison of labels ----------------------------------------------------------------------


def two_labelings(spark, sf_dir):
    """Labels of k-means and of Ward's tree cut at four, on the entities that are no outliers."""
    stored, scaled = both_features(spark, sf_dir)
    one = fitted_four(scaled)[1].withColumnRenamed("cluster", "label_a")
    tree = ward.ward_tree(scaled, "entity", FEATURES)
    two = ward.cut(scaled, "entity", tree, 4).withColumnRenamed("cluster", "label_b")
    kept = stored.filter("total < 4000")
    return materialise(compare.attach_labels(compare.attach_labels(kept, one, "entity"), two, "entity"), "labelings")


@query
def cluster_compare(spark, sf_dir):
    return two_labelings(spark, sf_dir).select(
        "entity", *[real(f).alias(f) for f in FEATURES], whole("label_a").alias("label_a"), whole("label_b").alias("label_b")
    )


@query
def cluster_crosstab(spark, sf_dir):
    return compare.crosstab(two_labelings(spark, sf_dir), "label_a", "label_b").select(
        whole("label_a").alias("label_a"), whole("label_b").alias("label_b"), "rows"
    )


@query
def cluster_best_match(spark, sf_dir):
    both = two_labelings(spark, sf_dir)
    matched = compare.relabel(both, "label_b", compare.best_match(both, "label_b", "label_a"))
    return matched.select("entity", F.col("label_a").cast("string").alias("label_a"), "label_b")


@query
def cluster_assignment(spark, sf_dir):
    """The second labels renamed one to one, so that no two of them become the same."""
    both = two_labelings(spark, sf_dir)
    renamed = compare.relabel(both, "label_b", compare.assignment(both, "label_b", "label_a"))
    return renamed.select("entity", F.col("label_a").cast("string").alias("label_a"), "label_b")


@query
def relabel_map(spark, sf_dir):
    swapped = compare.relabel(two_labelings(spark, sf_dir), "label_b", {1: 2, 2: 4, 4: 3, 3: 1})
    return swapped.select("entity", "label_b")
