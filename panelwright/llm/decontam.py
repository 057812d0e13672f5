"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index is a stored table of postings (term, document, position). Only terms that the test set
asks for are indexed: of every test window the two rarest by corpus count. Postings of the rarest
term are aligned with its place in the test item, and intersected with the postings of the second
rarest at the place where that one would have to be. What survives is compared word for word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import materialise, materialise_counted

#: What parts words, once A-Z are lower case: all ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20  # a table is broadcast only if it was measured to be smaller


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() does that for texts of ASCII only."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), GAP), "")


def tag(doc_id: Column, text: Column) -> Column:
    """Names a row by its content, so that repeated rows share one result and null ids have one."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def measured(df: DataFrame, label: str) -> DataFrame:
    """Store a table; mark it for broadcast if its stored rows were measured to be small.

    Beyond the bound Spark joins by shuffle and splits skewed partitions itself.
    """
    stored, rows = materialise_counted(df, label)
    widths = {"int": 4, "bigint": 8, "double": 8}
    fixed = sum(widths.get(kind, 0) for _, kind in df.dtypes)
    if rows * (fixed + 16) > BROADCAST_BYTES:
        return stored
    loose = [F.octet_length(F.to_json(F.struct(c))) for c, kind in df.dtypes if kind not in widths]
    size = stored.agg(F.sum(sum(loose, F.lit(0)))).first()[0] or 0 if loose else 0
    return F.broadcast(stored) if size + rows * (fixed + 16) <= BROADCAST_BYTES else stored


def counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) for the given terms over all words of all documents; 0 for a term that has none."""
    every = documents.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(every, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc, pos) of the given terms in all documents, stored; doc is a tag."""
    rows = documents.select(tag(F.col("doc_id"), F.col("text")).alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return materialise(rows.join(terms, "term").select("term", "doc", "pos").distinct(), "postings")


def probes(items: DataFrame, frequency: DataFrame, width: int) -> DataFrame:
    """(item, p1, t1, p2, t2): places and terms of the two rarest words of each window of the items.

    items holds item and words. Windows that share both places share a row.
    """
    places = items.select("item", F.posexplode("words").alias("p", "term")).join(frequency, "term")
    one = places.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("p", "n", "term"))).alias("at"))
    last = F.greatest(F.size("at") - width, F.lit(0))
    one = one.withColumn("s", F.explode(F.sequence(F.lit(0), last)))
    ranked = F.array_sort(F.transform(F.slice("at", F.col("s") + 1, F.lit(width)), lambda x: F.struct(x["n"], x["p"], x["term"])))
    one = one.select("item", F.get(ranked, 0).alias("a"), F.coalesce(F.get(ranked, 1), F.get(ranked, 0)).alias("b"))
    return one.select(
        "item", F.col("a.p").alias("p1"), F.col("a.term").alias("t1"), F.col("b.p").alias("p2"), F.col("b.term").alias("t2")
    ).distinct()


def aligned(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, item, shift): where both probe terms of some window stand at their places.

    Item word i would be document word shift + i. Shuffled by (term, document, position), so no
    frequent term or document meets in one task.
    """
    first = index.join(asked, index["term"] == asked["t1"]).select(
        "doc", "item", (F.col("pos") - F.col("p1")).alias("shift"), F.col("t2").alias("term"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos")
    )
    second = index.select("term", "doc", "pos")
    return first.join(second, ["term", "doc", "pos"], "left_semi").select("doc", "item", "shift").distinct()


def phrase_hits(documents: DataFrame, items: DataFrame, spots: DataFrame, width: int) -> DataFrame:
    """(doc, n_words, item, low, high): runs of document words that windows of the item cover.

    Each run is compared word by word.
    """
    touched = measured(spots.select("doc").distinct(), "touched-documents")
    texts = documents.withColumn("doc", tag(F.col("doc_id"), F.col("text"))).join(touched, "doc", "left_semi")
    texts = texts.select("doc", words(F.col("text")).alias("theirs")).dropDuplicates(["doc"])
    both = spots.join(items, "item").join(texts, "doc")
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    begin = F.greatest(F.col("shift"), F.lit(0))
    length = F.greatest(F.least(F.size("words") - skipped, F.size("theirs") - begin), F.lit(0))
    both = both.withColumn("begin", begin).withColumn("n", length).withColumn("least", F.least(F.size("words"), F.lit(width)))
    flags = F.zip_with(F.slice("theirs", F.col("begin") + 1, F.col("n")), F.slice("words", skipped + 1, F.col("n")), lambda a, b: a == b)
    both = both.select("doc", F.size("theirs").cast("long").alias("n_words"), "item", "begin", "n", "least", flags.alias("flags"))
    wrong = F.filter(F.transform("flags", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    both = both.withColumn("ends", F.concat(F.array(F.lit(-1)), wrong, F.array(F.col("n"))))
    runs = F.zip_with(
        F.slice("ends", F.lit(1), F.size("ends") - 1),
        F.slice("ends", F.lit(2), F.size("ends") - 1),
        lambda a, b: F.struct((a + 1).alias("low"), (b - 1).alias("high")),
    )
    long_enough = both.withColumn("run", F.explode(runs)).filter(F.col("run.high") - F.col("run.low") + 1 >= F.col("least"))
    return long_enough.select(
        "doc", "n_words", "item", (F.col("begin") + F.col("run.low")).alias("low"), (F.col("begin") + F.col("run.high")).alias("high")
    )


def proximity(index: DataFrame, asked: DataFrame, frequency: DataFrame, span: int) -> DataFrame:
    """(query, doc, pos): places of a query's rarest term with all its other terms within span words.

    asked holds (query, term). Postings meet in blocks of span positions, each in its own block
    and the two beside it, so no document's positions are paired with one another at large.
    """
    terms = asked.distinct().join(frequency, "term")
    rank = Window.partitionBy("query").orderBy("n", "term")
    terms = terms.withColumn("nth", F.row_number().over(rank)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("query")))
    block = F.floor(F.col("pos") / (span + 1))
    start = index.join(terms.filter("nth = 1").select("query", "term", "all"), "term").drop("term")
    around = start.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    others = index.select("term", "doc", F.col("pos").alias("at")).withColumn("block", F.floor(F.col("at") / (span + 1)))
    wanted = around.join(terms.filter("nth > 1").select("query", "term"), "query").join(others, ["term", "doc", "block"])
    near = wanted.filter(F.abs(F.col("at") - F.col("pos")) <= span).select("query", "doc", "pos", "all", "term").distinct()
    full = near.groupBy("query", "doc", "pos", "all").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 == F.col("all"))
    return full.select("query", "doc", "pos").union(start.filter(F.col("all") == 1).select("query", "doc", "pos"))


def found_in(documents: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(doc, n_words, hit, ids) of the documents in which some window of some item occurs, stored.

    hit counts words inside occurrences, each once; ids are the items' ids as sorted strings.
    """
    documents = documents.select("doc_id", "text")
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter("item_id IS NOT NULL AND size(words) > 0")
    items = items.dropDuplicates(["item_id", "words"]).withColumn("item", F.xxhash64("item_id", "words"))
    items = measured(items, "items")
    terms = items.select(F.explode("words").alias("term")).distinct()
    frequency = materialise(counts(documents, terms), "term-counts")
    asked = measured(probes(items.select("item", "words"), frequency, width), "probes")
    wanted = measured(asked.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "probe-terms")
    index = build_index(documents, wanted)
    spots = materialise(aligned(index, asked), "alignments")
    hits = materialise(phrase_hits(documents, items.select("item", "words"), spots, width), "hits")
    order = Window.partitionBy("doc").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.select("doc", "n_words", "low", "high").distinct().withColumn("till", F.coalesce(F.max("high").over(order), F.lit(-1)))
    fresh = F.greatest(F.col("high") - F.greatest(F.col("low") - 1, F.col("till")), F.lit(0))
    hit = covered.groupBy("doc", "n_words").agg(F.sum(fresh).cast("long").alias("hit"))
    named = hits.select("doc", "item").distinct().join(items.select("item", F.col("item_id").cast("string").alias("id")), "item")
    lists = named.groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return materialise(hit.join(lists, "doc"), "contaminated")


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 13, part: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of documents.

    A null or empty text has no words. Items that are null, empty or have no item_id are no
    items; an item_id on several rows is each of their texts. Repeated document rows have equal
    results, an empty table of documents has none; other columns are not read.
    """
    found = found_in(documents, benchmark, width).drop("n_words")
    rows = documents.select("doc_id", tag(F.col("doc_id"), F.col("text")).alias("doc"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, "doc", "left")
    hit = F.coalesce("hit", F.lit(0))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((hit > 0) & (hit * part >= F.col("n_words"))).alias("contaminated"),
    )


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame, width: int = 13, part: int = 20) -> DataFrame:
    """Documents of whose words fewer than one in `part` are covered, with all their columns."""
    bad = found_in(documents, benchmark, width).filter(F.col("hit") * part >= F.col("n_words"))
    bad = measured(bad.select(F.col("doc").alias("__contaminated")), "contaminated-tags")
    return documents.join(bad, tag(documents["doc_id"], documents["text"]) == F.col("__contaminated"), "left_anti")
