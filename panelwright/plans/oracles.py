"""SQL twins of the registered queries, over views named like the tables.

The day counters are written in their literal form, as row numbers inside (entity, bucket).
"""

from __future__ import annotations

from itertools import combinations

from panelwright.plans.base import EXACT, FEATURES, SIX, THRESHOLDS

ORACLES: dict[str, str] = {}


def r(expression: str, digits: int = 4) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


DAILY = """daily AS (
  SELECT user_id AS entity, CAST(ts AS DATE) AS day,
         SUM(CAST(value AS DECIMAL(18,2))) AS new_metric,
         COUNT(*) FILTER (WHERE event_type = 'error') AS new_bad
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""

PANEL = DAILY + """, panel AS (
  SELECT entity, day, new_metric, new_bad,
         SUM(new_metric) OVER w AS total_metric, SUM(new_bad) OVER w AS total_bad
  FROM daily WINDOW w AS (PARTITION BY entity ORDER BY day ROWS UNBOUNDED PRECEDING))"""

BUCKETS = ", ".join(
    f"CASE WHEN total_metric < {t} THEN '<{t}' WHEN total_metric >= {t} THEN '>={t}' END AS bucket_{t}"
    for t in THRESHOLDS
)
COUNTERS = ", ".join(
    f"CASE WHEN bucket_{t} = '<{t}' THEN 0 WHEN bucket_{t} = '>={t}' THEN "
    f"ROW_NUMBER() OVER (PARTITION BY entity, bucket_{t} ORDER BY day) END AS day_{t}"
    for t in THRESHOLDS
)
RUNNING = f"""{PANEL}, bucketed AS (SELECT *, {BUCKETS} FROM panel),
running AS (SELECT *, {COUNTERS} FROM bucketed)"""

FEATURE_TABLE = f"""{RUNNING}, features AS (
  SELECT entity, CAST(MAX(total_metric) AS DOUBLE) AS total, CAST(MAX(total_bad) AS DOUBLE) AS bad,
         CAST(MAX(CASE WHEN day_1000 = 1 THEN day_100 END) AS DOUBLE) AS span,
         CAST(MAX(CASE WHEN day_3000 = 1 THEN day_100 END) AS DOUBLE) AS long_span
  FROM running GROUP BY entity)"""

LABEL_A = (
    "CASE WHEN total < 2900 THEN 1 WHEN total < 3300 THEN 2 WHEN total < 3650 THEN 3 "
    "WHEN total < 4000 THEN 4 END"
)
LABEL_B = "CASE WHEN span <= 6 THEN 3 WHEN span <= 7 THEN 1 WHEN span <= 9 THEN 2 ELSE 4 END"

SCALED = f"""{FEATURE_TABLE}, scaled AS (SELECT entity, """ + ", ".join(
    f"({f} - AVG({f}) OVER ()) / STDDEV_SAMP({f}) OVER () AS {f}" for f in FEATURES
) + " FROM features)"

AS_OF = "day = (SELECT MAX(day) FROM panel)"
DAY_TEXT = "strftime(day, '%Y-%m-%d') AS day"

# --- sources and sinks -------------------------------------------------------------------------

ORACLES["csv_scan"] = """
SELECT c_custkey AS customer_key, c_name AS name_full, c_acctbal AS balance_1_0_residual,
       NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer"""

ORACLES["csv_multiline"] = "SELECT doc_id, md5(text) AS text_md5, LENGTH(text) AS n, lang FROM documents"

ORACLES["csv_marked"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"

ORACLES["csv_roundtrip"] = f"""WITH {FEATURE_TABLE}
SELECT entity, {r('total')} AS total, {r('bad')} AS bad, {r('span')} AS span, {r('long_span')} AS long_span,
       {big(LABEL_A)} AS cluster FROM features WHERE {LABEL_A} IS NOT NULL"""

# --- projection, rename, cast, filter ----------------------------------------------------------

ORACLES["project_cols"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_tax AS tax, l_returnflag FROM lineitem"""

ORACLES["drop_cols"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"

ORACLES["rename_cols"] = """
SELECT s_suppkey, s_name AS supplier, CAST(s_nationkey AS BIGINT) AS s_nationkey,
       s_acctbal AS supplier_balance FROM supplier"""

ORACLES["project_position"] = """
SELECT p_name, p_brand, p_type, COUNT(*) AS rows FROM part GROUP BY p_name, p_brand, p_type"""

ORACLES["cast_date"] = """
SELECT o_orderkey, YEAR(o_orderdate) AS y, DAYOFYEAR(o_orderdate) AS d FROM orders"""

ORACLES["filter_ne"] = "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'"

ORACLES["filter_not_in"] = """
SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer
WHERE c_mktsegment <> 'BUILDING' AND c_mktsegment <> 'MACHINERY'
  AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)"""

ORACLES["filter_in"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem
WHERE (l_returnflag = 'A' OR l_returnflag = 'R')
  AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)"""

ORACLES["assert_unique_key"] = """
SELECT l_orderkey, COUNT(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1 OR l_orderkey IS NULL"""

# --- enrichment, thresholds --------------------------------------------------------------------

ORACLES["dim_enrich"] = f"""WITH {PANEL},
per_customer AS (SELECT o_custkey, COUNT(*) AS n_orders, AVG(o_totalprice) AS mean_price FROM orders GROUP BY o_custkey),
per_nation AS (SELECT s_nationkey, AVG(s_acctbal) AS supplier_balance FROM supplier GROUP BY s_nationkey)
SELECT entity, {DAY_TEXT}, {r('total_metric')} AS total_metric, {r('c_acctbal')} AS c_acctbal, c_mktsegment,
       n_name, r_name, n_orders, {r('mean_price', 6)} AS mean_price, {r('supplier_balance', 6)} AS supplier_balance
FROM panel LEFT JOIN customer ON entity = c_custkey LEFT JOIN per_customer ON entity = o_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN per_nation ON c_nationkey = s_nationkey"""

ORACLES["threshold_counter"] = f"""WITH {RUNNING}
SELECT entity, {DAY_TEXT}, {r('total_metric')} AS total_metric,
       {', '.join(f'bucket_{t}' for t in THRESHOLDS)}, {', '.join(f'{big(f"day_{t}")} AS day_{t}' for t in THRESHOLDS)}
FROM running"""

ORACLES["counter_timestamps"] = f"""WITH moments AS (
  SELECT event_type AS entity, ts, SUM(CAST(value AS DECIMAL(18,2))) AS added FROM events GROUP BY event_type, ts),
run AS (SELECT *, SUM(added) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS total FROM moments)
SELECT entity, EPOCH_US(ts) AS at, {r('total')} AS total,
       {', '.join(f"{big(f'CASE WHEN total < {t} THEN 0 ELSE ROW_NUMBER() OVER (PARTITION BY entity, total >= {t} ORDER BY ts) END')} AS day_{t}" for t in (1000, 20000))}
FROM run"""

ORACLES["first_crossing"] = f"""WITH {RUNNING}
SELECT entity, {DAY_TEXT}, {r('total_metric')} AS total_metric, {big('day_100')} AS day_100,
       {big('day_500')} AS day_500 FROM running WHERE day_1000 = 1"""


def spans(where: str = "TRUE") -> str:
    """One table per upper threshold: the earlier counters on the row of its first crossing."""
    ctes = []
    for b in THRESHOLDS[1:]:
        picked = ", ".join(f"day_{a} AS days_{a}_to_{b}" for a in THRESHOLDS if a < b)
        ctes.append(f"to_{b} AS (SELECT entity, {picked} FROM running WHERE day_{b} = 1 AND {where})")
    return ", ".join(ctes)


PAIRS = [f"days_{a}_to_{b}" for a, b in combinations(THRESHOLDS, 2)]
SPAN_JOINS = " ".join(f"LEFT JOIN to_{b} USING (entity)" for b in THRESHOLDS[1:])
SPAN_COLUMNS = ", ".join(f"{big(p)} AS {p}" for p in PAIRS)

ORACLES["threshold_durations"] = f"""WITH {RUNNING}, {spans()}
SELECT entity, {r('total_metric')} AS total_metric, {SPAN_COLUMNS}
FROM (SELECT * FROM running WHERE {AS_OF} AND day_100 <> 0) AS section {SPAN_JOINS}"""

ORACLES["durations_as_of"] = f"""WITH {RUNNING}, {spans("day <= DATE '2024-01-10'")}
SELECT entity, {SPAN_COLUMNS}
FROM (SELECT DISTINCT entity FROM running WHERE day <= DATE '2024-01-10') AS entities {SPAN_JOINS}"""

SECTION = f"entity, {DAY_TEXT}, {r('total_metric')} AS total_metric, {big('total_bad')} AS total_bad"

ORACLES["asof_cross_section"] = f"WITH {RUNNING} SELECT {SECTION} FROM running WHERE {AS_OF} AND day_100 <> 0"

ORACLES["day_n_cross_section"] = (
    f"WITH {RUNNING} SELECT {SECTION} FROM running WHERE day_100 = 10 AND total_metric > 500"
)

ORACLES["significant_entities"] = f"""WITH {RUNNING}
SELECT entity, {r('total_metric')} AS total_metric, {big('day_1000')} AS day_1000
FROM running WHERE {AS_OF} AND day_100 <> 0 AND total_metric >= 2500"""

# --- descriptive -------------------------------------------------------------------------------

MEASURES = ("total", "bad", "span", "long_span")


def _summary(column: str, kind: str) -> str:
    if kind == "date":
        column, name = f"CAST(DATE_DIFF('day', DATE '1970-01-01', {column}) AS DOUBLE)", column
    else:
        name = column
    if kind == "string":
        facts = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min", "q1", "median", "mean", "q3", "max"))
    else:
        q = [f"quantile_cont({column}, {p})" for p in (0.25, 0.5, 0.75)]
        facts = (
            f"{r(f'MIN({column})')} AS min, {r(q[0])} AS q1, {r(q[1])} AS median, "
            f"{r(f'AVG({column})')} AS mean, {r(q[2])} AS q3, {r(f'MAX({column})')} AS max"
        )
    return (
        f"SELECT l_linestatus, '{name}' AS column, '{kind}' AS type, COUNT(*) AS rows, "
        f"COUNT(*) - COUNT({column}) AS nulls, {facts} FROM lines GROUP BY l_linestatus"
    )


ORACLES["table_summary"] = """WITH lines AS (
  SELECT l_linestatus, l_quantity, l_extendedprice, NULLIF(l_discount, 0.0) AS l_discount, l_returnflag,
         CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem)
""" + " UNION ALL ".join(
    _summary(c, k)
    for c, k in [("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_returnflag", "string"), ("l_shipdate", "date")]
)


def _correlations(names, table: str) -> str:
    cells = [
        f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'CORR({a}, {b})'} AS r FROM {table}"
        for a in names
        for b in names
    ]
    return " UNION ALL ".join(cells).replace("1.0 AS r FROM", "MAX(1.0) AS r FROM")


ORACLES["corr_matrix"] = f"""
SELECT a, b, {r('r', 6)} AS r FROM ({_correlations(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], 'lineitem')}) AS cells"""

ORACLES["corr_prune"] = f"""WITH {FEATURE_TABLE}, wide AS (SELECT *, total * 2 + bad AS twice FROM features),
matrix AS ({_correlations([*FEATURES, 'twice'], 'wide')}),
means AS (SELECT a, ROUND(AVG(ABS(r)), 9) AS m FROM matrix WHERE a <> b GROUP BY a)
SELECT x.a AS column, {r('MAX(ma.m)', 6)} AS mean_abs_r,
       NOT BOOL_OR(ABS(x.r) > 0.95 AND (ma.m > mb.m OR (ma.m = mb.m AND x.a > x.b))) AS keep
FROM matrix AS x JOIN means AS ma ON x.a = ma.a JOIN means AS mb ON x.b = mb.a
WHERE x.a <> x.b GROUP BY x.a"""

ORACLES["standardize"] = f"""
SELECT o_orderkey, {r('(o_totalprice - m) / s', 6)} AS o_totalprice
FROM orders, (SELECT AVG(o_totalprice) AS m, STDDEV_SAMP(o_totalprice) AS s FROM orders) AS stats"""

# --- regression --------------------------------------------------------------------------------


def moments(columns: list[str], table: str, by: str = "") -> str:
    """n, means m0.. and centred cross-products s00, s01 .. of the columns, per group."""
    parts = ["COUNT(*) AS n"] + [f"AVG({c}) AS m{i}" for i, c in enumerate(columns)]
    for i, j in [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]:
        parts.append(f"COVAR_POP({columns[i]}, {columns[j]}) * COUNT(*) AS s{i}{j}")
    where = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {by + ', ' if by else ''}{', '.join(parts)} FROM {table} WHERE {where}{group}"


def _s(i: int, j: int) -> str:
    return f"s{min(i, j)}{max(i, j)}"


def inverse(p: int) -> tuple[str, dict[tuple[int, int], str]]:
    """Determinant and cofactors of the p x p block of cross-products, p up to 3."""

    def det(rows, cols):
        if not rows:
            return "1.0"
        if len(rows) == 1:
            return _s(rows[0], cols[0])
        terms = []
        for k, c in enumerate(cols):
            rest = det(rows[1:], cols[:k] + cols[k + 1 :])
            terms.append(f"{'-' if k % 2 else '+'} {_s(rows[0], c)} * ({rest})")
        return " ".join(terms).lstrip("+ ")

    full = list(range(p))
    cofactors = {}
    for i in full:
        for j in full:
            minor = det([k for k in full if k != i], [k for k in full if k != j])
            cofactors[i, j] = f"{'-' if (i + j) % 2 else ''}({minor})"
    return det(full, full), cofactors


def fitted(p: int, source: str, by: str = "") -> str:
    """CTEs from `moments` to slopes b.., intercept, sigma2 and unscaled variances v.."""
    determinant, cof = inverse(p)
    slopes = ", ".join(
        "(" + " + ".join(f"({cof[i, j]}) * s{j}{p}" for j in range(p)) + f") / det AS b{i}" for i in range(p)
    )
    variances = ", ".join(f"({cof[i, i]}) / det AS v{i}" for i in range(p))
    at_mean = " + ".join(f"m{i} * m{j} * ({cof[i, j]}) / det" for i in range(p) for j in range(p))
    intercept = f"m{p} - " + " - ".join(f"b{i} * m{i}" for i in range(p))
    rss = f"s{p}{p} - " + " - ".join(f"b{i} * s{i}{p}" for i in range(p))
    return f"""moments AS ({source}),
determined AS (SELECT *, {determinant} AS det FROM moments),
sloped AS (SELECT *, {slopes}, {variances}, 1.0 / n + {at_mean} AS vi, n - {p} - 1 AS df FROM determined),
fit AS (SELECT *, {intercept} AS bi, ({rss}) / df AS sigma2 FROM sloped)"""


def coefficient_rows(names: list[str], by: str = "", digits: int = 4) -> str:
    key = f"{by}, " if by else ""
    rows = []
    for position, (name, b, v) in enumerate([("(intercept)", "bi", "vi")] + [(t, f"b{i}", f"v{i}") for i, t in enumerate(names)]):
        rows.append(
            f"SELECT {key}'{name}' AS term, CAST({position} AS BIGINT) AS position, {r(b, digits)} AS estimate, "
            f"{r(f'SQRT(sigma2 * {v})', digits)} AS std_error, {r(f'{b} / SQRT(sigma2 * {v})', digits)} AS t FROM fit"
        )
    return " UNION ALL ".join(rows)


LINE_TERMS = ["l_quantity", "l_discount"]
LINE_COLUMNS = [*LINE_TERMS, "l_extendedprice"]

ORACLES["ols_fit"] = f"WITH {fitted(2, moments(LINE_COLUMNS, 'lineitem'))} {coefficient_rows(LINE_TERMS)}"

LINES = """(SELECT l_quantity, l_tax, NULLIF(l_discount, 0.0) AS l_discount, l_extendedprice, l_quantity * l_tax AS crossed
  FROM lineitem) AS lines"""
ORACLES["ols_catalogue"] = " UNION ALL ".join(
    f"SELECT '{name}' AS model, * FROM (WITH {fitted(len(terms), moments([*columns, 'l_extendedprice'], LINES))} {coefficient_rows(terms)})"
    for name, terms, columns in [
        ("one", ["l_quantity"], ["l_quantity"]),
        ("two", LINE_TERMS, LINE_TERMS),
        ("crossed", ["l_quantity", "l_tax", "l_quantity:l_tax"], ["l_quantity", "l_tax", "crossed"]),
    ]
)

ORACLES["ols_by_group"] = f"""WITH lines AS (
  SELECT l_returnflag, l_quantity, NULLIF(l_discount, 0.0) AS l_discount, l_extendedprice FROM lineitem),
{fitted(2, moments(LINE_COLUMNS, 'lines', 'l_returnflag'))},
counts AS (SELECT l_returnflag, COUNT(*) AS total FROM lines GROUP BY l_returnflag)
SELECT l_returnflag, n, total - n AS dropped, {big('df')} AS df, {r('SQRT(sigma2)')} AS sigma,
       {r('1 - sigma2 * df / s22')} AS r2, {r('1 - sigma2 * (n - 1) / s22')} AS adj_r2,
       {r('(s22 - sigma2 * df) / 2 / sigma2')} AS f
FROM fit JOIN counts USING (l_returnflag)"""

DAY_TEN = f"""{RUNNING},
per_customer AS (SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey),
day_ten AS (
  SELECT running.*, c_acctbal / 1000 AS balance, n_orders, c_acctbal / 1000 * n_orders AS both_terms
  FROM running LEFT JOIN customer ON entity = c_custkey LEFT JOIN per_customer ON c_custkey = o_custkey
  WHERE day_100 = 10 AND total_metric > 500)"""

ORACLES["ols_interaction"] = f"""WITH {DAY_TEN},
rows_used AS (SELECT balance, CAST(n_orders AS DOUBLE) AS n_orders, both_terms, CAST(total_metric AS DOUBLE) AS y FROM day_ten),
{fitted(3, moments(['balance', 'n_orders', 'both_terms', 'y'], 'rows_used'))}
{coefficient_rows(['balance', 'n_orders', 'balance:n_orders'])}"""

ORACLES["ols_by_section"] = f"""WITH {RUNNING}, sections AS (
  SELECT 'day 10' AS section, CAST(total_metric AS DOUBLE) AS x, CAST(total_bad AS DOUBLE) AS y
  FROM running WHERE day_100 = 10 AND total_metric > 500
  UNION ALL
  SELECT 'as of', CAST(total_metric AS DOUBLE), CAST(total_bad AS DOUBLE)
  FROM running WHERE {AS_OF} AND day_100 <> 0 AND total_metric >= 2500),
{fitted(1, moments(['x', 'y'], 'sections', 'section'))}
{coefficient_rows(['total_metric'], 'section', 6)}"""

# Two-sided tail of Student's t: one minus the density integrated by Simpson's rule from -|t| to |t|.
T_STEPS = 4000
T_TAIL = f"""1 - 2 * (
  SELECT SUM((CASE WHEN i = 0 OR i = {T_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
             * POW(1 + POW(ABS(t) * i / {T_STEPS}.0, 2) / df, -(df + 1) / 2.0))
  FROM (SELECT UNNEST(RANGE(0, {T_STEPS} + 1)) AS i) AS steps
) * ABS(t) / {T_STEPS}.0 / 3 * EXP(LGAMMA((df + 1) / 2.0) - LGAMMA(df / 2.0)) / SQRT(df * PI())"""

ORACLES["ols_summary"] = f"""WITH {DAY_TEN},
rows_used AS (SELECT CAST(total_metric AS DOUBLE) AS x, CAST(total_bad AS DOUBLE) AS y FROM day_ten),
{fitted(1, moments(['x', 'y'], 'rows_used'))},
terms AS (
  SELECT '(intercept)' AS term, bi AS estimate, SQRT(sigma2 * vi) AS std_error, bi / SQRT(sigma2 * vi) AS t, * FROM fit
  UNION ALL
  SELECT 'total_metric', b0, SQRT(sigma2 * v0), b0 / SQRT(sigma2 * v0), * FROM fit),
tails AS (SELECT *, {T_TAIL} AS p FROM terms),
slope_tail AS (SELECT p AS f_p, t * t AS f FROM tails WHERE term = 'total_metric')
SELECT term, {', '.join(f'{r(c, 6)} AS {c}' for c in ('estimate', 'std_error', 't', 'p'))},
       {r('SQRT(sigma2)', 6)} AS sigma, {r('1 - sigma2 * df / s11', 6)} AS r2,
       {r('1 - sigma2 * (n - 1) / s11', 6)} AS adj_r2, {r('slope_tail.f', 6)} AS f, {r('slope_tail.f_p', 6)} AS f_p,
       n, CAST(0 AS BIGINT) AS dropped, {big('df')} AS df
FROM tails, slope_tail"""

ORACLES["ols_residuals"] = f"""WITH {fitted(1, moments(['l_quantity', 'l_extendedprice'], 'lineitem', 'l_returnflag'))},
residuals AS (
  SELECT l_returnflag, l_extendedprice - (bi + b0 * l_quantity) AS e FROM lineitem JOIN fit USING (l_returnflag))
SELECT l_returnflag, {r('MIN(e)')} AS min, {r('quantile_cont(e, 0.25)')} AS q1, {r('quantile_cont(e, 0.5)')} AS median,
       {r('quantile_cont(e, 0.75)')} AS q3, {r('MAX(e)')} AS max
FROM residuals GROUP BY l_returnflag"""

ORACLES["ols_rank_deficient"] = f"""WITH {fitted(1, moments(['l_quantity', 'l_extendedprice'], 'lineitem', 'l_linestatus'))}
{coefficient_rows(['l_quantity'], 'l_linestatus')}
UNION ALL SELECT l_linestatus, 'twice', CAST(2 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM fit"""

# --- clustering --------------------------------------------------------------------------------


def lloyd(ks, starts: int = 25, rounds: int = 25, seed: int = 123) -> str:
    """k-means written out: for every k and start the drawn points, then assignment and means by turns."""
    xs = list(FEATURES)
    distance = " + ".join(f"POW(p.{x} - c.{x}, 2)" for x in xs)
    ctes = [
        SCALED,
        "points AS MATERIALIZED (SELECT * FROM scaled)",
        f"""drawn AS MATERIALIZED (
  SELECT s, {', '.join(xs)}, ROW_NUMBER() OVER (PARTITION BY s ORDER BY MIN(md5('{seed}:' || s || ':' || entity))) AS c
  FROM points, (SELECT UNNEST(RANGE(1, {starts + 1})) AS s) AS starts GROUP BY s, {', '.join(xs)})""",
        f"""centres_0 AS MATERIALIZED (
  SELECT k, s, c, {', '.join(xs)} FROM drawn, (SELECT UNNEST([{', '.join(map(str, ks))}]) AS k) AS ks WHERE c <= k)""",
    ]
    for i in range(1, rounds + 2):
        ctes.append(f"""assigned_{i} AS MATERIALIZED (
  SELECT entity, k, s, MIN(d) AS d, ARG_MIN(c, d) AS c FROM (
    SELECT p.entity, c.k, c.s, c.c, {distance} AS d FROM points AS p, centres_{i - 1} AS c) AS measured
  GROUP BY entity, k, s)""")
        if i <= rounds:
            means = ", ".join(f"COALESCE(new.{x}, old.{x}) AS {x}" for x in xs)
            ctes.append(f"""centres_{i} AS MATERIALIZED (
  SELECT old.k, old.s, old.c, {means} FROM centres_{i - 1} AS old LEFT JOIN (
    SELECT k, s, c, {', '.join(f'AVG({x}) AS {x}' for x in xs)} FROM assigned_{i} JOIN points USING (entity)
    GROUP BY k, s, c) AS new USING (k, s, c))""")
    last = f"assigned_{rounds + 1}"
    ctes.append(f"costs AS (SELECT k, s, SUM(d) AS wss FROM {last} GROUP BY k, s)")
    ctes.append("""best AS (
  SELECT k, s, wss FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY ROUND(wss, 6), s) AS place FROM costs) AS ranked
  WHERE place = 1)""")
    return ",\n".join(ctes)


ORACLES["kmeans_fit"] = f"""WITH {lloyd([4])}
SELECT {big('k')} AS k, ROW_NUMBER() OVER (ORDER BY total, bad, span) AS cluster, size, {r('withinss')} AS withinss,
       {r('total')} AS total, {r('bad')} AS bad, {r('span')} AS span
FROM best JOIN (SELECT k, s, c, COUNT(*) AS size, SUM(d) AS withinss FROM assigned_26 GROUP BY k, s, c) AS parts USING (k, s)
JOIN centres_25 USING (k, s, c)"""

ORACLES["elbow_table"] = f"WITH {lloyd(range(2, 10))} SELECT {big('k')} AS k, {r('wss')} AS wss FROM best"

#: The four clusters of the label queries: k-means on the scaled features, numbered by centre.
FOUR = f"""{lloyd([4], starts=5)},
four AS MATERIALIZED (
  SELECT k, s, c, {', '.join(FEATURES)}, ROW_NUMBER() OVER (ORDER BY {', '.join(FEATURES)}) AS cluster
  FROM centres_25 JOIN best USING (k, s)),
labels AS MATERIALIZED (SELECT entity, four.cluster FROM assigned_26 JOIN four USING (k, s, c)),
labelled AS MATERIALIZED (SELECT features.*, cluster FROM features JOIN labels USING (entity))"""

ORACLES["kmeans_assign"] = f"WITH {FOUR} SELECT entity, {big('cluster')} AS cluster FROM labels"

ORACLES["pairwise_distance"] = f"""WITH {FOUR}
SELECT entity, {big('c.cluster')} AS cluster, {r('SQRT(' + ' + '.join(f'POW(p.{x} - c.{x}, 2)' for x in FEATURES) + ')')} AS distance
FROM points AS p, four AS c"""

ORACLES["cluster_wss"] = f"""WITH {FOUR}
SELECT {big('cluster')} AS cluster, COUNT(*) AS size,
       {r(' + '.join(f'VAR_POP({x}) * COUNT(*)' for x in FEATURES))} AS withinss
FROM labelled GROUP BY cluster"""

ORACLES["cluster_join"] = f"""WITH {FOUR}
SELECT entity, {r('total')} AS total, {big('cluster')} AS cluster FROM labelled WHERE total < 4000"""

ORACLES["cluster_split"] = f"""WITH {FOUR}
SELECT entity, {r('total')} AS total, {r('bad')} AS bad FROM labelled WHERE cluster = 2"""

ORACLES["cluster_profile"] = f"""WITH {FOUR}
SELECT {big('cluster')} AS cluster, 'propagate' AS nulls, COUNT(*) AS rows,
       {', '.join(f"{r(f'CASE WHEN COUNT({m}) = COUNT(*) THEN AVG({m}) END', 6)} AS mean_{m}" for m in MEASURES)}
FROM labelled GROUP BY cluster
UNION ALL
SELECT {big('cluster')}, 'skip', COUNT(*), {', '.join(f"{r(f'AVG({m})', 6)}" for m in MEASURES)}
FROM labelled GROUP BY cluster"""

ORACLES["outlier_table"] = f"""WITH {FEATURE_TABLE}
SELECT entity, {r('total')} AS total, CAST(NULL AS BIGINT) AS cluster FROM features WHERE total >= 4000"""


def _axes() -> str:
    """First two eigenvectors of the 3 x 3 correlation matrix by repeated multiplication."""
    x = FEATURES
    cells = ", ".join(f"CORR({x[i]}, {x[j]}) AS r{i}{j}" for i in range(3) for j in range(i + 1, 3))

    def times(v, shrink=""):
        rows = [f"{v}0 + r01 * {v}1 + r02 * {v}2", f"r01 * {v}0 + {v}1 + r12 * {v}2", f"r02 * {v}0 + r12 * {v}1 + {v}2"]
        return [f"({row}){shrink.format(i)}" for i, row in enumerate(rows)]

    def power(name, start, shrink, extra):
        y = times("v", shrink)
        norm = "SQRT(y0 * y0 + y1 * y1 + y2 * y2)"
        return f"""{name}(i, v0, v1, v2) AS (
  SELECT 0, {start} UNION ALL
  SELECT i + 1, y0 / {norm}, y1 / {norm}, y2 / {norm} FROM (
    SELECT i, {', '.join(f'{e} AS y{k}' for k, e in enumerate(y))} FROM {name}, m{extra} WHERE i < 3000) AS step)"""

    sign = "SIGN(CASE WHEN ROUND(ABS(v0), 9) >= ROUND(ABS(v1), 9) AND ROUND(ABS(v0), 9) >= ROUND(ABS(v2), 9) THEN v0 WHEN ROUND(ABS(v1), 9) >= ROUND(ABS(v2), 9) THEN v1 ELSE v2 END)"
    signed = ", ".join(f"v{k} * {sign} AS v{k}" for k in range(3))
    first = power("one", "6e-1, 5e-1, 4e-1", "", "")
    dot = "(a0 * v0 + a1 * v1 + a2 * v2)"
    shrink = f" - eigen * {dot} * a{{0}}"
    second = power("two", "3e-1, -7e-1, 5e-1", shrink, ", first_axis")
    top = times("v")
    return f"""m AS MATERIALIZED (SELECT {cells} FROM scaled),
{first},
first_axis AS MATERIALIZED (
  SELECT v0 AS a0, v1 AS a1, v2 AS a2, v0 * {top[0]} + v1 * {top[1]} + v2 * {top[2]} AS eigen
  FROM one, m WHERE i = 3000),
{second},
axis_one AS (SELECT {signed} FROM one WHERE i = 3000),
axis_two AS (SELECT {signed} FROM two WHERE i = 3000)"""


ORACLES["pca_projection"] = f"""WITH RECURSIVE {SCALED}, {_axes()}
SELECT entity, {r(' + '.join(f'a.v{i} * scaled.{x}' for i, x in enumerate(FEATURES)))} AS pc1,
       {r(' + '.join(f'b.v{i} * scaled.{x}' for i, x in enumerate(FEATURES)))} AS pc2,
       CAST({LABEL_B.replace('span', 'features.span')} AS BIGINT) AS cluster
FROM scaled JOIN features USING (entity), axis_one AS a, axis_two AS b"""

ORACLES["pca_two_columns"] = f"""WITH {SCALED} SELECT entity, {r('total')} AS pc1, {r('span')} AS pc2 FROM scaled"""



def distance(xs) -> str:
    return "SQRT(" + " + ".join(f"POW(a.{x} - b.{x}, 2)" for x in xs) + ")"


def density(eps: float, min_pts: int, tag: str = "", xs=FEATURES) -> str:
    """CTEs up to labelled{tag}(entity, cluster, is_core): components of core points, then borders."""
    return f"""near{tag} AS MATERIALIZED (SELECT a.entity AS a, b.entity AS b FROM points AS a, points AS b WHERE {distance(xs)} <= {eps}),
core{tag} AS MATERIALIZED (SELECT a AS entity FROM near{tag} GROUP BY a HAVING COUNT(*) >= {min_pts}),
links{tag} AS MATERIALIZED (
  SELECT a, b FROM near{tag} WHERE a IN (SELECT entity FROM core{tag}) AND b IN (SELECT entity FROM core{tag})),
reach{tag}(entity, root) AS (
  SELECT entity, entity FROM core{tag} UNION SELECT l.b, reach{tag}.root FROM reach{tag} JOIN links{tag} AS l ON reach{tag}.entity = l.a),
roots{tag} AS MATERIALIZED (SELECT entity, MIN(root) AS root FROM reach{tag} GROUP BY entity),
numbers{tag} AS (SELECT root, ROW_NUMBER() OVER (ORDER BY root) AS cluster FROM (SELECT DISTINCT root FROM roots{tag}) AS d),
border{tag} AS (
  SELECT a AS entity, MIN(root) AS root FROM near{tag} JOIN roots{tag} ON b = roots{tag}.entity
  WHERE a NOT IN (SELECT entity FROM core{tag}) GROUP BY a),
labelled{tag} AS (
  SELECT points.entity, COALESCE(n1.cluster, n2.cluster, 0) AS cluster, roots{tag}.root IS NOT NULL AS is_core
  FROM points LEFT JOIN roots{tag} ON points.entity = roots{tag}.entity LEFT JOIN numbers{tag} AS n1 ON roots{tag}.root = n1.root
  LEFT JOIN border{tag} ON points.entity = border{tag}.entity LEFT JOIN numbers{tag} AS n2 ON border{tag}.root = n2.root)"""


POINTS = f"{SCALED}, points AS MATERIALIZED (SELECT * FROM scaled)"

ORACLES["dbscan_fit"] = f"""WITH RECURSIVE {POINTS}, {density(0.5, 4)}
SELECT entity, {big('cluster')} AS cluster, is_core FROM labelled"""

ORACLES["dbscan_six"] = f"""WITH RECURSIVE {FEATURE_TABLE}, per_user AS (
  SELECT user_id AS entity, AVG(value) AS mean_value, MAX(value) AS top_value,
         CAST(COUNT(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS days FROM events GROUP BY user_id),
wide AS (SELECT * FROM features JOIN per_user USING (entity)),
points AS MATERIALIZED (
  SELECT entity, {', '.join(f'({x} - AVG({x}) OVER ()) / STDDEV_SAMP({x}) OVER () AS {x}' for x in SIX)} FROM wide),
{density(1.3, 4, xs=SIX)}
SELECT entity, {big('cluster')} AS cluster, is_core FROM labelled"""

EXACT_FEATURES = f"""{FEATURE_TABLE}, per_user AS (
  SELECT user_id AS entity, MAX(value) AS top_value, CAST(COUNT(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS days,
         CAST(COUNT(*) AS DOUBLE) AS moves FROM events GROUP BY user_id),
exact AS MATERIALIZED (SELECT entity, total / 64 AS total, bad, span, top_value, days, moves, long_span
  FROM features JOIN per_user USING (entity))"""

ORACLES["nearest_entities"] = f"""WITH {EXACT_FEATURES},
complete AS (SELECT * FROM exact WHERE {' AND '.join(f'{x} IS NOT NULL' for x in EXACT)}),
pairs AS (
  SELECT a.entity, b.entity AS neighbour, {' + '.join(f'(b.{x} - a.{x}) * (b.{x} - a.{x})' for x in EXACT)} AS d2
  FROM complete AS a JOIN complete AS b ON a.entity <> b.entity),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY d2, neighbour) AS rank FROM pairs)
SELECT entity, {big('rank')} AS rank, neighbour, {r('SQRT(d2)')} AS distance FROM ranked WHERE rank <= 5"""

MISSING = ("total", "bad", "span", "long_span")
ORACLES["partners_with_missing"] = f"""WITH {EXACT_FEATURES},
holes AS MATERIALIZED (
  SELECT entity, CASE WHEN entity % 11 <> 3 THEN total END AS total, CASE WHEN entity % 7 <> 2 THEN bad END AS bad,
         CASE WHEN entity % 5 <> 1 THEN span END AS span, long_span FROM exact),
pairs AS (
  SELECT a.entity, b.entity AS other,
         {' + '.join(f'COALESCE((a.{x} - b.{x}) * (a.{x} - b.{x}), 0)' for x in MISSING)} AS squares,
         {' + '.join(f'CAST(a.{x} IS NOT NULL AND b.{x} IS NOT NULL AS INTEGER)' for x in MISSING)} AS common
  FROM holes AS a JOIN holes AS b ON a.entity <> b.entity),
measured AS (
  SELECT entity, other, SQRT(squares * CAST({len(MISSING)} AS DOUBLE) / common) AS distance FROM pairs WHERE common > 0),
counted AS (
  SELECT entity, COUNT(*) AS comparable, COUNT(*) FILTER (WHERE distance <= 3.0) AS near FROM measured GROUP BY entity),
first AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY distance, other) AS place
                 FROM measured WHERE distance <= 3.0) WHERE place = 1)
SELECT entity, {big(' + '.join(f'CAST(h.{x} IS NOT NULL AS INTEGER)' for x in MISSING))} AS present,
       COALESCE(comparable, 0) AS comparable, COALESCE(near, 0) AS near, f.other AS nearest, {r('f.distance')} AS distance
FROM holes AS h LEFT JOIN counted USING (entity) LEFT JOIN first AS f USING (entity)"""

GRID = [(0.5, 4), (0.8, 4), (0.5, 3)]
ORACLES["dbscan_sweep"] = f"""WITH RECURSIVE {POINTS}, {', '.join(density(e, m, f'_{i}') for i, (e, m) in enumerate(GRID))}
""" + " UNION ALL ".join(
    f"SELECT CAST({e} AS DOUBLE) AS eps, CAST({m} AS BIGINT) AS min_pts, {big('cluster')} AS cluster, COUNT(*) AS size, "
    f"COUNT(*) FILTER (WHERE is_core) AS cores FROM labelled_{i} GROUP BY cluster"
    for i, (e, m) in enumerate(GRID)
)

def greedy_ward(table: str) -> str:
    """CTEs up to merges(step, left_rep, right_rep, height, size), joining the closest pair each time."""
    xs = list(FEATURES)
    gap = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    means = ", ".join(f"SUM(w.{x} * w.size) / SUM(w.size) AS {x}" for x in xs)
    return f"""ward AS (
  SELECT 0 AS step, entity AS rep, CAST(1 AS DOUBLE) AS size, {', '.join(xs)},
         CAST(NULL AS BIGINT) AS right_rep, CAST(NULL AS DOUBLE) AS height
  FROM {table}
  UNION ALL
  SELECT MAX(w.step) + 1, CASE WHEN w.rep = best.r THEN best.l ELSE w.rep END, SUM(w.size), {means},
         MAX(CASE WHEN w.rep = best.r THEN best.r END), SQRT(MAX(CASE WHEN w.rep = best.r THEN best.h2 END))
  FROM ward AS w, (
    SELECT a.rep AS l, b.rep AS r, 2 * a.size * b.size / (a.size + b.size) * ({gap}) AS h2
    FROM ward AS a JOIN ward AS b ON a.rep < b.rep ORDER BY h2, l, r LIMIT 1) AS best
  GROUP BY CASE WHEN w.rep = best.r THEN best.l ELSE w.rep END),
merges AS MATERIALIZED (
  SELECT step, rep AS left_rep, right_rep, height, size FROM ward WHERE right_rep IS NOT NULL)"""


ORACLES["ward_merges"] = f"""WITH RECURSIVE {SCALED}, points AS MATERIALIZED (SELECT * FROM scaled), {greedy_ward('points')}
SELECT CAST(step AS BIGINT) AS step, left_rep AS left, right_rep AS right, {r('height')} AS height, {big('size')} AS size
FROM merges"""

#: The joins of Ward's tree of `points` as signed numbers: matrix(step, a, b, height, size).
MATRIX = f"""{greedy_ward('points')},
numbers AS (SELECT entity, ROW_NUMBER() OVER (ORDER BY entity) AS n FROM points),
joined AS (
  SELECT m.step, m.height, m.size,
         COALESCE((SELECT MAX(p.step) FROM merges AS p WHERE p.left_rep = m.left_rep AND p.step < m.step), -l.n) AS u,
         COALESCE((SELECT MAX(p.step) FROM merges AS p WHERE p.left_rep = m.right_rep), -r.n) AS v
  FROM merges AS m JOIN numbers AS l ON l.entity = m.left_rep JOIN numbers AS r ON r.entity = m.right_rep),
matrix AS MATERIALIZED (
  SELECT step, CASE WHEN u < 0 AND v < 0 THEN u ELSE LEAST(u, v) END AS a,
         CASE WHEN u < 0 AND v < 0 THEN v ELSE GREATEST(u, v) END AS b, height, size
  FROM joined)"""

ORACLES["ward_matrix"] = f"""WITH RECURSIVE {SCALED}, points AS MATERIALIZED (SELECT * FROM scaled), {MATRIX}
SELECT {big('step')} AS step, {big('a')} AS first, {big('b')} AS second, {r('height')} AS height, {big('size')} AS size
FROM matrix"""

ORACLES["ward_order"] = f"""WITH RECURSIVE {SCALED}, points AS MATERIALIZED (SELECT * FROM scaled), {MATRIX},
below AS MATERIALIZED (
  SELECT step, a AS child, 0 AS shift FROM matrix UNION ALL
  SELECT m.step, m.b, COALESCE(f.size, 1) FROM matrix AS m LEFT JOIN matrix AS f ON f.step = m.a),
walk(node, place) AS (
  SELECT MAX(step), CAST(1 AS BIGINT) FROM matrix UNION ALL
  SELECT below.child, CAST(walk.place + below.shift AS BIGINT) FROM walk JOIN below ON below.step = walk.node)
SELECT entity, {big('place')} AS place FROM walk JOIN numbers ON node = -n"""

#: Ward's tree of `points` cut at four: ward_labels(entity, cluster).
CUT = f"""{greedy_ward('points')},
kept AS MATERIALIZED (SELECT * FROM merges WHERE step <= (SELECT COUNT(*) - 4 FROM points)),
climb(entity, held) AS (
  SELECT entity, entity FROM points UNION ALL
  SELECT entity, left_rep FROM climb JOIN kept ON climb.held = kept.right_rep),
roots AS (SELECT entity, MIN(held) AS root FROM climb GROUP BY entity),
ward_labels AS MATERIALIZED (SELECT entity, DENSE_RANK() OVER (ORDER BY root) AS cluster FROM roots)"""

ORACLES["ward_cut"] = f"""WITH RECURSIVE {SCALED}, points AS MATERIALIZED (SELECT * FROM scaled), {CUT}
SELECT entity, cluster FROM ward_labels"""

ORACLES["ward_elbow"] = f"""WITH RECURSIVE {FEATURE_TABLE}, points AS MATERIALIZED (SELECT entity, {', '.join(FEATURES)} FROM features),
{greedy_ward('points')},
ranked AS (SELECT height * height / 2 AS part, ROW_NUMBER() OVER (ORDER BY height DESC) AS place FROM merges)
SELECT k, {r('SUM(CASE WHEN place >= k THEN part ELSE 0 END)')} AS wss
FROM (SELECT UNNEST(RANGE(1, 11)) AS k) AS ks, ranked GROUP BY k"""


# --- comparison of labels ----------------------------------------------------------------------

BOTH = f"""{FOUR}, {CUT},
both_labels AS MATERIALIZED (
  SELECT labelled.*, labelled.cluster AS label_a, ward_labels.cluster AS label_b
  FROM labelled JOIN ward_labels USING (entity) WHERE total < 4000)"""

ORACLES["cluster_compare"] = f"""WITH RECURSIVE {BOTH}
SELECT entity, {', '.join(f'{r(f)} AS {f}' for f in FEATURES)}, {big('label_a')} AS label_a, {big('label_b')} AS label_b
FROM both_labels"""

ORACLES["cluster_crosstab"] = f"""WITH RECURSIVE {BOTH}
SELECT {big('label_a')} AS label_a, {big('label_b')} AS label_b, COUNT(*) AS rows FROM both_labels GROUP BY label_a, label_b"""

ORACLES["cluster_best_match"] = f"""WITH RECURSIVE {BOTH},
matched AS (SELECT label_b, label_a, ROW_NUMBER() OVER (PARTITION BY label_b ORDER BY COUNT(*) DESC, label_a) AS place
  FROM both_labels GROUP BY label_b, label_a)
SELECT entity, CAST(b.label_a AS VARCHAR) AS label_a, CAST(m.label_a AS VARCHAR) AS label_b
FROM both_labels AS b JOIN matched AS m ON b.label_b = m.label_b AND place = 1"""

ORACLES["cluster_assignment"] = f"""WITH RECURSIVE {BOTH},
shared AS (SELECT label_b, label_a, COUNT(*) AS n FROM both_labels GROUP BY label_b, label_a),
names AS (SELECT unnest([1, 2, 3, 4]) AS l),
orders AS (SELECT a.l AS p1, b.l AS p2, c.l AS p3, d.l AS p4 FROM names a, names b, names c, names d
  WHERE a.l NOT IN (b.l, c.l, d.l) AND b.l NOT IN (c.l, d.l) AND c.l <> d.l),
places AS (SELECT *, unnest([1, 2, 3, 4]) AS label_b, unnest([p1, p2, p3, p4]) AS label_a FROM orders),
totals AS (SELECT p1, p2, p3, p4, SUM(COALESCE(n, 0)) AS total FROM places LEFT JOIN shared USING (label_b, label_a) GROUP BY p1, p2, p3, p4),
chosen AS (SELECT [p1, p2, p3, p4] AS names FROM totals ORDER BY total DESC, p1, p2, p3, p4 LIMIT 1)
SELECT entity, CAST(label_a AS VARCHAR) AS label_a, CAST(c.names[label_b] AS VARCHAR) AS label_b FROM both_labels, chosen AS c"""

ORACLES["relabel_map"] = f"""WITH RECURSIVE {BOTH}
SELECT entity, CASE label_b WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 4 THEN '3' WHEN 3 THEN '1' END AS label_b FROM both_labels"""
