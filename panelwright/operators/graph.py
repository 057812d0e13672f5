"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialise


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component as its root.

    Edges (a, b) are turned into stars around ever smaller nodes, by the large-star and
    small-star steps in turn, until nothing moves; this takes a number of rounds that grows with
    the logarithm of the graph. Minima are pre-aggregated, and each join meets one row per node
    and is followed by a shuffle on another key, so that Spark can split a hub's partition.
    """
    spark = nodes.sparkSession
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    links = materialise(links.distinct(), "links")
    while not _settled(links):
        links = spark.sql(
            """
            WITH ends AS (SELECT u AS x, v AS y FROM {links} UNION ALL SELECT v, u FROM {links}),
            low AS (SELECT x, least(min(y), x) AS low FROM ends GROUP BY x),
            large AS (SELECT ends.y AS u, low.low AS v FROM ends JOIN low ON ends.x = low.x WHERE ends.y > ends.x),
            lowest AS (SELECT u, min(v) AS low FROM large GROUP BY u),
            small AS (SELECT large.u, large.v, lowest.low FROM large JOIN lowest ON large.u = lowest.u)
            SELECT DISTINCT stack(2, u, low, v, low) AS (u, v) FROM small
            """,
            links=links,
        ).filter("u != v")
        links = materialise(links, "links")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("node").join(found, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link, to a node without a link of its own."""
    return links.sparkSession.sql(
        """
        SELECT u FROM {links} LEFT SEMI JOIN (SELECT v FROM {links}) AS roots ON u = roots.v
        UNION ALL
        SELECT u FROM {links} GROUP BY u HAVING count(*) > 1
        """,
        links=links,
    ).isEmpty()
