"""Exact top-k by inner product: term-at-a-time accumulation into dense score arrays.

Vectors are rows of integer weights. Candidates are packed into blocks without a shuffle, and
each block keeps a posting list per term (the rows where the weight is not zero). Query rows are
packed likewise. For a query block and a candidate block, the terms are taken one after another:
each query row that has the term scatters its weight times the postings into its score array.
The best k of each array are selected by partition and merged, first in the task, then over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 4096  # rows of a candidate block
QUERIES = 512  # rows of a query block
TILE = 32  # query rows whose score arrays are in work at once
DENSE = 4  # a term that at least one row in DENSE holds is added to all of them, zeros included
EXACT = 1 << 52  # sums below this are exact in double precision
PACKED = "block long, ids binary, dims int, weights binary, longs boolean"


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """False for a null vector or one with a null, NaN or infinite component."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size rows (id, w), rows sorted by id within a block; no shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, ids, vectors = 0, [], []
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids.extend(batch["id"])
            vectors.extend(batch["w"])
            while len(ids) >= size:
                yield _block(base + number, ids[:size], vectors[:size])
                number, ids, vectors = number + 1, ids[size:], vectors[size:]
        if ids:
            yield _block(base + number, ids, vectors)

    return rows.mapInPandas(pack, PACKED)


def _block(number: int, ids: list, vectors: list) -> pd.DataFrame:
    order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
    dims = max(len(v) for v in vectors)
    table = np.zeros((len(ids), dims), dtype=np.int64)
    for at, i in enumerate(order):
        table[at, : len(vectors[i])] = vectors[i]
    small = bool(dims == 0 or np.abs(table).max(initial=0) < 1 << 31)
    return pd.DataFrame(
        {
            "block": [number],
            "ids": [np.asarray(ids, dtype=np.int64)[order].tobytes()],
            "dims": [dims],
            "weights": [table.astype(np.int32 if small else np.int64).tobytes()],
            "longs": [not small],
        }
    )


def _unpacked(ids: bytes, dims: int, weights: bytes, longs: bool) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(ids, dtype=np.int64)
    return rows, np.frombuffer(weights, dtype=np.int64 if longs else np.int32).reshape(len(rows), dims).astype(np.int64)


def postings(table: np.ndarray, kind: type) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term the rows that hold it and their weights; None for all rows, where many hold it."""
    lists = []
    for column in table.T:
        rows = np.flatnonzero(column)
        many = len(rows) * DENSE >= len(column)
        lists.append((None, column.astype(kind)) if many else (rows, column[rows].astype(kind)))
    return lists


def scatter(queries: np.ndarray, lists: list, n: int, kind: type) -> np.ndarray:
    """Scores of a few query rows against the n rows of the postings, term by term."""
    scores, room = np.zeros((len(queries), n), dtype=kind), np.empty((len(queries), n), dtype=kind)
    for term in range(min(queries.shape[1], len(lists))):
        holders = np.flatnonzero(queries[:, term])
        rows, weights = lists[term]
        if not len(holders) or not len(weights):
            continue
        if rows is None and len(holders) * DENSE >= len(queries):
            scores += np.multiply(queries[:, term].astype(kind)[:, None], weights, out=room)
            continue
        added = queries[holders, term].astype(kind)[:, None] * weights
        if rows is None:
            scores[holders] += added
        else:
            scores[np.ix_(holders, rows)] += added
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k best (ids, scores), ties to the smaller id; ids ascend, own rows are left out."""
    found = []
    for row, me in zip(scores, own):
        low, high = np.searchsorted(ids, me, "left"), np.searchsorted(ids, me, "right")
        row, names = (np.delete(row, slice(low, high)), np.delete(ids, slice(low, high))) if high > low else (row, ids)
        if len(row) > k:
            kth = np.partition(row, len(row) - k)[len(row) - k]
            above, ties = np.flatnonzero(row > kth), np.flatnonzero(row == kth)
            keep = np.concatenate([above, ties[: k - len(above)]])  # ids ascend, so the first ties win
            row, names = row[keep], names[keep]
        found.append((names, row.astype(np.int64)))
    return found


def top_k(rows: DataFrame, is_query: Column, k: int, stripes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with other rows.

    rows holds id (long) and w (array of long); rows with a null in either take no part, shorter
    vectors count as padded with zeros, and a query is not compared with rows of its own id.
    Repeated ids are candidates once for each row; a repeated query row counts once. Fewer than k
    candidates give as many rows as there are. Sums beyond 64 bits raise an error.

    Every query block is copied to a fixed number of stripes, every candidate block lies in one,
    so candidates are never copied, nothing passes through the driver, and a vector repeated any
    number of times only fills blocks like any other rows. The join is named, as Spark's estimate of
    a table does not count the copies and would have the driver gather and broadcast them; its tasks
    are as many as stripes, since the work of a stripe is out of proportion to its bytes.
    """
    spark = rows.sparkSession
    stripes = stripes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("w").isNotNull())
    candidates = packed(rows, CANDIDATES).withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))
    asked = packed(rows.filter(is_query).dropDuplicates(["id"]), QUERIES).select(*[F.col(c).alias(f"q_{c}") for c in "block ids dims weights longs".split()])
    asked = asked.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("stripe", F.col("stripe").cast("long"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merged: dict[int, list] = {}
        held: dict[int, tuple] = {}
        for batch in batches:
            for pair in batch.itertuples(index=False):
                if pair.block not in held:
                    ids, table = _unpacked(pair.ids, pair.dims, pair.weights, pair.longs)
                    held = {pair.block: (ids, table, {})}
                ids, table, lists = held[pair.block]
                own, queries = _unpacked(pair.q_ids, pair.q_dims, pair.q_weights, pair.q_longs)
                most = float(np.abs(table).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, min(pair.dims, pair.q_dims))
                if most >= 2.0**63:
                    raise OverflowError("an inner product may not fit 64 bits")
                kind = np.float64 if most < EXACT else np.int64
                if kind not in lists:
                    lists[kind] = postings(table, kind)
                state = merged.setdefault(pair.q_block, [(own[i], None, None) for i in range(len(own))])
                for low in range(0, len(own), TILE):
                    scores = scatter(queries[low : low + TILE], lists[kind], len(ids), kind)
                    for i, (names, values) in enumerate(best(scores, ids, own[low : low + TILE], k), low):
                        _, old_names, old_values = state[i]
                        if old_names is not None:
                            names, values = np.concatenate([old_names, names]), np.concatenate([old_values, values])
                        first = np.lexsort((names, -values))[:k]
                        state[i] = (own[i], names[first], values[first])
        for state in merged.values():
            yield pd.DataFrame(
                {
                    "query_id": np.repeat([s[0] for s in state], [len(s[1]) for s in state]),
                    "vec_id": np.concatenate([s[1] for s in state]),
                    "score": np.concatenate([s[2] for s in state]),
                }
            )

    pairs = candidates.repartition(stripes, "stripe").join(asked.repartition(stripes, "stripe").hint("merge"), "stripe")
    found = pairs.drop("stripe").mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
