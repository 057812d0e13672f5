"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of a binary trie. The join goes down from pairs of nodes, adds up the
bits in which they differ, and drops a pair once the error budget is spent.

The tops of the tries are dealt out by Spark, without any error: of budget + 1 pieces of the 64
bits at least one is the same in two linked fingerprints, so each piece in turn leads a trie, and
prints that agree in it form one group. A fingerprint is copied budget + 1 times, whatever the
table's size; of the leading piece only as many bits are looked at as the table's size asks for.
Where all of them leave the groups too large, tries are led by two pieces
of budget + 2, or by three of budget + 3. Crowded groups are cut into blocks that are joined pair by
pair, so that a group is bounded whatever the data. A group returns a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import releasing
from panelwright.operators.graph import components
from panelwright.session import materialise, materialise_counted

BITS = 64
CELL = 4096  # fingerprints of a block
MOST_LEADING = 3  # pieces that lead a trie
FRONTIER = 1 << 17  # node pairs in work at once
LEAF = 16  # node pairs with so few member pairs are compared directly
COUNTS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.lower().split()  # both treat ASCII only: A-Z, and x20 x09-x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if shingle == 4 and n > 1:
        joined = map(b" ".join, zip(words, words[1:], words[2:], words[3:]))
    else:
        joined = (b" ".join(words[i : i + shingle]) for i in range(n))
    hashes = np.fromiter((digest(s, 42) for s in joined), dtype="<u8", count=n)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ COUNTS for i in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer; a null text has no words."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signed(fingerprint(t.encode("utf-8"), shingle)) if isinstance(t, str) else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array(found, dtype=np.int64)})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


class Forest:
    """Disjoint sets over positions, joined many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> bool:
        root, changed = self.root, False
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                self.root = root
                return changed
            a, b, x, y, changed = a[apart], b[apart], x[apart], y[apart], True
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def trie_join(left: np.ndarray, right: np.ndarray | None, depth: int, whole: int) -> np.ndarray:
    """Links within `whole` bits as a forest: root position of each of the sorted values.

    Values of left (and right, behind them) are sorted; all of them share their first depth bits.
    right None joins left with itself. Pairs of nodes that already hang together as one component
    are dropped.
    """
    values = left if right is None else np.concatenate([left, right])
    forest = Forest(len(values))
    n = len(left)
    begin = (0, n, 0, n) if right is None else (0, n, n, len(values))
    if begin[1] == begin[0] or begin[3] == begin[2]:
        return forest.root
    stack = [(depth, np.array([begin], dtype=np.int64), np.array([0]))]
    steps = _steps(forest.root)
    while stack:
        level, nodes, errors = stack.pop()
        if len(nodes) > FRONTIER:  # the part with fewer errors comes first
            stack.append((level, nodes[:-FRONTIER], errors[:-FRONTIER]))
            nodes, errors = nodes[-FRONTIER:], errors[-FRONTIER:]
        a0, a1, b0, b1 = nodes.T
        same = (steps[a1 - 1] == steps[a0]) & (steps[b1 - 1] == steps[b0]) & (forest.root[a0] == forest.root[b0])
        nodes, errors = nodes[~same], errors[~same]
        if not len(nodes):
            continue
        a0, a1, b0, b1 = nodes.T
        sure = errors + (BITS - level) <= whole  # whatever the rest is, they are linked
        few = (a1 - a0) * (b1 - b0) <= LEAF
        ends = sure | few
        if ends.any():
            i, j = _members(nodes[ends])
            near = differing(values[i], values[j]) <= whole
            if forest.join(i[near], j[near]):
                steps = _steps(forest.root)
        nodes, errors = nodes[~ends], errors[~ends]
        if len(nodes):
            stack.append((level + 1, *_children(values, nodes, errors, level, whole)))
    return forest.root


def _steps(root: np.ndarray) -> np.ndarray:
    """Numbers that differ between two places if the component changes between them."""
    return np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])


def _members(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All member pairs of node pairs, which are few for each."""
    a0, a1, b0, b1 = nodes.T
    wide = b1 - b0
    sizes = (a1 - a0) * wide
    which = np.repeat(np.arange(len(nodes)), sizes)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a0[which] + nth // wide[which], b0[which] + nth % wide[which]


def _children(values: np.ndarray, nodes: np.ndarray, errors: np.ndarray, level: int, budget: int) -> tuple:
    """Pairs of children and their errors: first those that differ in this bit, last those that agree."""
    a0, a1, b0, b1 = nodes.T
    am, bm = _split(values, a0, a1, level), _split(values, b0, b1, level)
    pairs, costs = [], []
    self_pair = a0 == b0
    more = errors + 1 <= budget
    for x0, x1, y0, y1, keep, cost in (
        (a0, am, bm, b1, more, 1),
        (am, a1, b0, bm, more & ~self_pair, 1),
        (am, a1, bm, b1, errors <= budget, 0),
        (a0, am, b0, bm, errors <= budget, 0),
    ):
        keep = keep & (x1 > x0) & (y1 > y0)
        keep &= ~((x0 == y0) & (x1 - x0 == 1) & (y1 - y0 == 1))
        pairs.append(np.stack([x0[keep], x1[keep], y0[keep], y1[keep]], axis=1))
        costs.append(errors[keep] + cost)
    return np.concatenate(pairs), np.concatenate(costs)


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """First place in each sorted range whose bit at this level is set, by halving."""
    bit = np.uint64(1 << (BITS - 1 - level))
    low, high = low.copy(), high.copy()
    while (busy := low < high).any():
        middle = (low + high) >> 1
        is_set = (values[np.minimum(middle, len(values) - 1)] & bit) != 0
        high = np.where(busy & is_set, middle, high)
        low = np.where(busy & ~is_set, middle + 1, low)
    return low


def pieces(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of so many pieces of nearly equal width."""
    ends = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def tries(budget: int, count: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The pieces in the order of each trie, the leading ones first, and how many lead.

    As few lead as leave half a block to a group of evenly spread fingerprints.
    """
    for leading in range(1, MOST_LEADING + 1):
        parts = pieces(budget + leading)
        chosen = list(combinations(parts, leading))
        if count <= CELL // 2 << min(sum(width for _, width in c) for c in chosen):
            break
    return [[*c, *(p for p in parts if p not in c)] for c in chosen], leading


def gathered(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Values with their pieces moved into another order, the first one on top."""
    out = np.zeros_like(values)
    for low, width in order:
        piece = values >> np.uint64(low) & np.uint64((1 << width) - 1)
        out = out << np.uint64(width) | piece if width < BITS else piece
    return out


def links(prints: DataFrame, budget: int, count: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that join all within the budget, in some forest."""
    orders, leading = tries(budget, count)
    needed = (max(count, 1) // (CELL // 2)).bit_length()  # bits of a cell that leave half a block to it
    depths = [min(needed, sum(width for _, width in order[:leading])) for order in orders]
    heads = []
    for number, order in enumerate(orders):
        cell = F.lit(0).cast("long")
        for low, width in order[:leading]:
            piece = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1) if width < BITS else F.col("fp")
            cell = F.shiftleft(cell, width).bitwiseOR(piece) if width < BITS else piece
        cell = F.shiftrightunsigned(cell, sum(width for _, width in order[:leading]) - depths[number])
        heads.append(F.struct(F.lit(number).alias("trie"), cell.alias("cell")))
    rows = prints.select("fp", F.inline(F.array(*heads)))
    sizes = rows.groupBy("trie", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
    sizes = materialise(sizes.filter("blocks > 1"), "crowded-cells")
    own = rows.join(sizes, ["trie", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its cell; with itself alone in a cell of one block.
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("trie", "cell", "fp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") <= F.col("other")).alias("is_low"))

    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        trie, flag = int(batch["trie"].iloc[0]), batch["is_low"].to_numpy()
        prints = batch["fp"].to_numpy().view(np.uint64)
        values = gathered(prints, orders[trie])
        if batch["low"].iloc[0] == batch["high"].iloc[0]:
            sides = [np.argsort(values)]
        else:
            sides = [np.flatnonzero(flag), np.flatnonzero(~flag)]
            sides = [side[np.argsort(values[side])] for side in sides]
        root = trie_join(values[sides[0]], values[sides[1]] if len(sides) > 1 else None, depths[trie], budget)
        both = prints[np.concatenate(sides)]
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": both[moved].view(np.int64), "b": both[root[moved]].view(np.int64)})

    return met.groupBy("trie", "cell", "low", "high").applyInPandas(walk, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int, budget: int) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id that links reach.

    A text that is null, empty or blank has fingerprint 0 and links like any other. Rows with a
    null doc_id take part in links; a component of only such rows has a null component_id.
    Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    rows = materialise(fingerprints(documents, shingle), "fingerprints")
    distinct, count = materialise_counted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(distinct.select(F.col("fp").alias("node")), links(distinct.select("fp"), budget, count))
    found = materialise(found.select(F.col("node").alias("fp"), "root").join(distinct, "fp"), "roots")
    lowest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = found.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left")


def keep_one(documents: DataFrame, shingle: int, budget: int) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns.

    Rows without doc_id stay, as no other row can stand for them by name. Rows that share a kept
    doc_id are repeated rows: one of them stays.
    """
    found = near_duplicates(documents, shingle, budget).filter(F.col("doc_id").isNotNull())
    kept = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("__n"))
    odd = materialise(kept.filter("__n <> 1"), "dropped")  # few rows beside those that stay
    single = documents.join(odd.select("doc_id"), "doc_id", "left_anti").select(*documents.columns)
    many = odd.filter("__n > 1").select("doc_id")
    if many.isEmpty():
        return single
    repeated = documents.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated.select(*documents.columns))
