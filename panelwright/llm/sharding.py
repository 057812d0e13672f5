"""Shards of near-equal bytes: best-fit-decreasing packing of indivisible groups.

Groups of equal texts must not be torn apart. Groups of equal size are interchangeable, and while a
bin that took one of them has room for another it stays the tightest, so best fit runs over (size,
number of groups) and places many groups in one step, with the very result of placing them one by
one. The driver holds one line per distinct size: of sizes that add up to B bytes there are at most
sqrt(2 B). Which group goes where follows from its number within its size.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import with_positions
from panelwright.operators.joins import left_join
from panelwright.session import materialise

HOT = 2500  # a group with at least one in so many rows is joined by broadcast: there are no more than that


class Bins:
    """Open bins in a treap ordered by (room, bin): the tightest bin that fits is a descent."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.draw = random.Random(7)

    def add(self, room: int, name: int) -> None:
        low, high = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(low, [(room, name), self.draw.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is at least size."""
        node, found = self.root, None
        while node:
            node, found = (node[2], node[0]) if node[0][0] >= size else (node[3], found)
        if found:
            low, high = self._split(self.root, found)
            _, high = self._split(high, (found[0], found[1] + 1))
            self.root = self._merge(low, high)
        return found

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple:
        """Nodes below the key, and the others."""
        if not node:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


def best_fit_classes(
    classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None
) -> list[tuple[int, int, int]] | None:
    """(size, bin, count) for classes (size, count), largest first, each item into the tightest bin with room.

    A bin is opened only if none fits; an item above the capacity has a bin of its own. None if
    more than `most` bins are needed.
    """
    bins, placed, opened = Bins(), [], 0
    for size, count in classes:
        while count:
            spot = bins.take(size)
            if spot is None:
                if opened == most:
                    return None
                spot, opened = (capacity, opened), opened + 1
            taken = min(count, max(1, spot[0] // size)) if size else count
            placed.append((size, spot[1], taken))
            count -= taken
            if spot[0] > taken * size:
                bins.add(spot[0] - taken * size, spot[1])
    return placed


def classes_into_shards(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(size, shard, count): the least capacity for which best fit needs no more than the shards.

    Items heavier than the mean of what is left have a shard each, as nothing can go with them
    without a heavier shard; the capacity is searched for the others.
    """
    classes = sorted(classes, reverse=True)
    placed, total, at, first = [], sum(size * count for size, count in classes), 0, 0
    while first < len(classes) and shards - at > 1 and classes[first][0] * (shards - at) >= total:
        size, count = classes[first]
        placed.append((size, at, 1))
        total -= size
        at += 1
        if count > 1:
            classes[first] = (size, count - 1)
        else:
            first += 1
    rest, left = classes[first:], shards - at
    if not rest:
        return placed
    low = max(rest[0][0], -(-total // left))
    high, found = low, None
    while (found := best_fit_classes(rest, high, left)) is None:
        high = high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_classes(rest, middle, left)
        if tried is None:
            low = middle + 1
        else:
            high, found = middle, tried
    return placed + [(size, at + b, count) for size, b, count in found]


def handed_out(items: Iterable[tuple[int, object]], placed: list[tuple[int, int, int]]) -> dict:
    """Item -> bin, where the items of a size take its places in their order."""
    places: dict[int, list[int]] = {}
    for size, b, count in placed:
        places.setdefault(size, []).extend([b] * count)
    spots = {size: iter(bins) for size, bins in places.items()}
    return {name: next(spots[size]) for size, name in items}


def best_fit(sizes: list[tuple[int, object]], capacity: int, most: int | None = None) -> dict | None:
    """Item -> bin for items (size, name), largest first; see best_fit_classes."""
    placed = best_fit_classes(Counter(size for size, _ in sizes).items(), capacity, most)
    return None if placed is None else handed_out(sizes, placed)


def into_shards(items: list[tuple[int, object]], shards: int) -> dict:
    """Item -> shard for items (size, name); see classes_into_shards."""
    placed = classes_into_shards(Counter(size for size, _ in items).items(), shards)
    return handed_out(sorted(items, key=lambda x: str(x[1])), placed)


def pack(rows: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """Add `shard`: rows with equal keys stay together, shards have near-equal sums of size.

    Every group meets best-fit decreasing, at any size of the table. The driver sees one line per
    distinct size of a group and partition that holds it. A group on a third of the rows is
    pre-aggregated where its rows lie, and joined by a table of at most HOT groups.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(F.col(key).alias("__key")).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("__bytes"), F.count(F.lit(1)).alias("__rows")
    )
    ordered = groups.repartitionByRange("__bytes", "__key").sortWithinPartitions("__bytes", "__key")
    ordered = materialise(
        ordered.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "groups"
    )
    sizes = ordered.groupBy("__bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    placed = classes_into_shards(zip(sizes.column("__bytes").to_pylist(), sizes.column("n").to_pylist()), shards)
    ends: dict[int, list[int]] = {}
    spots: dict[int, list[int]] = {}
    for weight, shard, count in placed:
        before = ends.setdefault(weight, [])
        before.append((before[-1] if before else 0) + count)
        spots.setdefault(weight, []).append(shard)
    schema = pa.schema([("weight", pa.int64()), ("__ends", pa.list_(pa.int64())), ("__spots", pa.list_(pa.int32()))])
    plan = pa.table([list(ends), list(ends.values()), [spots[w] for w in ends]], schema=schema)
    numbered = with_positions(ordered, ["__bytes"], "__number")
    numbered = left_join(numbered, spark.createDataFrame(plan), [("__bytes", "weight")])
    passed = F.size(F.filter("__ends", lambda end: end <= F.col("__number")))
    assigned = numbered.select("__key", "__rows", F.get("__spots", passed).alias("shard"))
    assigned = materialise(assigned, "assigned")
    total = assigned.agg(F.sum("__rows")).first()[0] or 0
    hot = F.col("__rows") * HOT >= total
    many = F.broadcast(assigned.filter(hot).drop("__rows"))  # at most HOT groups
    same = F.col(key).eqNullSafe(F.col("__key"))
    others = rows.join(many, same, "left_anti").join(assigned.filter(~hot).drop("__rows"), same)
    return rows.join(many, same).unionByName(others).drop("__key")


def shard_documents(documents: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row, law `bytes`.

    Equal texts, null with null, share a shard; slots follow doc_id, nulls first, and repeated
    rows have a slot each. A group above the mean shard has a shard to itself. With fewer groups
    than shards some shards stay empty. An empty table gives no rows; other columns are not read.
    """
    body = F.col("text")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(body, 256), F.lit("null")).alias("__text"),
    )
    rows = materialise(rows, "sizes")  # the texts are read once
    packed = pack(rows, "__text", "size", shards).drop("__text")
    placed = packed.repartitionByRange("shard", "doc_id").sortWithinPartitions("shard", "doc_id", "text_crc32", "size")
    placed = materialise(
        placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "slots"
    )
    numbered = with_positions(placed, ["shard"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
