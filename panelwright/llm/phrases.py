"""Phrase collocations, mined after Toivonen.

A phrase is frequent if its words stand in a row within pieces of text at least `least` times; every
part of a frequent phrase is frequent. A sample of the documents, mined level by level at a lowered
bound, proposes phrases. One pass over all documents counts the proposed phrases and their negative
border, that is, every phrase that is not proposed although both its parts without the last and
without the first word are. If the border holds frequent phrases (failures), an expansion pass
counts, of the phrases not counted yet, those whose parts are each frequent or not counted either.
That closes the search: all parts of a frequent phrase are frequent, so one that is still not
counted passes this test. Every phrase counted anew holds a failure, so there are few.

The sample is mined by the same passes from no proposal at all: words, then pairs of them as the
border of the words, then the expansion.

Proposals are known to the tasks through a Bloom filter of a fixed number of bits, the only thing
that is broadcast. A phrase that it takes for proposed by mistake is counted needlessly; no count
and no decision rests on it. As a pass knows the filter of the pass before, it leaves out exactly
what was counted then. The border is never listed: a phrase of the text is in it by its parts.

Counted phrases leave a task in blocks, one for each bucket of a fixed number, so that blocks grow with
the texts and not with the product of the tasks on both sides; in a block phrases that differ in their
last word share one line, and blocks meet again by bucket. A bucket is told by a phrase's hash, the
phrases of one beginning falling into several, so none is hot; past the shuffle Spark takes the blocks
apart and adds up each phrase by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import packed
from panelwright.session import materialise, materialise_counted

LONGEST = 5  # words of a phrase
SHARE = 8  # one document in so many is in the sample
LOWERED = 0.5  # bound in the sample, as a part of the one that is expected there
FILTER_BITS = 1 << 26
PROBES = 3
CHUNK_BYTES = 6 << 20  # texts whose phrases are counted together before they leave a task
BATCH_ROWS = 1 << 15  # counted phrases that are spelled out together, but for the rest of a block
BUCKETS = 1 << 10  # at most so many blocks for each size of phrases of a chunk, however many tasks there are
APART = 8  # buckets over which phrases that differ in their last word are spread
UNKNOWN = "und"

# Signs that end a piece, and those that part words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
END = b"."  # stands for all of them, as no word can hold it
LOWERING = bytes(
    END[0] if c in ENDS else ord(" ") if c in BLANKS else c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256)
)
MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words in lower case, with END for each end of a piece and of a text."""
    line = END.join([*texts, b""]).translate(LOWERING)
    return line.replace(END, b" . ").split()


class Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Line:
    """Texts of one language in a row, as the numbers of their words; 0 is END."""

    def __init__(self) -> None:
        self.numbers, self.parts = Numbers({END: 0}), []

    def add(self, text: bytes) -> None:
        words = tokens([text])
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))


def word_hashes(language: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(language.encode("utf-8"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def longer_hash(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return (hashes ^ hashes >> np.uint64(29)) * MIX + word


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each hash in a filter whose size is a power of two."""
    mixed = (hashes ^ hashes >> np.uint64(32)) * SPREAD
    step = mixed >> np.uint64(32) | np.uint64(1)
    return [(mixed + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)]


def holds(words64: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter (64 bits to a number) holds each hash, or takes it for one it holds."""
    found = np.ones(len(hashes), dtype=bool)
    for place in probes(hashes, 64 * len(words64)):
        found &= (words64[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def phrase_hashes(languages: list[str], phrases: list[str]) -> np.ndarray:
    out = np.zeros(len(phrases), dtype=np.uint64)
    for i, (language, phrase) in enumerate(zip(languages, phrases)):
        one = word_hashes(language, phrase.encode("utf-8").split(b" "))
        value = one[:1]
        for k in range(1, len(one)):
            value = longer_hash(value, one[k : k + 1])
        out[i] = value[0]
    return out


class Counter:
    """Counts phrases in a line of one language.

    `known` is the filter of proposed or frequent phrases, `before` that of the pass before (None for
    a first pass). `hopeful` takes phrases that were not counted yet for frequent ones.
    """

    def __init__(self, language: str, known: np.ndarray, before: np.ndarray | None, hopeful: bool, buckets: int) -> None:
        self.language, self.known, self.before, self.hopeful, self.buckets = language, known, before, hopeful, buckets

    def count(self, line: Line) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(buckets, blocks) for words, their number, and phrases of all sizes up to LONGEST."""
        ids = np.concatenate([*line.parts, np.zeros(1, dtype=np.int32)])
        words = list(line.numbers)
        spelled = np.array(words, dtype=object)
        single = word_hashes(self.language, words)
        allowed = ids > 0  # places whose phrase of the present size may be frequent
        if self.before is None:
            counts = np.bincount(ids, minlength=len(words))[1:]
            first = np.arange(1, len(words))
            yield from self._blocks(spelled, first[:, None], single[1:], np.zeros(len(first), dtype=np.uint64), counts)
            yield np.zeros(1, dtype=np.int64), [b",;%d" % counts.sum()]
        counted = allowed if self.before is not None else np.zeros_like(allowed)
        hashes = single[ids]
        member = holds(self.known, single)[ids]
        old = counted & holds(self.before, single)[ids] if self.before is not None else counted
        for size in range(2, LONGEST + 1):
            likely = counted & member | allowed & ~counted if self.hopeful else allowed & member
            allowed, counted = _both(likely), _both(old)
            place = np.flatnonzero(allowed | counted)
            if not len(place):
                return
            at = np.flatnonzero(allowed & ~counted)
            starts = hashes[at]
            hashes[place] = longer_hash(hashes[place], single[ids[place + size - 1]])
            if len(at):
                key, _ = packed([ids[at + d].astype(np.int64) for d in range(size)], len(words))
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                starts, first = starts[first], at[first]
                del key, at
                rows = ids[first[:, None] + np.arange(size)]
                yield from self._blocks(spelled, rows, starts, single[rows[:, -1]], counts)
                del rows, first, starts
            member = np.zeros_like(allowed)
            member[place] = holds(self.known, hashes[place])
            if self.before is not None:
                old = np.zeros_like(allowed)
                at = np.flatnonzero(counted)
                old[at] = holds(self.before, hashes[at])


    def _blocks(self, spelled: np.ndarray, rows: np.ndarray, starts: np.ndarray, lasts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Blocks of phrases, given in order as numbers of their words and hashes of beginning and last word.

        A block has a line for each beginning: its words, then each last word, with its count unless
        that is 1. Commas, semicolons and line feeds part these, as no word can hold one.
        """
        buckets = ((starts >> np.uint64(20)) + (lasts >> np.uint64(20)) % np.uint64(APART)) % np.uint64(self.buckets)
        order = np.argsort(buckets.astype(np.uint16), kind="stable")
        buckets = buckets[order].astype(np.int64)
        ends = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1  # past each block
        low = 0
        while low < len(order):
            high = ends[np.searchsorted(ends, min(low + BATCH_ROWS, len(order)))]
            own = order[low:high]
            items = spelled[rows[own, -1]].tolist()
            for i in np.flatnonzero(counts[own] > 1).tolist():
                items[i] += b";%d" % counts[own[i]]
            bounds = ends[(ends > low) & (ends <= high)] - low
            opens = np.concatenate([[0], bounds[:-1]])
            heads = np.ones(len(own), dtype=bool)
            heads[1:] = (rows[own[1:], :-1] != rows[own[:-1], :-1]).any(axis=1)
            heads[opens] = True
            heads = np.flatnonzero(heads)
            for i, begin in zip(heads.tolist(), spelled[rows[own[heads], :-1]].tolist()):
                items[i] = b"\n" + b" ".join(begin) + b"," + items[i]
            yield buckets[low + opens], [b",".join(items[a:b])[1:] for a, b in zip(opens.tolist(), bounds.tolist())]
            low = high


def _both(here: np.ndarray) -> np.ndarray:
    """Places that hold, as do the places a word later."""
    grown = np.zeros_like(here)
    grown[:-1] = here[:-1] & here[1:]
    return grown


BLOCK_ROWS = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("block", pa.string())])


def _rows(counter: Counter, line: Line) -> Iterator[pa.RecordBatch]:
    for buckets, blocks in counter.count(line):
        names = pa.array([counter.language]).take(pa.array(np.zeros(len(blocks), dtype=np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), names, pa.array(blocks, pa.binary()).cast(pa.string())], schema=BLOCK_ROWS)


def added_up(blocks: DataFrame, tasks: int) -> DataFrame:
    """(lang, phrase, a) of all blocks. The number of tasks is fixed, as blocks are small for the rows in them."""
    lines = blocks.repartition(tasks, "bucket").select("bucket", "lang", F.explode(F.split("block", ",\n")).alias("line"))
    lines = lines.select("bucket", "lang", F.split("line", ",").alias("items"))
    begin = F.col("items")[0]
    lines = lines.select("bucket", "lang", begin.alias("begin"), F.explode(F.slice("items", 2, F.size("items") - 1)).alias("item"))
    last = F.substring_index("item", ";", 1)
    phrase = F.when(F.col("begin") == "", last).otherwise(F.concat_ws(" ", "begin", last))
    a = F.when(F.contains("item", F.lit(";")), F.substring_index("item", ";", -1).cast("long")).otherwise(F.lit(1).cast("long"))
    return lines.select("bucket", "lang", phrase.alias("phrase"), a.alias("a")).groupBy("bucket", "lang", "phrase").agg(F.sum("a").alias("a"))


def sent(texts: DataFrame, held: np.ndarray) -> Broadcast:
    """A filter for the tasks, FILTER_BITS at most and far less while it holds few phrases."""
    return texts.sparkSession.sparkContext.broadcast(zlib.compress(held.tobytes(), 1))


def received(held: Broadcast) -> np.ndarray:
    return np.frombuffer(zlib.decompress(held.value), dtype=np.uint64)


def count_pass(texts: DataFrame, known: Broadcast, before: Broadcast | None, hopeful: bool, least: int) -> DataFrame:
    """(lang, size, phrase, a): exact counts of the phrases of one pass, from `least` on."""
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    tasks, buckets = min(tasks, BUCKETS), BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = received(known), None if before is None else received(before)
        lines: dict[str, Line] = {}
        held = 0
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                lines.setdefault(language, Line()).add(text)
                held += len(text) + 1
                if held >= CHUNK_BYTES:
                    while lines:
                        name, line = lines.popitem()
                        yield from _rows(Counter(name, *filters, hopeful, buckets), line)
                    held = 0
        while lines:
            name, line = lines.popitem()
            yield from _rows(Counter(name, *filters, hopeful, buckets), line)

    blocks = texts.select("lang", "text").mapInArrow(run, "bucket int, lang string, block string")
    found = added_up(blocks, tasks).filter((F.col("a") >= least) | (F.col("phrase") == ""))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return found.select("lang", size.alias("size"), "phrase", "a")


def with_known(found: DataFrame, proposed: Broadcast) -> DataFrame:
    """Adds whether the filter held a phrase already; phrases of the greatest size need no place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received(proposed)
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            hashes = phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            known = holds(held, hashes) | (sizes == 0) | (sizes == LONGEST)
            yield batch.append_column("known", pa.array(known))

    return found.mapInArrow(run, "lang string, size int, phrase string, a long, known boolean")


def with_added(proposed: np.ndarray, failures: DataFrame) -> np.ndarray:
    """The filter with more phrases; only its own numbers, FILTER_BITS at most, reach the driver."""
    bits = 64 * len(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            hashes = phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            for place in probes(hashes, bits):
                np.bitwise_or.at(own, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        slots = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(own[slots].view(np.int64))], names=["slot", "bits"])

    rows = failures.select("lang", "phrase").mapInArrow(run, "slot long, bits long")
    merged = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    grown = proposed.copy()
    slots = merged.column("slot").to_numpy()
    grown[slots] |= merged.column("bits").to_numpy().view(np.uint64)
    return grown


def close(texts: DataFrame, proposed: np.ndarray, least: int, label: str, borders: int) -> tuple[np.ndarray, list[DataFrame]]:
    """All frequent phrases: a filter that holds them, and the tables of each pass.

    `borders` passes count what is proposed and its border, the frequent ones of which are proposed to
    the next; one expansion pass counts the rest, if there were failures at all.
    """
    before, now, tables, failures = None, sent(texts, proposed), [], 1
    while failures and len(tables) <= borders:
        found = count_pass(texts, now, before, len(tables) == borders, least)
        table, failures = materialise_counted(with_known(found, now), label, ~F.col("known"))
        tables.append(table)
        if before is not None:
            before.destroy()
        before = now
        if failures:
            proposed = with_added(proposed, table.filter("not known"))
            now = sent(texts, proposed)
    now.destroy()
    return proposed, tables


def frequent(documents: DataFrame, least: int, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, size, phrase, a): all phrases of up to five words that occur at least `least` times.

    Words are phrases of size 1, and size 0 holds the number of all word occurrences. A missing
    language is `und`; null or empty texts have no words. Copies count as often as they occur.
    """
    rows = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("doc_id", "text").alias("draw"),
    ).filter(F.col("text").isNotNull())
    texts = rows.select("lang", "text")
    sample = materialise(rows.filter(F.pmod("draw", F.lit(SHARE)) == 0).select("lang", "text"), "phrase-sample")
    nothing = np.zeros(bits // 64, dtype=np.uint64)
    proposed, _ = close(sample, nothing, max(1, round(LOWERED * least / SHARE)), "sampled-phrases", 2)
    _, tables = close(texts, proposed, least, "frequent-phrases", 1)
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.drop("known")


def collocations(documents: DataFrame, least: int, most: int) -> DataFrame:
    """The first `most` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase of two words or more is scored by floor(1000 * a * n / (l * r)) at the cut where that is
    lowest (then at the first), a, l and r being the counts of the phrase and of its two parts and n
    the number of words; one that is as frequent inside a longer one is left out. Order is by
    score, then a, both falling, then phrase. Numbers are exact decimals. A table without frequent
    phrases gives none; only doc_id, lang and text are read.
    """
    found = frequent(documents, least)
    known = found.filter("size > 0").select("lang", "size", "phrase", "a")
    candidates = known.filter("size > 1").withColumn("words", F.split("phrase", " "))
    longer = candidates.filter("size > 2").select("lang", "a", F.explode(F.array(_part(1, F.col("size") - 1), _part(2, F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (F.col("inside") < F.col("a")))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest")
    )
    for part, name in (("first", "l"), ("rest", "r")):
        counts = known.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
        cuts = cuts.join(counts, ["lang", part])
    totals = found.filter("size = 0").select("lang", F.col("a").alias("n"))  # one row a language
    cuts = cuts.join(totals, "lang")
    exact = {c: f"cast({c} AS decimal(18, 0))" for c in ("a", "l", "r", "n")}
    score = F.expr(f"cast({exact['a']} * {exact['n']} * 1000 AS decimal(38, 0)) div ({exact['l']} * {exact['r']})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _part(start, length):
    """Words of a phrase from a place counted from 1, joined again."""
    return F.array_join(F.slice("words", start, length), " ")
