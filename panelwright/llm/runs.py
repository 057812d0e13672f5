"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q that is at least `exponent` periods and `least`
words long and that no neighbouring word extends. For each period q, a harmonic grid of places so
close that every run of that period holds one of them is tested: word x against word x + q, and
where they agree the extension to both sides gives the run. The grids of all periods together have
about n log n places.

An extension takes constant time. Suffixes are sorted only at places whose residue modulo 13 is in
a difference cover, by doubling along each residue's chain; two places reach synchronised samples
after less than 13 words, which are compared one by one, and from there a sparse table over the
common prefixes of neighbours in the sorted order answers.

Documents are worked on many at a time: their words are numbered and strung together with a unique
mark before, between and behind them, so that no extension leaves its document. A group of documents
holds at most CHUNK words, or is one document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import packed, ranks

# Every difference modulo 13 is one of two members of this set.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: SHIFTS[i % 13, (j - i) % 13] is the least step that brings i and j to members of the cover.
SHIFTS = np.array(
    [
        [next(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (i + gap + d) % MODULUS in COVER) for gap in range(MODULUS)]
        for i in range(MODULUS)
    ]
)
CHUNK = 1 << 18  # words of documents worked on together
PLACES = 1 << 21  # grid places in work at once
WORD = r"[^\x20\x09-\x0D]+"


class Extensions:
    """Longest common extensions to the right in an array of non-negative numbers.

    The last number must occur nowhere else.
    """

    def __init__(self, w: np.ndarray) -> None:
        n = len(w)
        self.w = w
        places = np.arange(n)
        self.sampled = places[np.isin(places % MODULUS, COVER)]
        m = len(self.sampled)
        self.index = np.full(n, -1)
        self.index[self.sampled] = np.arange(m)
        levels = self._levels(n, m)
        self.rank = levels[-1]
        order = np.empty(m, dtype=np.int64)
        order[self.rank] = np.arange(m)
        self.table = self._table(self._neighbours(levels, order))

    def _blocks(self) -> np.ndarray:
        """Ranks of the sampled places by the next 13 words."""
        padded = np.concatenate([self.w + 1, np.zeros(MODULUS, dtype=np.int64)])
        return ranks(packed([padded[self.sampled + d] for d in range(MODULUS)], int(padded.max()) + 1)[0])[0]

    def _levels(self, n: int, m: int) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by 13, 26, 52 ... words, until all differ."""
        levels, step = [self._blocks()], MODULUS
        while int(levels[-1].max()) + 1 < m:
            further = self.sampled + step
            behind = np.where(further < n, levels[-1][self.index[np.minimum(further, n - 1)]] + 1, 0)
            levels.append(ranks(levels[-1] * (m + 1) + behind)[0])
            step *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common words of each sampled suffix and the next one in sorted order."""
        a, b = self.sampled[order[:-1]].copy(), self.sampled[order[1:]].copy()
        begin = a.copy()
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][self.index[a]] == levels[k][self.index[b]]
            a[same] += MODULUS << k
            b[same] += MODULUS << k
        return a - begin + self._few(a, b, np.full(len(a), MODULUS))

    def _few(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common words, counted one by one up to `most`."""
        common = np.zeros(len(a), dtype=np.int64)
        alive = np.flatnonzero(most > 0)
        while len(alive):
            step = common[alive]
            alive = alive[self.w[a[alive] + step] == self.w[b[alive] + step]]
            common[alive] += 1
            alive = alive[common[alive] < most[alive]]
        return common

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        """Minima over ranges of 1, 2, 4 ... values."""
        table, width = [values], 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of common words from places a and b, which differ."""
        shift = SHIFTS[a % MODULUS, (b - a) % MODULUS]
        found = self._few(a, b, shift)
        on = np.flatnonzero(found == shift)
        x, y = self.rank[self.index[a[on] + shift[on]]], self.rank[self.index[b[on] + shift[on]]]
        low, width = np.minimum(x, y), np.abs(x - y)
        level = np.frexp(width.astype(np.float64))[1] - 1  # exact: widths are far below 2**53
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row, first = self.table[k], low[at]
            found[on[at]] += np.minimum(row[first], row[first + width[at] - (1 << int(k))])
        return found


def runs_of(documents: Sequence[np.ndarray], least: int, exponent: int) -> list[np.ndarray]:
    """Per document of word numbers its runs (start, length, period), by start and then by period."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # behind the mark before the document
    n = int(sizes.sum()) + len(documents) + 1
    marks = max((int(d.max()) for d in documents if len(d)), default=0) + 1
    w = np.empty(n, dtype=np.int64)
    w[np.concatenate([[0], starts + sizes])] = marks + np.arange(len(documents) + 1)
    for start, document in zip(starts, documents):
        w[start : start + len(document)] = document
    right = left = None
    found = [[np.empty((0, 4), dtype=np.int64)] for _ in documents]
    for number, x, q in _grid(sizes, starts, least, exponent):
        same = w[x] == w[x + q]
        x, q, number = x[same], q[same], number[same]
        if not len(x):
            continue
        if right is None:
            right, left = Extensions(w), Extensions(w[::-1].copy())
        ahead, back = right.common(x, x + q), left.common(n - x, n - x - q)
        length = ahead + back + q
        long = length >= np.maximum(least, exponent * q)
        rows = np.stack([number, x - back - starts[number], length, q], axis=1)[long]
        rows = np.unique(rows, axis=0)
        cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
        for part in np.split(rows, cuts):
            if len(part):
                found[part[0, 0]].append(part)
    return [_smallest_periods(np.concatenate(parts)[:, 1:]) for parts in found]


def _grid(sizes: np.ndarray, starts: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, place and period of all grid places, in portions.

    A run of period q and length L has L - q places x with word x equal to word x + q in a row, at
    least max(least - q, (exponent - 1) * q): a grid of that width meets each run.
    """
    numbers, periods = [], []
    held = 0
    for number, size in enumerate(sizes):
        if size < least:
            continue
        numbers.append(np.full(int(size) // exponent, number))
        periods.append(np.arange(1, int(size) // exponent + 1))
        held += int(size) // exponent
        if held >= PLACES:
            yield from _places(np.concatenate(numbers), np.concatenate(periods), sizes, starts, least, exponent)
            numbers, periods, held = [], [], 0
    if held:
        yield from _places(np.concatenate(numbers), np.concatenate(periods), sizes, starts, least, exponent)


def _places(number, q, sizes, starts, least, exponent):
    width = np.maximum(least - q, (exponent - 1) * q)
    count = (sizes[number] - 1 - q) // width + 1
    ends = np.cumsum(count)
    first = 0
    while first < len(q):
        before = ends[first] - count[first]
        last = max(first + 1, int(np.searchsorted(ends, before + PLACES, side="right")))
        part = slice(first, last)
        row = np.repeat(np.arange(first, last), count[part])
        nth = np.arange(len(row)) - np.repeat(ends[part] - count[part] - before, count[part])
        yield number[row], starts[number[row]] + nth * width[row], q[row]
        first = last


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """One row (start, length, period) per stretch: a multiple of a period is met there too."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(rows: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; then the smallest start, then period."""
    # Two different quotients of numbers below 2**31 differ by more than 2**-62.
    ranked = ((-((length << 64) // period), start, period, length) for start, length, period in rows.tolist())
    best = min(ranked, default=None)
    return best and (best[1], best[3], best[2])


def collapsed(words: Sequence[bytes], rows: np.ndarray) -> bytes:
    """The words that no run repeats, joined by spaces: of each run its first period is kept."""
    if not len(rows):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0))


def numbered(texts: Sequence[list[bytes]]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.array([numbers.setdefault(word, len(numbers)) for word in words], dtype=np.int64) for words in texts]


def detect(documents: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """(doc_id, runs, best, collapsed) per row.

    runs is an array of (start, length, period) in words, by start and then by period; best is the
    strongest of them or null; collapsed is the text without the repeated part of each run. A null,
    empty or blank text has no runs and collapses to an empty text. Repeated rows give repeated
    results, a null doc_id stays null, an empty table gives none; only doc_id and text are read.
    """

    def work(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        found = runs_of(numbered(texts), least, exponent)
        names = ("start", "length", "period")
        best = [strongest(rows) for rows in found]
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "runs": [[dict(zip(names, row)) for row in rows.tolist()] for rows in found],
                "best": [dict(zip(names, b)) if b else None for b in best],
                "collapsed": [collapsed(words, rows).decode("utf-8") for words, rows in zip(texts, found)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                words = text.encode("utf-8").split() if isinstance(text, str) else []
                if texts and held + len(words) > CHUNK:
                    yield work(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield work(ids, texts)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = "struct<start:long,length:long,period:long>"
    return rows.mapInPandas(run, f"doc_id long, runs array<{one}>, best {one}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a run in one of ten documents, chosen and shaped by the checksum of its id.

    With h the checksum, g = h // 10 and n words: if h % 10 is 0, the p words from word a = g % n on repeat
    to the end, p = 1 + (n - a) // (3 + g % 8). A null id or text changes nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    changed = F.concat_ws(" ", F.concat(F.slice(words, F.lit(1), a), again))
    return F.when((h % 10 == 0) & text.rlike(WORD), changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
