"""Byte-level BPE on padded numpy matrices, and back.

Words (matches of the split pattern) that a task has not met yet are sorted into buckets by
length, one padded matrix of token ids per bucket. In each round every row finds its lowest pair
rank and merges the leftmost pair of that rank; rows are compacted after each round. Pair ranks
come from a hash table in numpy arrays. A long row also merges further pairs of the same rank in
the same round where no merged pair's neighbours could have come first, which leaves the result
as it is and keeps words of a million bytes from taking a million rounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import releasing

ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = np.uint32(0xFFFFFFFF)  # no such pair; also an empty place of the hash table
PAD = np.uint32(0xFFFF)
KEPT = 400_000  # encoded words of a generation that a task remembers
CELLS = 1 << 20  # cells of a matrix in work


def splitter(pattern: str) -> regex.Pattern:
    """The pattern, compiled; a repetition at the end of an alternative need not be given back.

    Nothing follows it that could fail, so the matches are the same and found faster. Patterns
    with groups are left alone.
    """
    if "(" not in pattern.replace("(?!", ""):
        pattern = regex.sub(r"(?<=[}\]st])\+(?=\||$)", "++", pattern)
    return regex.compile(pattern)


def latin(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of the first 256 characters only, where plain classes do.

    Property classes and white space are written out; None if the pattern escapes anything else.
    """

    def listed(token: str) -> str:
        held = [i for i in range(256) if regex.match(token, chr(i))]
        runs: list[list[int]] = []
        for i in held:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        return "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in runs)

    out, inside = "", False
    for token in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, flags=regex.DOTALL):
        if token.startswith("\\p") or token == "\\s":
            out += listed(token) if inside else f"[{listed(token)}]"
        elif token == "\\S" and not inside:
            out += "[^" + listed("\\s") + "]"
        elif token.startswith("\\"):
            return None
        else:
            inside = token == "[" or inside and token != "]"
            out += token
    return re.compile(out)


class Splitter:
    """All matches of a pattern in a text, by the faster of two equal expressions."""

    def __init__(self, pattern: str) -> None:
        whole = splitter(pattern)
        self.whole, self.latin = whole, latin(whole.pattern)

    def findall(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.whole.findall(text)


# The expression that byte-level tokenizers cut by, and the kinds of characters that it knows.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, DIGIT, SIGN, SPACE, EDGE = range(5)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each of the first 256 characters."""
    names = {r"\p{L}": LETTER, r"\p{N}": DIGIT, r"\s": SPACE}
    found = [next((k for n, k in names.items() if regex.match(n, chr(i))), SIGN) for i in range(256)]
    return np.array(found, dtype=np.uint8)


def cuts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Where BYTE_LEVEL's matches begin in texts of the first 256 characters, a byte for each.

    Returns the texts, each between line feeds that are its edges; the places where matches and
    edges begin; and which of these are edges. A match begins where the kind changes; the last
    white space before other text stands alone or, if a space, begins the match after it; an
    apostrophe that begins a match takes the letters of a contraction along.
    """
    data = b"\n".join([b"", *texts, b""])
    held = np.frombuffer(data + b"\n", dtype=np.uint8)  # one more to look ahead at
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kind = kinds()[held[:-1]]
    kind[edges] = EDGE
    begins = np.ones(len(kind), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[edges] = True
    after = 1 + np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    begins[after - 1] = True
    begins[after] = held[after - 1] != ord(" ")
    quotes = np.flatnonzero((held[:-1] == ord("'")) & begins)
    one, two = held[quotes + 1], held[quotes + 2]
    for last in ("s", "t", "m", "d", "re", "ve", "ll"):
        at = quotes[(one == ord(last[0])) & (two == ord(last[1]) if last[1:] else True)]
        begins[at + 1] = False
        begins[at + 1 + len(last)] = True
    places = np.flatnonzero(begins)
    return data, places, np.searchsorted(places, edges)


class Remembered:
    """Values of keys that were met lately, in two generations.

    When the younger is full it becomes the elder, and keys that are still in use move over; so
    the memory is bounded and frequent keys stay.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self.make = make
        self.forget()

    def forget(self) -> None:
        """Drop all, as at the end of a task; else a worker holds them beside other steps' work."""
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def of(self, keys: set[str]) -> dict[str, bytes]:
        """A table that has at least these keys."""
        if len(self.young) > KEPT:
            self.young, self.elder = {}, self.young
        known, elder, new = self.young, self.elder, []
        for key in keys:
            if key not in known:
                if (value := elder.get(key)) is None:
                    new.append(key)
                else:
                    known[key] = value
        known.update(zip(new, self.make(new)))
        return known


class Words:
    """Texts as the ids of their words; a word that was met lately is not encoded again."""

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]]) -> None:
        self.pattern, self.known = Splitter(pattern), Remembered(encode_words)
        self.cut = pattern == BYTE_LEVEL

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        single: dict[int, bytes] = {}
        for i, text in enumerate(texts if self.cut else []):
            try:
                single[i] = text.encode("latin-1")
            except UnicodeEncodeError:
                pass
        rest = [i for i in range(len(texts)) if i not in single]
        out = dict(zip(single, self._by_cuts([*single.values()]))) if single else {}
        out.update(zip(rest, self._by_matches([texts[i] for i in rest])))
        return [out[i] for i in range(len(texts))]

    def _by_matches(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        get = self.known.of(set().union(*split)).__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _by_cuts(self, texts: list[bytes]) -> list[bytes]:
        """The same for texts of a byte a character: each distinct word of them is looked up once."""
        data, places, edges = cuts(texts)
        offsets = np.append(places, len(data)).astype(np.int64, copy=False)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        numbered = pieces.dictionary_encode()
        which, ids = numbered.indices.to_numpy(), self._ids_of(numbered.dictionary)
        # The ids of all distinct words in one row, and which of them each place takes, text by text.
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        counts = sizes[which]
        counts[edges] = 0
        ends = np.cumsum(counts, dtype=np.int32)
        first = (np.cumsum(sizes, dtype=np.int32) - sizes)[which]
        taken = np.repeat(first - ends + counts, counts)
        taken += np.arange(len(taken), dtype=np.int32)
        found = np.frombuffer(b"".join(ids), dtype="<u4")[taken]
        bounds = ends[edges].tolist()
        return [found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _ids_of(self, distinct: pa.LargeBinaryArray) -> list[bytes]:
        _, offsets, data = distinct.buffers()
        text, at = data.to_pybytes().decode("latin-1"), np.frombuffer(offsets, dtype=np.int64)[: len(distinct) + 1].tolist()
        words = [text[a:b] for a, b in zip(at, at[1:])]
        out = [*map(self.known.young.get, words)]
        gaps = [i for i, ids in enumerate(out) if ids is None]
        known = self.known.of({words[i] for i in gaps})
        for i in gaps:
            out[i] = known[words[i]]
        return out


class Vocabulary:
    """A rank file: token bytes by id, byte ids, and the hashed table of mergeable pairs."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if max(ranks.values()) >= int(PAD):
            raise ValueError("ids must fit 16 bits")
        self.words = Words(pattern, lambda words: self.encode_words([w.encode("utf-8") for w in words]))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.uint32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 16 | right)
                    values.append(rank)
        self._fill(np.array(keys, dtype=np.uint32), np.array(values, dtype=np.uint32))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, NONE), np.full(1 << bits, NONE)
        at, todo, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[at[todo]] == NONE
            spots, first = np.unique(at[todo][free], return_index=True)
            chosen = todo[free][first]
            self.keys[spots], self.values[spots] = keys[chosen], values[chosen]
            todo = np.setdiff1d(todo, chosen)
            at[todo] = (at[todo] + np.uint32(1)) & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it does not merge."""
        keys = (left << np.uint32(16)) | right
        at = self._home(keys)
        seen = self.keys[at]
        found = np.where(seen == keys, self.values[at], NONE)
        open_ = np.nonzero((seen != keys) & (seen != NONE))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            spot = (at[open_] + np.uint32(1)) & self.mask
            at[open_] = spot
            seen, wanted = self.keys[spot], keys[open_]
            found[open_] = np.where(seen == wanted, self.values[spot], NONE)
            more = (seen != wanted) & (seen != NONE)
            open_ = tuple(i[more] for i in open_)
        found[(left == PAD) | (right == PAD)] = NONE
        return found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers, by length bucket."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        low = 0
        while low < len(order):
            width = max(1, int(lengths[order[low]]))
            widest = width if width < 16 else width + width // 8
            high = int(np.searchsorted(lengths[order], widest, "right"))
            high = min(high, low + max(1, CELLS // widest))
            part = order[low:high]
            for i, ids in zip(part, self._merge_rows([words[i] for i in part])):
                out[i] = ids
            low = high
        return out

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        width = max(1, int(sizes.max()))
        table = np.full((len(words), width), PAD, dtype=np.uint32)
        inside = np.arange(width) < sizes[:, None]
        table[inside] = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        out: list = [None] * len(words)
        live = np.arange(len(words))
        while len(live):
            pairs = self.ranks(table[:, :-1], table[:, 1:]) if table.shape[1] > 1 else np.empty((len(live), 0), np.uint32)
            least = pairs.min(axis=1, initial=NONE)
            done = least == NONE
            for row in np.flatnonzero(done):
                ids = table[row]
                out[live[row]] = ids[ids != PAD].astype("<u4", copy=False).tobytes()
            table, pairs, least, live = table[~done], pairs[~done], least[~done], live[~done]
            if not len(live):
                break
            first = pairs.argmin(axis=1)  # the leftmost of the lowest rank
            merged = np.zeros(table.shape, dtype=bool)
            merged[np.arange(len(live)), first] = True
            if table.shape[1] > 32:
                self._further(table, pairs, least, merged)
            table[merged] = np.broadcast_to(least[:, None], table.shape)[merged]
            gone = np.zeros_like(merged)
            gone[:, 1:] = merged[:, :-1]
            table[gone] = PAD
            keep = table != PAD  # compaction: move what is left to the front of each row
            counts = keep.sum(axis=1)
            packed = np.full((len(live), int(counts.max())), PAD, dtype=np.uint32)
            packed[np.arange(packed.shape[1]) < counts[:, None]] = table[keep]
            table = packed
        return out

    def _further(self, table: np.ndarray, pairs: np.ndarray, least: np.ndarray, merged: np.ndarray) -> None:
        """Mark more pairs of the row's lowest rank that later rounds would merge all the same.

        They must not overlap, and no merged pair may form a lower or equal rank with what is or
        will be beside it; a row in which one does is left at its leftmost pair.
        """
        equal = pairs == least[:, None]
        rows = np.flatnonzero(equal.sum(axis=1) > 1)
        if not len(rows):
            return
        part, equal, least = table[rows], equal[rows], least[rows]
        # Of a run of overlapping pairs (a a a) every second one from its start merges.
        places = np.arange(equal.shape[1])
        start = np.maximum.accumulate(np.where(equal, -1, places), axis=1)
        chosen = np.zeros(part.shape, dtype=bool)
        chosen[:, :-1] = equal & ((places - start) % 2 == 1)
        r, c = np.nonzero(chosen)
        whole, low = least[r], least[r]
        before = np.where(c > 0, part[r, c - 1], PAD)
        after = np.where(c + 2 < part.shape[1], part[r, np.minimum(c + 2, part.shape[1] - 1)], PAD)
        risky = np.zeros(len(rows), dtype=bool)
        for left, right in ((before, whole), (whole, after), (whole, whole)):
            np.logical_or.at(risky, r, self.ranks(left, right) <= low)
        safe = ~risky
        merged[rows[safe]] = chosen[safe]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


@contextmanager
def lent(path: str, pattern: str) -> Iterator[Vocabulary]:
    """The vocabulary for one task; the words it remembers go when the task ends."""
    words = vocabulary(path, pattern)
    try:
        yield words
    finally:
        words.words.known.forget()


def by_bytes(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of bounded total size; a text above the bound is alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as little-endian 32-bit integers, and their bytes.

    A null text is empty, and an empty text has no ids. Rows keep their count, repeated or not;
    an empty table gives none; other columns are not read. There is no shuffle.
    """

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with lent(path, pattern) as words:
            for batch in batches:
                texts = [t if isinstance(t, str) else "" for t in batch["text"]]
                low = 0
                for part in by_bytes(texts):
                    ids = words.words.encode(part)
                    yield pd.DataFrame(
                        {"doc_id": batch["doc_id"].iloc[low : low + len(part)], "ids": ids, "decoded": [words.decode(i) for i in ids]}
                    )
                    low += len(part)

    return _nullable(documents).mapInPandas(run, "doc_id long, ids binary, decoded binary")


def _nullable(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, as encode_documents() has them."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with lent(path, pattern) as words:
            for batch in batches:
                texts = [t if isinstance(t, str) else "" for t in batch["text"]]
                low = 0
                for part in by_bytes(texts):
                    ids = words.words.encode(part)
                    yield pd.DataFrame(
                        {
                            "doc_id": batch["doc_id"].iloc[low : low + len(part)],
                            "n_tokens": [len(i) // 4 for i in ids],
                            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                            "decoded_sha256": [hashlib.sha256(words.decode(i)).hexdigest() for i in ids],
                        }
                    )
                    low += len(part)

    return _nullable(documents).mapInPandas(run, "doc_id long, " + ENCODED)
