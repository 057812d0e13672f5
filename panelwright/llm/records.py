"""Token ids in length-delimited binary records, with an index of offsets beside each file.

A record is: length (8 bytes, little-endian), masked CRC-32C of these 8 bytes, the payload, masked
CRC-32C of the payload. The payload is the document id (8 bytes), its flag (1 byte, 0 if the id is
null) and the width of an id (1 byte: 2 for vocabularies that 16 bits can number, else 4), then
the ids. The index file holds offset and length of each record (8 bytes each), so that a reader
may take records in any order.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.bpe import Words, by_bytes
from panelwright.llm.shared import MEMBER_BYTES, attempt_name, join_path, opened, releasing, shared_folder
from panelwright.session import materialise

SEGMENT = 1024  # bytes of a payload that are taken along as one part of a checksum
GROUP = 1 << 21  # characters of text that are encoded together
AT_ONCE = 2048  # words handed to the library at once
BLOCK, BLOCK_BYTES = 2048, 2 << 20  # records and bytes of one unit of reading
FILES = "archive string, part int, nth int, block int, offset long, length long, n_records long, n_ids long"


# CRC-32C, reflected polynomial 0x82F63B78, and the mask constant of the record format: fixed values.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8


@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of a byte, and of two bytes in one step."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1))
    pairs = np.arange(1 << 16, dtype=np.uint32)
    first = one[pairs & 0xFF] ^ (pairs >> np.uint32(8))
    return one, one[first & 0xFF] ^ (first >> np.uint32(8))


def _stepped(rows: np.ndarray) -> np.ndarray:
    """Remainders of the rows of an even number of bytes each, all taken along together."""
    _, two = crc_tables()
    state = np.zeros(len(rows), dtype=np.uint32)
    for step in np.ascontiguousarray(rows.view("<u2").T):
        state = two[(state ^ step) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
    return state


@lru_cache(maxsize=1)
def _moved() -> list[list[int]]:
    """What SEGMENT zero bytes make of a remainder, by each of its four bytes."""
    one, _ = crc_tables()
    tables = []
    for place in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
        for _ in range(SEGMENT):
            state = one[state & 0xFF] ^ (state >> np.uint32(8))
        tables.append(state.tolist())
    return tables


def crc32c(datas: list[bytes]) -> list[int]:
    """CRC-32C of many byte strings at once.

    Each is cut into segments, zeros filled in before the first; a remainder of zero ignores them,
    and the usual start of all ones is the same as inverting the first four bytes. numpy takes all
    segments along together, and a table joins the segments of a string.
    """
    if not datas:
        return []
    if min(map(len, datas)) < 4:
        small, out = crc_tables()[0].tolist(), []
        for data in datas:
            state = 0xFFFFFFFF
            for byte in data:
                state = small[(state ^ byte) & 0xFF] ^ (state >> 8)
            out.append(state ^ 0xFFFFFFFF)
        return out
    longest = max(map(len, datas))
    size = SEGMENT if longest > SEGMENT else longest + longest % 2
    counts = [-(-len(data) // size) for data in datas]
    flipped = [bytes(size * n - len(data)) + bytes(255 - b for b in data[:4]) + data[4:] for data, n in zip(datas, counts)]
    parts = _stepped(np.frombuffer(b"".join(flipped), dtype=np.uint8).reshape(-1, size)).tolist()
    a, b, c, d = _moved() if size == SEGMENT else ([0],) * 4
    out, at = [], 0
    for n in counts:
        state = parts[at]
        for part in parts[at + 1 : at + n]:
            state = a[state & 0xFF] ^ b[state >> 8 & 0xFF] ^ c[state >> 16 & 0xFF] ^ d[state >> 24] ^ part
        at += n
        out.append(state ^ 0xFFFFFFFF)
    return out


def masked(datas: list[bytes]) -> list[int]:
    return [((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF for crc in crc32c(datas)]


def framed(payloads: list[bytes]) -> list[bytes]:
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    parts = zip(sizes, masked(sizes), payloads, masked(payloads))
    return [b"".join((s, struct.pack("<I", a), p, struct.pack("<I", b))) for s, a, p, b in parts]


def unframed(data: bytes) -> list[bytes]:
    """Payloads of the records that the bytes hold one after another, checksums verified."""
    sizes, payloads, said, at = [], [], [], 0
    while at < len(data):
        (length,) = struct.unpack_from("<Q", data, at)
        if at + 16 + length > len(data):
            raise ValueError("the bytes end inside a record")
        sizes.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + length])
        said += struct.unpack_from("<I", data, at + 8) + struct.unpack_from("<I", data, at + 12 + length)
        at += 16 + length
    if masked(sizes) != said[0::2] or masked(payloads) != said[1::2]:
        raise ValueError("a record does not match its checksum")
    return payloads


HEAD = "<qBB"  # document id, whether it has one, bytes of an id


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(HEAD, doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def count_ids(payload: bytes) -> int:
    return (len(payload) - struct.calcsize(HEAD)) // payload[struct.calcsize(HEAD) - 1]


def read_payload(payload: bytes) -> tuple[int | None, bytes]:
    """The document id, and the ids as little-endian 32-bit integers."""
    doc_id, known, width = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4")
    return (doc_id if known else None), ids.tobytes()


def byte_letters() -> dict[int, str]:
    """The character by which byte-level models write each byte; 255, which UTF-8 lacks, parts words."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)} | {255: " "}


class Encoder:
    """The tokenizers library on the words of a text; a word met lately is not encoded again.

    The pattern must be the tokenizer's own, by which it cuts a text into words that it encodes
    one by one. A byte-level tokenizer's model gets many words at once, in its own letters, of
    which the space is none: so the library need not search for words that are known, and the
    bytes of the tokens tell where each ends. Words with a character that the library classes
    otherwise than the pattern here, as by another version of Unicode, are handed over whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already uses all cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.words = Words(pattern, self._encode_words)
        self.alike: set[str] = set()  # characters met, by whether both class them alike
        self.unlike: set[str] = set()
        cut = self.tokenizer.pre_tokenizer
        bytewise = isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.model = None
        if bytewise and self.tokenizer.normalizer is None and all(t.special for t in added):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.letters = byte_letters()
            # A token of a byte-level model has a character for each of its bytes.
            vocabulary = self.tokenizer.get_vocab()
            self.sizes = np.zeros(1 + max(vocabulary.values(), default=-1), dtype=np.int64)
            self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self.words.encode(texts)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        if self.model is not None:
            odd = self._classed_otherwise(set().union(*words))
            known = [w for w in words if odd.isdisjoint(w)] if odd else words
            for low in range(0, len(known), AT_ONCE):
                out.update(self._at_once(known[low : low + AT_ONCE]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._one_by_one(rest)))
        return [out[w] for w in words]

    def _classed_otherwise(self, characters: set[str]) -> set[str]:
        """Those that the library does not cut off beside a letter, a digit, a sign and a space as the pattern does."""
        for c in characters - self.alike - self.unlike:
            probe = f"a{c}1{c}!{c} {c}"
            theirs = [end for _, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            ours = accumulate(map(len, self.words.pattern.findall(probe)))
            (self.alike if theirs == [*ours] else self.unlike).add(c)
        return characters & self.unlike

    def _at_once(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The words with their ids; none if the tokens don't add up to them."""
        spelled = [w.encode("utf-8") for w in words]
        text = b"\xff".join(spelled).decode("latin-1").translate(self.letters)
        (found,) = self.model.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)))
        reached = np.cumsum(self.sizes[ids])
        at = np.searchsorted(reached, ends)
        if not len(ids) or reached[-1] != ends[-1] or (reached[at] != ends).any():
            return iter(())
        data, cuts = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        return zip(words, [data[a:b] for a, b in zip(cuts, cuts[1:])])

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        out = []
        for low in range(0, len(texts), AT_ONCE):  # the library's results are a kilobyte a text
            for found in self.tokenizer.encode_batch_fast(texts[low : low + AT_ONCE], add_special_tokens=False):
                ids = found.ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encoded(documents: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """(doc_id, payload) per row, in no order: what a record holds, the end id appended."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, end = encoder(path, pattern), struct.pack("<I", end_id)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            done = 0
            for part in by_bytes(texts, GROUP):
                names = ids[done : done + len(part)]
                done += len(part)
                found = [np.frombuffer(i + end, dtype="<u4") for i in tool.encode(part)]
                payloads = [payload_of(d, i, tool.width) for d, i in zip(names, found)]
                yield pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "payload": payloads})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, payload binary")


def in_order(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows dealt out and sorted by doc_id, nulls first, with their `__part`.

    The bounds of the parts are quantiles of the ids alone, one per partition, so that rows are
    encoded once and not a second time for a sample of them.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = documents.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    part = F.lit(0)
    if bounds:
        listed = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
        part = F.coalesce(F.size(F.filter(listed, lambda b: b <= F.col("doc_id"))), F.lit(0))
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part).cast("int")
    dealt = rows.withColumn("__part", part).repartitionById(len(bounds) + 1, F.col("__part"))
    return dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("payload"))


def write_documents(documents: DataFrame, folder: str, path: str, pattern: str, end_id: int) -> DataFrame:
    """Encode, append the end id, and write records in ascending doc_id order; a manifest of blocks.

    Nulls come first; rows of one id are ordered by a hash of their ids. A null text is empty.
    Files are closed at a bounded size. Each attempt of a task has file names of its own and only
    successful ones are in the manifest, which has a row per block of records: place, counts, and
    the order (part, nth, block).
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        name, nth, out, index = attempt_name(), -1, None, None
        part, low, count, n_ids = 0, 0, 0, 0
        for batch in batches:
            part = int(batch["__part"].iloc[0]) if len(batch) else part
            payloads = [bytes(p) for p in batch["payload"]]
            for start in range(0, len(payloads), AT_ONCE):
                for payload, frame in zip(payloads[start:], framed(payloads[start : start + AT_ONCE])):
                    if out is None:
                        nth, block, offset, low, count, n_ids = nth + 1, 0, 0, 0, 0, 0
                        file = f"ids-{name}-{nth}.rec"
                        out = system.open_output_stream(join_path(at, file), compression=None)
                        index = system.open_output_stream(join_path(at, file + ".idx"), compression=None)
                    out.write(frame)
                    index.write(struct.pack("<QQ", offset, len(frame)))
                    offset, count, n_ids = offset + len(frame), count + 1, n_ids + count_ids(payload)
                    full = offset >= MEMBER_BYTES
                    if full or count == BLOCK or offset - low >= BLOCK_BYTES:
                        yield _manifest(folder, file, part, nth, block, low, offset, count, n_ids)
                        block, low, count, n_ids = block + 1, offset, 0, 0
                    if full:
                        out.close(), index.close()
                        out = None
        if out is not None:
            out.close(), index.close()
            if count:
                yield _manifest(folder, file, part, nth, block, low, offset, count, n_ids)

    rows = in_order(encoded(documents, path, pattern, end_id), documents.select(F.col("doc_id").cast("long").alias("doc_id")))
    return materialise(rows.mapInPandas(write, FILES), "id-files")


def _manifest(folder, file, part, nth, block, low, high, count, n_ids) -> pd.DataFrame:
    row = (join_path(folder, file), part, nth, block, low, high - low, count, n_ids)
    return pd.DataFrame([row], columns=[c.split()[0] for c in FILES.split(", ")])


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add `start`, the ids of all blocks before each, in two steps: in a part, and over parts.

    The second step is a window over one row per written partition.
    """
    inside = Window.partitionBy("part").orderBy("nth", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("__all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__before"))
    blocks = manifest.withColumn("__in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return blocks.join(parts, "part").withColumn("start", F.col("__in") + F.col("__before")).drop("__in", "__before")


def read_documents(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids) from the files, block by block, checksums verified.

    With digest, (doc_id, start, n_tokens, ids_crc32) instead: the ids stay in the task.
    """
    names = ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, offset, length, start in zip(batch["archive"], batch["offset"], batch["length"], batch["start"]):
                system, at = opened(place)
                with system.open_input_file(at) as file:
                    file.seek(int(offset))
                    data = file.read(int(length))
                rows = []
                for payload in unframed(data):
                    doc_id, ids = read_payload(payload)
                    rows.append((doc_id, start, *((len(ids) // 4, zlib.crc32(ids)) if digest else (ids,))))
                    start += len(ids) // 4
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    kinds = "n_tokens long, ids_crc32 long" if digest else "ids binary"
    return _spread(with_starts(manifest)).mapInPandas(read, f"doc_id long, start long, {kinds}")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(position, doc_id, ids) in an order drawn by the seed: the index files say where records lie."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place in batch["archive"]:
                system, at = opened(place + ".idx")
                with system.open_input_stream(at, compression=None) as stream:
                    table = np.frombuffer(stream.read(), dtype="<u8").reshape(-1, 2)
                yield pd.DataFrame({"archive": place, "offset": table[:, 0].astype("i8"), "length": table[:, 1].astype("i8")})

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {}
            for place, part in batch.reset_index(drop=True).groupby("archive", sort=False):
                system, at = opened(place)
                with system.open_input_file(at) as file:
                    for i in part.sort_values("offset").index:
                        file.seek(int(part["offset"][i]))
                        (payload,) = unframed(file.read(int(part["length"][i])))
                        rows[i] = (batch["position"].iloc[i], *read_payload(payload))
            yield pd.DataFrame([rows[i] for i in sorted(rows)], columns=["position", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    files = manifest.select("archive").distinct()
    index = files.mapInPandas(places, "archive string, offset long, length long")
    drawn = index.withColumn("position", F.xxhash64(F.lit(seed), F.element_at(F.split("archive", "/"), -1), "offset"))
    return drawn.orderBy("position").mapInPandas(take, "position long, doc_id long, ids binary")


def _spread(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(max(1, blocks.sparkSession.sparkContext.defaultParallelism))


def packed_documents(documents: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """Write all documents as records and read them back: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text is its end id alone; null ids come first; repeated rows have a record
    each; an empty table has no files and no rows; other columns are not read.
    """
    folder = shared_folder(documents.sparkSession, "ids")
    return read_documents(write_documents(documents, folder, path, pattern, end_id), digest=True)
