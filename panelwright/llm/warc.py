"""WARC archives: written as whole gzip streams, normalised to one member per record, read by index.

Crawlers often gzip a whole archive as one stream, which nobody can enter in the middle. The
normaliser inflates such a stream once, front to back, and rewrites every record as its own gzip
member beside an index of (offset, length), so that any record can be read by itself.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.decontam import measured
from panelwright.llm.shared import MEMBER_BYTES, attempt_name, join_path, opened, shared_folder
from panelwright.session import materialise

PIECE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: object) -> str:
    """A header value on one line; a WARC header can't hold line ends."""
    return " ".join(str(value).split()) if value is not None and value == value else ""


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the length of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of inflated bytes into whole records; holds one record and one chunk."""
    held = b""
    for chunk in chunks:
        held = held + chunk if held else chunk
        begin = 0
        while (end := held.find(b"\r\n\r\n", begin)) >= 0:
            stop = end + 8 + int(headers(held[begin:end])["content-length"])
            if stop > len(held):
                break
            yield held[begin:stop]
            begin = stop
        held = held[begin:]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflated(stream) -> Iterator[bytes]:
    """Bytes of a gzip file, of one member or many, in bounded pieces."""
    engine = zlib.decompressobj(31)
    while raw := stream.read(PIECE):
        while raw:
            yield engine.decompress(raw, PIECE)
            raw = engine.unconsumed_tail
            if engine.eof:
                raw, engine = engine.unused_data, zlib.decompressobj(31)
    yield engine.flush()


def member(raw: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, keeper): keeper is the page whose payload this one repeats, else null.

    Of equal payloads of at least least_bytes the row with the largest page_id is the response;
    rows that share that page_id all are. Rows without page_id count as smaller than any; a group
    of only such rows has no revisits. Digests are grouped with map-side maxima; only those that
    occur again are joined to the pages, by broadcast if they were measured to be few, so that
    payloads are not shuffled, else by a join that Spark can split.
    """
    rows = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("__same"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    last = rows.filter(large).groupBy("__same").agg(F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("__n"))
    last = measured(last.filter("__n > 1").drop("__n"), "repeated-payloads")
    joined = rows.join(last, "__same", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("__last"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("__last")).alias("keeper"))


def write_monolithic(decided: DataFrame, folder: str) -> DataFrame:
    """Write archives that are one gzip stream each; (archive, n_records) per file.

    Each attempt of a task writes files of its own name, and only files of attempts that ended
    well are in the result, so a lost executor leaves no half archive behind that anyone reads.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        name, count, files, out, engine, size = attempt_name(), 0, 0, None, None, 0
        for batch in batches:
            for page_id, url, html, keeper in zip(batch["page_id"], batch["url"], batch["html"], batch["keeper"]):
                if out is None:
                    path = join_path(folder, f"raw-{name}-{files}.warc.gz")
                    out = system.open_output_stream(join_path(at, f"raw-{name}-{files}.warc.gz"), compression=None)
                    engine, size, count, files = zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0, files + 1
                whole = [None if pd.isna(v) else int(v) for v in (page_id, keeper)]
                payload = html.encode("utf-8") if isinstance(html, str) else b""
                raw = record(whole[0], url, payload, whole[1], whole[1] is not None)
                out.write(engine.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= MEMBER_BYTES:
                    out.write(engine.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [path], "n_records": [count]})
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pd.DataFrame({"archive": [path], "n_records": [count]})

    return materialise(decided.mapInPandas(write, "archive string, n_records long"), "warc-raw")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives of one stream as one member per record; (archive, sidecar, n_records).

    The sidecar has a line "offset length record-id" per record. Each archive is inflated once.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, files = attempt_name(), 0
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for source in batch["archive"]:
                path = f"warc-{name}-{files}.warc.gz"
                files += 1
                origin, place = opened(source)
                offset, count = 0, 0
                with (
                    origin.open_input_stream(place, compression=None) as stream,
                    system.open_output_stream(join_path(at, path), compression=None) as out,
                    system.open_output_stream(join_path(at, path + ".idx"), compression=None) as index,
                ):
                    for raw in records(inflated(stream)):
                        packed = member(raw)
                        out.write(packed)
                        name_of = headers(raw[: raw.index(b"\r\n\r\n")])["warc-record-id"]
                        index.write(f"{offset} {len(packed)} {name_of}\n".encode())
                        offset, count = offset + len(packed), count + 1
                full = join_path(folder, path)
                yield pd.DataFrame({"archive": [full], "sidecar": [full + ".idx"], "n_records": [count]})

    spread = archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism))
    return materialise(spread.mapInPandas(rewrite, "archive string, sidecar string, n_records long"), "warc-members")


def index_of(members: DataFrame) -> DataFrame:
    """(archive, offset, length) of every record, read from the sidecars."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, sidecar in zip(batch["archive"], batch["sidecar"]):
                system, at = opened(sidecar)
                with system.open_input_stream(at, compression=None) as stream:
                    found = [line.split()[:2] for line in stream.read().splitlines()]
                yield pd.DataFrame(
                    {"archive": archive, "offset": [int(a) for a, _ in found], "length": [int(b) for _, b in found]}
                )

    return members.mapInPandas(lines, "archive string, offset long, length long")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read records by (archive, offset, length): RESULT, and the payload if asked for.

    A response's payload is checked against its digest; a revisit tells both by its headers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive, part in batch.groupby("archive", sort=False):
                system, at = opened(archive)
                with system.open_input_file(at) as file:
                    for offset, length in zip(part["offset"], part["length"]):
                        file.seek(int(offset))
                        rows.append(parsed(zlib.decompress(file.read(int(length)), 31), with_payload))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
            yield out

    schema = RESULT + ", payload binary" * with_payload
    return index.mapInPandas(read, schema)


def parsed(raw: bytes, with_payload: bool = False) -> tuple:
    cut = raw.index(b"\r\n\r\n")
    head = headers(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(head["content-length"])]
    line = block.index(b"\r\n\r\n")
    payload, said = block[line + 4 :], head["warc-payload-digest"].removeprefix("sha1:")
    size = int(headers(block[:line])["content-length"])
    if head["warc-type"] == "response" and (digest_of(payload) != said or len(payload) != size):
        raise ValueError(f"record {head['warc-record-id']} does not match its digest")
    page, of = (head.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
    row = (int(page) if page else None, size, said, head["warc-type"], int(of) if of else None)
    return (*row, payload) if with_payload else row


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC, normalise the archives, and read them back by their index: RESULT.

    A null html is an empty payload, an empty table gives no archive and no rows, other columns
    are not read. Equal payloads, the empty one too, become revisits as decide() tells.
    """
    spark = pages.sparkSession
    raw = write_monolithic(decide(pages, least_bytes), shared_folder(spark, "warc-raw"))
    members = normalise(raw, shared_folder(spark, "warc"))
    parts = spark.sparkContext.defaultParallelism
    return read_records(index_of(members).repartition(parts))
