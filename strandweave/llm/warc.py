"""Zstandard web archives: a sink that writes a frame for each record, and a reader that checks what it reads.

An archive begins with a skippable frame that holds the dictionary of all its
frames; each record is one frame. The sink is a Spark data source, whose commit
gives archives their final names; what a task that failed or ran twice leaves
has a hidden name that no reader takes.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandweave.llm.common import batches, join_once, scratch, stage

# Fixed values of the formats.
_DICTIONARY_FRAME = 0x184D2A5D
_FRAME = 0xFD2FB528
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

_ID = "urn:strandweave:page:"
_DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html binary, problem string"


@dataclass(frozen=True)
class Archives:
    """Parameters: an archive ends after ``archive_bytes``; its dictionary of at most
    ``dictionary_bytes`` is trained on its own first records, up to ``sample_bytes``.
    Of records with equal payloads of at least ``revisit_bytes``, one holds the payload.
    """

    archive_bytes: int = 64 << 20
    dictionary_bytes: int = 32 << 10
    sample_bytes: int = 2 << 20
    level: int = 3
    revisit_bytes: int = 0
    date: str = _DATE


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None, size: int, digest: str, date: str = _DATE) -> bytes:
    """One record: a response, or a revisit whose block has the headers of the response alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers else head + payload
    lines = [_VERSION.decode(), f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + _END


def dictionary(samples: list[bytes], p: Archives) -> bytes | None:
    """A dictionary trained on ``samples``; none where they are too few to train on."""
    with contextlib.suppress(zstandard.ZstdError):
        if len(samples) >= 8:
            return zstandard.train_dictionary(p.dictionary_bytes, samples).as_bytes()
    return None


def archive(records: Iterator[bytes], p: Archives) -> Iterator[bytes]:
    """Bytes of one archive: the dictionary in a skippable frame, then a frame for each record."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= p.sample_bytes:
            break
    made = dictionary(first, p)
    if made:
        packed = zstandard.ZstdCompressor(level=19).compress(made)
        yield struct.pack("<II", _DICTIONARY_FRAME, len(packed)) + packed
    pack = zstandard.ZstdCompressor(level=p.level, dict_data=zstandard.ZstdCompressionDict(made) if made else None, write_checksum=True)
    for r in first:
        yield pack.compress(r)
    del first
    for r in records:
        yield pack.compress(r)


def frames(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(record, problem) for each frame; what follows a frame that can't be decoded is one problem."""
    at, given = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == _DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        held, at = data[8 : 8 + size], 8 + size
        try:
            if held[:4] == struct.pack("<I", _FRAME):  # the dictionary may itself be compressed
                held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
            given = zstandard.ZstdCompressionDict(held)
        except zstandard.ZstdError as e:
            yield b"", f"dictionary: {e}"
            return
    unpack = zstandard.ZstdDecompressor(dict_data=given) if given else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one, out, step = unpack.decompressobj(), [], 4096
        try:
            while not one.eof and at < len(data):
                part = view[at : at + step]
                out.append(one.decompress(part))
                at += len(part) - len(one.unused_data)
                step = min(step * 2, 1 << 20)
        except zstandard.ZstdError as e:
            yield b"", f"frame: {e}"
            return
        yield b"".join(out), None if one.eof else "frame: cut off"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n") if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(_ID)
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def parsed(data: bytes) -> tuple:
    """A record's row (see RECORDS); ``problem`` names the first rule that it breaks."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    h = _headers(lines)
    kind, page = h.get("warc-type"), _page(h.get("warc-record-id", ""))
    lost = (page, h.get("warc-target-uri"), kind, None, None, None, None)
    if not gap or version != _VERSION:
        return *lost, "no version line"
    if missing := [k for k in _NEEDED if k not in h]:
        return *lost, f"header missing: {missing[0]}"
    length = h["content-length"]
    if not re.fullmatch(r"\d+", length) or len(rest) != int(length) + 4 or not rest.endswith(_END):
        return *lost, "length of the block"
    block = rest[:-4]
    if h.get("warc-block-digest", "") not in ("", f"sha1:{base32_digest(block)}"):
        return *lost, "digest of the block"
    if kind not in ("response", "revisit"):
        return *lost, None
    http, _, payload = block.partition(b"\r\n\r\n")
    told = _headers(http).get("content-length", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if not re.fullmatch(r"\d+", told) or (kind == "response" and int(told) != len(payload)):
        return *lost, "length of the payload"
    if kind == "response":
        if digest != base32_digest(payload):
            return *lost, "digest of the payload"
        return page, lost[1], kind, len(payload), digest, None, payload, None
    if h.get("warc-profile") != _PROFILE or "warc-refers-to" not in h or payload or len(digest) != 32:
        return *lost, "revisit"
    return page, lost[1], kind, int(told), digest, _page(h["warc-refers-to"]), None, None


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if ":" in path.split("/", 1)[0]:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcSink(DataSource):
    """Writes rows (page_id, url, html, payload_bytes, payload_digest, refers, refers_to) as archives.

    A task writes under hidden names; the commit renames what the tasks that
    count have written. The driver sees names, one for each archive.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool):  # noqa: ANN001, ANN201
        given = {f: type(getattr(Archives, f))(self.options[f.lower()]) for f in ("archive_bytes", "dictionary_bytes", "sample_bytes", "level", "date") if f.lower() in self.options}
        return _WarcWriter(self.options["path"], Archives(**given))


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, p: Archives):
        self.path, self.p = path.rstrip("/"), p

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        there, folder = _filesystem(self.path)
        there.create_dir(folder, recursive=True)
        records, names = self._records(iterator), []
        following = next(records, None)
        while following is not None:
            size, waiting = 0, following

            def some() -> Iterator[bytes]:
                nonlocal following, waiting, size
                while waiting is not None:
                    now, waiting = waiting, None
                    yield now
                    following = next(records, None)
                    if size < self.p.archive_bytes:
                        waiting, following = following, None

            name = f"_{uuid.uuid4().hex}.warc.zst"
            names.append(name)
            with there.open_output_stream(f"{folder}/{name}", compression=None) as out:
                for piece in archive(some(), self.p):
                    size += len(piece)
                    out.write(piece)
        return _Written(names)

    def _records(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for rb in iterator:
            for r in rb.to_pylist():
                payload = (r["html"] or "").encode()
                yield record(r["page_id"], r["url"], payload, r["refers"], r["refers_to"], r["payload_bytes"], base64.b32encode(bytes.fromhex(r["payload_digest"])).decode(), self.p.date)

    def commit(self, messages: list) -> None:
        there, folder = _filesystem(self.path)
        for n, name in enumerate(sorted(x for m in messages if m for x in m.names)):
            there.move(f"{folder}/{name}", f"{folder}/part-{n:06d}-{name[1:9]}.warc.zst")

    def abort(self, messages: list) -> None:
        there, folder = _filesystem(self.path)
        for name in (x for m in messages if m for x in m.names):
            with contextlib.suppress(OSError):
                there.delete_file(f"{folder}/{name}")


def with_revisits(pages: DataFrame, p: Archives = Archives()) -> DataFrame:
    """Rows for the sink: which page of each group of equal payloads holds the payload, and who refers to it.

    Payloads are equal if length, SHA-1 and SHA-256 are. The pages are shuffled
    once, by payload, with pages of a hot payload left where they are.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("*", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"), F.sha2(body, 256).alias("strong"))
    keys = ["payload_bytes", "payload_digest", "strong"]
    firsts = stage(rows.groupBy(*keys).agg(F.min("page_id").alias("first"), F.count("*").alias("uses")), "warc")
    total = int(firsts.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])
    out = join_once(rows, firsts, keys, "uses", total)
    refers = (F.col("payload_bytes") >= p.revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers"), F.when(refers, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, p: Archives = Archives()) -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` into archives under ``path``."""
    spark = pages.sparkSession
    batches(spark)
    spark.dataSource.register(WarcSink)
    options = {f: str(getattr(p, f)) for f in ("archive_bytes", "dictionary_bytes", "sample_bytes", "level", "date")}
    with_revisits(pages, p).write.format("warc").options(**options).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, html, problem) for each record under ``path``.

    ``problem`` is null for a record that keeps all rules: version line, needed
    headers, lengths of block and payload, both digests. A frame that can't be
    decoded ends its archive with one row that says so. Archives are read by
    Spark's own reader, so from any path it opens, one row each: they may have
    up to 2 GB. ``payloads`` false leaves html out.
    """
    batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    kind = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def tell(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kind)], names=names)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for held in rb.column(0):
                rows, size = [], 0
                for data, problem in frames(held.as_py()):
                    row = parsed(data) if problem is None else (*[None] * 7, problem)
                    rows.append(row if payloads else (*row[:6], None, row[7]))
                    size += len(data) if payloads else 200
                    if size > 8 << 20:
                        yield tell(rows)
                        rows, size = [], 0
                if rows:
                    yield tell(rows)

    return files.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, p: Archives = Archives()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archives.

    A null html is an empty payload. Rows that repeat the smallest id of a
    payload are responses all; a null id refers to the smallest id of its
    payload and is never that id, so a payload under null ids alone is held by
    each of them. Payloads count whole, however long. Other columns aren't
    read, so their names can't clash. An empty table gives an empty result. A
    record that breaks a rule fails the job.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, p)
    got = read_archives(spark, path, payloads=False)
    fine = F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("archive: "), F.col("problem"))))
    return got.select(fine.cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
