"""The ``bam`` source: columns decoded from whole blocks, index bins for filters, any number of tasks without an index.

A file is a chain of compressed blocks of up to 64 KB; a virtual offset names a
block (its place in the file, shifted by 16 bits) and a byte within it.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BAM_SCHEMA = "ordinal long, rid int, begin_pos int, map_q int, flag int, next_rid int, next_pos int, tlen int, cigar string, qname string, seq string, qual string, tags map<string,string>"

# Fixed values of the format: operations, bases, the fields of a record, sizes of tag values.
_OPS, _BASES = b"MIDNSHP=X", b"=ACMGRSVTWYHKDBN"
_FIELDS = np.dtype([("size", "<i4"), ("rid", "<i4"), ("begin_pos", "<i4"), ("n_name", "u1"), ("map_q", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("next_rid", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_NUMBERS = {"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
#: First bin of each level of the index, and how far a position shifts to its place in the level.
_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))

_MAGIC = b"\x1f\x8b\x08\x04"
_LONGEST_BLOCK = 1 << 16
#: Blocks are decoded in lots of about so many bytes.
_LOT = 4 << 20
#: A record start is believed if so many records in a row look like records, or all up to the file's end.
_CHAIN = 8
_MOST_FILES = 127


def open_file(path: str):
    """A file on any filesystem that Arrow knows, or a local one."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        filesystem, inner = fs.FileSystem.from_uri(path)
        return filesystem.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _block_size(buf: bytes, at: int) -> int:
    """The size of the block whose header begins at ``at``; 0 if none does."""
    if buf[at : at + 4] != _MAGIC or len(buf) < at + 18:
        return 0
    end = at + 12 + struct.unpack_from("<H", buf, at + 10)[0]
    k = at + 12
    while k + 6 <= min(end, len(buf)):
        n = struct.unpack_from("<H", buf, k + 2)[0]
        if buf[k : k + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", buf, k + 4)[0] + 1
        k += 4 + n
    return 0


def _unpacked(buf: bytes, at: int, size: int) -> bytes:
    begin = at + 12 + struct.unpack_from("<H", buf, at + 10)[0]
    crc, n = struct.unpack_from("<II", buf, at + size - 8)
    try:
        data = zlib.decompress(buf[begin : at + size - 8], -15, max(n, 1))
    except zlib.error as e:
        raise ValueError("damaged block") from e
    if len(data) != n or zlib.crc32(data) != crc:
        raise ValueError("damaged block")
    return data


def block(data: bytes) -> bytes:
    """``data``, at most 65,280 bytes, as one block; none makes the block that ends a file."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    head = _MAGIC + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """Blocks of a file; ``count`` tells how many were unpacked."""

    def __init__(self, path: str):
        self.file = open_file(path)
        self.size = self.file.size()
        self.count = 0

    def begin(self, offset: int) -> Iterator[tuple[int, bytes, int]]:
        """(offset, data, offset of the next) of the block at ``offset`` and of all that follow."""
        held, base, at = b"", offset, 0
        while True:
            size = _block_size(held, at)
            if not size or len(held) < at + size:
                self.file.seek(base + len(held))
                more = self.file.read(_LONGEST_BLOCK if self.count < 4 else 1 << 20)
                if not more:
                    if len(held) > at:
                        raise ValueError(f"damaged file: no block at {base + at}")
                    return
                held, base, at = held[at:] + more, base + at, 0
                size = _block_size(held, 0)
                if not size and len(held) >= _LONGEST_BLOCK:
                    raise ValueError(f"damaged file: no block at {base}")
                continue
            self.count += 1
            yield base + at, _unpacked(held, at, size), base + at + size
            at += size

    def find(self, offset: int) -> int | None:
        """The first block that begins at ``offset`` or later: its header names a place where another header or the end is, and it unpacks."""
        while offset < self.size:
            self.file.seek(offset)
            buf = self.file.read(4 * _LONGEST_BLOCK)
            at = buf.find(_MAGIC)
            while 0 <= at < 2 * _LONGEST_BLOCK:
                size = _block_size(buf, at)
                end = at + size
                if size > 25 and (offset + end == self.size or _block_size(buf, end)):
                    try:
                        _unpacked(buf, at, size)
                    except ValueError:
                        pass
                    else:
                        return offset + at
                at = buf.find(_MAGIC, at + 1)
            offset += 2 * _LONGEST_BLOCK
        return None


@dataclass(frozen=True)
class Header:
    text: str
    contigs: list[tuple[str, int]]
    first: int  # virtual offset of the first record


def read_header(path: str) -> Header:
    held, starts = b"", []
    blocks = Blocks(path).begin(0)

    def need(n: int) -> None:
        nonlocal held
        while len(held) < n:
            offset, data, _ = next(blocks, (None, b"", 0))
            if offset is None:
                raise ValueError(f"not a BAM file: {path}")
            starts.append((len(held), offset))
            held += data

    def number(at: int) -> int:
        need(at + 4)
        return struct.unpack_from("<i", held, at)[0]

    number(0)
    if held[:4] != b"BAM\1":
        raise ValueError(f"not a BAM file: {path}")
    at = 8 + number(4)
    need(at)
    text, names = held[8:at].rstrip(b"\0").decode(), []
    count, at = number(at), at + 4
    for _ in range(count):
        n = number(at)
        length = number(at + 4 + n)
        names.append((held[at + 4 : at + 3 + n].decode(), length))
        at += 8 + n
    if at == len(held):  # the next block begins with a record
        place = next(blocks, (Blocks(path).size, b"", 0))[0] << 16
    else:
        begin, block = [s for s in starts if s[0] <= at][-1]
        place = block << 16 | (at - begin)
    return Header(text, names, place)


def is_sorted(header: str) -> bool:
    """The first header line names the coordinate order."""
    first = header.split("\n", 1)[0].split("\t")
    return first[0] == "@HD" and "SO:coordinate" in first


@dataclass(frozen=True)
class Index:
    """Per contig: the chunks of each bin as pairs of virtual offsets, and the first record that touches each 16,384 positions."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[list[int]]

    def chunks(self, rid: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Chunks that hold all records touching [begin, end), in order, merged."""
        if rid >= len(self.bins) or begin >= end:
            return []
        end = min(end, 1 << 29)
        windows = self.windows[rid]
        least = next((x for x in windows[begin >> 14 :] if x), 0) if begin >> 14 < len(windows) else 0
        # a record that begins before the window and reaches into it stands no earlier than the window's first
        found = [c for first, shift in _LEVELS for b in range(first + (begin >> shift), first + ((end - 1) >> shift) + 1) for c in self.bins[rid].get(b, ())]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            a = max(a, least) if b > least else a
            if b <= least:
                continue
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def starts(self) -> list[int]:
        """Virtual offsets of record starts that the index names, sorted."""
        named = {x for w in self.windows for x in w if x}
        named.update(a for bins in self.bins for chunks in bins.values() for a, _ in chunks)
        return sorted(named)


def read_index(path: str) -> Index | None:
    """The index beside a file, or none."""
    try:
        raw = open_file(path + ".bai").read()
    except OSError:
        return None
    if raw[:4] != b"BAI\1":
        raise ValueError(f"not an index: {path}.bai")
    n, at = struct.unpack_from("<i", raw, 4)[0], 8
    bins, windows = [], []
    for _ in range(n):
        count, at = struct.unpack_from("<i", raw, at)[0], at + 4
        held = {}
        for _ in range(count):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
            at += 8 + 16 * chunks
            if number < 37449:  # beyond stands a bin of counts
                held[number] = list(zip(flat[::2], flat[1::2], strict=True))
        bins.append(held)
        count, at = struct.unpack_from("<i", raw, at)[0], at + 4
        windows.append(list(struct.unpack_from(f"<{count}Q", raw, at)))
        at += 8 * count
    return Index(bins, windows)


def parse_region(text: str, contigs: list[tuple[str, int]]) -> tuple[int, int, int]:
    """``name`` or ``name:begin-end`` (from 1, both ends included) to (contig, begin, end), half-open from 0."""
    names = [n for n, _ in contigs]
    name, _, span = (text, "", "") if text in names else text.rpartition(":")
    if name not in names:
        raise ValueError(f"no such contig: {text}")
    rid = names.index(name)
    first, _, last = span.replace(",", "").partition("-")
    return rid, int(first) - 1 if first else 0, int(last) if last else contigs[rid][1]


class _Window:
    """Data from a block on, grown as needed."""

    def __init__(self, blocks: Iterator[tuple[int, bytes, int]]):
        self.blocks, self.data, self.starts = blocks, b"", []

    def grow(self) -> bool:
        offset, data, _ = next(self.blocks, (None, b"", 0))
        if offset is None:
            return False
        self.starts.append((len(self.data), offset))
        self.data += data
        return True

    def need(self, n: int) -> bool:
        while len(self.data) < n and self.grow():
            pass
        return len(self.data) >= n


def _likely(data: bytes, lo: int, hi: int, lengths: np.ndarray) -> np.ndarray:
    """Places in [lo, hi) where the numbers of a record's head fit each other and the contigs."""
    buf = np.frombuffer(data, np.uint8)
    at = np.arange(lo, max(lo, min(hi, len(buf) - 35)))

    def i4(k: int) -> np.ndarray:
        return buf[at + k].astype(np.int64) | buf[at + k + 1].astype(np.int64) << 8 | buf[at + k + 2].astype(np.int64) << 16 | buf[at + k + 3].view(np.int8).astype(np.int64) << 24

    size, rid, pos, n_seq, next_rid, next_pos = (i4(k) for k in (0, 4, 8, 20, 24, 28))
    n_name, n_cigar = buf[at + 12].astype(np.int64), buf[at + 16].astype(np.int64) | buf[at + 17].astype(np.int64) << 8
    end = np.append(lengths, 1 << 31)
    good = (n_name > 0) & (n_seq >= 0) & (size >= 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq)
    good &= (rid >= -1) & (rid < len(lengths)) & (next_rid >= -1) & (next_rid < len(lengths)) & (pos >= -1) & (next_pos >= -1)
    good[good] &= (pos[good] <= end[rid[good]]) & (next_pos[good] <= end[next_rid[good]])
    return at[good]


def _is_record(w: _Window, at: int, lengths: np.ndarray) -> int | None:
    """Where the record at ``at`` ends, if it looks like one through its name and operations."""
    if not w.need(at + 36) or not len(_likely(w.data, at, at + 1, lengths)):
        return None
    size, n_name, n_cigar = struct.unpack_from("<i", w.data, at)[0], w.data[at + 12], struct.unpack_from("<H", w.data, at + 16)[0]
    if not w.need(at + 4 + size):
        return None
    name = w.data[at + 36 : at + 36 + n_name]
    ops = w.data[at + 36 + n_name : at + 36 + n_name + 4 * n_cigar : 4]
    return at + 4 + size if re.fullmatch(rb"[!-~]*\0", name) and all(x & 15 < len(_OPS) for x in ops) else None


def first_record(blocks: Blocks, offset: int, lengths: np.ndarray) -> int | None:
    """Virtual offset of the first record that begins in a block at ``offset`` or later.

    A place is believed if a chain of records follows from it. Neighbouring
    tasks ask for the same offset and so agree where one ends and the other begins.
    """
    begin = blocks.find(offset)
    if begin is None:
        return None
    w, lo = _Window(blocks.begin(begin)), 0
    while w.grow():
        hi = len(w.data)
        w.need(hi + 36)
        for at in _likely(w.data, lo, hi, lengths).tolist():
            now, n = at, 0
            while n < _CHAIN and now is not None and w.need(now + 1):
                now, n = _is_record(w, now, lengths), n + 1
            if now is not None:
                begin, block = [s for s in w.starts if s[0] <= at][-1]
                return block << 16 | (at - begin)
        lo = hi
    return None


@dataclass(frozen=True)
class Bounds:
    """What the filters leave: contigs, and begins or touched positions in [low, high)."""

    rids: frozenset[int] | None = None
    low: int = 0
    high: int = 1 << 31
    touch: bool = False


class Stretch(InputPartition):
    """Records from ``begin`` to ``end``: virtual offsets if ``exact``, else places in the file that the task resolves to record starts."""

    def __init__(self, path: str, file: int, begin: int, end: int | None, exact: bool, ordered: bool, bounds: Bounds):
        super().__init__(None)
        self.path, self.file, self.begin, self.end = path, file, begin, end
        self.exact, self.ordered, self.bounds = exact, ordered, bounds


def _flat(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all slices one after another, and where each begins among them (n + 1)."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return np.repeat(begin - ends[:-1], length) + np.arange(ends[-1]), ends


def _text(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8)))


def _cigar(buf: np.ndarray, begin: np.ndarray, n_ops: np.ndarray) -> pa.Array:
    at, of = _flat(begin, 4 * n_ops)
    packed = buf[at].view("<u4")
    count, op = (packed >> 4).astype(np.int64), np.frombuffer(_OPS + b"??????????", np.uint8)[packed & 15]
    digits = np.ones(len(count), np.int64)
    for k in range(1, 9):
        digits += count >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = op
    for k in range(int(digits.max()) if len(digits) else 0):
        has = digits > k
        out[ends[has] - 2 - k] = count[has] // 10**k % 10 + 48
    return _text(out, np.concatenate([[0], ends])[of // 4])


class Lot:
    """Some whole records of one buffer, decoded a column at a time."""

    def __init__(self, data: bytes, starts: np.ndarray, ordinals: np.ndarray):
        self.buf = np.frombuffer(data, np.uint8)
        self.at, self.ordinal = starts, ordinals
        self.f = self.buf[starts[:, None] + np.arange(36)].view(_FIELDS)[:, 0] if len(starts) else np.zeros(0, _FIELDS)
        self._tags: list | None = None

    def where(self, keep: np.ndarray) -> Lot:
        out = Lot.__new__(Lot)
        out.buf, out.at, out.ordinal, out.f, out._tags = self.buf, self.at[keep], self.ordinal[keep], self.f[keep], None
        return out

    def of(self, file: int) -> Lot:
        self.ordinal = self.ordinal | file << 56
        return self

    def _parts(self) -> tuple[np.ndarray, ...]:
        """Where each record's operations, bases, qualities and tags begin, and where it ends."""
        ops = self.at + 36 + self.f["n_name"]
        seq = ops + 4 * self.f["n_cigar"].astype(np.int64)
        n = self.f["n_seq"].astype(np.int64)
        return ops, seq, seq + (n + 1) // 2, seq + (n + 1) // 2 + n, self.at + 4 + self.f["size"]

    def last(self) -> np.ndarray:
        """The last position of each record on the reference."""
        at, of = _flat(self._parts()[0], 4 * self.f["n_cigar"].astype(np.int64))
        packed = self.buf[at].view("<u4")
        span = np.where(np.isin(packed & 15, [0, 2, 3, 7, 8]), packed >> 4, 0).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(span)])[of // 4]
        return self.f["begin_pos"] + np.maximum(1, np.diff(total)) - 1

    def column(self, name: str) -> pa.Array:
        ops, seq, qual, tags, _ = self._parts()
        n = self.f["n_seq"].astype(np.int64)
        if name == "ordinal":
            return pa.array(self.ordinal)
        if name in ("rid", "begin_pos", "map_q", "flag", "next_rid", "next_pos", "tlen"):
            return pa.array(self.f[name].astype(np.int32))
        if name == "cigar":
            return _cigar(self.buf, ops, self.f["n_cigar"].astype(np.int64))
        if name == "qname":
            at, of = _flat(self.at + 36, self.f["n_name"].astype(np.int64) - 1)
            return _text(self.buf[at], of)
        if name == "seq":
            within, of = _flat(np.zeros(len(n), np.int64), n)
            packed = self.buf[np.repeat(seq, n) + (within >> 1)]
            return _text(np.frombuffer(_BASES, np.uint8)[np.where(within & 1, packed & 15, packed >> 4)], of)
        if name == "qual":
            at, of = _flat(qual, n)
            q = self.buf[at]
            return _text(np.where(q < 94, q, 0) + 33, of)
        if name == "tags":
            return self._all_tags()
        if name.startswith("tag_") and len(name) == 6:
            return self._one_tag(name[4:])
        raise ValueError(f"no such column of alignments: {name}")

    def _walk(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tags in steps: of the k-th tag of every record that has one, (record, key, kind, begin and end of the value)."""
        if self._tags is None:
            _, _, _, at, end = self._parts()
            row, zero, self._tags = np.arange(len(at)), np.append(np.flatnonzero(self.buf == 0), len(self.buf)), []
            sizes = np.zeros(256, np.int64)
            for kind, size in _SIZES.items():
                sizes[ord(kind)] = size
            while len(more := np.flatnonzero(at + 3 <= end)):
                row, at, end = row[more], at[more], end[more]
                key = self.buf[at].astype(np.int32) << 8 | self.buf[at + 1]
                kind, at = self.buf[at + 2], at + 3
                stop = at + sizes[kind]
                text = (kind == 90) | (kind == 72)
                stop[text] = zero[np.searchsorted(zero, at[text])]
                for i in np.flatnonzero(kind == 66):
                    count = struct.unpack_from("<i", self.buf, at[i] + 1)[0]
                    stop[i] = at[i] + 5 + count * _SIZES[chr(self.buf[at[i]])]
                if (sizes[kind][~text & (kind != 66)] == 0).any() or (stop > end).any():
                    raise ValueError("damaged tags")
                self._tags.append((row, key, kind, at, stop))
                at = stop + text
        return self._tags

    def _values(self, kind: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """Values of tags as texts, in order."""
        order, parts = [], []
        for k in np.unique(kind):
            at, letter = np.flatnonzero(kind == k), chr(k)
            if letter in "AZH":
                index, of = _flat(begin[at], end[at] - begin[at])
                part = _text(self.buf[index], of)
            elif letter == "B":
                part = pa.array([self._array(b) for b in begin[at]], pa.string())
            else:
                size = _SIZES[letter]
                numbers = self.buf[begin[at][:, None] + np.arange(size)].view(_NUMBERS[letter])[:, 0]
                part = pa.array([str(float(x)) for x in numbers], pa.string()) if letter == "f" else pa.array(numbers).cast(pa.string())
            order.append(at)
            parts.append(part)
        if not parts:
            return pa.array([], pa.string())
        place = np.argsort(np.concatenate(order), kind="stable")
        return pa.concat_arrays(parts).take(pa.array(place))

    def _array(self, at: int) -> str:
        sub, count = chr(self.buf[at]), struct.unpack_from("<i", self.buf, at + 1)[0]
        values = np.frombuffer(self.buf, _NUMBERS[sub], count, at + 5)
        return ",".join([sub, *(str(float(x)) if sub == "f" else str(x) for x in values)])

    def _all_tags(self) -> pa.Array:
        steps = self._walk()
        if not steps:
            return pa.MapArray.from_arrays(pa.array(np.zeros(len(self.at) + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
        row, key, kind, begin, end = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(row, kind="stable")
        row, key, kind, begin, end = (x[order] for x in (row, key, kind, begin, end))
        letters = np.stack([key >> 8, key & 255], axis=1).astype(np.uint8).reshape(-1)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.at)))]).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(ends), _text(letters, np.arange(len(row) + 1) * 2), self._values(kind, begin, end))

    def _one_tag(self, name: str) -> pa.Array:
        want = ord(name[0]) << 8 | ord(name[1])
        held = [tuple(x[s[1] == want] for x in s) for s in self._walk()]
        row, _, kind, begin, end = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 5
        place = np.full(len(self.at), -1)
        place[row] = np.arange(len(row))
        return self._values(kind, begin, end).take(pa.array(place, mask=place < 0))


class BamReader(DataSourceReader):
    """Plans stretches of records and decodes the columns of ``schema`` from them; ``blocks`` counts the blocks unpacked."""

    def __init__(self, schema, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        if len(self.paths) > _MOST_FILES:
            raise ValueError(f"more than {_MOST_FILES} files at once")
        self.names = schema.fieldNames()
        self.split_bytes = int(options.get("split_bytes", 32 << 20))
        self.splits = int(options["splits"]) if "splits" in options else None
        self.region = options.get("region")
        rids = frozenset(int(r) for r in options["rids"].split(",")) if "rids" in options else None
        self.bounds = Bounds(rids, int(options.get("begin_from", 0)), int(options.get("begin_to", 1 << 31)))
        self.blocks = 0

    def partitions(self) -> list[InputPartition]:
        """Stretches of about equal size.

        With an index they lie between record starts that it names, and where
        contigs are known only in chunks of the bins asked for. Without one they
        are equal parts of the file, and each task finds its first record.
        """
        out: list[InputPartition] = []
        for k, path in enumerate(self.paths):
            head, index = read_header(path), read_index(path)
            bounds = self.bounds
            if self.region:
                rid, low, high = parse_region(self.region, head.contigs)
                if bounds.rids is not None and rid not in bounds.rids:
                    continue
                # the filters on begins stay with Spark, the region is what is touched
                bounds = Bounds(frozenset([rid]), low, high, True)
            size = Blocks(path).size
            step = max(1, size // self.splits if self.splits else self.split_bytes)
            if index is None:
                cuts = [*range(head.first >> 16, size, step)]
                out += [Stretch(path, k, a, b, False, is_sorted(head.text), bounds) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
                continue
            if bounds.rids is not None and all(r >= 0 for r in bounds.rids):
                chunks = [c for r in sorted(bounds.rids) for c in index.chunks(r, max(0, bounds.low), bounds.high)]
            else:
                chunks = [(head.first, size << 16)]
            starts = index.starts()
            for a, b in chunks:
                a = max(a, head.first)
                for s in starts[bisect_right(starts, a) : bisect_left(starts, b)]:
                    if (s >> 16) - (a >> 16) >= step:
                        out.append(Stretch(path, k, a, s, True, True, bounds))
                        a = s
                out.append(Stretch(path, k, a, b, True, True, bounds))
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        for lot in self._lots(part):
            if len(lot.at):
                yield pa.RecordBatch.from_arrays([lot.column(n) for n in self.names], names=self.names)

    def _lots(self, part: Stretch) -> Iterator[Lot]:
        blocks, begin, end = Blocks(part.path), part.begin, part.end
        if not part.exact:
            head = read_header(part.path)
            lengths = np.array([n for _, n in head.contigs], np.int64)
            begin = head.first if begin <= head.first >> 16 else first_record(blocks, begin, lengths)
            end = None if end is None else first_record(blocks, end, lengths)
        if begin is not None and (end is None or begin < end):
            for lot in self._records(blocks, begin, end, part.file):
                kept, done = self._within(lot, part.bounds)
                yield kept
                if done and part.ordered:
                    break
        self.blocks += blocks.count

    @staticmethod
    def _within(lot: Lot, b: Bounds) -> tuple[Lot, bool]:
        """The records that the bounds leave, and whether none can follow: a record of the last contig begins beyond."""
        if b.rids is None and not b.low and b.high >= 1 << 31:
            return lot, False
        rid, pos = lot.f["rid"], lot.f["begin_pos"]
        keep = (pos < b.high) & ((lot.last() if b.touch else pos) >= b.low)
        done = False
        if b.rids is not None:
            keep &= np.isin(rid, list(b.rids))
            # records without a contig stand last
            past = (rid > max(b.rids)) | ((rid == max(b.rids)) & (pos >= b.high)) | (rid < 0)
            done = bool(past.any()) and min(b.rids) >= 0
        return lot.where(keep), done

    def _records(self, blocks: Blocks, begin: int, end: int | None, file: int) -> Iterator[Lot]:
        """Whole records that begin in [begin, end), in lots; each one's ordinal is its file and virtual offset."""
        skip, rest, mark = begin & 0xFFFF, b"", begin
        held, places, marks, size = [], [], [], 0
        for offset, data, following in blocks.begin(begin >> 16):
            if not held and rest:
                held, places, marks, size = [rest], [0], [mark], len(rest)
            held.append(data[skip:])
            places.append(size)
            marks.append(offset << 16 | skip)
            size, skip = size + len(held[-1]), 0
            beyond = end is not None and following << 16 >= end
            if size - len(rest) >= _LOT or beyond:
                lot, rest, mark = _cut(b"".join(held), places, marks, end)
                held = []
                yield lot.of(file)
                if beyond and not rest:
                    return
        if held:
            lot, rest, _ = _cut(b"".join(held), places, marks, end)
            yield lot.of(file)
        if rest:
            raise ValueError("damaged file: a record is cut off")


class PushingReader(BamReader):
    """A reader that takes its bounds from the filters of the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes what the filters say of contig and position; Spark applies all of them again to the rows."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            b = self.bounds
            if name == "rid" and isinstance(f, (EqualTo, In)):
                rids = frozenset(f.value) if isinstance(f, In) else frozenset([f.value])
                self.bounds = replace(b, rids=rids if b.rids is None else b.rids & rids)
            elif name == "begin_pos" and isinstance(f, EqualTo):
                self.bounds = replace(b, low=max(b.low, f.value), high=min(b.high, f.value + 1))
            elif name == "begin_pos" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.bounds = replace(b, low=max(b.low, f.value + isinstance(f, GreaterThan)))
            elif name == "begin_pos" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.bounds = replace(b, high=min(b.high, f.value + isinstance(f, LessThanOrEqual)))
            yield f


def _cut(data: bytes, places: list[int], marks: list[int], end: int | None) -> tuple[Lot, bytes, int]:
    """The whole records of ``data`` that begin before ``end``; the begun one that is left, and its virtual offset.

    ``places`` are where blocks begin in ``data``, ``marks`` their virtual offsets.
    """
    word, at, n, starts = struct.Struct("<i").unpack_from, 0, len(data), []
    while at + 4 <= n:
        after = at + 4 + word(data, at)[0]
        if not at < after <= n:
            break
        starts.append(at)
        at = after
    found, where, mark = np.array([*starts, at], np.int64), np.array(places, np.int64), np.array(marks, np.int64)
    # of blocks at one place all but the last are empty
    k = np.searchsorted(where, found, "right") - 1
    ordinals = mark[k] + found - where[k]
    left = int(ordinals[-1])
    ordinals, found = ordinals[:-1], found[:-1]
    if end is not None:
        found, ordinals = found[ordinals < end], ordinals[ordinals < end]
    rest = data[at:] if end is None or left < end else b""
    return Lot(data, found, ordinals), rest, left


class BamSource(DataSource):
    """``spark.read.format("bam").load("a.bam,b.bam")``.

    With a schema given, only its columns are decoded; beside those of
    BAM_SCHEMA, ``tag_XX string`` is one tag. ``region`` (``chr1:1000-2000``)
    leaves what touches it, ``rids`` (``0,3``), ``begin_from`` and ``begin_to``
    what begins there (the end left out): all read only the chunks that an
    index names for them. ``split_bytes`` and ``splits`` set the tasks.
    Ordinals are file number and virtual offset, the same however a file is read.

    With option ``pushdown`` the query's filters on rid and begin_pos count as
    well. Spark keeps what was pushed with the loaded relation and gives it to
    every other scan of it, so such a DataFrame is for one scan: load it anew
    for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return BAM_SCHEMA

    def reader(self, schema) -> BamReader:
        kind = PushingReader if self.options.get("pushdown", "").lower() == "true" else BamReader
        return kind(schema, self.options)
