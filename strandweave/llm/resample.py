"""Importance resampling towards a target: hashed n-gram weights, and an exact cutoff by medians of medians.

A document's weight sums the log ratios of its features' bucket shares in the
target and in the corpus; Gumbel noise keyed by its id makes the highest scores
a draw without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches, stage, unstage
from strandweave.llm.textops import CHUNK_BYTES, chunks


@dataclass(frozen=True)
class Resampling:
    """Parameters: features are runs of 1 to ``longest`` words in ``buckets`` buckets; of the
    documents with ``least_words`` words, ``percent`` are drawn with noise keyed by ``seed``.
    """

    buckets: int = 10_000
    longest: int = 3
    least_words: int = 20
    percent: int = 5
    seed: int = 42


#: Bytes that part words: all of ASCII but digits and letters.
_PARTS = np.ones(256, dtype=bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PART = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The checksum is linear over bits, so a run of words is summed from its words' checksums:
# crc(a + b) = zeros(crc(a), len(b)) ^ crc(b), where zeros() feeds that many zero bytes.
_SHORT = 64
_BYTE = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32) ^ np.uint32(zlib.crc32(b"\0"))


def _one_zero(c: np.ndarray) -> np.ndarray:
    return _BYTE[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Tables of zeros(b << 8 j, n) for n < _SHORT, and of zeros(byte b's own sum, n)."""
    lanes = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    shift, own = [lanes], [_BYTE]
    for _ in range(_SHORT):
        shift.append(_one_zero(shift[-1]))
        own.append(_one_zero(own[-1]))
    return np.stack(shift), np.stack(own)


_SHIFT, _OWN = _powers()
_FAR = [_SHIFT[_SHORT]]


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = table[0, c & np.uint32(255)]
    for j in (1, 2, 3):
        out = out ^ table[j, (c >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def zeros(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after ``n`` zero bytes each, ``n`` of any size."""
    flat = _SHIFT.reshape(-1)
    base = (n & (_SHORT - 1)).astype(np.int64) * 1024
    out = flat[base + (c & np.uint32(255))]
    for j in (1, 2, 3):
        out = out ^ flat[base + 256 * j + ((c >> np.uint32(8 * j)) & np.uint32(255))]
    far, k = n // _SHORT, 0
    while far.any():
        if k == len(_FAR):
            _FAR.append(_through(_FAR[-1], _FAR[-1]))
        at = np.flatnonzero(far & 1)
        out[at] = _through(_FAR[k], out[at])
        far, k = far >> 1, k + 1
    return out


def word_sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 and length in bytes of each lower-cased word, and each text's first word (n + 1 bounds)."""
    blob = b" ".join(texts) + b" "
    buf = np.frombuffer(blob, dtype=np.uint8)
    inside = ~_PARTS[buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), bounds
    length = stops - starts
    last = np.cumsum(length)
    body = _LOWER[buf[inside]]
    after = np.minimum(np.repeat(last, length) - 1 - np.arange(len(body)), _SHORT - 1)
    sums = np.bitwise_xor.reduceat(_OWN.reshape(-1)[after * 256 + body], last - length)
    ones = np.full(1, 0xFFFFFFFF, np.uint32)
    begun = np.concatenate([zeros(ones, np.array([n])) for n in range(_SHORT)]) ^ ones
    sums = sums ^ begun[np.minimum(length, _SHORT - 1)]
    for i in np.flatnonzero(length >= _SHORT):
        sums[i] = zlib.crc32(_LOWER[buf[starts[i] : stops[i]]].tobytes())
    return sums, length, bounds


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK_BYTES that end between words."""
    at = 0
    while at < len(text):
        found = _PART.search(text, at + CHUNK_BYTES)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _runs(sums: np.ndarray, length: np.ndarray, first: np.ndarray, p: Resampling) -> np.ndarray:
    """Buckets of the runs that end at each word; ``p.buckets`` stands where a run would begin before ``first``."""
    n = len(sums)
    spaced = zeros(np.full(n, zlib.crc32(b" "), np.uint32), length) ^ sums
    out = np.full((n, p.longest), p.buckets, dtype=np.int32)
    out[:, 0] = sums % np.uint32(p.buckets)
    now, place = sums, np.arange(n)
    for j in range(1, min(p.longest, n)):
        now = zeros(now[:-1], length[j:] + 1) ^ spaced[j:]
        fits = place[j:] - j >= first[j:]
        out[j:, j][fits] = (now % np.uint32(p.buckets))[fits]
    return out


def word_buckets(texts: list[bytes], p: Resampling) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, words of each text, buckets of the runs that end at each word).

    Long texts come in several parts, each alone, with the last words of one carried into the next.
    """
    for a, b in chunks(texts):
        if b - a == 1 and len(texts[a]) > 2 * CHUNK_BYTES:
            held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            for piece in _segments(texts[a]):
                sums, length, _ = word_sums([piece])
                k = len(held)
                held, size = np.concatenate([held, sums]), np.concatenate([size, length])
                yield a, np.array([len(sums)]), _runs(held, size, np.zeros(len(held), np.int64), p)[k:]
                keep = max(0, len(held) - p.longest + 1)
                held, size = held[keep:], size[keep:]
        else:
            sums, length, bounds = word_sums(texts[a:b])
            n = np.diff(bounds)
            yield a, n, _runs(sums, length, np.repeat(bounds[:-1], n), p)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, p: Resampling, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; every task adds up its own first."""
    batches(docs.sparkSession)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(p.buckets + 1, dtype=np.int64)
        for rb in it:
            for _, _, runs in word_buckets(_texts(rb.column(0)), p):
                sums += np.bincount(runs.reshape(-1), minlength=p.buckets + 1)
        at = np.flatnonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "n"])

    each = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(p.buckets, dtype=np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most p.buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the bucket's smoothed share in the target over that in the corpus), one for each bucket."""
    k, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_s + k) / (float(s + 1) * float(all_t + k))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def noise(seed: int, name: int | None) -> int:
    """Gumbel noise in thousandths, from the hash of seed and id (a null id counts as an empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, p: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight, score) per row, from the array of gains that travels with the task."""
    batches(docs.sparkSession)
    worth = np.append(gain, 0)

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            words = np.zeros(rb.num_rows, dtype=np.int64)
            weight, features = words.copy(), words.copy()
            for a, n, runs in word_buckets(_texts(rb.column(1)), p):
                ends = np.concatenate([[0], np.cumsum(n)])
                total = np.concatenate([[0], np.cumsum(worth[runs].sum(axis=1))])
                found = np.concatenate([[0], np.cumsum((runs < p.buckets).sum(axis=1))])
                b = a + len(n)
                words[a:b] += n
                weight[a:b] += np.diff(total[ends])
                features[a:b] += np.diff(found[ends])
            score = weight + np.array([noise(p.seed, k) for k in rb.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(features), pa.array(words), pa.array(weight), pa.array(score)], names=[id_col, "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(judge, f"`{id_col}` long, n_features long, n_words long, weight long, score long")


Key = tuple[int, ...]
_KEY = ("k0", "k1", "k2", "k3")


def _halves(it: Iterator[pa.RecordBatch], low: Key | None, high: Key | None, pivot: Key | None) -> Iterator[pa.RecordBatch]:
    """Of the keys between the bounds, those on each side of the pivot: their number and median."""
    got = [np.stack([np.asarray(c) for c in rb.columns]) for rb in it]
    keys = np.concatenate(got, axis=1) if got else np.zeros((4, 0), np.int64)

    def under(limit: Key) -> np.ndarray:
        below, same = np.zeros(keys.shape[1], bool), np.ones(keys.shape[1], bool)
        for c, x in zip(keys, limit, strict=True):
            below |= same & (c < x)
            same &= c == x
        return below

    if low is not None:
        keys = keys[:, ~under((*low[:-1], low[-1] + 1))]
    if high is not None:
        keys = keys[:, under(high)]
    if pivot is None:
        sides = [keys]
    else:
        sides = [keys[:, under(pivot)], keys[:, ~under((*pivot[:-1], pivot[-1] + 1))]]
    for side, k in enumerate(sides):
        if n := k.shape[1]:
            middle = k[:, np.lexsort(k[::-1])[n // 2]]
            yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "n": pa.array([n], pa.int64())} | {c: pa.array([v], pa.int64()) for c, v in zip(_KEY, middle, strict=True)})


def _middle(medians: list[tuple[int, Key]]) -> Key:
    """The median of the medians, each weighted by the keys it stands for."""
    half, seen = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> Key:
    """The k-th smallest (k from 1) of distinct keys (k0, k1, k2, k3) of longs.

    Each round takes every partition's median of the keys that remain, and of
    these the median weighted by their numbers: at least a quarter of the keys
    lies on either side, so a quarter at least is discarded. One job a round
    counts both sides and takes their medians; it returns two rows a partition.
    What remains is written anew once three quarters of its table are gone, so
    all rounds together read a small multiple of the keys.
    """
    fields = "side int, n long, " + ", ".join(f"{c} long" for c in _KEY)
    table, rows, left = keys, None, None
    low = high = pivot = None
    sides: list[list[tuple[int, Key]]] = [[], []]
    while True:
        near = table
        if low is not None:
            near = near.where(F.col("k0") >= low[0])
        if high is not None:
            near = near.where(F.col("k0") <= high[0])
        bounds = (low, high, pivot)
        found = near.select(*_KEY).mapInArrow(lambda it, b=bounds: _halves(it, *b), fields).collect()
        sides = [[(r["n"], tuple(r[c] for c in _KEY)) for r in found if r["side"] == s] for s in (0, 1)]
        below = sum(n for n, _ in sides[0])
        if pivot is None:
            side, left = 0, below
            rows = rows or left
        elif below == k - 1:
            break
        elif below >= k:
            side, left, high = 0, below, pivot
        else:
            side, left, low, k = 1, sum(n for n, _ in sides[1]), pivot, k - below - 1
        pivot = _middle(sides[side])
        if left * 4 < rows:
            near = table.where(_at_most(high, strict=True) if high else F.lit(True)).where(~_at_most(low) if low else F.lit(True))
            smaller = stage(near.select(*_KEY), "resample")
            if table is not keys:
                unstage(table)
            table, rows = smaller, left
    if table is not keys:
        unstage(table)
    return pivot


def _at_most(limit: Key, strict: bool = False) -> Column:
    here, there = F.struct(*_KEY), F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(_KEY, limit, strict=True)))
    return (F.col("k0") <= limit[0]) & (here < there if strict else here <= there)


def resampled(docs: DataFrame, target: DataFrame, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, n_features, weight, score, rank); rank from 1 in order of score, null if not drawn.

    Ties in score go to the smaller id, then to the fewer features; a null id
    comes last among ties and draws its noise as an empty one. Rows that repeat
    are rows of their own: they score alike, and where the cutoff falls among
    them any of them are drawn. Null and empty texts have no features and
    weight 0. Texts count whole, however long. An empty target leaves the
    corpus' own shares to decide; an empty table gives an empty result. Other
    columns aren't read, so their names can't clash. What travels to the tasks
    is one array of ``p.buckets`` gains.
    """
    gain = gains(bucket_counts(docs, p, text_col), bucket_counts(target, p, text_col))
    key = [(-F.col("score")).alias("k0"), F.coalesce(F.col(id_col), F.lit(2**63 - 1)).alias("k1"), F.col("n_features").alias("k2"), F.monotonically_increasing_id().alias("k3")]
    rows = stage(weighed(docs, gain, p, id_col, text_col).select("*", *key), "resample")
    long = F.col("n_words") >= p.least_words
    draw = rows.where(long).count() * p.percent // 100
    shown = [id_col, "n_features", "weight", "score"]
    if not draw:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    won = long & _at_most(cutoff(rows.where(long), draw))
    # ranks are dealt by ranges of the order: a row's place in its range, after all ranges before
    ordered = stage(rows.where(won).orderBy(*_KEY).select(*shown, F.monotonically_increasing_id().alias("at")), "resample")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(ordered.groupBy(part.alias("part")).count().collect())  # a row for each range
    before, seen = [], 0
    for r in sizes:
        before.append((r["part"], seen))
        seen += r["count"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, seen long"))
    ranked = ordered.withColumn("part", part.cast("long")).join(offsets, "part").select(*shown, (F.col("seen") + place + 1).alias("rank"))
    return rows.where(~won).select(*shown, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
