"""Phrase collocations: frequent word runs by mergeable Misra-Gries summaries, then counted exactly.

The first pass summarises hashed runs in hash partitions: each partition's
summary has more counters than its mass divided by the least frequency, so no
frequent run can lose its counter, however the parts were merged. The second
pass counts the texts of the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.common import batches, join_once, stage, unstage
from strandweave.llm.textops import CHUNK_BYTES, chunks, mix, word_spans


@dataclass(frozen=True)
class Phrases:
    """Parameters.

    Phrases have 2 to ``longest`` words and ``least`` occurrences in their
    language. A phrase goes if a longer one around it has ``percent`` of its
    occurrences. ``top`` are reported for each language. ``partition_bytes`` of
    text make one hash partition, at most ``partitions`` of them, whose summary
    has ``spare`` times the counters that the guarantee needs, so that few
    others survive; tasks sum up ``pending`` runs before they pass them on. The filter between the passes
    has at most 2 ** ``filter_bits`` bits.
    """

    least: int = 30
    longest: int = 4
    percent: int = 80
    top: int = 2000
    scale: int = 2_000_000
    partition_bytes: int = 16 << 20
    partitions: int = 1 << 16
    spare: int = 8
    pending: int = 4_000_000
    filter_bits: int = 28


_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_WORD_END = _PIECE_END.copy()
_WORD_END[[0x20, 0x09]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _segments(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK_BYTES that end where a piece ends (a longer piece stays whole)."""
    at, marks = 0, None
    while at < len(text):
        end = len(text)
        if end - at > CHUNK_BYTES:
            if marks is None:
                marks = np.flatnonzero(_PIECE_END[np.frombuffer(text, np.uint8)])
            k = int(np.searchsorted(marks, at + CHUNK_BYTES))
            end = int(marks[k]) + 1 if k < len(marks) else end
        yield text[at:end]
        at = end


def _parts(texts: list[bytes], langs: list[str]) -> Iterator[tuple[list[bytes], list[str]]]:
    for a, b in chunks(texts):
        if b - a == 1:
            for part in _segments(texts[a]):
                yield [part], langs[a:b]
        else:
            yield texts[a:b], langs[a:b]


class Runs:
    """The word runs of some texts, hashed with their language.

    ``keys[j - 1]`` holds the hash of the run of j words that begins at each
    word, ``ok[j - 1]`` whether it stays within its piece.
    """

    def __init__(self, texts: list[bytes], langs: list[str], longest: int):
        self.langs = langs
        words, bounds, self.starts, self.stops = word_spans(texts, _WORD_END)
        self.blob = b" ".join(texts)
        self.count = np.diff(bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        seed = np.array([xxhash.xxh64_intdigest(x) for x in langs], dtype=np.uint64)
        ends = np.cumsum(_PIECE_END[np.frombuffer(self.blob, np.uint8)]) if len(words) else np.zeros(0, np.int64)
        piece = ends[self.starts] if len(words) else ends
        now, ok, n = mix(words + seed[self.doc]), np.ones(len(words), bool), len(words)
        self.keys, self.ok = [now], [ok]
        for j in range(1, longest):
            m = max(0, n - j)
            now = mix(now[:m] * _ODD + words[j:])
            ok = (piece[j:] == piece[:m]) & (self.doc[j:] == self.doc[:m])
            self.keys.append(now)
            self.ok.append(ok)

    def all(self) -> np.ndarray:
        return np.concatenate([k[o] for k, o in zip(self.keys, self.ok, strict=True)])

    def text(self, at: int, words: int) -> str:
        spans = range(at, at + words)
        return b" ".join(self.blob[self.starts[i] : self.stops[i]] for i in spans).translate(_LOWER).decode("utf-8", "replace")


def _columns(rb: pa.RecordBatch) -> tuple[list[bytes], list[str]]:
    return [t or b"" for t in rb.column(1).cast(pa.binary()).to_pylist()], rb.column(0).to_pylist()


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def reduced(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of at most ``capacity`` counters, and what every counter lost.

    The loss is the count next below the capacity: at least capacity + 1
    counters lose it, so all losses of a table stay under its mass / capacity.
    """
    if len(keys) <= capacity:
        return keys, counts, 0
    lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > lost
    return keys[keep], counts[keep] - lost, lost


#: Leading bits of a hash that tell runs apart in the summaries; runs that share them only make a survivor more.
_KEY_BITS = 48


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps after it, in 4 bytes each where all fit."""
    gaps = np.diff(keys) >> np.uint64(64 - _KEY_BITS)
    if len(gaps) and int(gaps.max()) >= 1 << 32:
        return keys.tobytes()
    return keys[:1].tobytes() + gaps.astype(np.uint32).tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if len(packed) == 8 * n:
        return np.frombuffer(packed, np.uint64)
    gaps = np.frombuffer(packed, np.uint32, n - 1, 8).astype(np.uint64) << np.uint64(64 - _KEY_BITS)
    return np.cumsum(np.concatenate([np.frombuffer(packed, np.uint64, 1), gaps]), dtype=np.uint64)


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    """The number that the leading bits of each key make."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _masses(rows: DataFrame, bits: int, p: Phrases) -> DataFrame:
    """(bucket, lang, n): the runs in each hash partition, and the words of each language (bucket null)."""

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, words = np.zeros(1 << bits, dtype=np.int64), {}
        for rb in it:
            for texts, langs in _parts(*_columns(rb)):
                runs = Runs(texts, langs, p.longest)
                mass += np.bincount(_place(runs.all(), bits), minlength=1 << bits)
                for lang, n in zip(langs, runs.count.tolist(), strict=True):
                    words[lang] = words.get(lang, 0) + n
        buckets, names = list(range(1 << bits)), list(words)
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(buckets + [None] * len(names), pa.int32()),
                "lang": pa.array([None] * len(buckets) + names, pa.string()),
                "n": pa.array(mass.tolist() + list(words.values()), pa.int64()),
            }
        )

    return rows.mapInArrow(weigh, "bucket int, lang string, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))


def survivors(rows: DataFrame, capacity: np.ndarray, bits: int, p: Phrases) -> DataFrame:
    """(bucket, n, keys): hashes of all runs that may have ``p.least`` occurrences, from the merged summaries.

    A task holds the summary of one partition at a time, ``capacity`` counters
    and as many that wait to be merged.
    """

    def summarise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(pending)
            pending.clear()
            keys &= np.uint64(2**64 - 2 ** (64 - _KEY_BITS))
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
            counts, keys = np.diff(first, append=len(keys)), keys[first]
            edges = np.searchsorted(_place(keys, bits), np.arange((1 << bits) + 1))
            parts, held = [], 0
            for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if x < y:
                    parts.append((b, *reduced(keys[x:y], counts[x:y], int(capacity[b]))))
                    held += len(parts[-1][1])
                if parts and (held > 250_000 or b == (1 << bits) - 1):
                    yield told(parts)
                    parts, held = [], 0

        def told(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([q[0] for q in parts], pa.int32()),
                    "lost": pa.array([q[3] for q in parts], pa.int64()),
                    "keys": pa.array([_packed(q[1]) for q in parts], pa.binary()),
                    "counts": pa.array([q[2].astype(np.uint32).tobytes() for q in parts], pa.binary()),
                }
            )

        for rb in it:
            for texts, langs in _parts(*_columns(rb)):
                pending.append(Runs(texts, langs, p.longest).all())
                size += len(pending[-1])
                if size >= p.pending:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, lost, size, waiting = None, 0, 0, []

        def settle() -> None:
            nonlocal waiting, lost, size
            keys, counts = _summed(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            keys, counts, more = reduced(keys, counts, int(capacity[bucket]))
            lost += more
            waiting, size = [(keys, counts)], len(keys)

        def done() -> pa.RecordBatch:
            settle()
            keys, counts = waiting[0]
            keys = keys[counts + lost >= p.least]
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})

        for rb in it:
            for b, gone, keys, counts in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if b != bucket:
                    if waiting:
                        yield done()
                    bucket, lost, size, waiting = b, 0, 0, []
                lost += gone
                counts = np.frombuffer(counts, np.uint32).astype(np.int64)
                waiting.append((_unpacked(keys, len(counts)), counts))
                size += len(waiting[-1][0])
                if size > 2 * capacity[bucket] + 65536:
                    settle()
        if waiting:
            yield done()

    parts = rows.mapInArrow(summarise, "bucket int, lost long, keys binary, counts binary")
    parts = parts.repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(merge, "bucket int, n long, keys binary")


def _filter(found: DataFrame, bits: int, p: Phrases) -> tuple[int, np.ndarray]:
    """A bit for every leading part of a survivor's hash: at most 2 ** p.filter_bits bits, whatever the corpus.

    Each hash partition makes its own stretch of the bits, so what returns to
    the driver is the filter and nothing else.
    """
    n = found.agg(F.sum("n")).first()[0] or 0
    width = min(p.filter_bits, max(bits + 3, 16, (256 * n).bit_length()))

    def stretch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            out = []
            for b, keys in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                on = np.zeros(1 << (width - bits), dtype=bool)
                on[_place(np.frombuffer(keys, np.uint64), width) - (b << (width - bits))] = True
                out.append(np.packbits(on).tobytes())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.binary())], names=["bucket", "on"])

    made = np.zeros(1 << (width - 3), dtype=np.uint8)
    step = 1 << (width - bits - 3)
    for r in found.select("bucket", "keys").mapInArrow(stretch, "bucket int, on binary").toLocalIterator():
        made[r["bucket"] * step : (r["bucket"] + 1) * step] |= np.frombuffer(r["on"], np.uint8)
    return width, made


def exact_counts(rows: DataFrame, width: int, made: np.ndarray, bits: int, p: Phrases) -> DataFrame:
    """(lang, phrase, words, f): exact counts, by text, of the runs that pass the filter and have ``p.least`` occurrences.

    Tasks pass on one row for each hash partition, a list of texts and their
    counts; the partition then adds up equal texts, a bounded number at a time.
    """
    shared = rows.sparkSession.sparkContext.broadcast(made)
    entry = pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, tuple[str, str]] = {}
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = together()
            # texts in order within a hash partition share beginnings, which compresses well
            where = _place(keys, bits)
            told = [names[k] for k in keys.tolist()]
            order = sorted(range(len(told)), key=lambda i: (where[i], told[i]))
            told, counts = [told[i] for i in order], counts[order]
            flat = pa.StructArray.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string()), pa.array(counts, pa.int64())], fields=list(entry))
            edges = np.searchsorted(where, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(edges))
            lists = pa.ListArray.from_arrays(pa.array(np.append(edges[some], edges[-1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], names=["bucket", "found"])

        for rb in it:
            for texts, langs in _parts(*_columns(rb)):
                runs = Runs(texts, langs, p.longest)
                for j, (keys, ok) in enumerate(zip(runs.keys, runs.ok, strict=True)):
                    at = np.flatnonzero(ok)
                    place = _place(keys[at], width)
                    at = at[(shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                    if len(at):
                        some, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                        for k, i in zip(some.tolist(), at[first].tolist(), strict=True):
                            if k not in names:
                                names[k] = (langs[runs.doc[i]], runs.text(i, j + 1))
                        waiting.append((some, n))
                        size += len(some)
                if len(names) > 400_000:
                    yield from flush()
                    names, waiting, size = {}, [], 0
                elif size > p.pending // 4:
                    waiting = [together()]
                    size = len(waiting[0][0])
        if waiting:
            yield from flush()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, size = None, [], 0

        def summed() -> pa.Table:
            t = pa.concat_tables(waiting).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            return t.rename_columns(["f" if c == "f_sum" else c for c in t.column_names]).select(["lang", "phrase", "f"])

        def done() -> Iterator[pa.RecordBatch]:
            t = summed()
            yield from t.filter(pc.greater_equal(t["f"], p.least)).combine_chunks().to_batches(max_chunksize=20_000)

        for rb in it:
            for b, found in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                if b != bucket:
                    if waiting:
                        yield from done()
                    bucket, waiting, size = b, [], 0
                waiting.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(found.values)]))
                size += len(found)
                if size > 1_000_000:
                    waiting = [summed()]
                    size = waiting[0].num_rows if waiting[0].num_rows < 500_000 else 0
        if waiting:
            yield from done()

    each = rows.mapInArrow(count, "bucket int, found array<struct<lang: string, phrase: string, f: bigint>>")
    each = each.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "lang string, phrase string, f long")
    return each.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _with_parts(cuts: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """``cuts`` with the counts l and r of both parts; a part of a frequent phrase is frequent."""
    out, staged = cuts, []
    for part, name in (("left", "l"), ("rest", "r")):
        uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
        side = stage(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(uses, ["lang", part]), "phrases")
        out = join_once(out, side, ["lang", part], "uses", total).drop("uses")
        staged.append(side)
    return out


def collocations(docs: DataFrame, p: Phrases = Phrases(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    A-Z is lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. a, l, r are exact occurrences of the
    phrase and of the parts of its lowest-scoring cut (ties to the shortest
    first part), n the language's words; score is floor(scale * a / (l + r)),
    in decimals, so nothing overflows. Order: score, then a, both descending,
    then the phrase by its bytes, so ranks are the same every time.

    A null language counts as ``und``, a null text as empty. Rows that repeat
    count each time. Texts count whole; a long one is taken in parts that end
    with a piece. Other columns aren't read, so their names can't clash. An
    empty table, or one without frequent phrases, gives an empty result.
    """
    batches(docs.sparkSession)
    rows = _rows(docs, lang_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min((p.partitions - 1).bit_length(), max(0, (size // p.partition_bytes).bit_length()))
    masses = stage(_masses(rows, bits, p), "phrases")
    capacity = np.zeros(1 << bits, dtype=np.int64)
    for r in masses.where("bucket is not null").toLocalIterator():  # a row for each hash partition
        capacity[r["bucket"]] = p.spare * (r["n"] // p.least + 1)
    found = stage(survivors(rows, capacity, bits, p), "phrases")
    width, made = _filter(found, bits, p)
    known = stage(exact_counts(rows, width, made, bits, p), "phrases")
    unstage(found)

    total = known.count()
    words, k = F.split("phrase", " "), F.col("k")
    # a longer phrase that is frequent enough holds one that is longer by a single word, and no less frequent
    inner = [known.where("words > 2").select("lang", _part(words, F.lit(i), F.col("words") - 1).alias("phrase"), "f") for i in (1, 2)]
    around = inner[0].unionByName(inner[1]).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = known.where("words > 1").join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < p.percent * F.col("f"))).drop("longer")

    def scored(cuts: DataFrame) -> DataFrame:
        cuts = cuts.select("lang", "phrase", "words", "f", "k", _part(words, F.lit(1), k).alias("left"), _part(words, k + 1, F.col("words") - k).alias("rest"))
        score = F.expr(f"cast({p.scale} * cast(f as decimal(28, 0)) div (cast(l as decimal(28, 0)) + r) as long)")
        return _with_parts(cuts, known, total * (p.longest - 1)).select("lang", "phrase", "words", F.col("f").alias("a"), F.struct(score.alias("score"), "k", "l", "r").alias("b"))

    def lowest(rows: DataFrame) -> DataFrame:
        """The lowest of all cuts, for phrases with their first one."""
        more = rows.where("words > 2").select("lang", "phrase", "words", F.col("a").alias("f"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
        return rows.unionByName(scored(stage(more, "phrases"))).groupBy("lang", "phrase", "words").agg(F.first("a").alias("a"), F.min("b").alias("b"))

    # a language may hold most phrases: its best are found in many parts first
    order = [F.desc("b.score"), F.desc("a"), F.asc("phrase")]
    parts = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def best(rows: DataFrame) -> DataFrame:
        some = rows.withColumn("part", parts)
        some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= p.top)
        return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= p.top).drop("part")

    # one cut bounds the score from above; what stays below the last of ``top`` whole scores needs no other cut
    first = stage(scored(stage(kept, "phrases").withColumn("k", F.lit(1))), "phrases")
    floor = lowest(stage(best(first).drop("rank"), "phrases")).groupBy("lang").agg(F.count("*").alias("whole"), F.min(F.struct("b.score", "a")).alias("floor"))
    floor = F.broadcast(stage(floor.where(F.col("whole") >= p.top).drop("whole"), "phrases"))  # languages of ``top`` phrases
    near = first.join(floor, "lang", "left").where(F.col("floor").isNull() | (F.struct("b.score", "a") >= F.col("floor"))).drop("floor")
    ranked = best(lowest(stage(near, "phrases")))
    n = masses.where("lang is not null").select("lang", "n")
    out = ranked.join(n, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
