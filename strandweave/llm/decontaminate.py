"""Benchmark decontamination: seeds that no hit can avoid, then Smith-Waterman alignment.

Seeds are pairs of words, neighbours or next but one. An alignment that scores
enough has few edits, so of each item it holds a known number of pairs with at
most one edit between the two words. That number less one of an item's places
may therefore go without a seed: those whose pairs are most frequent in the
corpus. All other places seed, so every hit holds a seed, however dense its
edits are. Items too short for pairs seed by single words in the same way. A
seed that occurs in a text brings the passage around it, as wide as its item
needs, and each pair of passage and item is aligned word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.common import BROADCAST_LIMIT_BYTES, HOT_ROWS, batches, stage
from strandweave.llm.textops import chunks, mix, word_spans

_MARKS = re.compile(r"[^\w\x00-\x7f]|_")
#: ASCII bytes that aren't letters or digits part words; all others belong to them.
_PART = np.ones(256, dtype=bool)
_PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Decontamination:
    """Parameters. A hit is a pair whose alignment scores at least ``ratio`` of a perfect one."""

    ratio: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    broadcast_bytes: int = BROADCAST_LIMIT_BYTES


def plain(text: str | None) -> bytes:
    """Lower-cased, with punctuation outside ASCII turned to spaces."""
    low = (text or "").lower()
    if not low.isascii():
        low = _MARKS.sub(" ", low)
    return low.encode("utf-8", "replace")


def _needed(words: int, p: Decontamination) -> tuple[int, int, int]:
    """For an item of so many words: (pairs, single words, words of a text) of a hit, the least, the least and the most.

    With m words matched, e edits fit if match * m - cost * e reaches the score.
    Of the m - 1 pairs of neighbours in the alignment, k have at most one edit
    between them and g of these none, so e >= (k - g) + 2 * (m - 1 - k), and
    2 * k >= k + g >= 2 * (m - 1) - e.
    """
    score, cost = p.ratio * p.match * words, min(-p.mismatch, -p.gap)
    least = max(1, math.ceil(score / p.match - 1e-9))
    pairs = min(2 * (m - 1) - (p.match * m - score) / cost for m in (least, words))
    return max(0, math.ceil(pairs / 2 - 1e-9)), least, words + math.ceil((p.match * words - score) / cost)


def _grams(texts: list[bytes], single: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's index, seed hashes, number of their first word, byte starts and ends of words): pairs of words, and single words if asked for."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    for a, b in chunks(texts):
        hashes, bounds, starts, ends = word_spans(texts[a:b], _PART)
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts[a:b]]])
        kinds = [(d, mix(hashes[:-d] * odd + hashes[d:]).view(np.int64)) for d in (1, 2) if len(hashes) > d]
        if single:
            kinds.append((0, mix(hashes + odd).view(np.int64)))
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi > lo:
                own = [(g[lo : hi - d], np.arange(hi - lo - d)) for d, g in kinds if hi - lo > d]
                g, at = (np.concatenate(c) for c in zip(*own, strict=True)) if own else (np.zeros(0, dtype=np.int64),) * 2
                yield a + i, g, at, starts[lo:hi] - offsets[i], ends[lo:hi] - offsets[i]


def _texts(rb: pa.RecordBatch, at: int) -> list[bytes]:
    return [plain(t) for t in rb.column(at).to_pylist()]


def _exploded(single: bool):
    """Rows to (id, pos, gram): every seed hash with its place."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for i, g, at, _, _ in _grams(_texts(rb, 1), single):
                yield pa.RecordBatch.from_arrays([pa.array([rb.column(0)[i].as_py()] * len(g), pa.int64()), pa.array(at.astype(np.int32)), pa.array(g)], names=["id", "pos", "gram"])

    return run


def _item_grams(p: Decontamination):
    """Rows of items to (id, part, pos, gram, spare, single, reach): what may seed them, and how many places need not."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for i, g, at, starts, _ in _grams(_texts(rb, 1), True):
                n = len(starts)
                pairs, words, reach = _needed(n, p)
                # single words stand last
                keep = slice(0, len(g) - n) if pairs else slice(len(g) - n, len(g))
                own = [pa.array([x] * len(g[keep]), kind) for x, kind in ((rb.column(0)[i].as_py(), pa.int64()), (rb.column(2)[i].as_py(), pa.int64()), ((pairs or words) - 1, pa.int32()), (not pairs, pa.bool_()), (reach, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own[:2], pa.array(at[keep].astype(np.int32)), pa.array(g[keep]), *own[2:]], names=["id", "part", "pos", "gram", "spare", "single", "reach"])

    return run


def _known(grams: DataFrame, limit: int) -> np.ndarray | None:
    """Distinct n-grams as a sorted array if a count shows them to fit, else none."""
    one = grams.select("gram").distinct()
    if one.count() * 8 > limit:
        return None
    return np.sort(np.asarray(one.toArrow()["gram"]).astype(np.int64))


class _Among:
    """Places of the hashes that are in a sorted array; a table of their low bits rejects most others first."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.mask = (1 << min(26, max(16, len(known).bit_length() + 6))) - 1
        self.bits = np.zeros(self.mask + 1, dtype=bool)
        self.bits[known & self.mask] = True

    def __call__(self, g: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.bits[g & self.mask])
        if not len(near):
            return near
        at = np.searchsorted(self.known, g[near])
        at[at == len(self.known)] = 0
        return near[self.known[at] == g[near]]


def _frequencies(docs: DataFrame, grams: DataFrame, single: bool, p: Decontamination) -> DataFrame:
    """(gram, df): occurrences over all of ``docs`` of the items' seed hashes."""
    known = _known(grams, p.broadcast_bytes)
    if known is None:
        everything = docs.mapInArrow(_exploded(single), "id long, pos int, gram long")
        return everything.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, total = _Among(known), np.zeros(len(known), dtype=np.int64)
        for rb in it:
            for _, g, _, _, _ in _grams(_texts(rb, 1), single):
                np.add.at(total, np.searchsorted(known, g[among(g)]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(total[at])], names=["gram", "df"])

    return docs.mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


#: Passages are passed on in batches of about so many bytes.
_BATCH_BYTES = 4 << 20


def _batched(rows: Iterator[tuple], kinds: tuple, names: list[str], text: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 64
        if size > _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)
            held, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)


def _runs(pos: np.ndarray, item: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, first, last place) of seeds that one alignment could hold; their order is that of item and place."""
    breaks = np.flatnonzero((np.diff(item) != 0) | (np.diff(pos) > 2 * reach[1:])) + 1
    for lo, hi in zip([0, *breaks], [*breaks, len(pos)], strict=True):
        yield int(item[lo]), max(0, int(pos[lo]) - int(reach[lo])), int(pos[hi - 1]) + int(reach[lo])


def _near_items(docs: DataFrame, seeds: DataFrame, single: bool) -> DataFrame:
    """(id, item, start, passage): the text around each item's seeds, with seeds that a count has shown to fit in a task."""
    local = seeds.select("gram", "item", "reach").toArrow().sort_by([("gram", "ascending"), ("item", "ascending")])
    gram, items, reaches = (np.asarray(local[c]).astype(np.int64) for c in ("gram", "item", "reach"))
    known, first = np.unique(gram, return_index=True)
    offsets = np.append(first, len(gram))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = _Among(known)

        def rows(rb: pa.RecordBatch) -> Iterator[tuple]:
            ids, texts = rb.column(0).to_pylist(), _texts(rb, 1)
            for i, g, at, starts, ends in _grams(texts, single):
                hit = among(g)
                if not len(hit):
                    continue
                k = np.searchsorted(known, g[hit])
                many = offsets[k + 1] - offsets[k]
                flat = np.repeat(offsets[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pos, item = np.repeat(at[hit], many), items[flat]
                order = np.lexsort((pos, item))
                for one, lo, hi in _runs(pos[order], item[order], reaches[flat[order]]):
                    yield ids[i], one, lo, texts[i][starts[lo] : ends[min(hi, len(starts) - 1)]].decode("utf-8", "replace")

        for rb in it:
            yield from _batched(rows(rb), (pa.int64(), pa.int64(), pa.int32(), pa.string()), ["id", "item", "start", "passage"], 3)

    return docs.mapInArrow(scan, "id long, item long, start int, passage string")


def _near_items_joined(docs: DataFrame, seeds: DataFrame, single: bool) -> DataFrame:
    """As :func:`_near_items` by joins: all hashes of the texts meet the seeds, and the texts hit are read again.

    Of the seeds, those that occur in over a thousandth of all places are fewer than a thousand; their rows are salted.
    """
    total = seeds.select("gram", "df").distinct().agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    salts = F.when(F.col("df") > max(HOT_ROWS, total // 1000), 32).otherwise(1)
    hot = F.broadcast(seeds.where(salts > 1).select("gram").distinct().withColumn("__hot", F.lit(32)))
    every = docs.mapInArrow(_exploded(single), "id long, pos int, gram long").join(hot, "gram", "left")
    every = every.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.coalesce("__hot", F.lit(1))).cast("int")).drop("__hot")
    spread = seeds.select("gram", "item", "reach", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    places = every.join(spread, ["gram", "salt"]).select("id", "item", "pos", "reach").distinct()
    held = places.groupBy("id", "item").agg(F.array_sort(F.collect_list(F.struct("pos", "reach"))).alias("at"))
    found = docs.join(held, "id").select("id", "text", "item", F.transform("at", lambda x: x["pos"]).alias("pos"), F.transform("at", lambda x: x["reach"]).alias("reach"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(rb: pa.RecordBatch) -> Iterator[tuple]:
            ids, texts, item, pos, reach = rb.column(0).to_pylist(), _texts(rb, 1), rb.column(2).to_pylist(), rb.column(3).to_pylist(), rb.column(4).to_pylist()
            for i, _, _, starts, ends in _grams(texts, single):
                here = np.array(pos[i], dtype=np.int64)
                keep = here < len(starts)  # rows that repeat an id are other texts
                here, far = here[keep], np.array(reach[i], dtype=np.int64)[keep]
                for one, lo, hi in _runs(here, np.full(len(here), item[i]), far) if len(here) else ():
                    yield ids[i], one, lo, texts[i][starts[lo] : ends[min(hi, len(starts) - 1)]].decode("utf-8", "replace")

        for rb in it:
            yield from _batched(rows(rb), (pa.int64(), pa.int64(), pa.int32(), pa.string()), ["id", "item", "start", "passage"], 3)

    return found.mapInArrow(cut, "id long, item long, start int, passage string")


def smith_waterman(item: list[str], passage: list[str], match: int, mismatch: int, gap: int) -> tuple[int, int, int]:
    """Best local alignment of two word lists: (score, first and last word of the passage that it covers).

    The gap penalty is linear, so a row's horizontal gaps are a running maximum.
    """
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    y = np.array([number.get(w, -1) for w in passage], dtype=np.int64)
    n = len(y)
    if not n or not item:
        return 0, 0, -1
    step = -gap * np.arange(n + 1)
    above, begun = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best, span = 0, (0, -1)
    for w in item:
        here = np.zeros(n + 1, dtype=np.int64)
        diagonal = above[:-1] + np.where(y == number[w], match, mismatch)
        up = above[1:] + gap
        here[1:] = np.maximum(0, np.maximum(diagonal, up))
        origin = np.arange(n + 1)
        origin[1:] = np.where(here[1:] == 0, origin[1:], np.where(diagonal >= up, begun[:-1], begun[1:]))
        lifted = here + step
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        above, begun = run - step, origin[source]
        j = int(above.argmax())
        if above[j] > best:
            best, span = int(above[j]), (int(begun[j]), j - 1)
    return best, *span


def _may_hit(item: list[str], passage: list[str], p: Decontamination) -> bool:
    """False if the passage lacks the pairs or words that a hit needs."""
    pairs, words, _ = _needed(len(item), p)
    held = set(passage)
    if sum(w in held for w in item) < words:
        return False
    near = set(zip(passage, passage[1:], strict=False)) | set(zip(passage, passage[2:], strict=False))
    return sum((w, x) in near or (w, y) in near for w, x, y in zip(item, item[1:], [*item[2:], None], strict=False)) >= pairs


def contaminated(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, score, ratio, start, stop): each text's best alignment with each item it holds.

    start and stop are numbers of words. Null and empty texts and items hold
    nothing; rows with a null id are left out; rows that repeat an id are one
    text's parts, of which the best counts; repeated items count once. Of equal
    alignments the one that begins first counts. Texts are read whole, and
    aligned where a seed is, however long they are. Words are compared
    lower-cased, without punctuation. Other columns aren't read. An empty
    table on either side gives an empty result.
    """
    batches(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tests = items.where(F.col(item_col).isNotNull() & F.col("text").isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).distinct()
    kinds = "id long, part long, pos int, gram long, spare int, single boolean, reach int"
    grams = stage(tests.withColumn("part", F.xxhash64("text")).mapInArrow(_item_grams(p), kinds), "grams")
    single = grams.agg(F.coalesce(F.bool_or("single"), F.lit(False))).first()[0]
    rarity = grams.join(_frequencies(texts, grams, single, p), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # the places whose hashes are most frequent needn't seed, as many as a hit can do without
    place = W.partitionBy("id", "part", "pos")
    ranked = rarity.withColumn("cost", F.sum("df").over(place)).withColumn("rank", F.dense_rank().over(W.partitionBy("id", "part").orderBy(F.desc("cost"), "pos")))
    seeds = ranked.where("rank > spare").groupBy(F.col("id").alias("item"), "gram").agg(F.max("reach").alias("reach"), F.max("df").alias("df"))
    seeds = stage(seeds.where("df > 0"), "seeds")

    fits = seeds.count() * 24 <= p.broadcast_bytes
    passages = (_near_items if fits else _near_items_joined)(texts, seeds, single)
    wanted = tests.select(F.col("id").alias("item"), F.col("text").alias("wanted"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("wanted") + 16), F.lit(0))).first()[0]
    pairs = passages.join(F.broadcast(wanted) if size <= p.broadcast_bytes else wanted, "item").select("id", "item", "start", "passage", "wanted")

    def align(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
        for rb in it:
            rows = []
            for i, item, start, passage, wanted in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                want, have = cut.findall(plain(wanted).decode()), cut.findall(passage)
                if not _may_hit(want, have, p):
                    continue
                score, a, b = smith_waterman(want, have, p.match, p.mismatch, p.gap)
                if score >= p.ratio * p.match * len(want):
                    rows.append((i, item, score, score / (p.match * len(want)), start + a, start + b))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "item", "score", "ratio", "start", "stop"])

    hits = pairs.mapInArrow(align, "id long, item long, score long, ratio double, start long, stop long")
    best = F.max_by(F.struct("score", "ratio", "start", "stop"), F.struct("ratio", "score", -F.col("start"))).alias("b")
    return hits.groupBy("id", "item").agg(best).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.score", "b.ratio", "b.start", "b.stop")


def drop_contaminated(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that hold a test item, with all columns.

    Rows with a null id stay, as do null and empty texts. Of rows that repeat
    an id all go if the text of any of them holds an item. An empty table of
    items leaves all, an empty one of documents gives an empty result.
    """
    return docs.join(contaminated(docs, items, p, id_col).select(id_col).distinct(), id_col, "left_anti")
