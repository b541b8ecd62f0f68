"""Sequence operators: reference regions, approximate search, k-mers and pileup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.columns import base_entropy, gc_content
from strandweave.operators.batched import approximate, local
from strandweave.session import settled, ship


def regions(chunks: DataFrame, wanted: DataFrame, chunk_size: int) -> DataFrame:
    """``wanted(rid, template_id, begin_pos, end_pos)`` with ``seq``, the half-open stretch of the reference.

    ``chunks(template_id, chunk_no, seq)`` holds the reference in equal pieces,
    so a region reads the few that it touches. Beyond the contig's end there
    is nothing; a region outside it is empty.
    """
    lo, hi = F.floor(F.col("begin_pos") / chunk_size), F.floor((F.col("end_pos") - 1) / chunk_size)
    valid = wanted.where(F.col("begin_pos") < F.col("end_pos"))
    touched = valid.withColumn("chunk_no", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    parts = touched.join(chunks.select("template_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("seq").alias("part")), ["template_id", "chunk_no"])
    base = F.col("chunk_no") * chunk_size
    begin = F.greatest(F.col("begin_pos") - base, F.lit(0))
    piece = F.substring(F.col("part"), (begin + 1).cast("int"), (F.least(F.col("end_pos") - base, F.lit(chunk_size)) - begin).cast("int"))
    joined = parts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("chunk_no", piece.alias("s")))).alias("ps"))
    return wanted.join(joined.select("rid", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("seq")), "rid", "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def sequence_features(chunks: DataFrame, bps: DataFrame, chunk_size: int, flank: int = 1000) -> DataFrame:
    """(bp_id, gc, complexity) of the ``flank`` bases before each breakpoint's left end and those from its right end on, taken together."""
    left = bps.select("bp_id", "template_id", F.greatest(F.col("final_left") - flank, F.lit(0)).alias("begin_pos"), F.col("final_left").alias("end_pos"), F.lit(0).alias("side"))
    right = bps.select("bp_id", F.col("right_template").alias("template_id"), F.col("final_right").alias("begin_pos"), (F.col("final_right") + flank).alias("end_pos"), F.lit(1).alias("side"))
    wanted = left.unionByName(right).withColumn("rid", F.struct("bp_id", "side"))
    seqs = regions(chunks, wanted.drop("bp_id", "side"), chunk_size).select(F.col("rid.bp_id").alias("bp_id"), "rid.side", "seq")
    whole = seqs.groupBy("bp_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return whole.select("bp_id", gc_content("seq").alias("gc"), base_entropy("seq").alias("complexity"))


def approximate_hits(text: str, needle: str, error: float) -> list[tuple[int, int, int]]:
    """Best approximate occurrences of ``needle``: (begin, end, edits), half-open.

    Bit-parallel edit distance over integers of any length finds where
    occurrences end. From each end the shortest distance is aligned backwards
    to where it begins. A later hit replaces those before it only if it is at
    least as good and at least as long.
    """
    m = len(needle)
    if not m or not text:
        return []
    budget = int(error * m)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, ch in enumerate(needle):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score = full, 0, m
    ends = []
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score <= budget:
            ends.append((j + 1, score))
    best: list[tuple[int, int, int]] = []
    for end, edits in ends:
        if best and edits > best[0][2]:
            continue
        begin = _origin(text, needle, end, edits)
        if best and end - begin < best[0][1] - best[0][0]:
            continue
        if best and (edits < best[0][2] or end - begin > best[0][1] - best[0][0]):
            best = []
        best.append((begin, end, edits))
    return sorted(set(best))


def _origin(text: str, needle: str, end: int, edits: int) -> int:
    """The leftmost begin from which ``text[begin:end]`` is ``edits`` away from ``needle``."""
    m = len(needle)
    row = list(range(m + 1))
    found = end
    for k in range(1, m + edits + 1):
        if end - k < 0:
            break
        ch, diagonal = text[end - k], row[0]
        row[0] = k
        for i in range(1, m + 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (needle[m - i] != ch))
        if row[m] == edits:
            found = end - k
    return found


def searched(pairs: DataFrame, error: float) -> DataFrame:
    """``pairs(qid, rid, needle, hay)`` to (qid, rid, hit_begin, hit_end, edits): the best hits of each needle, ties kept."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[(pdf["needle"].str.len() > 0) & (pdf["hay"].str.len() > 0)]
            found = approximate(list(zip(pdf["hay"], pdf["needle"], strict=True)), error)
            rows = [(q, r, *hit) for q, r, hits in zip(pdf["qid"], pdf["rid"], found, strict=True) for hit in hits]
            yield pd.DataFrame(rows, columns=["qid", "rid", "hit_begin", "hit_end", "edits"])

    ship(pairs.sparkSession)
    return pairs.mapInPandas(run, "qid long, rid long, hit_begin long, hit_end long, edits long")


def placed_clip(orientation: Column, left_clip: Column, begin: Column, end: Column) -> Column:
    """(left, right) that a hit of a clip's sequence adds; one of them is null."""
    none = F.lit(None).cast("long")
    left = F.when((orientation == 0) & left_clip, end).when((orientation == 3) & left_clip, begin)
    left = left.when((orientation == 2) & ~left_clip, begin).otherwise(none)
    right = F.when((orientation == 2) & left_clip, end - 1).when((orientation == 0) & ~left_clip, begin - 1).when((orientation == 3) & ~left_clip, end - 1).otherwise(none)
    return F.struct(left.alias("left"), right.alias("right"))


#: Letters of a sequence that are cut into k-mers at once, and rows of a k-mer that one task joins.
PIECE, HOT = 1024, 4096


def kmers(seqs: DataFrame, k: int, sid: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(seq_id, pos, kmer) of each window of ``k`` letters.

    Sequences are cut into pieces first, since a letter is reached by walking from the start.
    """
    rows = seqs.where(F.length(seq) >= k)
    number = F.floor((F.length(seq) - k) / PIECE).cast("int")
    pieces = rows.select(sid, seq, F.explode(F.sequence(F.lit(0), number)).alias("piece"))
    pieces = pieces.select(sid, (F.col("piece") * PIECE).alias("base"), F.substring(F.col(seq), F.col("piece") * PIECE + 1, F.lit(PIECE + k - 1)).alias("part"))
    each = pieces.select(sid, "base", "part", F.explode(F.sequence(F.lit(0), F.length("part") - k)).alias("at"))
    return each.select(sid, (F.col("base") + F.col("at")).alias("pos"), F.substring(F.col("part"), F.col("at") + 1, F.lit(k)).alias("kmer"))


#: Bits of a filter of k-mers at most: 32 MB, however many k-mers there are.
FILTER_BITS = 1 << 28


def _hashed(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of each window of ``k`` letters of the texts, in order."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i : len(h) + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    begin = np.cumsum(size) - size
    counts = np.maximum(size - k + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, at, h[begin[text] + at]


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of the texts of about ``most`` letters each."""
    begin = letters = 0
    for i, t in enumerate(texts, 1):
        letters += len(t)
        if letters >= most or i == len(texts):
            yield begin, i
            begin, letters = i, 0


def _filter(queries: DataFrame, k: int) -> np.ndarray:
    """Bits of the hashes of all k-mers of the queries; its size follows their number up to FILTER_BITS."""
    letters = queries.agg(F.sum(F.length("seq"))).first()[0] or 0
    bits = min(FILTER_BITS, 1 << max(16, (32 * letters).bit_length()))

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts = rb.column(0).to_pylist()
            for a, b in _slices(texts):
                bit = np.unique(_hashed(texts[a:b], k)[2] & np.uint64(bits - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.int64(1) << (bit & 31))], names=["word", "mask"])

    rows = queries.where(F.length("seq") >= k).select("seq").mapInArrow(words, "word long, mask long")
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)
    out[np.asarray(found["word"])] = np.asarray(found["mask"]).astype(np.uint32)
    return out


def _shared_kmers(targets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(tid, tp, kmer) of the targets' k-mers that the queries may hold: all that they do hold, and few others."""
    ship(targets.sparkSession)
    bits = targets.sparkSession.sparkContext.broadcast(_filter(queries, k))
    kind = targets.schema["seq_id"].dataType.simpleString()

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        low = np.uint64(len(table) * 32 - 1)
        for rb in it:
            texts = rb.column(1).to_pylist()
            for a, b in _slices(texts):
                text, at, h = _hashed(texts[a:b], k)
                bit = h & low
                yes = np.flatnonzero(table[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                for c in range(0, len(yes), 1 << 17):
                    part = yes[c : c + (1 << 17)]
                    words = [texts[a + t][p : p + k] for t, p in zip(text[part].tolist(), at[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(a + text[part])), pa.array(at[part].astype(np.int32)), pa.array(words, pa.string())], names=["tid", "tp", "kmer"])

    return targets.where(F.length("seq") >= k).select("seq_id", "seq").mapInArrow(kept, f"tid {kind}, tp int, kmer string")


def _dealt(q: DataFrame, t: DataFrame, hot: int, *by: str) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: rows of ``t`` of a k-mer with more than ``hot`` of them are dealt to several parts, those of ``q`` copied to each."""
    counts = settled(t.groupBy("kmer").agg(F.count("*").alias("n")))
    limit = max(hot, (counts.agg(F.sum("n")).first()[0] or 0) // 1000)
    # fewer than a thousand k-mers by the limit
    many = F.broadcast(counts.where(F.col("n") > limit).select("kmer", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    t = t.join(many, "kmer", "left").withColumn("part", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return q.join(many, "kmer", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"), t


def seeded(queries: DataFrame, targets: DataFrame, k: int, hot: int = HOT) -> DataFrame:
    """(qid, tid, diagonal, seeds): shared k-mers per diagonal, by an equi-join of k-mers.

    A bit filter of the queries' k-mers, of 32 MB at most, leaves out the
    targets' that no query holds, before they are rows. A k-mer that stands in
    the targets more than ``hot`` times, and in more than a thousandth of all
    places, is dealt to several tasks; no shared k-mer is dropped.
    """
    q = kmers(queries, k).select(F.col("seq_id").alias("qid"), F.col("pos").alias("qp"), "kmer")
    t = settled(_shared_kmers(targets, queries, k))
    q, t = _dealt(q, t, hot, "tid", "tp")
    return q.join(t, ["kmer", "part"]).groupBy("qid", "tid", (F.col("tp") - F.col("qp")).alias("diagonal")).agg(F.count("*").alias("seeds"))


def local_score(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1, opening: int = -2) -> tuple[int, int, int]:
    """Best local alignment of ``a`` in ``b`` with affine gaps: (score, begin and end in ``b``, half-open); of equal ones the first to end."""
    n = len(b)
    score, gaps_down = [0] * (n + 1), [float("-inf")] * (n + 1)
    origin, down_from = list(range(n + 1)), list(range(n + 1))
    best = (0, 0, 0)
    for x in a:
        diagonal, diagonal_from = 0, 0
        score[0], across, across_from = 0, float("-inf"), 0
        for j in range(1, n + 1):
            if score[j] + opening > gaps_down[j] + gap:
                down_from[j] = origin[j]
            gaps_down[j] = max(score[j] + opening, gaps_down[j] + gap)
            if score[j - 1] + opening > across + gap:
                across_from = origin[j - 1]
            across = max(score[j - 1] + opening, across + gap)
            straight = diagonal + (match if x == b[j - 1] else mismatch)
            straight_from = diagonal_from
            diagonal, diagonal_from = score[j], origin[j]
            top = max(0, straight, gaps_down[j], across)
            origin[j] = j if top == 0 else straight_from if top == straight else down_from[j] if top == gaps_down[j] else across_from
            score[j] = top
            if top > best[0]:
                best = (int(top), origin[j], j)
    return best


def locally_aligned(pairs: DataFrame) -> DataFrame:
    """``pairs(qid, rid, needle, hay)`` to (qid, rid, score, hit_begin, hit_end): the best local alignment of each pair that scores at all."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[(pdf["needle"].str.len() > 0) & (pdf["hay"].str.len() > 0)]
            found = local(list(zip(pdf["needle"], pdf["hay"], strict=True)))
            rows = [(q, r, *best) for q, r, best in zip(pdf["qid"], pdf["rid"], found, strict=True)]
            yield pd.DataFrame([r for r in rows if r[2] > 0], columns=["qid", "rid", "score", "hit_begin", "hit_end"])

    ship(pairs.sparkSession)
    return pairs.mapInPandas(run, "qid long, rid long, score long, hit_begin long, hit_end long")


#: Ids of one text that are a row, and places of shared k-mers that are looked at together.
PACK, SPOTS = 64, 1 << 20


def extended(queries: DataFrame, targets: DataFrame, k: int, least: int, hot: int = HOT, pack: int = PACK) -> DataFrame:
    """(qid, tid, diagonal, seeds, hit_begin, hit_end, edits): seeded diagonals extended to the whole query without gaps.

    Only diagonals of at least ``least`` seeds on which the query lies within
    the target are extended; edits are the letters that differ. Equal texts are
    one, until pairs are given with all their ids. What is shuffled is pairs of
    texts that may have so many seeds: those in which so many places of the
    query hold a k-mer of the target. Their diagonals, of which a text of one
    letter has as many as letters, are found beside the target, for all its
    queries at once. Nothing is shuffled after that.
    """
    ship(targets.sparkSession)
    number = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one_q, one_t = (settled(d.where(F.length("seq") >= k).groupBy("seq").agg(F.min("seq_id").alias("rep"), F.collect_list("seq_id").alias("ids"))) for d in (queries, targets))
    q, t = (d.select(F.col("rep").alias("seq_id"), "seq") for d in (one_q, one_t))
    asked = kmers(q, k).groupBy(F.col("seq_id").alias("qid"), "kmer").agg(F.count("*").alias("n"))
    held = settled(_shared_kmers(t, q, k).select("tid", "kmer").distinct())
    asked, held = _dealt(asked, held, hot, "tid")
    pairs = asked.join(held, ["kmer", "part"]).groupBy("qid", "tid").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("qid", "tid")
    kinds = [d.schema["seq_id"].dataType.simpleString() for d in (queries, targets)]

    parts = F.ceil(F.size("ids") / pack).cast("int")

    def packs(one: DataFrame) -> DataFrame:
        each = one.select("rep", "seq", "ids", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        return each.select("rep", "part", "seq", F.slice("ids", F.col("part") * pack + 1, F.lit(pack)).alias("ids"))

    # a text with many ids is a target for each pack of them; it comes before its queries
    many = F.broadcast(one_t.where(parts > 1).select(F.col("rep").alias("tid"), parts.alias("parts")))
    met = pairs.join(packs(one_q).drop("part").withColumnRenamed("rep", "qid"), "qid").join(many, "tid", "left")
    met = met.select("tid", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "qid", "seq", "ids")
    own = packs(one_t).select(F.col("rep").alias("tid"), "part", F.lit(None).cast(kinds[0]).alias("qid"), "seq", F.col("ids").alias("own"))
    # by number, since a pair is few bytes and much work
    rows = met.unionByName(own, allowMissingColumns=True).repartition(number, "tid", "part").sortWithinPartitions("tid", "part", "qid")
    hits = rows.select("qid", "seq", "ids", "own").mapInArrow(_extender(k, least), f"qids array<{kinds[0]}>, tids array<{kinds[1]}>, diagonal int, seeds long, hit_begin long, hit_end long, edits int")
    hits = hits.withColumn("qid", F.explode("qids")).withColumn("tid", F.explode("tids"))
    return hits.select("qid", "tid", "diagonal", "seeds", "hit_begin", "hit_end", "edits")


def _extender(k: int, least: int):  # noqa: ANN202
    """Rows (qid, seq, ids, own), a target's without qid before those of its queries, to the extended diagonals with the ids of both."""

    def diagonals(order: np.ndarray, hashes: np.ndarray, size: int, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, diagonal) with at least ``least`` equal hashes, where the query lies within the target."""
        text, at, h = _hashed(texts, k)
        low = np.searchsorted(hashes, h)
        n = np.searchsorted(hashes, h, "right") - low
        whole = np.cumsum(np.bincount(text, n, len(texts)))
        length = np.array([len(t) for t in texts])
        # so many queries at once as have SPOTS places together
        ends = np.unique(np.append(np.searchsorted(whole, np.arange(SPOTS, whole[-1] + SPOTS, SPOTS), "right"), len(texts)))
        begin = 0
        for end in ends[ends > 0].tolist():
            i, j = np.searchsorted(text, [begin, end])
            begin = end
            own = np.repeat(np.arange(i, j), n[i:j])
            spot = order[low[own] + np.arange(len(own)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])] - at[own]
            fits = (spot >= 0) & (spot + length[text[own]] <= size)
            cells, seeds = np.unique(text[own][fits] * (size + 1) + spot[fits], return_counts=True)
            cells = cells[seeds >= least]
            yield cells // (size + 1), cells % (size + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = codes = order = hashes = ids = None
        for rb in it:
            qids, seqs = (rb.column(i).to_pylist() for i in (0, 1))
            alone = [i for i, x in enumerate(qids) if x is None]
            for begin, end in zip([0, *alone], [*alone, len(qids)], strict=True):
                if begin < end and qids[begin] is None:
                    target, order, ids = seqs[begin], None, rb.column(3).slice(begin, 1)
                    begin += 1
                if begin == end:
                    continue
                if order is None:
                    hashes = _hashed([target], k)[2]
                    order = np.argsort(hashes, kind="stable")
                    hashes, codes = hashes[order], np.frombuffer(target.encode("utf-32-le", "surrogatepass"), np.uint32)
                texts = seqs[begin:end]
                own = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in texts]
                for query, at in diagonals(order, hashes, len(codes), texts):
                    sizes = np.array([len(own[i]) for i in query.tolist()], np.int64)
                    for m in np.unique(sizes).tolist():
                        like = np.flatnonzero(sizes == m)
                        for part in (like[c : c + (1 << 14)] for c in range(0, len(like), 1 << 14)):
                            same = np.lib.stride_tricks.sliding_window_view(codes, m)[at[part]] == np.stack([own[i] for i in query[part].tolist()])
                            runs = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
                            # seeds letter by letter: equal hashes were only a first look
                            seeds = (runs[:, k:] - runs[:, :-k] == k).sum(axis=1)
                            good = seeds >= least
                            if good.any():
                                hit = at[part][good]
                                asked, own_ids = rb.column(2).take(pa.array(begin + query[part][good])), ids.take(pa.array(np.zeros(len(hit), np.int64)))
                                yield pa.RecordBatch.from_arrays([asked, own_ids, pa.array(hit.astype(np.int32)), pa.array(seeds[good]), pa.array(hit), pa.array(hit + m), pa.array((m - same[good].sum(axis=1)).astype(np.int32))], names=["qids", "tids", "diagonal", "seeds", "hit_begin", "hit_end", "edits"])

    return run


#: Positions of the reference whose counts are added up together, as a power of two: a row of counts is some KB, a batch of them some 100 MB.
STRETCH_BITS = 8


def pileup(reads: DataFrame, lo: str = "begin_pos", seq: str = "seq", key: str = "template_id") -> DataFrame:
    """(template_id, pos, base, depth): the commonest base at each covered position, ties to the smaller letter.

    No base is a row: a task counts the letters at each position of its reads,
    about a million letters at a time, and hands on one row for each stretch of
    the reference, or more if it comes to more than a million counts; a stretch
    adds them to one matrix of positions by letters, one row after another, so
    memory doesn't grow with the depth.
    """
    kind = reads.schema[key].dataType.simpleString()
    width = 1 << STRETCH_BITS

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # of each stretch, letters' places and their counts
        kept, typed = 0, None

        def told() -> Iterator[pa.RecordBatch]:
            places = list(held)
            for c in range(0, len(places), 1024):
                part = places[c : c + 1024]
                columns = [pa.array([p[0] for p in part], typed), pa.array([p[1] for p in part], pa.int64())]
                columns += [pa.array([held[p][i].astype(t).tobytes() for p in part], pa.binary()) for i, t in ((0, np.uint32), (1, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "stretch", "at", "n"])

        for rb in it:
            typed = rb.column(0).type
            names, begins, all_texts = (c.to_pylist() for c in rb.columns)
            for a, b in _slices(all_texts):
                texts = [t.encode("latin-1", "replace") for t in all_texts[a:b]]
                size = np.array([len(t) for t in texts], np.int64)
                known: dict = {}
                own = np.array([known.setdefault(x, len(known)) for x in names[a:b]], np.int64)
                pos = np.repeat(np.array(begins[a:b], np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                stretch = pos >> STRETCH_BITS
                low, span = int(stretch.min()), int(stretch.max() - stretch.min()) + 1
                group = np.repeat(own, size) * span + (stretch - low)
                local = (pos & (width - 1)) << 8 | np.frombuffer(b"".join(texts), np.uint8)
                cells, n = np.unique(group << (STRETCH_BITS + 8) | local, return_counts=True)
                group, local = cells >> (STRETCH_BITS + 8), cells & ((1 << (STRETCH_BITS + 8)) - 1)
                first = np.flatnonzero(np.diff(group, prepend=-1))
                labels = list(known)
                for g, i, j in zip(group[first].tolist(), first.tolist(), [*first[1:].tolist(), len(group)], strict=True):
                    place, more = (labels[g // span], g % span + low), np.stack([local[i:j], n[i:j]])
                    if place in held:
                        both = np.concatenate([held[place], more], axis=1)
                        at, back = np.unique(both[0], return_inverse=True)
                        total = np.zeros(len(at), np.int64)
                        np.add.at(total, back, both[1])
                        more = np.stack([at, total])
                        kept -= held[place].shape[1]
                    held[place] = more
                    kept += more.shape[1]
                if kept > 1 << 20:
                    yield from told()
                    held.clear()
                    kept = 0
        if held:
            yield from told()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, typed = np.zeros((width, 256), np.int64), None, None

        def told() -> pa.RecordBatch:
            depth = held.sum(axis=1)
            at = np.flatnonzero(depth)
            base = held[at].argmax(axis=1)
            return pa.RecordBatch.from_arrays([pa.array([place[0]] * len(at), typed), pa.array((place[1] << STRETCH_BITS) + at), pa.array([chr(b) for b in base], pa.string()), pa.array(depth[at])], names=[key, "pos", "base", "depth"])

        for rb in it:
            typed = rb.column(0).type
            for name, stretch, at, n in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if place != (name, stretch):
                    if place is not None:
                        yield told()
                    held[:], place = 0, (name, stretch)
                held.reshape(-1)[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.int64)
        if place is not None:
            yield told()

    ship(reads.sparkSession)
    rows = reads.where(F.length(seq) > 0).select(F.col(key), F.col(lo).cast("long").alias("lo"), F.upper(seq).alias("seq"))
    counts = rows.mapInArrow(count, f"`{key}` {kind}, stretch long, at binary, n binary")
    counts = counts.repartition(key, "stretch").sortWithinPartitions(key, "stretch")
    return counts.mapInArrow(add, f"`{key}` {kind}, pos long, base string, depth long")
