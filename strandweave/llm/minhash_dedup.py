"""MinHash near-dedup with sequential Bayesian verification.

Banded MinHash signatures propose candidates. Their signatures are compared in
batches; after each batch a pair is dropped once the posterior probability that
its similarity reaches the threshold is under ``miss``. What survives is
verified on the full shingle sets.

Copies cost one row each: texts with the same shingle set become one node
before banding. Within a bucket, nodes are compared with one centre, not with
each other: with the node whose buckets hold most nodes, which is the text that
the others were made from if it is there. Links found join components; only
pairs of a bucket that still lie in different components, and whose sizes let
them reach the threshold, are compared further. So a group of copies, however
large, costs little more than its size, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches, join_once, semi, stage, unstage
from strandweave.llm.graph import components
from strandweave.llm.textops import mix, shingle_sets


@dataclass(frozen=True)
class NearDedup:
    """Parameters. ``bands`` of ``rows`` hashes: a pair at similarity s is missed with (1 - s^rows)^bands, 2e-8 at 0.8."""

    width: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 45
    batch: int = 25
    miss: float = 1e-5
    block: int = 256
    seed: int = 17

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    def min_matches(self) -> np.ndarray:
        """Per batch, the fewest matches with which a pair stays.

        With a uniform prior and m matches of n the similarity is
        Beta(m + 1, n - m + 1), so P(s >= t) is P(Binomial(n + 1, t) <= m).
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            total, m = 0.0, 0
            while True:
                total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if total >= self.miss:
                    break
                m += 1
            out.append(m)
        return np.array(out)


def _signer(p: NearDedup):
    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed)
        a = (rng.integers(0, 2**32, p.hashes, dtype=np.uint32) | np.uint32(1))[:, None]
        b = rng.integers(0, 2**32, p.hashes, dtype=np.uint32)[:, None]
        for rb in it:
            texts = [t or b"" for t in rb.column(1).cast(pa.binary()).to_pylist()]
            n, f1, f2, sig = [], [], [], []
            for s in shingle_sets(texts, p.width):
                n.append(len(s))
                f1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).astype(np.int64)))
                if not len(s):
                    sig.append(None)
                    continue
                x, least = (s >> np.uint64(29)).astype(np.uint32), None
                for k in range(0, len(x), 4096):
                    low = (a * x[None, k : k + 4096] + b).min(axis=1)
                    least = low if least is None else np.minimum(least, low)
                sig.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "f1", "f2", "sig"])

    return sign


def _pruner(p: NearDedup):
    need = p.min_matches()

    def prune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            if not rb.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(rb.column(c).to_pylist()), dtype=np.uint32).reshape(rb.num_rows, -1) for c in ("sa", "sb"))
            left, seen = np.arange(rb.num_rows), np.zeros(rb.num_rows, dtype=np.int64)
            for k, least in enumerate(need):
                cut = slice(k * p.batch, (k + 1) * p.batch)
                seen[left] += (x[left, cut] == y[left, cut]).sum(axis=1)
                left = left[seen[left] >= least]
            yield rb.select(["a", "b"]).take(pa.array(left))

    return prune


def _setter(width: int):
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            texts = [t or b"" for t in rb.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["id", "items"])

    return sets


def _verifier(percent: int):
    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            keep = []
            for x, y in zip(rb.column("xa").to_pylist(), rb.column("xb").to_pylist(), strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            yield rb.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    Links texts with 100 * |A and B| >= percent * |A or B| over distinct word
    shingles; component_id is the smallest id reachable, kept tells whether
    that is the row's own id. A null or wordless text has no shingles and links
    with nothing. Rows that repeat an id are one document, linked if any of its
    texts is; each gets a row. A row with a null id links with nothing, and is
    kept with a null component. Texts are read whole, however long; ties don't
    matter, since every link counts. An empty table gives an empty result.
    Other columns aren't read, so their names can't clash.
    """
    batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(texts.mapInArrow(_signer(p), "id long, n long, f1 long, f2 long, sig binary"), "sig")
    sets = signed.where("n > 0 and id is not null")
    first = stage(sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "first")
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    nodes = sets.join(first.select(F.col("rep").alias("id"), "f1", "f2", "n"), ["id", "f1", "f2", "n"]).select("id", "n", "sig").distinct()

    key = F.explode(F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda k: F.xxhash64(k, F.expr("sig").substr(k * (4 * p.rows) + 1, F.lit(4 * p.rows)))))
    banded = nodes.select("id", "n", key.alias("key"))
    full = stage(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "full")
    met = stage(join_once(banded, full.withColumn("weight", F.col("c")), ["key"], "weight", total).drop("weight"), "bucket")
    hub = met.groupBy("id").agg(F.sum("c").alias("met"))
    shared = stage(met.join(hub, "id").select("key", "id", "n", "met"), "bucket")
    unstage(met)
    unstage(full)
    sigs = stage(nodes.join(shared.select("id").distinct(), "id", "left_semi").select("id", "sig"), "nodes")
    # the signatures of all others have done their work
    slim = stage(signed.drop("sig"), "ids")
    unstage(signed)
    signed, sets = slim, slim.where("n > 0 and id is not null")

    mid = _centres(shared)
    star = join_once(shared, mid, ["key"], "weight", total).where(F.col("id") != F.col("mid")).where(_sizes_fit(p.percent))
    links = _verified(texts, _pruned(star.select(F.least("id", "mid").alias("a"), F.greatest("id", "mid").alias("b")).distinct(), sigs, p), p)
    labels = components(links)
    more = _apart(texts, shared, mid, labels, sigs, total, p)
    if more is not None:
        labels = components(links.unionByName(more))
    for table in (sigs, shared, mid):
        unstage(table)

    # a set that very many texts share would be a hot key
    own = join_once(sets.select("id", "f1", "f2", "n"), first, ["f1", "f2", "n"], "copies", total).select("id", "rep")
    placed = own.join(labels, own["rep"] == labels["node"], "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    if own.distinct().groupBy("id").count().where("count > 1").take(1):
        # several texts of one id can sit in several components: join those too
        many = own.join(labels, own["rep"] == labels["node"], "left").select(F.col("id").alias("a"), F.coalesce("component", "rep").alias("b")).where("a <> b")
        joined = components(many.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        placed = own.select("id").distinct().join(joined, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("id", "n").join(placed, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _sizes_fit(percent: int) -> Column:
    """|A and B| is at most the smaller size and |A or B| at least the larger."""
    return (100 * F.col("n") >= percent * F.col("n2")) & (100 * F.col("n2") >= percent * F.col("n"))


def _centres(shared: DataFrame) -> DataFrame:
    """(key, mid, n2, weight): of each bucket the node that meets most nodes, and how many nodes it has."""
    rank = F.struct((-F.col("met")).alias("r"), F.col("id").alias("mid"), F.col("n").alias("n2"))
    return stage(shared.groupBy("key").agg(F.min(rank).alias("m"), F.count("*").alias("weight")).select("key", "m.mid", "m.n2", "weight"), "mid")


def _pruned(pairs: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_pruner(p), "a long, b long")


def _apart(texts: DataFrame, shared: DataFrame, mid: DataFrame, labels: DataFrame, sigs: DataFrame, total: int, p: NearDedup) -> DataFrame | None:
    """Links between components, among nodes that share a bucket's centre.

    Nodes around a centre are compared in blocks, first by signatures, batch by
    batch, then those left by their full sets. No row is made for a pair: each
    block yields a spanning forest of its links, and a large group is the work
    of many tasks.
    """
    rows = shared.join(labels, shared["id"] == labels["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    centred = join_once(rows, mid.join(mixed, "key").select("key", "mid", "weight"), ["key"], "weight", total)
    around = stage(centred.select("mid", "id", "n", "comp").distinct(), "apart")
    count = around.count()
    if not count:
        return None
    parts = around.groupBy("mid").agg(F.ceil(F.count("*") / p.block).cast("int").alias("parts"), F.count("*").alias("weight"))
    dealt = join_once(around, parts, ["mid"], "weight", total).join(sigs, "id").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    few = F.pmod(F.xxhash64("mid"), F.lit(max(64, count // 1024)))
    group = F.when(F.col("parts") == 1, few).otherwise(F.xxhash64("mid", F.least("side", "o"), F.greatest("side", "o"))).alias("g")
    dealt = dealt.select(group, "mid", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "id", "n", "comp", "sig")
    close = stage(dealt.groupBy("g").applyInArrow(_close_blocks(p), "g long, mid long, i int, j int, side int, id long, n long, comp long"), "close")
    sets = semi(texts, close.select("id").distinct(), "id").mapInArrow(_setter(p.width), "id long, items binary")
    found = close.join(sets, "id").groupBy("g").applyInArrow(_linked_blocks(p), "a long, b long").distinct()
    return stage(found, "links")


def _by_block(t: pa.Table) -> Iterator[pa.Table]:
    t = t.sort_by([("mid", "ascending"), ("i", "ascending"), ("j", "ascending")])
    mid, i, j = (np.asarray(t[c]).astype(np.int64) for c in ("mid", "i", "j"))
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(mid) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1, [len(mid)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield t.slice(lo, hi - lo)


def _eligible(t: pa.Table, p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block in different components, of sizes that fit, and of different sides where it has two."""
    side, n, comp = (np.asarray(t[c]).astype(np.int64) for c in ("side", "n", "comp"))
    x, y = np.triu_indices(t.num_rows, 1)
    fit = (comp[x] != comp[y]) & (100 * n[x] >= p.percent * n[y]) & (100 * n[y] >= p.percent * n[x])
    if t["i"][0].as_py() != t["j"][0].as_py():
        fit &= side[x] != side[y]
    return x[fit], y[fit]


def _close_blocks(p: NearDedup):
    need = p.min_matches()
    names = ["g", "mid", "i", "j", "side", "id", "n", "comp"]

    def compare(t: pa.Table) -> pa.Table:
        out = []
        for block in _by_block(t):
            x, y = _eligible(block, p)
            sig = np.frombuffer(b"".join(block["sig"].to_pylist()), dtype=np.uint32).reshape(block.num_rows, -1)
            seen = np.zeros(len(x), dtype=np.int64)
            for k, least in enumerate(need):
                cut = slice(k * p.batch, (k + 1) * p.batch)
                seen += (sig[x, cut] == sig[y, cut]).sum(axis=1)
                stay = seen >= least
                x, y, seen = x[stay], y[stay], seen[stay]
                if not len(x):
                    break
            out.append(block.select(names).take(pa.array(np.unique(np.concatenate([x, y])))))
        return pa.concat_tables(out)

    return compare


def _linked_blocks(p: NearDedup):
    def link(t: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], []]
        for block in _by_block(t):
            ids, comp = np.asarray(block["id"]), np.asarray(block["comp"])
            x, y = _eligible(block, p)
            if not len(x):
                continue
            sets = [np.frombuffer(b, dtype=np.uint64) for b in block["items"].to_pylist()]
            size = np.array([len(s) for s in sets])
            _, token = np.unique(np.concatenate(sets), return_inverse=True)
            row = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            both = np.zeros((len(sets), len(sets)), dtype=np.int64)
            for low in range(0, int(token[-1]) + 1, 4096):  # shared shingles of all pairs, some columns at a time
                a, b = np.searchsorted(token, [low, low + 4096])
                has = np.zeros((len(sets), 4096), dtype=np.float32)
                has[row[a:b], token[a:b] - low] = 1
                both += (has @ has.T).astype(np.int64)
            shared = both[x, y]
            linked = (100 * shared >= p.percent * (size[x] + size[y] - shared)) & (shared > 0)
            root = {c: c for c in comp.tolist()}
            for a, b in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                u, v = (_root(root, int(comp[k])) for k in (a, b))
                if u != v:
                    root[u] = v
                    out[0].append(min(int(ids[a]), int(ids[b])))
                    out[1].append(max(int(ids[a]), int(ids[b])))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return link


def _root(root: dict[int, int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def _verified(texts: DataFrame, pairs: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs that link by their full sets."""
    close = stage(pairs, "close")
    ids = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stage(semi(texts, ids, "id").mapInArrow(_setter(p.width), "id long, items binary"), "sets")
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("xa"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("xb"))
    out = stage(close.join(a, "a").join(b, "b").mapInArrow(_verifier(p.percent), "a long, b long").distinct(), "links")
    unstage(close)
    unstage(sets)
    return out


def drop_near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the smallest id's rows stay, with all columns.

    Rows that repeat that id all stay, as do rows with a null id and texts
    without words. An empty table gives an empty result.
    """
    gone = near_duplicates(docs, p, id_col, text_col).where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
