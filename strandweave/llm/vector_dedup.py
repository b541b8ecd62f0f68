"""Near-duplicate vectors by NN-descent.

1. Equal vectors become one node with a count.
2. A first neighbour graph comes from random-hyperplane leaves; leaves above a
   size are dealt into blocks, differently in each tree.
3. Rounds of descent join the neighbours of each node's neighbourhood with one
   another and keep each node's nearest.
4. Pairs at the threshold become links: of each neighbourhood a spanning forest
   of them, so their number stays linear in the rows.
5. A list full of linked neighbours says nothing of those beyond it. Lists are
   therefore enlarged to the whole component, compared in blocks in double
   precision, which yields every node's number of links.
6. An audit compares samples of nodes with all nodes, drawn by the size of
   their component and judged by their number of links, so that large groups
   don't stand for small ones. While any class is short of the target, lists
   grow and descent goes on. Where that would cost more than comparing all with
   all, or the rounds are used up, an exact pass finds the links that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.common import BROADCAST_LIMIT_BYTES, batches, join_once, stage, unstage
from strandweave.llm.graph import components


@dataclass(frozen=True)
class Descent:
    """Parameters. Of each class of component sizes about ``audit`` nodes are compared with all, of nodes
    without links eight times as many; ``block`` rows of a component are compared at once, ``chunk_bytes``
    of vectors with all in the exact pass.
    """

    threshold: float = 0.95
    neighbours: int = 8
    trees: int = 5
    leaf: int = 96
    rounds: int = 2
    more_rounds: int = 3
    audit: int = 512
    recall: float = 0.99
    block: int = 256
    seed: int = 5
    chunk_bytes: int = BROADCAST_LIMIT_BYTES


def _unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; vectors that can't be compared go."""
    for rb in it:
        ids, out = [], []
        for i, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.asarray(v, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            top = np.abs(x).max()
            if top > 0:
                x = x / top
                ids.append(i)
                out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "vec"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one width; shorter vectors count as padded with zeros."""
    found = [np.frombuffer(b, dtype=np.float64) for b in column.to_pylist()]
    width = max(map(len, found), default=0)
    out = np.zeros((len(found), width))
    for row, v in zip(out, found, strict=True):
        row[: len(v)] = v
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs marked in a square matrix."""
    left, out = np.ones(len(near), dtype=bool), []
    for root in range(len(near)):
        if not left[root] or not near[root].any():
            continue
        left[root], todo = False, [root]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x] & left):
                left[y] = False
                out.append((x, int(y)))
                todo.append(int(y))
    return out


_EDGES = "u long, v long, sim float, link boolean"


def _join(ids: np.ndarray, vec: np.ndarray, k: int, t: float, out: tuple[list, ...]) -> None:
    """Append each node's k nearest of the group, and a spanning forest of the pairs at the threshold.

    Nearest by single precision; links by double.
    """
    single = vec.astype(np.float32)
    sims = single @ single.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(ids)), k)
    col = top.ravel()
    out[0].append(ids[row])
    out[1].append(ids[col])
    out[2].append(sims[row, col])
    out[3].append(np.zeros(len(row), dtype=bool))
    close = np.flatnonzero((sims >= t - 1e-4).any(axis=1))
    if len(close):
        near = vec[close] @ vec[close].T >= t
        np.fill_diagonal(near, False)
        pairs = close[np.array(_forest(near), dtype=np.int64).reshape(-1, 2)]
        out[0].append(ids[pairs[:, 0]])
        out[1].append(ids[pairs[:, 1]])
        out[2].append(sims[pairs[:, 0], pairs[:, 1]])
        out[3].append(np.ones(len(pairs), dtype=bool))


def _edges(out: tuple[list, ...]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.float32(), pa.bool_())
    return pa.table([pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(out, kinds, strict=True)], names=["u", "v", "sim", "link"])


def _leaves(nodes: DataFrame, p: Descent, bits: int) -> DataFrame:
    """(tree, leaf, id, vec): which leaf each node falls into, by signs of random projections."""

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            x = _matrix(rb.column("vec"))
            for tree in range(p.trees):
                plane = np.random.default_rng([p.seed, tree, x.shape[1]]).normal(size=(x.shape[1], bits))
                code = ((x @ plane > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(code), pa.int32()), pa.array(code), rb.column("id"), rb.column("vec")], names=["tree", "leaf", "id", "vec"])

    return nodes.select("id", "vec").mapInArrow(place, "tree int, leaf long, id long, vec binary")


def _first_graph(nodes: DataFrame, count: int, p: Descent) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1, count / p.leaf)))))
    placed = stage(_leaves(nodes, p, bits), "leaves")
    size = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * p.leaf)).alias("parts"), F.count("*").alias("weight"))
    dealt = join_once(placed, size, ["tree", "leaf"], "weight", p.trees * count).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))

    def compare(t: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        _join(np.asarray(t["id"]), _matrix(t["vec"]), p.neighbours, p.threshold, out)
        return _edges(out)

    return dealt.select("tree", "leaf", "part", "id", "vec").groupBy("tree", "leaf", "part").applyInArrow(compare, _EDGES)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k nearest, without repeats."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _descend(nodes: DataFrame, graph: DataFrame, k: int, count: int, p: Descent) -> DataFrame:
    """One round: within each node's neighbourhood, forward and backward, all are compared with all."""
    order = W.partitionBy("v").orderBy(F.desc("sim"), "u")
    backward = graph.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(F.col("v").alias("x"), F.col("u").alias("id"))
    around = graph.select(F.col("u").alias("x"), F.col("v").alias("id")).unionByName(backward)
    around = around.unionByName(nodes.select(F.col("id").alias("x"), "id")).distinct()
    group = F.pmod(F.xxhash64("x"), F.lit(max(8, count // 256)))
    rows = around.join(nodes.select("id", "vec"), "id").select(group.alias("g"), "x", "id", "vec")

    def compare(t: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        t = t.sort_by("x")
        x, ids = np.asarray(t["x"]), np.asarray(t["id"])
        vec = _matrix(t["vec"])
        cuts = np.flatnonzero(np.diff(x, prepend=x[0] - 1, append=x[-1] + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            _join(ids[a:b], vec[a:b], 4, p.threshold, out)
        return _edges(out)

    return rows.groupBy("g").applyInArrow(compare, _EDGES)


def _counted(nodes: DataFrame, labels: DataFrame, count: int, p: Descent) -> DataFrame:
    """(id, others): links of each node to rows of other nodes, over its whole component, in blocks."""
    member = nodes.join(labels, nodes["id"] == labels["node"]).select("component", "id", "vec", "times")
    parts = labels.groupBy("component").agg(F.ceil(F.count("*") / p.block).cast("int").alias("parts"), F.count("*").alias("weight"))
    dealt = join_once(member, parts, ["component"], "weight", count).drop("weight").withColumn("b", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    rows = dealt.select("component", "id", "vec", "times", "parts", "b", pair).select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "vec", "times", "parts")
    # components of one block share groups, as many as keep a group to about 2,048 rows; larger ones have a group for each pair of blocks
    rows = rows.withColumn("g", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(max(64, count // 2048)))).otherwise(F.xxhash64("component", "i", "j")))

    def links(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("i", "ascending"), ("j", "ascending")])
        keys = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("component", "i", "j")])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [keys.shape[1]]])
        ids, got = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = t.slice(a, b - a)
            x, times, side, own = _matrix(part["vec"]), np.asarray(part["times"]), np.asarray(part["b"]), np.asarray(part["id"])
            for k in range(0, len(x), 512):
                near = x[k : k + 512] @ x.T >= p.threshold
                near[np.arange(near.shape[0]), np.arange(k, k + near.shape[0])] = False
                if keys[1, a] != keys[2, a]:
                    near &= side[k : k + 512, None] != side[None, :]
                ids.append(own[k : k + 512])
                got.append(near @ times)
        return pa.table([pa.array(np.concatenate(ids)), pa.array(np.concatenate(got).astype(np.int64))], names=["id", "others"])

    found = rows.drop("parts").groupBy("g").applyInArrow(links, "id long, others long")
    return found.groupBy("id").agg(F.sum("others").alias("others"))


def _recall(nodes: DataFrame, labels: DataFrame, counted: DataFrame, count: int, p: Descent) -> float:
    """Least share, over classes of link counts, of a node's links that were found, by comparing samples with all nodes.

    Samples are drawn by component size, and weighted by how many nodes each stands for.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).withColumn("weight", F.col("size"))
    sized = join_once(labels, sizes, ["component"], "weight", count).select(F.col("node").alias("id"), F.floor(F.log2("size")).cast("int").alias("s"))
    placed = nodes.select("id", "vec").join(sized, "id", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    many = {r["s"]: r["count"] for r in placed.groupBy("s").count().collect()}
    if not many:
        return 1.0
    # about audit nodes of each class, by a hash of the id
    share = F.create_map(*[F.lit(x) for c, n in many.items() for x in (c, min(1.0, p.audit * (8 if c == 0 else 1) / n))])
    drawn = placed.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) < F.element_at(share, F.col("s")) * float(1 << 30))
    mine = drawn.select("id", "vec", "s").toArrow()
    if not mine.num_rows:
        return 1.0
    asked, ids, strata = _matrix(mine["vec"]), np.asarray(mine["id"]), np.asarray(mine["s"])

    def true_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for rb in it:
            x = _matrix(rb.column("vec"))
            width = max(x.shape[1], asked.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, asked))
            near = (y @ x.T >= p.threshold) & (ids[:, None] != np.asarray(rb.column("id"))[None, :])
            total += near @ np.asarray(rb.column("times"))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "true"])

    true = nodes.mapInArrow(true_links, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    rows = true.where(F.col("true") > 0).join(counted, "id", "left").select("id", "true", F.least("true", F.coalesce("others", F.lit(0))).alias("found")).toArrow()
    if not rows.num_rows:
        return 1.0
    stands = {s: many[s] / n for s, n in zip(*np.unique(strata, return_counts=True), strict=True)}
    weight_of = dict(zip(ids.tolist(), (stands[s] for s in strata), strict=True))
    wanted, share = np.asarray(rows["true"]), np.asarray(rows["found"]) / np.asarray(rows["true"])
    weight, kind = np.array([weight_of[i] for i in rows["id"].to_pylist()]), np.floor(np.log2(wanted)).astype(int)
    return float(min(np.average(share[kind == c], weights=weight[kind == c]) for c in np.unique(kind)))


def _chunks(nodes: DataFrame, count: int, p: Descent) -> int:
    """Chunks in which the exact pass takes the nodes."""
    total = nodes.agg(F.sum(F.length("vec") + F.lit(8))).first()[0] or 0
    return max(1, min(count, -(-total // p.chunk_bytes)))


def _all_links(nodes: DataFrame, parts: int, p: Descent) -> DataFrame:
    """(u, v): links that join all that are at the threshold, from comparing all nodes with each chunk in double precision.

    A task keeps which nodes of the chunk it has joined, so it makes no more links than it has rows and the chunk nodes.
    """
    out = None
    for part in range(parts):
        mine = nodes.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select("id", "vec").toArrow()
        if not mine.num_rows:
            continue

        def compare(it: Iterator[pa.RecordBatch], own=np.asarray(mine["id"]), vec=_matrix(mine["vec"])) -> Iterator[pa.RecordBatch]:  # noqa: B008
            label, single = np.arange(len(own)), vec.astype(np.float32)
            for rb in it:
                x, ids = _matrix(rb.column("vec")), np.asarray(rb.column("id"))
                width = min(x.shape[1], vec.shape[1])
                u, v = [], []
                for k in range(0, len(x), 256):
                    y, here = x[k : k + 256, :width], ids[k : k + 256]
                    maybe = y.astype(np.float32) @ single[:, :width].T >= p.threshold - 1e-4
                    maybe &= here[:, None] != own[None, :]
                    for r in np.flatnonzero(maybe.any(axis=1)):
                        cols = np.flatnonzero(maybe[r])
                        cols = cols[vec[cols, :width] @ y[r] >= p.threshold]
                        if not len(cols):
                            continue
                        groups, first = np.unique(label[cols], return_index=True)
                        u += [here[r]] * len(first)
                        v += own[cols[first]].tolist()
                        if len(groups) > 1:
                            label[np.isin(label, groups)] = groups[0]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        found = stage(nodes.select("id", "vec").mapInArrow(compare, "u long, v long"), "links")
        out = found if out is None else out.unionByName(found)
    return out


def near_vectors(vectors: DataFrame, p: Descent = Descent(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept).

    Links two vectors with cosine of at least the threshold. Vectors that are
    null, empty, zero, or hold null or non-finite components link with
    nothing. A shorter vector counts as padded with zeros. Equal vectors link.
    Rows that repeat an id count as further vectors of that id and share its
    component. A row with a null id links with nothing and is kept. Ties
    among neighbours don't matter, since every link counts. Other columns
    aren't read, so their names can't clash. An empty table gives an empty result.
    """
    batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    unit = stage(rows.mapInArrow(_unit, "id long, vec binary"), "unit")
    nodes = stage(unit.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("times")), "vectors")
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    # a vector that very many rows hold would be a hot key
    members = join_once(unit, nodes.select("vec", F.col("id").alias("rep"), F.col("times").alias("weight"), "times"), ["vec"], "weight", total).select("id", "rep", "times")

    k = p.neighbours
    found = stage(_first_graph(nodes, count, p), "graph")
    graph = stage(_nearest(found, k), "graph")
    links = stage(found.where("link").select("u", "v").distinct(), "links")
    labels, counted = None, None
    for turn in range(1 + p.more_rounds):
        for _ in range(p.rounds if turn == 0 else 1):
            if not graph.take(1):
                break
            new = stage(_descend(nodes, graph, k, count, p), "graph")
            old = [found, graph, links]
            links = stage(links.unionByName(new.where("link").select("u", "v")).distinct(), "links")
            graph, found = stage(_nearest(graph.unionByName(new.select("u", "v", "sim")), k), "graph"), new
            for t in old:
                unstage(t)
        labels = stage(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))), "labels")
        counted = stage(_counted(nodes, labels, count, p), "counted")
        if _recall(nodes, labels, counted, count, p) >= p.recall:
            break
        parts = _chunks(nodes, count, p)
        # a round reads each vector some 4 * k times, the exact pass once for each chunk
        if turn == p.more_rounds or parts <= 4 * k:
            every = links.unionByName(_all_links(nodes, parts, p))
            labels = stage(components(every.select(F.col("u").alias("a"), F.col("v").alias("b"))), "labels")
            counted = stage(_counted(nodes, labels, count, p), "counted")
            break
        k *= 2

    own = members.join(labels, members["rep"] == labels["node"], "left").join(counted.withColumnRenamed("id", "rep"), "rep", "left")
    own = own.groupBy("id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"),
        F.max(F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"),
    )
    out = rows.select("id").join(own, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
