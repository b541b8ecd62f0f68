"""Tolerance clustering of breakpoint evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.columns import INVERTED, SWAPPED
from strandweave.operators.intervals import _attached, dense_join, islands
from strandweave.operators.reads import pair_regions
from strandweave.options import CallOptions
from strandweave.session import settled, ship

KEYS = ["template_id", "orientation"]


def at_places(evidence: DataFrame, by: list[str]) -> DataFrame:
    """One row for the rows of ``evidence`` that are equal in ``by``, with their number ``n`` and their ``weight``, each 1 if there is no such column."""
    n, weight = (F.sum(F.col(x) if x in evidence.columns else F.lit(1)).cast("long").alias(x) for x in ("n", "weight"))
    return evidence.groupBy(*by).agg(n, weight)


def evidence_places(evidence: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Evidence that :func:`summed` can't tell apart as one row: however deep the reads, there are no more rows than places."""
    return at_places(evidence, [*keys, "kind", "left_pos", "right_pos", *_strands(evidence)])


def _strands(rows: DataFrame) -> list[str]:
    return [x for x in ("left_reverse", "right_reverse") if x in rows.columns]


def clustered(evidence: DataFrame, tol: int, passes: int = 0, keys: list[str] = KEYS, left: tuple[str, str] = ("left_pos", "left_pos"), right: tuple[str, str] = ("right_pos", "right_pos")) -> DataFrame:
    """``evidence`` with left_island and right_island, which with the keys name a cluster.

    ``left`` and ``right`` name begin and end of each side. Rows whose left
    sides chain within the tolerance fall apart by their right sides, and so on
    by turns: ``passes`` times, or until no cluster falls apart any more. The
    result doesn't depend on the order of rows. ``evidence`` is read twice.
    """
    rows = settled(islands(evidence, keys, *left, tol, "left_island"))
    rows = islands(rows, [*keys, "left_island"], *right, tol, "right_island")
    done, names = 1, ["left_island", "right_island"]
    while not passes or done < passes:
        rows, cols = settled(rows) if done == 1 else rows, [*keys, *names]
        more = settled(islands(rows, cols, *left, tol, "__l"))
        more = settled(islands(more, [*cols, "__l"], *right, tol, "__r"))
        if not passes:
            ends = more.groupBy(*cols).agg(F.min("__l").alias("__l1"), F.max("__l").alias("__l2"), F.min("__r").alias("__r1"), F.max("__r").alias("__r2"))
            if not ends.where("__l1 < __l2 or __r1 < __r2").take(1):
                break
        rows = more.drop(*names).withColumnsRenamed({"__l": "left_island", "__r": "right_island"})
        done += 1
    return rows


def summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of :func:`evidence_places`: hull, medians, strands and support by kind (0 split, 1 pair, 2 clip).

    Support counts a row ``weight`` times, medians ``n`` times. Exact positions
    come from split and clip evidence; a group of pairs only lies between its
    hull's inner ends and is imprecise. Strands, if there are any, are those of
    the first piece of evidence by kind, position and strand.
    """
    support = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("weight"))), F.lit(0)).cast("long")
    strands = _strands(rows)
    out = rows.groupBy(*by).agg(
        F.sum("weight").cast("long").alias("supp"),
        support(0).alias("se"),
        support(1).alias("pe"),
        support(2).alias("ce"),
        F.min("left_pos").alias("min_left"),
        F.max("left_pos").alias("max_left"),
        F.min("right_pos").alias("min_right"),
        F.max("right_pos").alias("max_right"),
        *[F.min_by(x, F.struct("kind", "left_pos", "right_pos", *strands)).alias(x) for x in strands],
    )
    out = _attached(out, _medians(rows.where("kind <> 1"), by), by)
    sure = F.col("se") + F.col("ce") > 0
    return out.withColumns({"final_left": F.when(sure, F.col("mid_left")).otherwise(F.col("min_left")), "final_right": F.when(sure, F.col("mid_right")).otherwise(F.col("max_right")), "imprecise": ~sure}).drop("mid_left", "mid_right")


def _medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, mid_left, mid_right): the upper medians of the positions on either side, each counted ``n`` times."""
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"{x}_pos").cast("long").alias("pos")) for x in ("left", "right")])
    at = rows.select(*by, "n", F.inline(sides)).where("pos is not null").groupBy(*by, "side", "pos").agg(F.sum("n").alias("n"))
    one = W.partitionBy(*by, "side")
    at = at.withColumns({"__upto": F.sum("n").over(one.orderBy("pos")), "__all": F.sum("n").over(one)})
    middle = at.where("__upto - n <= __all div 2 and __all div 2 < __upto")
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("side") == x, F.col("pos"))).alias(f"mid_{x}") for x in ("left", "right")])


def breakpoints(evidence: DataFrame, tol: int, passes: int = 0, keys: list[str] = KEYS) -> DataFrame:
    """One row per cluster of ``evidence``, as :func:`summed` gives it."""
    rows = settled(evidence_places(evidence, keys))
    return summed(clustered(rows, tol, passes, keys), [*keys, "left_island", "right_island"]).drop("left_island", "right_island")


def pair_breakpoints(pairs: DataFrame, o: CallOptions, passes: int = 0) -> DataFrame:
    """Clusters of discordant pairs: (pair_id, keys, supp, left_pos, right_pos, strands, left_lo, left_hi, right_lo, right_hi).

    Ends of pairs are intervals, and cluster by the tolerance like positions;
    pairs at the same place are one row.
    The position on either side is the end of the reads that faces the
    breakpoint; around it lies the region of :func:`pair_regions`.
    """
    keys = ["template_id", "right_template", "orientation"]
    rows = pairs.select(F.col("left_template").alias("template_id"), "right_template", "orientation", "left_begin", (F.col("left_end") - 1).alias("left_last"), "right_begin", (F.col("right_end") - 1).alias("right_last"), "left_reverse", "right_reverse")
    rows = settled(at_places(rows, rows.columns))
    rows = clustered(rows, o.adj_tol, passes, keys, ("left_begin", "left_last"), ("right_begin", "right_last"))
    order = F.struct("left_begin", "right_begin", "left_reverse", "right_reverse")
    hull = rows.groupBy(*keys, "left_island", "right_island").agg(
        F.sum("n").alias("supp"), F.min("left_begin").alias("l1"), F.max("left_last").alias("l2"), F.min("right_begin").alias("r1"), F.max("right_last").alias("r2"),
        F.min_by("left_reverse", order).alias("left_reverse"), F.min_by("right_reverse", order).alias("right_reverse"),
    )
    kind, back = F.col("orientation"), F.col("left_reverse")
    left = F.when((kind == SWAPPED) | ((kind == INVERTED) & back), F.col("l1")).otherwise(F.col("l2"))
    right = F.when((kind == SWAPPED) | ((kind == INVERTED) & ~back), F.col("r2")).otherwise(F.col("r1"))
    # mates face each other, so the far end's strand counts turned round
    out = hull.select(*keys, "supp", left.cast("long").alias("left_pos"), right.cast("long").alias("right_pos"), "left_reverse", (~F.col("right_reverse")).alias("right_reverse"), F.xxhash64(*keys, "l1", "l2", "r1", "r2").alias("pair_id"))
    return pair_regions(out, o)


def pair_matches(pairs: DataFrame, bps: DataFrame, tol: int) -> DataFrame:
    """(pair_id, supp, bp_id): breakpoints of a pair's orientation and contigs whose hulls its regions meet on both sides."""
    keys = ["template_id", "right_template", "orientation"]
    a = pairs.select(*keys, "pair_id", F.col("supp").alias("pair_supp"), (F.col("left_lo") - tol).alias("p1"), (F.col("left_hi") + tol).alias("p2"), (F.col("right_lo") - tol).alias("q1"), (F.col("right_hi") + tol).alias("q2"))
    b = bps.select(*keys, "bp_id", F.col("min_left").alias("b1"), F.col("max_left").alias("b2"), F.col("min_right").alias("c1"), F.col("max_right").alias("c2"))
    hit = dense_join(settled(a), settled(b), keys, ("p1", "p2"), ("b1", "b2"), (F.col("q1") <= F.col("c2")) & (F.col("c1") <= F.col("q2")))
    return hit.select("pair_id", F.col("pair_supp").alias("supp"), "bp_id")


def linked(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to (node, label), label the smallest node reachable; nodes without links aren't listed.

    In each round a node takes the smallest label among its neighbours, and
    then the label of that label, so long chains halve with every round.
    """
    both = settled(links.where("a <> b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        near = now.join(near, now["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "seen").alias("near"))
        further = now.select(F.col("node").alias("near"), F.col("label").alias("beyond"))
        step = settled(near.join(further, "near", "left").select("node", F.least("near", "beyond").alias("label"), "was"))
        now = step.drop("was")
        if not step.where("label < was").take(1):
            return now


def with_pairs(exact: DataFrame, pairs: DataFrame | None, o: CallOptions, passes: int = 0) -> DataFrame:
    """Breakpoints of split and clip evidence, with the support of pairs, and those of pairs that match none.

    A pair's support counts for the breakpoint that its regions meet, without
    its positions; breakpoints that one pair meets become one. Pairs that meet
    none stay as imprecise breakpoints at their own position.
    """
    keys = ["template_id", "right_template", "orientation"]
    rows = clustered(settled(evidence_places(exact, keys)), o.adj_tol, passes, keys)
    rows = settled(rows.withColumn("bp_id", F.xxhash64(*keys, "left_island", "right_island")).drop("left_island", "right_island"))
    if pairs is None:
        return settled(summed(rows, [*keys, "bp_id"]))
    ends = [f(f"{x}_pos").alias(f"{n}_{x}") for x in ("left", "right") for n, f in (("min", F.min), ("max", F.max))]
    hits = settled(pair_matches(pairs, rows.groupBy(*keys, "bp_id").agg(*ends), o.adj_tol))
    shared = hits.groupBy("pair_id").agg(F.min("bp_id").alias("b"), F.max("bp_id").alias("top")).where("b < top")
    if shared.take(1):
        labels = linked(hits.join(shared.select("pair_id", "b"), "pair_id").select(F.col("bp_id").alias("a"), "b"))
        named = F.coalesce("label", "bp_id").alias("bp_id")
        rows = settled(rows.join(labels, F.col("bp_id") == F.col("node"), "left").select(*[c for c in rows.columns if c != "bp_id"], named))
        hits = hits.join(labels, F.col("bp_id") == F.col("node"), "left").select("pair_id", "supp", named).distinct()
    bps = summed(rows, [*keys, "bp_id"])
    gain = hits.groupBy("bp_id").agg(F.sum("supp").alias("__pe"))
    bps = bps.join(gain, "bp_id", "left").withColumns({"pe": F.col("pe") + F.coalesce("__pe", F.lit(0)), "supp": F.col("supp") + F.coalesce("__pe", F.lit(0))}).drop("__pe")
    rest = pairs.join(hits.select("pair_id").distinct(), "pair_id", "left_anti")
    zero = F.lit(0).cast("long")
    rough = rest.select(
        *keys, F.col("pair_id").alias("bp_id"), "supp", zero.alias("se"), F.col("supp").alias("pe"), zero.alias("ce"),
        F.col("left_pos").alias("min_left"), F.col("left_pos").alias("max_left"), F.col("right_pos").alias("min_right"), F.col("right_pos").alias("max_right"),
        F.col("left_pos").alias("final_left"), F.col("right_pos").alias("final_right"), F.lit(True).alias("imprecise"), "left_reverse", "right_reverse",
    )
    return bps.unionByName(rough)


def replayed(evidence: DataFrame, tol: int, order: str = "ev_id") -> DataFrame:
    """(template_id, orientation, cluster, supp, min_left, max_left, min_right, max_right), one record after another.

    Each record joins all clusters whose hulls, widened by the tolerance, it
    meets on both sides, and so joins them to one another; a hull that has
    grown is compared again only when a next record comes. The result depends
    on the order. A hull lies within the records that it joins, so groups that
    twice the tolerance parts on either side never meet, and what one pass of
    clustering at that tolerance parts are exact units.
    """
    ship(evidence.sparkSession)
    rows = clustered(evidence, 2 * tol, 1)
    schema = "template_id int, orientation int, cluster long, supp long, min_left long, max_left long, min_right long, max_right long"

    def replay(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hulls: list[list[int]] = []
        for ident, left, right in pdf.sort_values(order)[[order, "left_pos", "right_pos"]].itertuples(index=False):
            met = [h for h in hulls if h[2] - tol <= left <= h[3] + tol and h[4] - tol <= right <= h[5] + tol]
            rest = [h for h in hulls if h not in met]
            joined = [*met, [ident, 1, left, left, right, right]]
            low, high = [min(x) for x in zip(*joined, strict=True)], [max(x) for x in zip(*joined, strict=True)]
            hulls = [*rest, [low[0], sum(h[1] for h in joined), low[2], high[3], low[4], high[5]]]
        return pd.DataFrame([(key[0], key[1], *h) for h in hulls], columns=[x.split()[0] for x in schema.split(", ")])

    return rows.groupBy(*KEYS, "left_island", "right_island").applyInPandas(replay, schema)
