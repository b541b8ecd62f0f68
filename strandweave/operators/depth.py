"""Read depth around breakpoints: window means, divergence, background thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.columns import EPSILON, index_quantile, poisson_divergence
from strandweave.operators.intervals import COARSE, as_of, bin_join, coverage


def with_placements(reads: DataFrame, placed: DataFrame, key: str, begin: str, end: str, weight: str) -> DataFrame:
    """Depth of reads and of placed clips, each weighted by its support."""
    one = reads.select(key, begin, end, F.lit(1).cast("long").alias("__w"))
    more = placed.select(key, begin, end, F.col(weight).cast("long").alias("__w"))
    return coverage(one.unionByName(more), key, begin, end, F.col("__w"))


def window_bounds(pos: Column, length: Column, window: int | Column, span: int | Column, left: bool) -> tuple[Column, Column, Column]:
    """(begin, position, end) of the half-open windows on either side of a position, clamped to the contig."""
    p = F.least(pos, length - 1)
    down, up = (window, span) if left else (span, window)
    down, up = (F.lit(x) if isinstance(x, int) else x for x in (down, up))
    begin = F.when(p > down, p - down).otherwise(0)
    end = F.when(p < length - up - 1, p + up + 1).otherwise(length - 1)
    return begin, p, end


def window_means(depth: DataFrame, points: DataFrame, lengths: DataFrame, key: str, pid: str, pos: str, window: int | str, span: int | str, left: bool = True) -> DataFrame:
    """(pid, key, left_mean, right_mean) of depth before and after each position; windows are numbers or columns of ``points``.

    A window's sum is the difference of the depth's integral at its ends, so
    its width costs nothing. Points with the same windows are one row until
    their means are known, so a task has no more rows than there are positions.
    """
    wide = sorted({x for x in (window, span) if isinstance(x, str)})
    spot = [key, pos, *wide]
    places = points.select(*spot).distinct().select(F.struct(*spot).alias("__place"), *spot)
    means = _means_at(depth, places, lengths, key, "__place", pos, window, span, left)
    return points.select(pid, key, F.struct(*spot).alias("__place")).join(means.drop(key), "__place").drop("__place")


def _means_at(depth: DataFrame, points: DataFrame, lengths: DataFrame, key: str, pid: str, pos: str, window: int | str, span: int | str, left: bool) -> DataFrame:
    rows = points.join(lengths, key)
    window, span = (F.col(x) if isinstance(x, str) else x for x in (window, span))
    b, p, e = window_bounds(F.col(pos), F.col("length"), window, span, left)
    rows = rows.select(pid, key, b.cast("long").alias("b"), p.cast("long").alias("p"), e.cast("long").alias("e"))
    bounds = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(x).alias("x")) for i, x in enumerate("bpe")])).alias("o")
    asked = rows.select(pid, key, "b", "p", "e", bounds).select(pid, key, "b", "p", "e", "o.at", F.col("o.x").alias("__pos"))
    known = integral(depth, key).select(key, F.col("start").alias("__pos"), F.struct("start", "stop", "depth", "cum").alias("run"))
    run = F.col("run")
    total = F.coalesce(run["cum"] + (F.least(F.col("__pos"), run["stop"]) - run["start"]) * run["depth"], F.lit(0))
    at = as_of(known, asked, key, "__pos", "run").groupBy(pid, key, "b", "p", "e").agg(*[F.max(F.when(F.col("at") == i, total)).alias(f"i{i}") for i in range(3)])
    mean = lambda sum_, n: F.greatest(sum_, F.lit(0)) / (n + EPSILON)
    return at.select(pid, key, mean(F.col("i1") - F.col("i0"), F.greatest(F.col("p") - F.col("b"), F.lit(0))).alias("left_mean"), mean(F.col("i2") - F.col("i1"), F.greatest(F.col("e") - F.col("p"), F.lit(0))).alias("right_mean"))


def integral(depth: DataFrame, key: str, coarse: int = COARSE) -> DataFrame:
    """``depth`` with cum, the depth summed over all positions before each run: within coarse bins, then across them."""
    area = (F.col("stop") - F.col("start")) * F.col("depth")
    rows = depth.withColumn("__bin", F.floor(F.col("start") / coarse))
    per_bin = rows.groupBy(key, "__bin").agg(F.sum(area).alias("__sum"))
    carried = per_bin.select(key, "__bin", (F.sum("__sum").over(W.partitionBy(key).orderBy("__bin")) - F.col("__sum")).alias("__carry"))
    local = W.partitionBy(key, "__bin").orderBy("start")
    return rows.join(carried, [key, "__bin"]).withColumn("cum", F.col("__carry") + F.sum(area).over(local) - area).drop("__bin", "__carry")


def divergence(left: Column, right: Column) -> Column:
    """Divergence with the larger mean first."""
    return poisson_divergence(F.greatest(left, right), F.least(left, right))


def breakpoint_depth(depth: DataFrame, bps: DataFrame, lengths: DataFrame, window: int) -> DataFrame:
    """``bps`` with re, the larger divergence of its two ends, and rd, the mean of the depths outside of it.

    The window is cut to the variant's size if both ends lie on one contig.
    """
    apart = F.abs(F.col("final_right") - F.col("final_left")) + 1
    sized = bps.withColumn("__w", F.when(F.col("template_id") == F.col("right_template"), F.least(apart, F.lit(window))).otherwise(F.lit(window)))
    left = window_means(depth, sized.select("bp_id", "template_id", F.col("final_left").alias("pos"), "__w"), lengths, "template_id", "bp_id", "pos", "__w", "__w")
    right = window_means(depth, sized.select("bp_id", F.col("right_template").alias("template_id"), F.col("final_right").alias("pos"), "__w"), lengths, "template_id", "bp_id", "pos", "__w", "__w", left=False)
    score = divergence(F.col("left_mean"), F.col("right_mean"))
    scores = left.select("bp_id", F.col("left_mean").alias("__lo"), score.alias("__ls")).join(right.select("bp_id", F.col("right_mean").alias("__ro"), score.alias("__rs")), "bp_id")
    return bps.join(scores, "bp_id", "left").withColumns({"re": F.greatest("__ls", "__rs"), "rd": (F.col("__lo") + F.col("__ro")) / 2}).drop("__lo", "__ls", "__ro", "__rs")


def background(depth: DataFrame, lengths: DataFrame, shares: DataFrame, samples: int, window: int) -> DataFrame:
    """(re, depth) at background positions that have any depth around them."""
    points = background_positions(lengths, "template_id", shares, samples).distinct().withColumn("pid", F.xxhash64("template_id", "pos"))
    means = window_means(depth, points, lengths, "template_id", "pid", "pos", window, window)
    rows = means.select(divergence(F.col("left_mean"), F.col("right_mean")).alias("re"), ((F.col("left_mean") + F.col("right_mean")) / 2).alias("depth"))
    return rows.where("depth > 0")


def background_positions(lengths: DataFrame, key: str, shares: DataFrame, samples: int) -> DataFrame:
    """(key, pos): an arithmetic sequence of positions per contig, as many as its share of breakpoints asks for.

    ``shares(key, n)`` has the breakpoints of each contig. Deterministic, and
    spread over the contig by a multiplicative step.
    """
    total = shares.agg(F.sum("n").alias("all"))
    count = F.ceil(F.lit(samples) * F.col("n") / F.col("all")).cast("int")
    each = shares.join(F.broadcast(total)).join(lengths, key).select(key, "length", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return each.select(key, ((F.col("i").cast("long") * 48271 + 11) % F.col("length")).alias("pos"))


def outlier_threshold(df: DataFrame, value: str, k: float) -> DataFrame:
    """One row (q1, median, q3, threshold): the third quartile and k times the interquartile range."""
    q = df.agg(index_quantile(value, 0.25).alias("q1"), index_quantile(value, 0.5).alias("median"), index_quantile(value, 0.75).alias("q3"))
    return q.withColumn("threshold", F.col("q3") + k * (F.col("q3") - F.col("q1")))
