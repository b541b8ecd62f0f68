"""Clipped reads: where the sequence beyond a clip lies, by approximate search in candidate regions.

Three kinds of regions are tried in turn, the next only for clips that the one
before has placed nowhere: the far sides of breakpoints and pairs at the clip's
position; the stretch just beyond the least variant size, for small deletions;
and the far sides again with the clip's sides swapped. Of a clip's hits those
with the fewest edits count, all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.columns import INVERTED, LARGE, SWAPPED, cigar_ops, ref_length, revcomp
from strandweave.operators import seqsearch
from strandweave.operators.consensus import assembled
from strandweave.operators.intervals import bin_join, islands
from strandweave.options import CallOptions
from strandweave.session import settled


def clip_reads(reads: DataFrame, o: CallOptions) -> DataFrame:
    """(ordinal, template_id, is_left, pos, seq): each soft-clipped end of a read, with its bases.

    A left clip knows the position that follows it, a right clip the one before.
    Ends without bases give nothing.
    """
    ops = cigar_ops("cigar")
    first, last = F.get(ops, F.lit(0)), F.get(ops, F.size(ops) - 1)
    big = lambda c: (c["op"] == "S") & (c["count"] >= o.min_clip_size)
    begin = F.col("begin_pos").cast("long")
    one = F.when(big(first), F.struct(F.lit(True).alias("is_left"), begin.alias("pos"), F.left("seq", first["count"]).alias("seq")))
    two = F.when(big(last) & (F.size(ops) > 1), F.struct(F.lit(False).alias("is_left"), (begin + ref_length(ops) - 1).alias("pos"), F.right("seq", last["count"]).alias("seq")))
    ends = F.filter(F.array(one, two), lambda e: e.isNotNull() & ~F.coalesce(e["seq"], F.lit("*")).isin("", "*"))
    return reads.select("ordinal", "template_id", F.explode(ends).alias("e")).select("ordinal", "template_id", "e.*")


def clip_clusters(clips: DataFrame, tol: int, assemble: bool = False) -> DataFrame:
    """(clip_id, template_id, is_left, lo, hi, mid, supp, seq): clips of one side that chain within the tolerance.

    seq is that of the first read in file order; with ``assemble``, the
    consensus of all of them (see :func:`consensus.assembled`).
    """
    rows = islands(clips, ["template_id", "is_left"], "pos", "pos", tol, "island").withColumn("clip_id", F.xxhash64("template_id", "is_left", "island"))
    rows = settled(rows) if assemble else rows
    out = rows.groupBy("clip_id", "template_id", "is_left").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY pos DESC) as bigint)").alias("mid"), F.count("*").alias("supp"), F.min_by("seq", "ordinal").alias("seq"))
    if not assemble:
        return out
    # a right clip's bases begin at its place, a left clip's end there
    facing = F.when(F.col("is_left"), F.reverse("seq")).otherwise(F.col("seq"))
    made = assembled(rows.select("clip_id", facing.alias("seq")), "clip_id")
    return out.drop("seq").join(made, "clip_id").withColumn("seq", facing)


def targets(bps: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(left and right contig, hull of either side, orientation) of breakpoints and of pairs' candidate regions."""
    cols = ["template_id", "right_template", "orientation", "l1", "l2", "r1", "r2"]
    out = bps.select("template_id", "right_template", "orientation", F.col("min_left").alias("l1"), F.col("max_left").alias("l2"), F.col("min_right").alias("r1"), F.col("max_right").alias("r2"))
    if pairs is not None:
        out = out.unionByName(pairs.select("template_id", "right_template", "orientation", F.col("left_lo").alias("l1"), F.col("left_hi").alias("l2"), F.col("right_lo").alias("r1"), F.col("right_hi").alias("r2")))
    return out.select(*cols)


def partner_regions(clips: DataFrame, found: DataFrame, o: CallOptions, swapped: bool) -> DataFrame:
    """Regions to search for ``clips``: the far sides of what lies at their position, widened to the search size.

    A left clip lies at right sides, a right clip at left ones; swapped, the
    other way round. Only deletions and inversions are searched first, and
    duplications and inversions swapped; for inversions the clip is turned.
    """
    kinds = (SWAPPED, INVERTED) if swapped else (LARGE, INVERTED)
    out = None
    for is_left in (True, False):
        at_right = is_left != swapped
        near = found.where(F.col("orientation").isin(*kinds))
        # where the clip lies, and the side to search
        near = near.select(
            F.col("right_template" if at_right else "template_id").alias("template_id"), "orientation", (F.col("r1" if at_right else "l1") - o.adj_tol).alias("n1"), (F.col("r2" if at_right else "l2") + o.adj_tol).alias("n2"),
            F.col("template_id" if at_right else "right_template").alias("far"), F.col("l1" if at_right else "r1").alias("f1"), F.col("l2" if at_right else "r2").alias("f2"),
        )
        hit = bin_join(clips.where(F.col("is_left") == is_left), near, ["template_id"], ("lo", "hi"), ("n1", "n2"))
        out = hit if out is None else out.unionByName(hit)
    size = F.col("f2") - F.col("f1") + 1
    more = F.when(size < o.pair_search_size, F.floor((o.pair_search_size - size) / 2)).otherwise(0)
    needle = F.when(F.col("orientation") == INVERTED, revcomp("seq")).otherwise(F.col("seq"))
    return out.select("clip_id", "orientation", F.lit(swapped).alias("swapped"), F.col("far").alias("template_id"), F.greatest(F.col("f1") - more, F.lit(0)).cast("long").alias("begin_pos"), (F.col("f2") + more).cast("long").alias("end_pos"), needle.alias("needle")).distinct()


def twilight_regions(clips: DataFrame, max_insert: Column, o: CallOptions) -> DataFrame:
    """Regions of small deletions: beyond the least variant size, as far as pairs reach."""
    lo = F.when(F.col("is_left"), F.col("lo") - o.min_sv_size - max_insert).otherwise(F.col("hi") + o.min_sv_size)
    hi = F.when(F.col("is_left"), F.col("lo") - o.min_sv_size).otherwise(F.col("hi") + o.min_sv_size + max_insert)
    return clips.select("clip_id", F.lit(LARGE).alias("orientation"), F.lit(False).alias("swapped"), "template_id", F.greatest(lo, F.lit(0)).cast("long").alias("begin_pos"), F.greatest(hi, F.lit(0)).cast("long").alias("end_pos"), F.col("seq").alias("needle"))


def best_hits(regions: DataFrame, chunks: DataFrame, chunk_size: int, error: float) -> DataFrame:
    """(clip_id, orientation, swapped, template_id, begin_pos, end_pos, edits): each clip's hits with the fewest edits, in genome order's coordinates."""
    key = F.xxhash64("clip_id", "orientation", "swapped", "template_id", "begin_pos", "end_pos")
    asked = settled(regions.withColumn("rid", key))
    # by number: a region is few bytes and much work
    with_text = seqsearch.regions(chunks, asked, chunk_size).repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")
    # read twice below, and costly
    hits = settled(seqsearch.searched(with_text.select(F.col("clip_id").alias("qid"), "rid", "needle", F.upper("seq").alias("hay")), error))
    least = hits.groupBy("qid").agg(F.min("edits").alias("least"))
    best = hits.join(least, "qid").where("edits = least").join(asked.select("rid", "orientation", "swapped", "template_id", F.col("begin_pos").alias("base")), "rid")
    return best.select(F.col("qid").alias("clip_id"), "orientation", "swapped", "template_id", (F.col("base") + F.col("hit_begin")).alias("begin_pos"), (F.col("base") + F.col("hit_end")).alias("end_pos"), "edits").distinct()


def placed(clips: DataFrame, hits: DataFrame) -> DataFrame:
    """Evidence (keys, kind 2, positions, strands, weight) and where the clip's bases lie (placed_template, placed_pos, placed_size).

    One side is the clip's own position, the other the hit's end that faces it.
    """
    own = clips.select("clip_id", F.col("template_id").alias("own"), "is_left", "mid", "supp", F.length("seq").cast("long").alias("size"))
    rows = hits.join(own, "clip_id")
    kind = F.col("orientation")
    # an inversion found by swapping stands for a clip of the other side
    is_left = F.when((kind == INVERTED) & F.col("swapped"), ~F.col("is_left")).otherwise(F.col("is_left"))
    spot = seqsearch.placed_clip(kind, is_left, F.col("begin_pos"), F.col("end_pos"))
    rows = rows.withColumn("spot", spot).where("spot.left is not null or spot.right is not null")
    at_left = F.col("spot.left").isNotNull()
    turned = kind == INVERTED
    return rows.select(
        F.when(at_left, F.col("template_id")).otherwise(F.col("own")).alias("template_id"), F.when(at_left, F.col("own")).otherwise(F.col("template_id")).alias("right_template"), "orientation", F.lit(2).alias("kind"),
        F.coalesce("spot.left", "mid").alias("left_pos"), F.coalesce("spot.right", "mid").alias("right_pos"), F.when(turned, at_left).otherwise(False).alias("left_reverse"), F.when(turned, ~at_left).otherwise(False).alias("right_reverse"),
        F.col("supp").alias("weight"), F.col("template_id").alias("placed_template"), F.coalesce("spot.left", "spot.right").alias("placed_pos"), F.col("size").alias("placed_size"), "clip_id",
    )


def clip_evidence(clips: DataFrame, found: DataFrame, chunks: DataFrame, chunk_size: int, max_insert: Column, o: CallOptions) -> DataFrame:
    """What :func:`placed` gives for ``clips``, clusters of clips, beside ``found``, breakpoints and pairs as :func:`targets` lists them."""
    left, out = clips, None
    for regions in (lambda c: partner_regions(c, found, o, False), lambda c: twilight_regions(c, max_insert, o), lambda c: partner_regions(c, found, o, True)):
        hits = settled(best_hits(regions(left), chunks, chunk_size, o.clip_error_rate))
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits.select("clip_id").distinct(), "clip_id", "left_anti")
    return placed(clips, out)
