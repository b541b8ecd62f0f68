"""From alignments to evidence: routing, insert sizes, pairs, split reads and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions.columns import (
    INVERTED,
    LARGE,
    MATE_REVERSE,
    NOT_DECIDED,
    PROPER,
    REVERSE,
    SMALL,
    SUPPLEMENTARY,
    SWAPPED,
    cigar_ops,
    cigar_spans,
    discordant,
    edge_clip,
    has_flag,
    index_quantile,
    inner_gap,
    usable,
)
from strandweave.options import CallOptions
from strandweave.session import settled


def _tagged(reads: DataFrame) -> Column:
    """The read has supplementary alignments elsewhere."""
    if "tag_SA" in reads.columns:
        return F.col("tag_SA").isNotNull()
    return F.coalesce(F.map_contains_key("tags", F.lit("SA")), F.lit(False)) if "tags" in reads.columns else F.lit(False)


def routed(reads: DataFrame, o: CallOptions, max_insert: Column | float) -> DataFrame:
    """Usable reads with the booleans to_split, to_clip and to_pair.

    A primary read with supplementary alignments, a supplementary one, or one
    with a large inner gap gives split evidence; one with a clipped end, clip
    evidence; a discordant one without supplementary alignments, pair evidence.
    """
    limit = max_insert if isinstance(max_insert, Column) else F.lit(float(max_insert))
    flag = F.col("flag")
    tagged = _tagged(reads)
    ops = F.col("__ops")
    extra = has_flag(flag, SUPPLEMENTARY)
    clip = ~tagged & ~extra & edge_clip(ops, o.min_clip_size)
    gap = ~tagged & ~extra & ~clip & inner_gap(ops, o.min_sv_size)
    pair = ~tagged & ~extra & discordant(flag, has_flag(flag, MATE_REVERSE), has_flag(flag, REVERSE), F.col("tlen"), F.col("map_q"), o.min_map_q, limit)
    rows = with_ops(reads.where(usable("flag"))).withColumns({"to_split": tagged | extra | gap, "to_clip": clip & (F.col("map_q") >= o.min_map_q), "to_pair": pair})
    return rows if "__ops" in reads.columns else rows.drop("__ops")


def with_ops(reads: DataFrame) -> DataFrame:
    """``reads`` with their operations as column __ops, for expressions that look at them more than once: as a column of their own they are parsed once."""
    return reads if "__ops" in reads.columns else reads.withColumn("__ops", cigar_ops("cigar"))


def _sizes(reads: DataFrame, min_map_q: int) -> DataFrame:
    """(ordinal, size) of the proper pairs that count: mapped well enough and without supplementary alignments."""
    sure = usable("flag") & has_flag("flag", PROPER) & ~has_flag("flag", SUPPLEMENTARY) & (F.col("map_q") >= min_map_q) & ~_tagged(reads)
    return reads.where(sure).select("ordinal", F.abs("tlen").alias("size"))


def insert_bounds(reads: DataFrame, deviations: float = 9.0, sample: int = 100_000, min_map_q: int = 20) -> DataFrame:
    """One row (median, mad, low, high) over the first ``sample`` proper pairs in file order.

    A sample in file order is what the estimate is defined on. Every task keeps
    its first ones in one scan of three columns; the sizes are then at hand for
    both medians. Too few reads give what there is; none gives nulls.
    """
    proper = settled(_sizes(reads, min_map_q).orderBy("ordinal").limit(sample).select("size"))
    median = proper.agg(index_quantile("size", 0.5).alias("median"))
    off = proper.join(F.broadcast(median)).select("median", F.abs(F.col("size") - F.col("median")).alias("off"))
    mad = median.join(F.broadcast(off.agg(index_quantile("off", 0.5).alias("mad"))))
    return mad.select("median", "mad", (F.col("median") - deviations * F.col("mad")).alias("low"), (F.col("median") + deviations * F.col("mad")).alias("high"))


def insert_limit(reads: DataFrame, o: CallOptions, file_order: bool = False, sample: int = 100_000) -> float | None:
    """The upper bound of insert sizes, as ``insert_bounds``; none without proper pairs.

    With ``file_order``, for rows whose partitions follow each other in the
    file, reading stops with the partition that completes the sample.
    """
    if not file_order:
        high = insert_bounds(reads, o.insert_deviations, sample, o.min_map_q).first()["high"]
        return None if high is None else float(high)
    sizes = sorted(r["size"] for r in _sizes(reads, o.min_map_q).select("size").take(sample))  # at most ``sample`` numbers
    if not sizes:
        return None
    median = sizes[len(sizes) // 2]
    return float(median + o.insert_deviations * sorted(abs(x - median) for x in sizes)[len(sizes) // 2])


def paired(mates: DataFrame, max_insert: Column | float) -> DataFrame:
    """Both ends of each discordant pair in one row, with the orientation they show.

    Ends that face each other are LARGE if they lie further apart than
    ``max_insert``, a number or a column of each end, and else SMALL. The end with non-negative length is the left one; of ends on different
    contigs the smaller (contig, position) is. An end without its mate gives
    nothing.
    """
    limit = max_insert if isinstance(max_insert, Column) else F.lit(float(max_insert))
    side = F.struct("template_id", "begin_pos", "end_pos", "is_reverse", "tlen", "map_q", limit.alias("limit"))
    one = F.struct(F.col("template_id"), F.col("begin_pos"))
    by = mates.groupBy("qname").agg(
        F.count("*").alias("n"),
        F.max_by(side, F.struct(F.col("tlen") >= 0, F.negative("template_id"), F.negative("begin_pos"))).alias("l"),
        F.min_by(side, F.struct(F.col("tlen") >= 0, F.negative("template_id"), F.negative("begin_pos"))).alias("r"),
        F.min(one).alias("low"),
    )
    both = by.where(F.col("n") == 2)
    turned = F.when(F.col("l.template_id") != F.col("r.template_id"), NOT_DECIDED)
    turned = turned.when(F.col("l.is_reverse") == F.col("r.is_reverse"), INVERTED).when(F.col("l.is_reverse"), SWAPPED)
    turned = turned.when(F.abs("l.tlen") > F.col("l.limit"), LARGE).otherwise(SMALL)
    return both.select(
        "qname",
        F.col("l.template_id").alias("left_template"),
        F.col("r.template_id").alias("right_template"),
        F.col("l.begin_pos").alias("left_begin"),
        F.col("l.end_pos").alias("left_end"),
        F.col("r.begin_pos").alias("right_begin"),
        F.col("r.end_pos").alias("right_end"),
        F.col("l.is_reverse").alias("left_reverse"),
        F.col("r.is_reverse").alias("right_reverse"),
        turned.alias("orientation"),
    )


def split_evidence(segments: DataFrame, o: CallOptions) -> DataFrame:
    """Breakpoints between segments of a read that are neighbours on the query.

    Reads of more than ``max_split`` segments, or with a weak one, give none.
    Query spans must touch, lie within the tolerance, or overlap by no more
    than ``max_overlap``; where strands differ the second is turned round.
    """
    whole = W.partitionBy("read_id")
    me = F.struct("template_id", "ref_begin", "ref_end", "is_reverse", "q_begin", "q_end")
    # the ordered window first, so that its sort serves the others
    rows = segments.withColumn("b", F.lead(me).over(whole.orderBy("q_begin", "seg_no")))
    rows = rows.withColumns({"n": F.count("*").over(whole), "low_q": F.min("map_q").over(whole), "size": F.max("q_end").over(whole)})
    rows = rows.where((F.col("n") <= o.max_split) & (F.col("n") > 1) & (F.col("low_q") >= o.min_map_q) & F.col("b").isNotNull()).select("read_id", "size", me.alias("a"), "b")
    a, b = F.col("a"), F.col("b")
    turned = a["is_reverse"] != b["is_reverse"]
    q2b = F.when(turned, F.col("size") - b["q_end"]).otherwise(b["q_begin"])
    q2e = F.when(turned, F.col("size") - b["q_begin"]).otherwise(b["q_end"])
    shared = F.least(a["q_end"], q2e) - F.greatest(a["q_begin"], q2b)
    near = F.when(shared > 0, shared <= o.max_overlap).otherwise(-shared <= o.adj_tol)
    same = (a["template_id"] == b["template_id"]) & ~turned
    mirrored = (a["template_id"] == b["template_id"]) & turned
    forward = a["ref_begin"] < b["ref_begin"]
    before = a["ref_begin"] <= b["ref_begin"]
    lo, hi = F.when(before, a).otherwise(b), F.when(before, b).otherwise(a)
    left = F.when(same & forward, a["ref_end"]).when(same, b["ref_begin"]).when(mirrored, F.when(lo["is_reverse"], lo["ref_end"]).otherwise(lo["ref_begin"])).otherwise(a["ref_end"])
    right = F.when(same & forward, b["ref_begin"] - 1).when(same, a["ref_end"] - 1).when(mirrored, F.when(lo["is_reverse"], hi["ref_end"] - 1).otherwise(hi["ref_begin"] - 1)).otherwise(b["ref_begin"] - 1)
    kind = F.when(same & forward, LARGE).when(same, SWAPPED).when(mirrored, INVERTED).otherwise(NOT_DECIDED)
    left_reverse, right_reverse = F.when(mirrored, lo["is_reverse"]).otherwise(a["is_reverse"]), F.when(mirrored, hi["is_reverse"]).otherwise(b["is_reverse"])
    return rows.where(near).select("read_id", a["template_id"].alias("left_template"), b["template_id"].alias("right_template"), left.alias("left_pos"), right.alias("right_pos"), kind.alias("orientation"), left_reverse.alias("left_reverse"), right_reverse.alias("right_reverse"))


def cigar_evidence(reads: DataFrame, o: CallOptions) -> DataFrame:
    """(read_id, template_id, what, left_pos, right_pos): deletions and clips within single alignments."""
    spans = cigar_spans(F.col("begin_pos"), F.col("__ops"), o.min_sv_size, o.min_clip_size, o.compat_double_deletion)
    rows = with_ops(reads).select("read_id", "template_id", spans.alias("s"))
    gone = rows.select("read_id", "template_id", F.lit("deletion").alias("what"), F.inline("s.deletions").alias("left_pos", "right_pos"))
    clip = rows.select("read_id", "template_id", F.lit("clip").alias("what"), F.inline("s.clips").alias("left_pos", "right_pos"))
    return gone.unionByName(clip)


def pair_regions(pairs: DataFrame, o: CallOptions) -> DataFrame:
    """Where the breakpoint of each pair may lie: left_lo, left_hi, right_lo, right_hi.

    A side opens towards the missing sequence by the search size and away from
    it by the least variant size; an inverted pair opens both ways. Sides that
    cross are cut back.
    """
    s, w = o.min_sv_size, o.pair_search_size
    spans = {"RIGHT": (s, w), "LEFT": (w, s), "BOTH": (w, w)}

    def side(pos: str, by_orientation: Column) -> tuple[Column, Column]:
        down = F.when(by_orientation == "RIGHT", spans["RIGHT"][0]).when(by_orientation == "LEFT", spans["LEFT"][0]).otherwise(spans["BOTH"][0])
        up = F.when(by_orientation == "RIGHT", spans["RIGHT"][1]).when(by_orientation == "LEFT", spans["LEFT"][1]).otherwise(spans["BOTH"][1])
        return F.greatest(F.col(pos) - down, F.lit(0)), F.col(pos) + up

    kind = F.col("orientation")
    open_left = F.when(kind == INVERTED, "BOTH").when(kind == SWAPPED, "LEFT").otherwise("RIGHT")
    open_right = F.when(kind == INVERTED, "BOTH").when(kind == SWAPPED, "RIGHT").otherwise("LEFT")
    (ll, lh), (rl, rh) = side("left_pos", open_left), side("right_pos", open_right)
    out = pairs.withColumns({"left_lo": ll, "left_hi": lh, "right_lo": rl, "right_hi": rh})
    crossed = F.col("left_hi") > F.col("right_pos")
    out = out.withColumn("__lh", F.when(crossed, F.col("right_pos") - 1).otherwise(F.col("left_hi")))
    out = out.withColumn("right_lo", F.when(F.col("right_lo") < F.col("left_pos"), F.col("left_pos") + 1).otherwise(F.col("right_lo")))
    return out.withColumn("left_hi", F.col("__lh")).drop("__lh")
