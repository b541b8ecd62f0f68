"""The ``call`` command: alignments to variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.columns import REVERSE, cigar_spans, has_flag, read_end_name, ref_length, status_text
from strandweave.operators import calls, clips, cluster, depth, reads, seqsearch
from strandweave.operators.intervals import coverage
from strandweave.options import CallOptions
from strandweave.session import forget, settled, stored
from strandweave.sources import vcf

#: Contigs are broadcast by their number only up to so many.
MANY_CONTIGS = 100_000


def routed_reads(alignments: DataFrame, o: CallOptions, file_order: bool = False) -> DataFrame:
    """Usable alignments of contigs, from one scan, with what evidence needs of them.

    (template_id, begin_pos, end_pos) for the depth; to_split, to_clip, to_pair
    and max_insert, the estimated upper bound of insert sizes (null without
    proper pairs). Names and lengths stay only where a read gives evidence,
    operations and bases only where it is clipped; of split reads there are the
    spans that their operations give (ref_end, q_begin, q_end, deletions), so
    that operations are taken apart in this scan alone.
    """
    limit = reads.insert_limit(alignments, o, file_order)
    rows = reads.routed(reads.with_ops(alignments.where("rid is not null and rid >= 0")), o, float("inf") if limit is None else limit)
    some = F.col("to_split") | F.col("to_clip") | F.col("to_pair")
    kept = {c: F.when(F.col("to_clip") if c == "cigar" else some, F.col(c)).alias(c) for c in ("ordinal", "qname", "cigar", "flag", "map_q", "tlen", "next_rid")}
    every = cigar_spans(F.col("begin_pos"), F.col("__ops"), o.min_sv_size, o.min_clip_size, o.compat_double_deletion)
    spans = [F.when(F.col("to_split"), every[x]).alias(x) for x in ("ref_end", "q_begin", "q_end", "deletions")]
    end = (F.col("begin_pos") + ref_length(F.col("__ops"))).cast("long").alias("end_pos")
    bases = F.when(F.col("to_clip"), F.col("seq")).alias("seq") if o.use_clips else F.lit(None).cast("string").alias("seq")
    return rows.select(F.col("rid").alias("template_id"), "begin_pos", end, *kept.values(), *spans, bases, "to_split", "to_clip", "to_pair", F.lit(limit).cast("double").alias("max_insert"))


def exact_evidence(routed: DataFrame, o: CallOptions) -> DataFrame:
    """Split reads and deletions within reads: (template_id, right_template, orientation, kind, left_pos, right_pos, left_reverse, right_reverse, weight)."""
    rows = routed.where("to_split").withColumn("is_reverse", has_flag("flag", REVERSE))
    parts = rows.select(read_end_name("qname", "flag").alias("read_id"), "template_id", F.col("ordinal").alias("seg_no"), F.col("begin_pos").cast("long").alias("ref_begin"), "ref_end", "is_reverse", "q_begin", "q_end", "map_q")
    split = reads.split_evidence(parts, o).withColumnRenamed("left_template", "template_id").withColumn("kind", F.lit(0))
    gone = rows.where(F.col("map_q") >= o.min_map_q).select("template_id", "is_reverse", F.inline("deletions").alias("left_pos", "right_pos"))
    gone = gone.select("template_id", F.col("template_id").alias("right_template"), F.lit(0).alias("orientation"), F.lit(0).alias("kind"), "left_pos", "right_pos", F.col("is_reverse").alias("left_reverse"), F.col("is_reverse").alias("right_reverse"))
    return split.select(*gone.columns).unionByName(gone).withColumn("weight", F.lit(1).cast("long"))


def pair_evidence(routed: DataFrame, o: CallOptions) -> DataFrame:
    """Clusters of discordant pairs whose both ends lie on contigs."""
    ends = routed.where("to_pair and next_rid is not null and next_rid >= 0")
    ends = ends.select("qname", "template_id", "begin_pos", "end_pos", has_flag("flag", REVERSE).alias("is_reverse"), "tlen", "map_q", F.coalesce("max_insert", F.lit(float("inf"))).alias("max_insert"))
    return cluster.pair_breakpoints(reads.paired(ends, F.col("max_insert")), o)


def clip_places(routed: DataFrame, exact: DataFrame, pairs: DataFrame | None, chunks: DataFrame, chunk_size: int, o: CallOptions) -> DataFrame:
    """Evidence from clipped sequences found again in the reference, with the places of their bases."""
    bounds = routed.select(F.floor("max_insert").cast("long").alias("max_insert")).limit(1)
    found = clips.clip_clusters(clips.clip_reads(routed.where("to_clip"), o), o.adj_tol, o.assemble_clips)
    found = settled(found.join(F.broadcast(bounds)))
    known = clips.targets(cluster.breakpoints(exact, o.adj_tol, 0, ["template_id", "right_template", "orientation"]), pairs)
    return clips.clip_evidence(found, settled(known), chunks, chunk_size, F.coalesce("max_insert", F.lit(0)), o)


def merged_breakpoints(routed: DataFrame, o: CallOptions = CallOptions(), chunks: DataFrame | None = None, chunk_size: int = 65536) -> tuple[DataFrame, DataFrame | None]:
    """(breakpoints with the support of all kinds of evidence, places of clipped bases or none).

    ``routed`` should be stored. Pairs raise the support of breakpoints that
    their regions meet; those that meet none are imprecise breakpoints. Clipped
    sequences need ``chunks``, the reference.
    """
    exact = settled(cluster.evidence_places(exact_evidence(routed, o), ["template_id", "right_template", "orientation"]))
    pairs = settled(pair_evidence(routed, o)) if o.use_pairs else None
    placed = None
    if o.use_clips and chunks is not None:
        placed = settled(clip_places(routed, exact, pairs, chunks, chunk_size, o))
        exact = exact.unionByName(placed.withColumn("n", F.lit(1).cast("long")).select(exact.columns))
    return settled(cluster.with_pairs(exact, pairs, o)), placed


def call(alignments: DataFrame, contigs: DataFrame, o: CallOptions = CallOptions(), chunks: DataFrame | None = None, chunk_size: int = 65536, file_order: bool = False) -> DataFrame:
    """Variants of one sample: sv_type, chrom, begin_pos, end_pos, target_pos, status, alt, evidence, sc, sv_id.

    ``alignments`` has the columns of the ``bam`` source, ``contigs``
    (template_id, name, length); ``chunks`` the reference, without which
    clipped sequences aren't searched and sequence features are left out.
    Alignments without a contig count for nothing. The alignments are scanned
    once, after a first look at insert sizes that stops early if ``file_order``
    says that partitions follow each other in the file.
    """
    contigs = settled(contigs)
    routed = stored(routed_reads(alignments, o, file_order), "reads")
    bps, placed = merged_breakpoints(routed, o, chunks, chunk_size)

    limits = {"re": o.depth_threshold, "depth": None}
    if o.use_depth:
        cover = routed.select("template_id", F.col("begin_pos").cast("long").alias("begin_pos"), "end_pos")
        if placed is not None:
            more = placed.select(F.col("placed_template").alias("template_id"), F.col("placed_pos").alias("begin_pos"), (F.col("placed_pos") + F.col("placed_size")).alias("end_pos"), "weight")
            rle = settled(depth.with_placements(cover, more, "template_id", "begin_pos", "end_pos", "weight"))
        else:
            rle = settled(coverage(cover, "template_id", "begin_pos", "end_pos"))
        lengths = contigs.select("template_id", F.col("length").cast("long").alias("length"))
        bps = settled(depth.breakpoint_depth(rle, bps, lengths, o.depth_window))
        shares = bps.groupBy("template_id").agg(F.count("*").alias("n"))
        sampled = settled(depth.background(rle, lengths, shares, o.depth_samples, o.depth_window))
        limits = {"re": depth.outlier_threshold(sampled, "re", o.depth_threshold).first()["threshold"], "depth": depth.outlier_threshold(sampled, "depth", o.depth_outlier).first()["threshold"]}
    else:
        bps = bps.withColumns({"re": F.lit(None).cast("double"), "rd": F.lit(None).cast("double")})
    # without any background nothing can stand out
    bps = settled(calls.voted(bps, o, float("inf") if limits["re"] is None else limits["re"]))

    local = bps.where("template_id = right_template")
    dels = calls.deletions(local, o, limits["depth"])
    dups, dels = calls.duplications(local, dels, o)
    dups = calls.translocations(dups, o)
    found = calls.inversions(local, o).unionByName(dels).unionByName(dups.select(dels.columns))
    names = contigs.select("template_id", F.col("name").alias("chrom"))
    found = found.join(F.broadcast(names) if names.count() <= MANY_CONTIGS else names, "template_id").withColumn("no", F.lit(None).cast("int"))
    found = found.withColumn("alt", F.concat(F.lit("<"), "sv_type", F.lit(">")))
    none = F.lit(None).cast("long")
    ends = calls.breakends(bps, contigs).withColumns({"sv_type": F.lit("BND"), "end_pos": none, "target_pos": none, "status": F.lit("PASS")})
    every = settled(found.unionByName(ends.select(found.columns)))
    every = calls.ranked(every) if o.rank_aggregation else calls.by_evidence(every)
    if chunks is not None:
        every = every.join(seqsearch.sequence_features(chunks, bps, chunk_size), "bp_id", "left")
    every = calls.numbered(settled(every))
    forget(routed)
    return every if o.report_filtered else every.where("status = 'PASS'")


def as_records(variants: DataFrame) -> DataFrame:
    """Rows for :func:`strandweave.sources.vcf.write_vcf`."""
    names = ("SC", "VT", "SE", "PE", "CE", "RE", "RD") + (("GC", "CP") if "gc" in variants.columns else ())
    source = {"GC": "gc", "CP": "complexity"}
    fields = {k: F.coalesce(F.col(source.get(k, k.lower())), F.lit(0)) for k in names}
    info = vcf.info_text(F.col("sv_type"), F.col("begin_pos"), F.col("end_pos"), F.col("target_pos"), fields)
    info = F.when(F.col("imprecise"), F.concat(info, F.lit(";IMPRECISE"))).otherwise(info)
    return variants.select("chrom", "begin_pos", "end_pos", F.col("sv_id").alias("id"), "alt", status_text("status").alias("filter"), info.alias("info"), F.array(F.lit("1/0")).alias("genotypes"))
