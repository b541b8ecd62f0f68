"""The ``merge`` command: call sets of several samples to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import merge as ops
from strandweave.operators.intervals import in_order
from strandweave.options import MergeOptions
from strandweave.session import settled
from strandweave.sources import vcf


def merged(spark: SparkSession, paths: list[str], o: MergeOptions = MergeOptions()) -> DataFrame:
    """Multi-sample records (chrom, begin_pos, end_pos, id, alt, filter, info, genotypes) in VCF form."""
    rows = vcf.read_vcf(spark, paths, o.use_all).where("sv_type <> 'BND'")
    gt = F.coalesce(F.get("genotypes", F.lit(0)), F.lit("0/0"))
    svs = rows.select(F.xxhash64("dataset_idx", "ordinal").alias("sv"), "sv_type", "chrom", "begin_pos", "end_pos", "target_pos", F.coalesce("sc", F.lit(0.0)).alias("sc"), F.coalesce("rd", F.lit(0.0)).alias("rd"), "dataset_idx", "ordinal", gt.alias("gt"))
    return records(settled(svs), len(paths), o)


def records(svs: DataFrame, samples: int, o: MergeOptions = MergeOptions()) -> DataFrame:
    """The records of :func:`merged` from variants ``svs(sv, sv_type, chrom, begin_pos, end_pos, target_pos, sc, rd, dataset_idx, ordinal, gt)``."""
    spark = svs.sparkSession
    members = settled(ops.first_fit(svs, o.overlap))
    each = ops.cluster_summary(members)
    target = members.where("target_pos is not null").groupBy("cluster").agg(F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY target_pos DESC) as bigint)").alias("target_pos"), F.max("target_pos").alias("in_target"), F.min("target_pos").alias("out_target"))
    every = spark.range(samples).select(F.col("id").cast("int").alias("dataset_idx"))
    cells = ops.genotypes(members, every).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dataset_idx", F.concat_ws(":", "gt", F.col("dp").cast("string")).alias("g")))).alias("g"))
    rows = each.join(target, "cluster", "left").join(cells, "cluster")
    c = {"MIN_SC": "min_sc", "MAX_SC": "max_sc", "IN_BEGINPOS": "in_begin", "IN_ENDPOS": "in_end", "OUT_BEGINPOS": "out_begin", "OUT_ENDPOS": "out_end", "TARGETPOS": "target_pos", "IN_TARGETPOS": "in_target", "OUTTARGETPOS": "out_target", "BEGIN": "begin_pos", "END": "end_pos"}
    info = vcf.merged_info_text(F.col("sv_type"), {k: F.col(v) for k, v in c.items()})
    # numbered in one order of all, and from 1 within each type
    rows = settled(rows)
    rows = in_order(rows, ["sv_type", "chrom", "begin_pos", "end_pos", "cluster"], "__n", rows.count())
    first = rows.groupBy("sv_type").agg(F.min("__n").alias("__first"))
    rows = rows.join(F.broadcast(first), "sv_type")  # a row for each type
    n = F.col("__n") - F.col("__first") + 1
    return rows.select("chrom", "begin_pos", "end_pos", F.concat_ws("_", "sv_type", n.cast("string")).alias("id"), F.concat(F.lit("<"), "sv_type", F.lit(">")).alias("alt"), F.lit("PASS").alias("filter"), info.alias("info"), F.transform("g", lambda x: x["g"]).alias("genotypes"))


def merge_files(spark: SparkSession, paths: list[str], out: str, o: MergeOptions = MergeOptions()) -> None:
    vcf.write_vcf(merged(spark, paths, o), out, [p.rsplit("/", 1)[-1] for p in paths], "GT:DP")
