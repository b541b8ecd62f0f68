"""Streaming forms: windowed read counts with late data, and pairing of mates as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(template_id, begins, n): reads per contig and window of event time; what is later than ``late`` is dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("template_id", (F.col("user_id") % 4).cast("int"))
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", every), "template_id").agg(F.count("*").alias("n"))
    return counted.select("template_id", F.col("window.start").alias("begins"), "n")


def paired_stream(mates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Mates joined by name as they come; state goes when both are older than ``late``.

    ``mates(qname, ts, tlen, begin_pos, template_id)``.
    """
    left = mates.where("tlen >= 0").select("qname", F.col("ts").alias("lt"), F.col("begin_pos").alias("left_begin"), F.col("template_id").alias("left_template")).withWatermark("lt", late)
    right = mates.where("tlen < 0").select(F.col("qname").alias("rname"), F.col("ts").alias("rt"), F.col("begin_pos").alias("right_begin"), F.col("template_id").alias("right_template")).withWatermark("rt", late)
    near = F.expr(f"qname = rname AND rt BETWEEN lt - INTERVAL {late} AND lt + INTERVAL {late}")
    return left.join(right, near).select("qname", "left_template", "left_begin", "right_template", "right_begin")
