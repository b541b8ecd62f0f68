"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records uniformly into buckets that fit in memory, by
a seeded hash. Pass two shuffles each bucket by Fisher-Yates (the ``shuffle``
function) and writes it. The buckets in order are one random permutation of all
records; shards are equal stretches of it.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.common import small_enough, stage

#: Buckets whose offsets one task adds up.
_GROUP = 4096
#: Cells by which the records are measured before they are scattered; a bucket is a stretch of them.
_CELLS = 1 << 20


def shuffled_shards(docs: DataFrame, shards: int = 24, seed: int = 1, bucket_bytes: int = 8 << 20, memory_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0, without gaps), shuffled.

    Law ``rows``: shards' counts differ by one at most. Where a record goes
    depends on seed, id and text alone, so any number of tasks gives the same
    result, also when a task runs again; records of equal id and text may
    change places with one another. Null ids and texts are records like
    others; repeated rows each get a slot. An input column named shard or slot
    is replaced. An empty table gives an empty result.

    A bucket holds about ``bucket_bytes`` of text, and more, up to
    ``memory_bytes`` (a share of an executor's memory), where there would be
    over 4,096 of them; a text longer than that makes its bucket longer. Rows
    that repeat id and text so often that they fill buckets are numbered and
    dealt to several in turn.
    """
    docs = docs.drop("shard", "slot")
    names = docs.columns
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + 64
    cells = stage(docs.groupBy(F.pmod(key, F.lit(_CELLS)).alias("cell")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.max(size).alias("longest")), "cells")
    total, n = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    buckets = min(_CELLS, max(1, min(ceil(total / bucket_bytes), 4096), ceil(total / memory_bytes)))
    of_cell = F.expr(f"(cell * {buckets} div {_CELLS}) << 20")
    # buckets that repeated rows fill: as many as there is room for at most half of all
    wide = 2 * max(bucket_bytes, ceil(total / buckets))
    full = cells.groupBy(of_cell.alias("__bucket")).agg(F.sum("bytes").alias("b"), F.max("longest").alias("longest"), F.sum("rows").alias("r")).where((F.col("b") - F.col("longest") > wide) & (F.col("r") > 1))
    full = stage(full.select("__bucket", F.ceil(F.col("b") / wide).cast("long").alias("__parts")), "full")

    rows = docs.select(F.pmod(key, F.lit(_CELLS)).alias("cell"), key.alias("__key"), size.alias("__size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__record"))
    rows = rows.select(of_cell.alias("__bucket"), "__key", "__size", "__record")
    if full.take(1):
        rows = _dealt(rows, full, wide)
    # each partition's buckets in order and each bucket's records by hash, so that the shuffle's draws fall alike in every run
    gathered = rows.repartition(buckets, "__bucket").groupBy("__bucket").agg(F.collect_list(F.struct("__key", "__record")).alias("__all")).sortWithinPartitions("__bucket")
    order = F.transform(F.array_sort(F.transform("__all", lambda r, i: F.struct(r["__key"].alias("k"), i.alias("i")))), lambda x: x["i"])
    dealt = gathered.select("__bucket", "__all", F.shuffle(order, F.lit(seed)).alias("__order"))
    record = F.transform("__order", lambda i: F.get("__all", i)["__record"])
    dealt = stage(dealt.select("__bucket", F.posexplode(record).alias("__place", "__record")), "shuffled")

    counts = dealt.groupBy("__bucket").agg(F.count("*").alias("c")).withColumn("g", F.expr(f"(__bucket >> 20) div {_GROUP}"))
    groups = counts.groupBy("g").agg(F.sum("c").alias("gc"))
    groups = groups.withColumn("before", F.sum("gc").over(W.orderBy("g")) - F.col("gc")).select("g", "before")
    inside = W.partitionBy("g").orderBy("__bucket")
    starts = counts.join(groups, "g").select("__bucket", (F.col("before") + F.sum("c").over(inside) - F.col("c")).alias("__start"))
    starts = stage(starts, "starts")

    side = F.broadcast(starts) if small_enough(starts, 24) else starts
    out = dealt.join(side, "__bucket").withColumn("__at", F.col("__start") + F.col("__place")).withColumn("shard", F.expr(f"cast(__at * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return out.select(*[F.col(f"__record.`{c}`").alias(c) for c in names], "shard", (F.col("__at") - first).alias("slot"))


def _dealt(rows: DataFrame, full: DataFrame, wide: int) -> DataFrame:
    """``rows`` with those that repeat, in ``full`` buckets, dealt to the bucket's parts in turn.

    Copies are numbered within id and text, so a part gets the same number of
    them however the input is cut, and no other row moves. The numbers come
    from a written table: each of its partitions counts its own copies, and a
    table with a row for each key and partition carries the counts on.
    """
    held = rows.join(F.broadcast(full) if small_enough(full, 16) else full, "__bucket")
    # each fills a good part of a bucket, so they are few
    many = held.groupBy("__bucket", "__key", "__parts").agg(F.sum("__size").alias("b"), F.count("*").alias("c")).where((F.col("c") > 1) & (F.col("b") > wide // 64))
    many = stage(many.select("__bucket", "__key", "__parts"), "repeated")
    side = F.broadcast(many) if small_enough(many, 32) else many
    copies = stage(rows.join(side, ["__bucket", "__key"]).withColumn("__row", F.monotonically_increasing_id()), "copies").withColumn("__pid", F.shiftright("__row", 33))
    each = copies.groupBy("__key", "__pid").agg(F.count("*").alias("c"))
    before = each.withColumn("__before", F.sum("c").over(W.partitionBy("__key").orderBy("__pid")) - F.col("c")).drop("c")
    local = F.row_number().over(W.partitionBy("__key", "__pid").orderBy("__row")) - 1
    numbered = copies.withColumn("__local", local).join(before, ["__key", "__pid"])
    part = (F.col("__before") + F.col("__local")) % F.col("__parts")
    rest = rows.join(side.select("__bucket", "__key"), ["__bucket", "__key"], "left_anti")
    return rest.unionByName(numbered.select((F.col("__bucket") + part).alias("__bucket"), "__key", "__size", "__record"))


def shard_digest(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """Per record: doc_id, size, text_crc32, law, shard, slot, grown_shard, read from the shuffled output."""
    out = shuffled_shards(docs, shards, seed)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
