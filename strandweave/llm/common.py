"""Shared plumbing of the training-data operators: staged tables and column helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import ship

_STAGED: list[tuple[SparkSession, str]] = []

#: A table is broadcast only if its counted size stays under this many bytes.
BROADCAST_LIMIT_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local run uses a
    folder under the temp directory; on a cluster, where no executor would see
    it, this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with a table that every executor can read, so a lost executor
    costs a re-read and not a recomputation. Iterative operators drop their
    older tables with :func:`unstage`; what is left goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def unstage(df: DataFrame) -> None:
    """Delete the files behind a staged table."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm: Any = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def small_enough(df: DataFrame, bytes_per_row: int) -> bool:
    """True if counting shows the table to stay under the broadcast limit."""
    return df.count() * bytes_per_row <= BROADCAST_LIMIT_BYTES


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``df`` rows whose key is in ``ids`` (one column of that name).

    Broadcasts the ids behind a size check; past it, a shuffled semi join.
    """
    side = F.broadcast(ids) if small_enough(ids, 16) else ids
    return df.join(side, key, "left_semi")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used, within higher-order functions too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: A key with more than this many rows, and a thousandth of them all, is joined by broadcast.
HOT_ROWS = 4096


def join_once(big: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has each key once and in ``weight`` how many rows of ``big`` hold it.

    Keys that hold more than a thousandth of all ``total`` rows would land in
    one task each. There are under a thousand of them for each row's number of
    keys, so they are broadcast; the rest is shuffled, hot rows left out. A
    look at ``small``, which should be staged or cheap, tells whether there are any.
    """
    limit = max(HOT_ROWS, total // 1000)
    if not small.where(F.col(weight) > limit).take(1):
        return big.join(small, keys)
    hot = F.broadcast(small.where(F.col(weight) > limit).withColumn("__hot", F.lit(True)))
    rest = big.join(hot.select(*keys, "__hot"), keys, "left").where("__hot is null").drop("__hot")
    return big.join(hot.drop("__hot"), keys).unionByName(rest.join(small.where(F.col(weight) <= limit), keys))


def batches(spark: SparkSession) -> None:
    """Prepare for Arrow functions: the package goes to the workers, and batches of the session stay small.

    Texts may be long, so a batch is bounded in rows and in bytes; lower limits of the session are kept.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
