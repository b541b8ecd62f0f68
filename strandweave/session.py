"""Sessions and cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the bench; on a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder.

    For results that several branches of a plan read, and for loops. The
    folder is ``spark.checkpoint.dir``; where that is unset, a local run uses
    a temporary one, and on a cluster this raises.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


_STORED: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Like :func:`settled`, for large tables of which later steps read some
    columns and rows. The files go with :func:`forget`, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _STORED.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._stored_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a stored table that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm: Any = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _STORED:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that they need no copy of it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "strandweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
