"""Evidence from a stream against the batch operators, with late rows and an emptied state."""

import random

from pyspark.sql import functions as F

from strandweave.operators.reads import paired, split_evidence
from strandweave.options import CallOptions
from strandweave.streaming.reads import FIELDS, evidence_stream, genome_time


def _rows(rng):
    """Segments and ends on three contigs in genome order; some reads reach from one contig to a later one."""
    out = []
    for i in range(60):
        a, b = rng.randrange(3), rng.randrange(3)
        one, two = rng.randrange(100, 5000), rng.randrange(100, 5000)
        last = max(a, b)
        if i % 2:
            out.append((f"s{i}", "split", a, one, one + 60, False, 0, 60, 60, 1, None, last))
            out.append((f"s{i}", "split", b, two, two + 40, bool(i % 3), 60, 100, 60, 2, None, last))
        else:
            out.append((f"p{i}", "pair", a, one, one + 100, False, None, None, 60, None, two - one if two >= one else one - two, last))
            out.append((f"p{i}", "pair", b, two, two + 100, True, None, None, 60, None, -abs(two - one) - 1, last))
    out.append(("alone", "split", 1, 50, 90, False, 0, 40, 60, 1, None, 1))
    return sorted(out, key=lambda r: (r[2], r[3]))


def _key(row):
    return tuple(str(x) for x in row)


def test_stream_equals_batch_and_leaves_no_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _rows(random.Random(2))
    # the stream's files: a contig each, one segment long after its contig, and the row that closes it
    late = ("alone", "split", 1, 9000, 9040, False, 40, 80, 60, 2, None, 1)
    files = [[r for r in rows if r[2] == c] for c in range(3)] + [[("end", "split", 9, 0, 1, False, 0, 1, 60, 1, None, 9)], [late], [("end2", "split", 11, 0, 1, False, 0, 1, 60, 1, None, 9)]]
    for n, part in enumerate(files):
        df = spark.createDataFrame(part, FIELDS).withColumn("at", genome_time("template_id", "ref_begin"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = evidence_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(200)
    assert query.exception() is None
    batch = spark.createDataFrame(rows, FIELDS)
    want = split_evidence(batch.where("kind = 'split'"), CallOptions())
    got = spark.read.parquet(str(tmp_path / "out/split")).drop("batch")
    a, b = (set(map(_key, x.select(want.columns).collect())) for x in (got, want))
    assert a == b and got.count() == want.count() > 3, (a - b, b - a)
    ends = batch.where("kind = 'pair'").select(F.col("read_id").alias("qname"), "template_id", F.col("ref_begin").alias("begin_pos"), F.col("ref_end").alias("end_pos"), "is_reverse", "tlen", "map_q")
    want = paired(ends, float("inf"))
    got = spark.read.parquet(str(tmp_path / "out/pair")).drop("batch")
    assert sorted(map(_key, got.select(want.columns).collect())) == sorted(map(_key, want.collect())) and got.count() == 30
    # the late segment came after its read had gone, and made no pair with it
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) > 10 and states[-1] == 0, states
