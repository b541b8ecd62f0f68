from pyspark.sql import functions as F

from strandweave.options import CallOptions
from strandweave.plans.call import as_records, call
from strandweave.plans.merge import merged
from strandweave.sources import alignments, vcf


def test_headers_and_samples(spark, tmp_path):
    lines = vcf.header("merge")
    assert {"MIN_SC", "OUTTARGETPOS", "DP", "GT"} <= {x.split("ID=")[1].split(",")[0] for x in lines if "ID=" in x}
    called = {x.split("ID=")[1].split(",")[0] for x in vcf.header("call") if "ID=" in x}
    assert {"GC", "CP", "CE", "IMPRECISE", "FILTERED"} <= called
    (tmp_path / "a.vcf").write_text("\n".join([*lines, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo"]) + "\n")
    assert vcf.vcf_header(spark, str(tmp_path / "a.vcf")) == (lines, ["one", "two"])


def test_records_by_many_writers(spark, tmp_path):
    import gzip

    import pytest

    rows = spark.range(30_000).select(F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("chrom"), ((F.col("id") * 7919) % 100_003).alias("begin_pos"), ((F.col("id") * 7919) % 100_003 + 60).alias("end_pos"), F.concat(F.lit("DEL_"), "id").alias("id"), F.lit("<DEL>").alias("alt"), F.lit("PASS").alias("filter"), F.lit("SE=4;SVTYPE=DEL").alias("info"), F.array(F.lit("1/0")).alias("genotypes")).repartition(5)
    vcf.write_vcf(rows, str(tmp_path / "out.vcf.gz"), ["SAMPLE"])
    text = gzip.decompress((tmp_path / "out.vcf.gz").read_bytes()).decode()
    want = [r["value"] for r in vcf.vcf_lines(rows, ["SAMPLE"]).collect()]
    assert text == "\n".join(want) + "\n" and [p.name for p in tmp_path.iterdir()] == ["out.vcf.gz"]
    vcf.write_vcf(rows.where("false"), str(tmp_path / "none.vcf.gz"), ["SAMPLE"])
    assert gzip.decompress((tmp_path / "none.vcf.gz").read_bytes()).decode().splitlines() == want[: len(want) - 30_000]
    # a task that fails leaves nothing
    spark.dataSource.register(vcf.RecordSink)
    lines = rows.select(F.when(F.col("id") != "DEL_777", F.col("id")).alias("value"))
    with pytest.raises(Exception, match="record without text"):
        lines.write.format("records").mode("append").save(str(tmp_path / "bad.vcf.gz"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.vcf.gz", "out.vcf.gz"]


def test_breakpoint_table(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 9, 4), (0, 1, 9, 2)], "template_id int, final_left long, final_right long, se long")
    vcf.breakpoint_table(rows, str(tmp_path / "t"))
    got = spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()
    assert sorted((r["final_left"], r["se"]) for r in got) == [("1", "2"), ("5", "4")]


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">one x\nACGTA\nCGTAC\nGT\n>two\nTTTT\n")
    alignments.register(spark)
    rows = spark.read.format("fasta").option("chunk", "5").load(str(path)).orderBy("template_id", "chunk_no").collect()
    assert [(r["name"], r["chunk_no"], r["seq"]) for r in rows] == [("one", 0, "ACGTA"), ("one", 1, "CGTAC"), ("one", 2, "GT"), ("two", 0, "TTTT")]


def test_sam(spark, tmp_path):
    path = tmp_path / "a.sam"
    path.write_text("@HD\tVN:1.6\nr\t16\tchr1\t11\t60\t4M\t=\t20\t9\tACGT\tIIII\tNM:i:1\tSA:Z:q\n")
    r = alignments.read_sam(spark, str(path)).first()
    assert (r["begin_pos"], r["flag"], r["tags"]) == (10, 16, {"NM": "1", "SA": "q"})


def test_planted_deletion_to_text_and_merge(spark, tmp_path):
    rows = []
    for i in range(8):
        rows.append((2 * i, 0, 940 + i, 60, 0x1, 0, 0, 0, f"{60 - i}M40S", f"q{i}", "", "", {"SA": "x"}))
        rows.append((2 * i + 1, 0, 1500, 60, 0x801, 0, 0, 0, f"{60 - i}H{40 + i}M", f"q{i}", "", "", {"SA": "x"}))
    df = spark.createDataFrame(rows, alignments.BAM_SCHEMA)
    names = spark.createDataFrame([(0, "chr1", 5000)], "template_id int, name string, length long")
    found = call(df, names, CallOptions())
    got = [(r["sv_type"], r["begin_pos"], r["end_pos"], r["se"]) for r in found.collect()]
    assert got == [("DEL", 1000, 1499, 8)]
    lines = [r["value"] for r in vcf.vcf_lines(as_records(found), ["SAMPLE"]).collect()]
    assert lines[0] == "##fileformat=VCFv4.1" and lines[-1].startswith("chr1\t1001\tDEL_1\tN\t<DEL>\t.\tPASS\tSC=100.000000;VT=") and "SVLEN=-500;SVTYPE=DEL" in lines[-1]
    for k in range(2):
        (tmp_path / f"s{k}.vcf").write_text("\n".join(lines) + "\n")
    out = merged(spark, [str(tmp_path / f"s{k}.vcf") for k in range(2)]).collect()
    assert len(out) == 1 and out[0]["genotypes"][0].startswith("1/0:") and "OUT_BEGINPOS=1000" in out[0]["info"]


def test_streaming_counts(spark, tmp_path):
    from strandweave.streaming.depth import windowed_counts

    src = spark.createDataFrame([(i, i % 8) for i in range(40)], "m int, user_id long").select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0)").alias("ts"), "user_id")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 40
