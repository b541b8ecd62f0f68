"""The BAM source: columns, index chunks and filters, tasks without an index, damaged files."""

import random
import struct

import pytest
from bam_files import BASES, OPS, block, header, record, write
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan
from pyspark.sql.types import StructType

from strandweave.sources import alignments
from strandweave.sources.bam import BAM_SCHEMA, Blocks, PushingReader

CONTIGS = [("chr1", 900_000), ("chr2", 90_000)]


def _schema(*names):
    out = StructType()
    for n in names:
        out = out.add(n, "string")
    return out


def _reader(path, names=("ordinal", "qname"), **options):
    return PushingReader(_schema(*names), {"path": str(path), **{k: str(v) for k, v in options.items()}})


def _rows(reader, filters=()):
    list(reader.pushFilters(list(filters)))
    return [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


def _some(n, rng):
    """(record, what it says) of all shapes."""
    out = []
    for i in range(n):
        seq = "".join(rng.choice(BASES) for _ in range(rng.choice([0, 1, 7, 100, 101])))
        cigar = [(rng.choice([1, 9, 10, 123, 45678]), rng.choice(OPS)) for _ in range(rng.choice([0, 1, 3, 20]))]
        tags = [("NM", "i", i), ("SA", "Z", "x,1;" * rng.randrange(3)), ("XA", "A", "q"), ("XF", "f", 0.5), ("XB", "B", ("s", [1, -2])), ("XC", "C", 255), ("XS", "s", -7), ("XE", "Z", "")]
        tags = rng.sample(tags, rng.randrange(len(tags) + 1))
        name, qual = "r" * rng.randrange(1, 90) + str(i), bytes(rng.choice([0, 30, 93, 94, 255]) for _ in seq)
        said = {"flag": rng.randrange(4096), "rid": rng.choice([-1, 0, 1]), "begin_pos": rng.randrange(-1, 80_000), "map_q": rng.randrange(256), "tlen": rng.randrange(-999, 999)}
        r = record(name, said["flag"], said["rid"], said["begin_pos"], said["map_q"], cigar, said["tlen"], seq, tags, qual=qual)
        shown = {k: ",".join([v[0], *map(str, v[1])]) if kind == "B" else str(v) for k, kind, v in tags}
        said |= {"next_rid": said["rid"], "next_pos": said["begin_pos"], "qname": name, "seq": seq, "cigar": "".join(f"{a}{o}" for a, o in cigar), "qual": "".join(chr(q + 33) if q < 94 else "!" for q in qual), "tags": shown}
        out.append((r, said))
    return out


def test_all_columns_of_all_shapes(spark, tmp_path):
    made = _some(300, random.Random(1))
    write(tmp_path / "a.bam", CONTIGS, [r for r, _ in made], index=False)
    got = [r.asDict() for r in alignments.read_bam(spark, str(tmp_path / "a.bam")).orderBy("ordinal").collect()]
    assert [{k: v for k, v in g.items() if k != "ordinal"} for g in got] == [said for _, said in made]
    few = alignments.read_bam(spark, str(tmp_path / "a.bam"), ("qname", "tag_SA", "ordinal"), splits="9").orderBy("ordinal")
    assert [(r["qname"], r["tag_SA"]) for r in few.collect()] == [(s["qname"], s["tags"].get("SA")) for _, s in made]
    with pytest.raises(ValueError, match="no such column"):
        _rows(_reader(tmp_path / "a.bam", ("nothing",)))
    assert alignments.is_sorted(alignments.read_header(str(tmp_path / "a.bam")).text)
    assert [tuple(r) for r in alignments.contigs(spark, str(tmp_path / "a.bam")).collect()] == [(0, "chr1", 900_000), (1, "chr2", 90_000)]


def test_equal_rows_for_every_cut_with_and_without_an_index(tmp_path):
    rng = random.Random(2)
    made = sorted(((c, p) for c in (0, 1) for p in rng.sample(range(80_000), 30)), key=lambda x: x)
    records = [record(f"n{i}", 0, c, p, 60, [(50, "M")], seq="A" * rng.choice([3, 60, 300]), tags=[("SA", "Z", "y" * rng.randrange(900))]) for i, (c, p) in enumerate(made)]
    records += [record("lost", 4, -1, -1, 0, [])] * 3
    path = tmp_path / "a.bam"
    write(path, CONTIGS, records, size=250)  # records run over several blocks
    whole = _rows(_reader(path, splits=1))
    assert [q for _, q in whole] == [f"n{i}" for i in range(60)] + ["lost"] * 3
    for splits in (2, 5, 17, 64):
        assert _rows(_reader(path, splits=splits)) == whole
    path.with_name("a.bam.bai").unlink()
    size = path.stat().st_size
    for splits in range(1, 40):
        assert _rows(_reader(path, splits=splits)) == whole
    reader = _reader(path)
    for cut in range(0, size, 7):  # two tasks that part anywhere
        a, b = reader.partitions()[0], reader.partitions()[0]
        a.end = b.begin = cut
        got = [tuple(r.values()) for part in (a, b) for x in reader.read(part) for r in x.to_pylist()] if cut else whole
        assert got == whole, cut
    parts = _reader(path, splits=20).partitions()
    assert len(parts) > 15


@pytest.mark.parametrize("indexed", [True, False])
def test_filters_open_only_the_chunks_they_need(spark, tmp_path, indexed):
    places = [(c, p) for c, n in ((0, 800_000), (1, 80_000)) for p in range(0, n, 500)]
    records = [record(f"r{c}:{p}", 0, c, p, 60, [(90, "M"), (20, "N"), (10, "M"), (4, "S")], seq="A" * 104) for c, p in places]
    path = tmp_path / "a.bam"
    write(path, CONTIGS, records, size=2000, index=indexed)
    all_blocks = Blocks(str(path))
    total = sum(1 for _ in all_blocks.begin(0))
    reader = _reader(path, split_bytes=300)
    got = _rows(reader, [EqualTo(("rid",), 0), GreaterThanOrEqual(("begin_pos",), 300_000), LessThan(("begin_pos",), 340_000)])
    assert [q for _, q in got] == [f"r0:{p}" for p in range(300_000, 340_000, 500)]
    every = alignments.read_bam(spark, str(path), split_bytes="300")
    df = alignments.read_bam(spark, str(path), split_bytes="300", pushdown="true").where("rid = 0 and begin_pos between 300000 and 339999")
    assert df.count() == 80 and df.rdd.getNumPartitions() > 1
    told = alignments.read_bam(spark, str(path), split_bytes="300", rids="0", begin_from="300000", begin_to="340000")
    assert told.count() == 80 and told.rdd.getNumPartitions() == df.rdd.getNumPartitions()
    # without that option a relation serves any number of scans with their own filters
    assert every.where("begin_pos < 1000").count() == 4 and every.unionByName(every.where("begin_pos < 1000")).count() == len(places) + 4
    assert not indexed or df.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 5  # the filters reached the source
    region = alignments.read_bam(spark, str(path), region="chr2:40,101-41000", split_bytes="300")
    assert [r["qname"] for r in region.orderBy("ordinal").collect()] == ["r1:40000", "r1:40500"]
    for text, want in (("chr2:40121-40500", []), ("chr1:1-1", ["r0:0"]), ("chr2:79,900-90,000", []), ("chr1:120-501", ["r0:0", "r0:500"])):
        assert [q for _, q in _rows(_reader(path, region=text))] == want
    assert len(_rows(_reader(path, region="chr1"))) == 1600
    assert _rows(_reader(path), [EqualTo(("rid",), 7)]) == []
    if indexed:
        assert reader.blocks < total / 8, (reader.blocks, total)
        assert len(reader.partitions()) > 1
        one = _reader(path)
        _rows(one, [EqualTo(("rid",), 1)])
        assert one.blocks < total / 5
        far = _reader(path, region="chr2:79,000-79,100")
        _rows(far)
        assert far.blocks < total / 20


def test_a_long_record_that_reaches_into_a_region(tmp_path):
    records = [record("long", 0, 0, 100, 60, [(500_000, "N"), (50, "M")], seq="A" * 50)]
    records += [record(f"s{p}", 0, 0, p, 60, [(50, "M")], seq="A" * 50) for p in range(1000, 700_000, 1000)]
    write(tmp_path / "a.bam", CONTIGS, records, size=1500)
    got = [q for _, q in _rows(_reader(tmp_path / "a.bam", region="chr1:450,001-450,100"))]
    assert got == ["long", "s450000"]


def test_unsorted_files_are_read_to_the_end(tmp_path):
    records = [record(f"s{p}", 0, 0, p, 60, [(50, "M")], seq="A" * 50) for p in (5000, 100, 7000, 120)]
    write(tmp_path / "a.bam", CONTIGS, records, size=120, index=False, sort="unsorted")
    assert [q for _, q in _rows(_reader(tmp_path / "a.bam", region="chr1:90-200"))] == ["s100", "s120"]


def test_several_files_and_damage(tmp_path):
    a, b = tmp_path / "a.bam", tmp_path / "b.bam"
    for path in (a, b):
        write(path, CONTIGS, [record(f"{path.name}{i}", 0, 0, i, 60, [(4, "M")]) for i in range(3)], index=False)
    got = _rows(_reader(f"{a},{b}"))
    assert [q for _, q in got] == [f"{n}.bam{i}" for n in "ab" for i in range(3)] and got == sorted(got)
    whole = a.read_bytes()
    (tmp_path / "none.bam").write_bytes(block(header(CONTIGS)) + block(b""))
    assert _rows(_reader(tmp_path / "none.bam")) == []
    (tmp_path / "short.bam").write_bytes(block(header(CONTIGS)) + block(struct.pack("<i", 500) + bytes(40)))
    with pytest.raises(ValueError, match="cut off"):
        _rows(_reader(tmp_path / "short.bam"))
    (tmp_path / "bad.bam").write_bytes(whole[:-40] + b"x" * 40)
    with pytest.raises(ValueError, match="damaged"):
        _rows(_reader(tmp_path / "bad.bam"))
    with pytest.raises(ValueError, match="not a BAM"):
        (tmp_path / "text.bam").write_bytes(block(b"hello, this is not it"))
        _rows(_reader(tmp_path / "text.bam"))


def test_schema_is_what_it_says():
    assert [f.split()[0] for f in BAM_SCHEMA.split(", ")][:3] == ["ordinal", "rid", "begin_pos"]


def test_call_scans_the_file_once(spark, tmp_path):
    from strandweave.operators.reads import insert_bounds, insert_limit
    from strandweave.options import CallOptions
    from strandweave.plans.call import routed_reads

    rng = random.Random(6)
    records = [record(f"p{i}", 0x23 | (0x40 if i % 2 else 0x80), 0, 20 * i, 60, [(50, "M")], tlen=rng.choice([300, 310, 320]), seq="A" * 50) for i in range(4000)]
    records.append(record("clip", 0, 0, 90_000, 60, [(30, "S"), (50, "M")], seq="AC" * 40))
    write(tmp_path / "a.bam", CONTIGS, records, size=3000)
    df = alignments.read_bam(spark, str(tmp_path / "a.bam"), alignments.CALL_COLUMNS, split_bytes="900")
    o = CallOptions()
    want = insert_bounds(df, o.insert_deviations).first()["high"]
    assert insert_limit(df, o, file_order=True) == want == insert_limit(df, o)
    # a small sample is found in the first tasks
    assert insert_limit(df, o, True, 100) == insert_bounds(df, o.insert_deviations, 100).first()["high"]
    routed = routed_reads(df, o, file_order=True)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1 and "Sort" not in plan and "Join" not in plan
    rows = routed.collect()
    assert len(rows) == 4001 and [r["seq"] for r in rows if r["seq"]] == ["AC" * 40] and all(r["qname"] is None for r in rows if not r["to_clip"])
