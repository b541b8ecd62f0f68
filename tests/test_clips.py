"""Clipped reads: search and placement against planted variants."""

import random

from pyspark.sql import functions as F

from strandweave.operators import clips, seqsearch
from strandweave.options import CallOptions
from strandweave.plans.call import call
from strandweave.sources import alignments

rng = random.Random(12)
REF = "".join(rng.choice("ACGT") for _ in range(8000))
TURN = str.maketrans("ACGT", "TGCA")
CLIPS = "clip_id long, template_id int, is_left boolean, lo long, hi long, mid long, supp long, seq string"
TARGETS = "template_id int, right_template int, orientation int, l1 long, l2 long, r1 long, r2 long"


def _chunks(spark, size=1000):
    return spark.createDataFrame([(0, i // size, REF[i : i + size]) for i in range(0, len(REF), size)], "template_id int, chunk_no int, seq string")


def test_placement_by_kind(spark):
    edit = lambda s: s[:10] + s[10].translate(TURN) + s[11:]
    rows = [
        (1, 0, False, 999, 999, 999, 5, edit(REF[1080:1120])),  # small deletion, right clip
        (2, 0, True, 2080, 2080, 2080, 4, REF[1960:2000]),  # small deletion, left clip
        (3, 0, False, 2999, 2999, 2999, 3, REF[3905:3945]),  # large deletion beside a known breakpoint
        (4, 0, True, 4000, 4000, 4000, 2, REF[4460:4500]),  # duplication, found with sides swapped
        (5, 0, True, 5500, 5500, 5500, 1, REF[5100:5140].translate(TURN)[::-1]),  # inversion
        (6, 0, False, 7000, 7000, 7000, 9, "ACGT" * 10),  # nowhere
    ]
    known = [(0, 0, 0, 2990, 2999, 3900, 3910), (0, 0, 2, 4000, 4000, 4480, 4499), (0, 0, 3, 5050, 5200, 5490, 5510)]
    found = clips.clip_evidence(spark.createDataFrame(rows, CLIPS), spark.createDataFrame(known, TARGETS), _chunks(spark), 1000, F.lit(400), CallOptions())
    got = {r["clip_id"]: (r["orientation"], r["left_pos"], r["right_pos"], r["weight"]) for r in found.collect()}
    assert got == {1: (0, 999, 1079, 5), 2: (0, 2000, 2080, 4), 3: (0, 2999, 3904, 3), 4: (2, 4000, 4499, 2), 5: (3, 5100, 5500, 1)}


def test_clip_reads_and_clusters(spark):
    rows = [(3, 0, 100, "30S70M", "A" * 30 + "C" * 70), (1, 0, 110, "25S75M", "G" * 25 + "C" * 75), (2, 0, 50, "60M40S", "C" * 60 + "T" * 40), (4, 0, 50, "60M10S", "C" * 70), (5, 0, 50, "60M40H", "C" * 60), (6, 0, 500, "20S10M20S", "*")]
    reads = spark.createDataFrame(rows, "ordinal long, template_id int, begin_pos int, cigar string, seq string")
    one = clips.clip_reads(reads, CallOptions())
    assert sorted(map(tuple, one.collect())) == [(1, 0, True, 110, "G" * 25), (2, 0, False, 109, "T" * 40), (3, 0, True, 100, "A" * 30)]
    many = clips.clip_clusters(one, 50).select("is_left", "lo", "hi", "mid", "supp", "seq").collect()
    assert sorted(map(tuple, many)) == [(False, 109, 109, 109, 1, "T" * 40), (True, 100, 110, 110, 2, "G" * 25)]


def _read(i, flag, pos, cigar, name, seq="", tlen=0, next_pos=0, tags=None):
    return (i, 0, pos, 60, flag, 0, next_pos, tlen, cigar, name, seq, "", tags or {})


def test_clip_only_deletion_is_called(spark):
    rows = [_read(i, 0x43, 100 + 5 * i, "100M", f"p{i}", tlen=300 + i % 7, next_pos=300) for i in range(40)]
    rows += [_read(100 + i, 0x1, 940 + i, f"{60 - i}M40S", f"c{i}", REF[940 + i : 1000] + REF[1080:1120]) for i in range(6)]
    contigs = spark.createDataFrame([(0, "chr1", len(REF))], "template_id int, name string, length long")
    df = spark.createDataFrame(rows, alignments.BAM_SCHEMA)
    found = call(df, contigs, CallOptions(), _chunks(spark), 1000).collect()
    assert [(r["sv_type"], r["begin_pos"], r["end_pos"], r["se"], r["pe"], r["ce"]) for r in found] == [("DEL", 999, 1079, 0, 0, 6)]
    assert call(df, contigs, CallOptions(use_clips=False), _chunks(spark), 1000).count() == 0


def test_pairs_support_by_region_and_stay_imprecise(spark):
    sizes = [_read(i, 0x43, 100 + i, "100M", f"p{i}", tlen=300 + i % 7, next_pos=300) for i in range(40)]
    split = []
    for i in range(2):
        split.append(_read(100 + 2 * i, 0x1, 2940, "60M40S", f"s{i}", tags={"SA": "x"}))
        split.append(_read(101 + 2 * i, 0x801, 3500, "60H40M", f"s{i}", tags={"SA": "x"}))
    pairs = []
    for i in range(5):  # reads end 120 bases before the deletion and begin 100 behind it
        pairs.append(_read(200 + 2 * i, 0x61, 2780 + i, "100M", f"d{i}", tlen=900, next_pos=3600))
        pairs.append(_read(201 + 2 * i, 0x91, 3600 + i, "100M", f"d{i}", tlen=-900, next_pos=2780))
    for i in range(6):  # another event, with pairs only
        pairs.append(_read(300 + 2 * i, 0x61, 5000 + i, "100M", f"e{i}", tlen=1500, next_pos=6400))
        pairs.append(_read(301 + 2 * i, 0x91, 6400 + i, "100M", f"e{i}", tlen=-1500, next_pos=5000))
    contigs = spark.createDataFrame([(0, "chr1", len(REF))], "template_id int, name string, length long")
    df = spark.createDataFrame(sizes + split + pairs, alignments.BAM_SCHEMA)
    found = call(df, contigs, CallOptions(use_depth=False)).collect()
    got = sorted((r["begin_pos"], r["end_pos"], r["se"], r["pe"], r["imprecise"]) for r in found)
    assert got == [(3000, 3499, 2, 5, False), (5104, 6400, 0, 6, True)]
    # an inner size within the limit shows nothing
    near = [_read(400, 0x61, 7000, "100M", "n", tlen=310, next_pos=7200), _read(401, 0x91, 7200, "100M", "n", tlen=-310, next_pos=7000)] * 6
    assert call(spark.createDataFrame(sizes + near, alignments.BAM_SCHEMA), contigs, CallOptions(use_depth=False)).count() == 0


def test_split_reads_count_once(spark):
    rows = []
    for i in range(8):
        rows.append(_read(2 * i, 0x1, 940 + i, f"{60 - i}M40S", f"q{i}", REF[940 + i : 1000] + REF[1500:1540], tags={"SA": "x"}))
        rows.append(_read(2 * i + 1, 0x801, 1500, f"{60 - i}S{40}M", f"q{i}", REF[940 + i : 1000] + REF[1500:1540], tags={"SA": "x"}))
    contigs = spark.createDataFrame([(0, "chr1", len(REF))], "template_id int, name string, length long")
    found = call(spark.createDataFrame(rows, alignments.BAM_SCHEMA), contigs, CallOptions(), _chunks(spark), 1000).collect()
    assert [(r["sv_type"], r["begin_pos"], r["end_pos"], r["se"], r["ce"]) for r in found] == [("DEL", 1000, 1499, 8, 0)]


def test_strands_of_breakends(spark):
    rows = []
    for k, back in enumerate((False, True)):
        for i in range(5):
            flag = 0x1
            rows.append(_read(100 * k + 2 * i, flag, 940 + 2000 * k, "60M40S", f"b{k}{i}", tags={"SA": "x"}))
            other = list(_read(100 * k + 2 * i + 1, 0x801 + (0x10 if back else 0), 1500 + 2000 * k, "40M60H" if back else "60H40M", f"b{k}{i}", tags={"SA": "x"}))
            other[1] = 1
            rows.append(tuple(other))
    contigs = spark.createDataFrame([(0, "chr1", len(REF)), (1, "chr2", len(REF))], "template_id int, name string, length long")
    found = call(spark.createDataFrame(rows, alignments.BAM_SCHEMA), contigs, CallOptions(use_depth=False)).collect()
    got = {(r["sv_id"], r["alt"]) for r in found}
    assert ("BND_1_1", "N[chr2:1500[") in got and ("BND_1_2", "]chr1:1001]N") in got
    assert {r["alt"][1] for r in found if r["sv_id"] == "BND_2_1"} <= {"]"} and len(found) in (2, 4)


def test_regions_are_searched_once(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), seqsearch.searched

    def counted(pairs, error):
        def tick(it):
            for rb in it:
                seen.add(rb.num_rows)
                yield rb

        return real(pairs.mapInArrow(tick, pairs.schema), error)

    monkeypatch.setattr(seqsearch, "searched", counted)
    text = "".join(random.Random(7).choices("ACGT", k=600))
    chunks = spark.createDataFrame([(1, k, text[64 * k : 64 * k + 64]) for k in range(10)], "template_id int, chunk_no long, seq string")
    asked = spark.createDataFrame([(c, 0, False, 1, 50, 550, text[100 + c : 140 + c]) for c in range(20)], "clip_id long, orientation int, swapped boolean, template_id int, begin_pos long, end_pos long, needle string")
    got = {r["clip_id"]: (r["begin_pos"], r["end_pos"], r["edits"]) for r in clips.best_hits(asked, chunks, 64, 0.1).collect()}
    assert got == {c: (100 + c, 140 + c, 0) for c in range(20)}
    assert seen.value == 20
