import math

import pytest
from pyspark.sql import functions as F

from strandweave.functions import columns as x
from strandweave.operators import reads
from strandweave.options import CallOptions
from strandweave.sources import vcf


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_flags(spark):
    r = one(spark, x.has_flag(F.lit(0x14), x.REVERSE), x.usable(F.lit(0x400)), x.usable(F.lit(0x104)), x.read_end_name(F.lit("q"), F.lit(0x40)), x.read_end_name(F.lit("q"), F.lit(0x80)))
    assert tuple(r) == (True, True, False, "q/1", "q/2")


def test_intervals(spark):
    i = F.lit
    r = one(spark, x.overlaps(i(10000), i(20000), i(19000), i(22000)), x.overlaps(i(1), i(2), i(3), i(4)), x.adjacent(i(0), i(10), i(60), i(70), 50), x.adjacent(i(0), i(10), i(61), i(70), 50), x.reciprocal(i(0), i(99), i(20), i(99), 0.8), x.reciprocal(i(0), i(99), i(21), i(99), 0.8), x.valid(i(5), i(4)), x.widened(i(10), i(20), 50)[0])
    assert tuple(r) == (True, False, True, False, True, False, False, 0)


CIGARS = [
    ("10S80M", (80, 0, 90, 90), [], []),
    ("80M25S", (80, 0, 80, 105), [], [(179, None)]),
    ("25S80M", (80, 25, 105, 105), [], [(None, 100)]),
    ("80M25H", (80, 0, 80, 105), [], []),
    ("40M60D40M", (140, 0, 80, 80), [(140, 200)], []),
    ("40M60N40M", (140, 0, 80, 80), [(140, 200)], []),
    ("40M60I40M", (80, 0, 140, 140), [], []),
    ("50D50M", (100, 0, 50, 50), [(100, 150)], []),
    ("50M5P50M", (100, 0, 105, 105), [], []),
]


@pytest.mark.parametrize("text,spans,gone,clips", CIGARS)
def test_cigar(spark, text, spans, gone, clips):
    s = one(spark, x.cigar_spans(F.lit(100), x.cigar_ops(F.lit(text)), 50, 20))[0]
    start = spans[1] if not text.startswith("10S") else 10
    assert s["ref_end"] == 100 + spans[0] and s["q_size"] == spans[3] and s["q_begin"] == start
    assert [tuple(d) for d in s["deletions"]] == gone
    assert [tuple(c) for c in s["clips"]] == clips


def test_double_deletion(spark):
    s = one(spark, x.cigar_spans(F.lit(100), x.cigar_ops(F.lit("40M60D40M")), 50, 20, True))[0]
    assert s["ref_end"] == 300


def test_dna(spark):
    r = one(spark, x.revcomp(F.lit("ACGTN")), x.gc_content(F.lit("GCNN")), x.base_entropy(F.lit("ACGT")), x.base_entropy(F.lit("AAAA")), x.gc_content(F.lit("")))
    assert r[0] == "NACGT" and r[1] == 0.5 and r[2] == 2.0 and r[3] == 0.0 and r[4] is None


def test_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    r = df.agg(x.index_quantile("v", 0.25).alias("a"), x.index_quantile("v", 0.5).alias("b"), x.index_quantile("v", 0.75).alias("c")).first()
    assert tuple(r) == (2, 3, 4)
    r = one(spark, x.poisson_divergence(F.lit(10.0), F.lit(5.0)), x.poisson_pmf(F.lit(2), F.lit(3.0)))
    assert math.isclose(r[0], 10 - 5 + 5 * math.log(0.5), abs_tol=1e-6) and math.isclose(r[1], 4.5 * math.exp(-3))


def test_info(spark):
    df = spark.createDataFrame([("SE=3;IMPRECISE;SVLEN=-10;SVTYPE=DEL", 11), ("SVTYPE=BND", 5)], "info string, pos long")
    a, b = vcf.parse_info(df).collect()
    assert (a["se"], a["imprecise"], a["begin_pos"], a["end_pos"], a["sv_type"]) == (3, True, 10, 19, "DEL")
    assert (b["end_pos"], b["target_pos"]) == (0, None)


def test_split_geometry(spark):
    rows = [
        (1, 1, 0, 100, 160, False, 0, 60, 60), (1, 2, 0, 500, 540, False, 60, 100, 60),
        (2, 1, 0, 500, 560, False, 0, 60, 60), (2, 2, 0, 100, 140, False, 60, 100, 60),
        (3, 1, 0, 100, 160, False, 0, 60, 60), (3, 2, 1, 500, 540, False, 60, 100, 60),
        (4, 1, 0, 100, 160, False, 0, 60, 60), (4, 2, 0, 500, 540, False, 39, 100, 60),
        (5, 1, 0, 100, 160, False, 0, 60, 60), (5, 2, 0, 500, 540, False, 111, 150, 60),
        (6, 1, 0, 100, 160, False, 0, 60, 60), (6, 2, 0, 500, 540, False, 60, 100, 10),
    ]
    df = spark.createDataFrame(rows, "read_id long, seg_no int, template_id int, ref_begin long, ref_end long, is_reverse boolean, q_begin long, q_end long, map_q int")
    got = {r["read_id"]: (r["left_pos"], r["right_pos"], r["orientation"]) for r in reads.split_evidence(df, CallOptions()).collect()}
    assert got == {1: (160, 499, 0), 2: (100, 559, 2), 3: (160, 499, 4)}
