import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave import catalog
from strandweave.operators import calls, cluster, depth, intervals, merge, seqsearch
from strandweave.options import CallOptions
from strandweave.plans import call as command


def test_bin_join_matches_brute_force(spark):
    rng = random.Random(1)
    span = lambda wide: (b := rng.randrange(50_000), b + rng.choice([0, 5, 900, 2500, wide]))
    left, right = [(i, i % 2, *span(150_000)) for i in range(120)], [(i, i % 2, *span(200_000)) for i in range(120)]
    a = spark.createDataFrame(left, "a int, k int, b1 long, e1 long")
    b = spark.createDataFrame(right, "b int, k int, b2 long, e2 long")
    got = [(r["a"], r["b"]) for r in intervals.bin_join(a, b, ["k"], ("b1", "e1"), ("b2", "e2")).select("a", "b").collect()]
    want = [(x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(got) == sorted(want)


def test_coverage_across_bins(spark):
    rows = [(0, 5, 25), (0, 10, 12), (0, 24, 40), (1, 3, 3)]
    df = spark.createDataFrame(rows, "t int, b long, e long")
    got = {p: r["depth"] for r in intervals.coverage(df, "t", "b", "e", coarse=8).collect() for p in range(r["start"], r["stop"])}
    want = {}
    for _, b, e in rows:
        for p in range(b, e):
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_islands_across_bins(spark):
    rows = [(None, 0), (None, 50), (None, 100), (None, 151), (1, 10)]
    df = spark.createDataFrame(rows, "k int, p long")
    got = {(r["k"], r["p"]): r["i"] for r in intervals.islands(df, ["k"], "p", "p", 50, "i", coarse=40).collect()}
    assert got == {(None, 0): 0, (None, 50): 0, (None, 100): 0, (None, 151): 151, (1, 10): 10}


def test_canonical_and_replayed_clusters(spark):
    rows = [(1, 0, 0, 0, 0, 1000), (2, 0, 0, 0, 50, 1050), (3, 0, 0, 1, 100, 1100), (4, 0, 0, 0, 5000, 1000), (5, 0, 2, 0, 0, 1000)]
    df = spark.createDataFrame(rows, "ev_id long, template_id int, orientation int, kind int, left_pos long, right_pos long")
    got = sorted((r["orientation"], r["min_left"], r["supp"]) for r in cluster.breakpoints(df, 50).collect())
    assert got == [(0, 0, 3), (0, 5000, 1), (2, 0, 1)]
    got = sorted((r["orientation"], r["min_left"], r["supp"]) for r in cluster.replayed(df, 50).collect())
    assert got == [(0, 0, 3), (0, 5000, 1), (2, 0, 1)]


def _mutual(a, b, share):
    both = min(a[1], b[1]) - max(a[0], b[0]) + 1
    return both >= share * (a[1] - a[0] + 1) and both >= share * (b[1] - b[0] + 1)


def test_first_fit_in_file_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        b, size = rng.randrange(3000), rng.choice([1, 2, 5, 40, 45, 50, 300, 350, 5000])
        rows.append((i * 7 % 401, rng.choice(["DEL", "INV", "BND"]), rng.choice("cd"), b, b + size - 1, rng.randrange(3), rng.randrange(1000)))
    df = spark.createDataFrame(rows, "sv long, sv_type string, chrom string, begin_pos long, end_pos long, dataset_idx int, ordinal int")
    clusters, want = {}, {}
    for sv, kind, chrom, b, e, _, _ in sorted(rows, key=lambda r: (r[5], r[6], r[0])):
        if kind == "BND":
            continue
        for first, members in clusters.setdefault((kind, chrom), {}).items():
            if any(_mutual((b, e), m, 0.8) for m in members):
                members.append((b, e))
                want[sv] = first
                break
        else:
            clusters[kind, chrom][sv] = [(b, e)]
            want[sv] = sv
    assert {r["sv"]: r["cluster"] for r in merge.first_fit(df, 0.8).collect()} == want
    assert merge.first_fit(df.where("false"), 0.8).count() == 0
    for share in (0.5, 0.95, 1.0):
        got = {(r["a"], r["b"]) for r in merge.overlapping_pairs(df, share).collect()}
        assert got == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1:3] == y[1:3] and _mutual(x[3:5], y[3:5], share)}


def test_genotypes(spark):
    rows = [(1, 1, 0, 0, "0/0", 9.9), (2, 1, 0, 1, "1/1", 4.0), (3, 1, 0, 2, "0/1", 1.0), (4, 1, 2, 0, "1/0", 7.0), (5, 5, 1, 0, "0/0", 2.0)]
    df = spark.createDataFrame(rows, "sv long, cluster long, dataset_idx int, ordinal int, gt string, rd double")
    got = {(r["cluster"], r["dataset_idx"]): (r["gt"], r["dp"]) for r in merge.genotypes(df, spark.range(3).selectExpr("cast(id as int) dataset_idx")).collect()}
    assert got == {(1, 0): ("1/1", 4), (1, 1): ("0/0", 0), (1, 2): ("1/0", 7), (5, 0): ("0/0", 0), (5, 1): ("0/0", 2), (5, 2): ("0/0", 0)}


def test_replay_against_one_pass_over_all(spark):
    rng = random.Random(8)
    rows = [(i, 0, rng.choice([0, 2]), rng.randrange(0, 1500), rng.randrange(0, 600)) for i in range(250)]
    df = spark.createDataFrame(rows, "ev_id long, template_id int, orientation int, left_pos long, right_pos long")
    hulls = []
    for _, _, o, x, y in rows:
        met = [h for h in hulls if h[0] == o and h[2] - 20 <= x <= h[3] + 20 and h[4] - 20 <= y <= h[5] + 20]
        hulls = [h for h in hulls if h not in met]
        every = [*met, (o, 1, x, x, y, y)]
        hulls.append((o, sum(h[1] for h in every), min(h[2] for h in every), max(h[3] for h in every), min(h[4] for h in every), max(h[5] for h in every)))
    got = sorted((r["orientation"], r["supp"], r["min_left"], r["max_left"], r["min_right"], r["max_right"]) for r in cluster.replayed(df, 20).collect())
    assert got == sorted(hulls)


def test_clusters_that_fall_apart_in_a_second_pass(spark):
    # the right sides part the rows, and then the left sides no longer chain
    rows = [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 50, 900), (3, 0, 0, 0, 100, 0), (4, 0, 0, 0, 110, 40)]
    df = spark.createDataFrame(rows, "ev_id long, template_id int, orientation int, kind int, left_pos long, right_pos long")
    got = lambda passes: sorted((r["min_left"], r["supp"]) for r in cluster.breakpoints(df, 50, passes).collect())
    assert got(1) == [(0, 3), (50, 1)] and got(0) == [(0, 1), (50, 1), (100, 2)]


@pytest.mark.parametrize("few", [200_000, 0])
def test_numbers_in_order(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    rng = random.Random(3)
    rows = [(rng.choice(["DEL", "DUP", "DUP:TANDEM", "TRA", "INV"]), 0, rng.randrange(9000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "sv_type string, template_id int, begin_pos long, bp_id long").withColumns({"end_pos": F.col("begin_pos") + 9, "status": F.lit("PASS"), "no": F.lit(None).cast("int")})
    ends = spark.createDataFrame([("BND", 0, 5, 1000, 1), ("BND", 1, 9, 1000, 2), ("BND", 0, 1, 1001, 1), ("BND", 2, 3, 1001, 2)], "sv_type string, template_id int, begin_pos long, bp_id long, no int").withColumns({"end_pos": F.lit(None).cast("long"), "status": F.lit("PASS")})
    got = {(r["bp_id"], r["no"]): r["sv_id"] for r in calls.numbered(df.unionByName(ends)).collect()}
    want, seen = {}, {}
    for kind, _, b, i in sorted(rows, key=lambda r: (r[0].split(":")[0], r[2], r[3])):
        kind = kind.split(":")[0]
        seen[kind] = seen.get(kind, -1 if kind == "TRA" else 0) + 1
        want[i, None] = f"{kind}_{seen[kind]}"
    assert got == want | {(1001, 1): "BND_1_1", (1001, 2): "BND_1_2", (1000, 1): "BND_2_1", (1000, 2): "BND_2_2"}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=30), st.text("ACGT", min_size=1, max_size=10))
def test_search_matches_edit_distance(text, needle):
    hits = seqsearch.approximate_hits(text, needle, 0.3)
    best = min(_distance(needle, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert bool(hits) == (best <= int(0.3 * len(needle)))
    for b, e, k in hits:
        assert _distance(needle, text[b:e]) == k


def test_long_needle():
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(300))
    needle = text[50:150]
    assert seqsearch.approximate_hits(text, needle, 0.05) == [(50, 150, 0)]


def test_pileup(spark):
    df = spark.createDataFrame([(0, 10, "ACG"), (0, 11, "CG"), (0, 11, "TG")], "template_id int, begin_pos long, seq string")
    got = {r["pos"]: (r["base"], r["depth"]) for r in seqsearch.pileup(df).collect()}
    assert got == {10: ("A", 1), 11: ("C", 3), 12: ("G", 3)}


def test_regions(spark):
    chunks = spark.createDataFrame([(0, 0, "ACGT"), (0, 1, "TTTT"), (0, 2, "GG")], "template_id int, chunk_no int, seq string")
    wanted = spark.createDataFrame([(1, 0, 2, 9), (2, 0, 8, 99), (3, 0, 50, 60)], "rid long, template_id int, begin_pos long, end_pos long")
    assert {r["rid"]: r["seq"] for r in seqsearch.regions(chunks, wanted, 4).collect()} == {1: "GTTTTTG", 2: "GG", 3: ""}


def test_as_of(spark):
    rng = random.Random(4)
    known = [(rng.choice([1, 2]), rng.randrange(500), rng.randrange(99)) for _ in range(60)]
    asked = [(rng.choice([1, 2, 3]), rng.randrange(-5, 520), i) for i in range(80)]
    a, b = spark.createDataFrame(known, "k int, p long, v long"), spark.createDataFrame(asked, "k int, p long, i int")
    got = {r["i"]: r["v"] for r in intervals.as_of(a, b, "k", "p", "v", coarse=64).collect()}
    want = {i: max(((p, v) for k2, p, v in known if k2 == k and p <= at), default=(None, None))[1] for k, at, i in asked}
    assert got == want


def test_seeds_with_a_hot_word(spark):
    a = spark.createDataFrame([(1, "A" * 30), (2, "ACGTACGTAC")], "seq_id long, seq string")
    b = spark.createDataFrame([(7, "A" * 60 + "ACGTACGTAC"), (8, "ACGTACGTAC" * 200)], "seq_id long, seq string")
    want = {}
    for q, x in ((1, "A" * 30), (2, "ACGTACGTAC")):
        for t, y in ((7, "A" * 60 + "ACGTACGTAC"), (8, "ACGTACGTAC" * 200)):
            for i in range(len(x) - 4):
                for j in range(len(y) - 4):
                    if x[i : i + 5] == y[j : j + 5]:
                        want[q, t, j - i] = want.get((q, t, j - i), 0) + 1
    got = {(r["qid"], r["tid"], r["diagonal"]): r["seeds"] for r in seqsearch.seeded(a, b, 5, hot=3).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=12), st.text("ACGT", min_size=1, max_size=14))
def test_local_alignment_matches_the_plain_recurrence(a, b):
    low = float("-inf")
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            e[i][j] = max(e[i][j - 1] - 1, h[i][j - 1] - 2)
            f[i][j] = max(f[i - 1][j] - 1, h[i - 1][j] - 2)
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), e[i][j], f[i][j])
    score, begin, end = seqsearch.local_score(a, b)
    assert score == max(max(r) for r in h) and (score == 0 or begin < end)


def test_kmers_that_no_query_holds_are_never_rows(spark):
    rng = random.Random(6)
    a = spark.createDataFrame([(1, "ACGTACGTACGTTTACGACC")], "seq_id long, seq string")
    b = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(20)] + [(99, "GG" + "ACGTACGTACGTTTACGACC")], "seq_id long, seq string")
    kept = seqsearch._shared_kmers(b, a, 12).collect()
    assert {(r["tp"], r["kmer"]) for r in kept if r["tid"] == 99} >= {(i + 2, "ACGTACGTACGTTTACGACC"[i : i + 12]) for i in range(9)}
    assert len(kept) < 100  # of 40,000


def test_diagonals_of_one_letter_are_not_shuffled(spark):
    a = spark.createDataFrame([(i, "T" * 60) for i in range(20)], "seq_id long, seq string")
    b = spark.createDataFrame([(i, "T" * 2000) for i in range(20)], "seq_id long, seq string")
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert seqsearch.extended(a, b, 20, 5).where("seeds = 41 and edits = 0 and hit_end = hit_begin + 60").count() == 400 * 1941
    assert written() - before < 1e6


def test_equal_texts_are_extended_once_and_given_with_all_ids(spark, monkeypatch):
    rng, looked = random.Random(11), spark.sparkContext.accumulator(0)
    texts = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(3)] + ["AC" * 50, "T" * 80, "ACG"]
    a = [(1000 + i, texts[i % 5][7 : 7 + 30 + i % 2]) for i in range(15)]
    b = [(i, texts[i % 6]) for i in range(30)] + [(99, texts[0][:40] + "G" + texts[0][40:])]
    want = []
    for q, x in a:
        for t, y in b:
            for d in range(len(y) - len(x) + 1):
                same = [c == y[d + i] for i, c in enumerate(x)]
                seeds = sum(all(same[i : i + 12]) for i in range(len(x) - 11))
                if seeds >= 3:
                    want.append((q, t, d, seeds, d, d + len(x), same.count(False)))
    inner = seqsearch._extender

    def counted(k, least):
        run = inner(k, least)

        def each(it):
            for rb in it:
                looked.add(rb.column(0).null_count)
                yield rb

        return lambda it: run(each(it))

    monkeypatch.setattr(seqsearch, "_extender", counted)
    left, right = spark.createDataFrame(a, "seq_id long, seq string"), spark.createDataFrame(b, "seq_id long, seq string")
    for pack, targets in ((64, 6), (2, 1 + 5 * 3)):  # distinct targets of at least 12 letters, and packs of their ids
        looked.value = 0
        got = seqsearch.extended(left, right, 12, 3, hot=5, pack=pack).collect()
        assert sorted(map(tuple, got)) == sorted(want) and looked.value == targets


def test_adjacent_intervals_are_counted_without_pairs(spark):
    rng = random.Random(12)
    a = [(i, rng.choice([1, 2, 3, None]), b := rng.randrange(-60, 500), b + rng.randrange(-3, 60)) for i in range(150)]
    b = [(rng.choice([1, 2, None]), p := rng.randrange(-60, 500), p + rng.choice([0, 30, 200, -1])) for _ in range(90)]
    left, right = spark.createDataFrame(a, "i int, k int, b1 long, e1 long"), spark.createDataFrame(b, "k int, b2 long, e2 long")
    got = {r["i"]: r["n"] for r in intervals.adjacent_counts(left, right, ["k"], ("b1", "e1"), ("b2", "e2"), 20, "n", coarse=64).collect()}
    near = {i: sum(k == k2 and b2 <= e2 and not (b1 <= e2 and b2 <= e1) and max(b1, b2) - min(e1, e2) <= 20 for k2, b2, e2 in b) for i, k, b1, e1 in a if k and b1 <= e1}
    assert got == {i: n for i, n in near.items() if n} and len(got) > 30
    # 90,000 times as many pairs as rows
    n = 300_000
    many = spark.range(n).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("b1"), F.lit(9).cast("long").alias("e1"))
    others = spark.range(n).select(F.lit(1).alias("k"), F.lit(20).cast("long").alias("b2"), F.lit(30).cast("long").alias("e2"))
    assert intervals.adjacent_counts(many, others, ["k"], ("b1", "e1"), ("b2", "e2"), 20, "n").where(f"n = {n}").count() == n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_reads_that_end_before_they_begin_count_as_sql_has_them(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "orders"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        df = df.withColumn("value", F.when(F.col("event_id") % 3 == 0, -F.col("value")).when(F.col("event_id") % 3 == 1, -F.col("event_id") % 60.0).otherwise(F.col("value"))) if t == "events" else df
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["interval_adjacent_join"]).fetchall())
    assert sorted(map(tuple, catalog.interval_adjacent_join(spark, str(tmp_path)).select("read_id", "near").collect())) == want and want


def test_near_points_match_brute_force(spark):
    rng = random.Random(8)
    a = [(i, rng.choice([1, 2, None]), rng.randrange(-40, 400), rng.randrange(400)) for i in range(150)]
    b = [(rng.choice([1, 2, None]), rng.randrange(-40, 400), rng.randrange(400)) for _ in range(60)]
    left, right = spark.createDataFrame(a, "i int, k int, p long, q long"), spark.createDataFrame(b, "k int, r long, s long")
    got = sorted((r["k"], r["p"], r["q"]) for r in intervals.near_points(left, right, ["k"], ("p", "q"), ("r", "s"), 20).collect())
    want = sorted({(k, p, q) for _, k, p, q in a if any(k is not None and k == k2 and abs(p - r) <= 20 and abs(q - s) <= 20 for k2, r, s in b)})
    assert got == want and len(want) > 5


def test_points_of_one_window_are_one_row(spark):
    n = 200_000
    runs = spark.createDataFrame([(1, 0, 50, 3), (1, 50, 90, 5)], "k int, start long, stop long, depth long")
    points = spark.range(n).select(F.col("id").alias("i"), F.lit(1).alias("k"), F.lit(50).cast("long").alias("pos"))
    lengths = spark.createDataFrame([(1, 1000)], "k int, length long")
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = depth.window_means(runs, points, lengths, "k", "i", "pos", 10, 9).groupBy(F.round("left_mean", 3), F.round("right_mean", 3)).count().collect()
    assert [tuple(r) for r in got] == [(3.0, 5.0, n)]
    assert written() - before < 8e6


def test_a_pile_up_of_many_batches_hands_on_few_small_rows(spark):
    n = 4000
    rows = spark.range(0, n, 1, 2).select(F.lit(1).alias("template_id"), (F.col("id") % 3).alias("begin_pos"), F.expr("repeat('ACGGT', 400)").alias("seq"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # each batch was a row of its own for each stretch
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    try:
        before = written()
        got = seqsearch.pileup(rows).agg(F.count("*"), F.sum("depth")).first()
        assert tuple(got) == (2002, n * 2000)
        assert written() - before < 300_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_deep_evidence_is_clustered_by_place(spark, monkeypatch):
    # 4,000 rows at 8 places in three clusters; medians count rows, not places
    rng = random.Random(3)
    spots = [(0, 100, 300), (0, 120, 310), (0, 121, 311), (1, 150, 330), (0, 5000, 7000), (0, 5050, 7050), (1, 9000, 9100), (1, 9049, 9140)]
    made = [(1, 0, *rng.choices(spots, [9, 1, 4, 2, 1, 1, 3, 3])[0]) for _ in range(4000)]
    sizes = []
    real = cluster.settled

    def seen(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cluster, "settled", seen)
    df = spark.createDataFrame(made, "template_id int, orientation int, kind int, left_pos long, right_pos long")
    got = {r["min_left"]: r for r in cluster.breakpoints(df, 50).collect()}
    assert max(sizes) <= len(spots) and set(got) == {100, 5000, 9000}
    for low, r in got.items():
        mine = [x for x in made if low <= x[3] <= low + 100]
        exact = [x for x in mine if x[2] != 1]
        assert (r["supp"], r["se"], r["pe"]) == (len(mine), len(exact), len(mine) - len(exact))
        want = tuple(sorted(x[k] for x in exact)[len(exact) // 2] for k in (3, 4)) if exact else (min(x[3] for x in mine), max(x[4] for x in mine))
        assert (r["final_left"], r["final_right"], r["imprecise"]) == (*want, not exact)


def test_operations_are_taken_apart_once(spark):
    cols = "ordinal long, qname string, rid int, begin_pos int, flag int, next_rid int, next_pos int, tlen long, map_q int, cigar string, seq string, tags map<string,string>"
    rows = [(1, "a", 0, 100, 65, 0, 900, 0, 60, "60M40S", "", {"SA": "x"}), (2, "a", 0, 900, 2113, 0, 100, 0, 60, "60S40M", "", {}), (3, "b", 0, 500, 99, 0, 700, 300, 60, "30M80D30M", "", {}), (4, "c", 0, 500, 99, 0, 700, 300, 60, None, "", {})]
    o = CallOptions(use_depth=False)
    routed = command.routed_reads(spark.createDataFrame(rows, cols), o).localCheckpoint()
    exact = command.exact_evidence(routed, o)
    assert sorted((r["left_pos"], r["right_pos"]) for r in exact.collect()) == [(160, 899), (530, 610)]
    assert "regexp_extract_all" not in exact._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_spans_asked_for_are_found_and_as_one_fold_finds_them(spark):
    rng = random.Random(5)
    texts = ["", "*", "60D", "30H60N", "5H10S50M", "80D30S40M", "30S", *["".join(f"{rng.choice([5, 19, 20, 49, 50, 90])}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 6))) for _ in range(150)]]
    cols = "ordinal long, qname string, rid int, begin_pos int, flag int, next_rid int, next_pos int, tlen long, map_q int, cigar string, seq string, tags map<string,string>"
    rows = [(i, str(i), 0, 7 * i, 65, 0, 900, 0, 60, t, "", {"SA": "x"}) for i, t in enumerate([*texts, None])]
    for double in (False, True):
        routed = command.routed_reads(spark.createDataFrame(rows, cols), CallOptions(use_depth=False, compat_double_deletion=double))
        got = {r["ordinal"]: (r["ref_end"], r["q_begin"], r["q_end"], [tuple(x) for x in r["deletions"]]) for r in routed.collect() if r["cigar"] is None and r["ordinal"] < len(texts)}
        for i, text in enumerate(texts):
            end, first, last, gone = 7 * i, None, None, []
            for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text):
                n = int(n)
                if op in "MIP=X":
                    first, last = first or 0, (last or 0) + n
                elif op in "SH" and first is None:
                    first = last = n
                if op in "DN" and n >= 50:
                    gone.append((end, end + n))
                end += n * (op in "M=XDN") + n * (double and op in "DN" and n >= 50)
            assert got[i] == (end, first, last, gone), text
        # sizes and clips, which nothing reads, are left out
        plan = routed._jdf.queryExecution().optimizedPlan().toString()
        assert "q_size" not in plan and "clips" not in plan
