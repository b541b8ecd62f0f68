"""Registered queries against their SQL on the smallest tables, and that all can be planned."""

import os
import random
import re

import pytest

from strandweave import catalog

SF = "/root/testdata/sf0.001"
CHECKED = ["read_routing_flags", "cigar_ref_length", "cigar_fold_segments", "insert_size_median_mad", "mate_pairing", "split_adjacent_segments", "interval_bin_join", "breakpoint_cluster", "coverage_rle", "window_depth_mean", "filter_and_vote", "call_inversion", "call_breakend", "order_rank_aggregation", "info_parse", "info_format", "gc_entropy", "reference_region", "merged_evidence", "call_end_to_end", "asof_lookup", "merge_reciprocal_overlap_pairs"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
    out = duck.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in out.description].index(c) for c in cols]
    want = sorted(map(repr, (tuple(r[i] for i in at) for r in out.fetchall())))
    assert got == want


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_crowded_join_meets_equal_intervals_once(spark, duck):
    test_matches_sql(spark, duck, "crowded_interval_join")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["kmer_seed_search", "seed_extension", "unmatched_pairs_anti", "kl_score"])
def test_shared_kmers_match_sql(spark, duck, name):
    test_matches_sql(spark, duck, name)


def test_sequences_take_out_runs_of_letters_and_chunks_walk_pieces(spark, tmp_path):
    long = "".join(random.Random(9).choices("acgtACGTxyz ,\n", k=20_000))
    texts = [None, "", "xyz", "Tag\ncat", "\u017f\u212a\u0130 gAtTaCa \U0001f9ec a", "a", long, "acgt" * 1024, "acgt" * 1024 + "t"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    dna = catalog._dna(spark, str(tmp_path))
    want = {i: None if t is None else re.sub("[^acgt]", "", t.lower()).upper() for i, t in enumerate(texts)}
    assert {r["seq_id"]: r["seq"] for r in dna.collect()} == want
    got = {(r["template_id"], r["chunk_no"]): r["seq"] for r in catalog._chunks(dna).collect()}
    assert got == {(i, k): s[64 * k : 64 * k + 64] for i, s in want.items() for k in range(-(-len(s or "") // 64))}
