"""Consensus of clips: the true sequence out of noisy ones, whatever the order and number."""

import random

import pytest

from strandweave import catalog
from strandweave.operators import consensus as module
from strandweave.operators import seqsearch
from strandweave.operators.clips import clip_clusters
from strandweave.operators.consensus import assembled, consensus, consensuses


def _noisy(seq, rng, rate=0.05):
    out = []
    for c in seq:
        x = rng.random()
        if x < rate * 0.6:
            out.append(rng.choice([b for b in "ACGT" if b != c]))
        elif x < rate * 0.8:
            continue
        elif x < rate:
            out += [c, rng.choice("ACGT")]
        else:
            out.append(c)
    return "".join(out)


def test_the_true_sequence_comes_out():
    rng, right = random.Random(1), 0
    for _ in range(25):
        truth = "".join(rng.choice("ACGT") for _ in range(90))
        seqs = [_noisy(truth, rng) for _ in range(20)]
        got = consensus(seqs, [1] * len(seqs))
        assert got == consensus(seqs[::-1], [1] * len(seqs))
        right += got == truth
        assert truth[5:-5] in got
    assert right >= 22, right


def test_clips_of_different_lengths_and_starts():
    rng = random.Random(2)
    for _ in range(10):
        truth = "".join(rng.choice("ACGT") for _ in range(80))
        seqs = [_noisy(truth[rng.randrange(4) : rng.randrange(40, 81)], rng) for _ in range(24)]
        got = consensus(seqs, [1] * 24)
        assert len(got) >= 50 and truth.find(got[3:45]) in range(0, 9), (got, truth)


def test_a_letter_inserted_beside_one_that_differs():
    # the third inserts TT after a letter, the last after the letter that differs from it
    head, tail = "GATTACAGGC", "CCGAGTACGA"
    seqs = [head + "A" + tail, head + "G" + tail, head + "ATT" + tail, head + "GTT" + tail]
    assert consensus(seqs, [9, 7, 5, 3]) == seqs[0]
    for weights in ([3, 5, 7, 9], [5, 9, 3, 7], [9, 3, 7, 5]):
        assert consensus(seqs, weights) in seqs


def test_few_sequences_and_weights():
    assert consensus(["ACG"], [1]) == "ACG" and consensus(["ACG", "ACGTT"], [1, 1]) == "ACGTT"
    assert consensus(["ACGTACGT", "ACGAACGT"], [5, 1]) == "ACGTACGT"
    assert consensus(["AAAA", "CCCC", "GGGG"], [1, 1, 1]) in ("AAAA", "CCCC", "GGGG")


def test_runs_of_one_or_two_letters_keep_their_length():
    # letters that differ, moved against each other along a run, once cost more than a gap
    rng = random.Random(6)
    for k in range(60):
        truth = (rng.choice(["A", "C", "G", "T", "AC", "TG", "GA"]) * 60)[:60]
        seqs = sorted({"".join(c if rng.random() > 0.05 else c.translate(str.maketrans("ACGT", "CGTA")) for c in truth) for _ in range(20)})
        assert consensus(seqs, [1] * len(seqs)) == truth, k


def test_groups_of_any_size(spark):
    rng = random.Random(3)
    truth = {k: "".join(rng.choice("ACGT") for _ in range(60)) for k in range(3)}
    sizes = {0: 400, 1: 12, 2: 1}  # the first takes two rounds
    rows = [(k, _noisy(truth[k], rng) if k < 2 else truth[k]) for k, n in sizes.items() for _ in range(n)]
    rows += [(7, None), (7, ""), (8, "ACGT"), (8, "ACGT")]
    got = {r["k"]: r["seq"] for r in assembled(spark.createDataFrame(rows, "k long, seq string"), "k").collect()}
    assert got == truth | {8: "ACGT"}
    assert assembled(spark.createDataFrame([], "k long, seq string"), "k").count() == 0


def test_clusters_with_their_consensus(spark):
    rng = random.Random(4)
    truth = "".join(rng.choice("ACGT") for _ in range(50))
    rows = [(i, 0, False, 1000 + i % 3, _noisy(truth, rng)) for i in range(15)] + [(99, 0, True, 1000, "ACGTACGTACGTACGTACGT")]
    clips = spark.createDataFrame(rows, "ordinal long, template_id int, is_left boolean, pos long, seq string")
    plain = {r["is_left"]: r for r in clip_clusters(clips, 50).collect()}
    made = {r["is_left"]: r for r in clip_clusters(clips, 50, assemble=True).collect()}
    assert plain[False]["seq"] == rows[0][4] and made[False]["seq"] == truth
    assert made[True]["seq"] == "ACGTACGTACGTACGTACGT" and made[False]["supp"] == 15 and made[False]["clip_id"] == plain[False]["clip_id"]


@pytest.mark.parametrize("cells", [1 << 24, 1 << 15])
def test_groups_together_and_in_turns_give_what_each_gives(monkeypatch, cells):
    rng, groups = random.Random(8), []
    for n in (1, 2, 5, 20, 40):
        truth = "".join(rng.choice("ACGT\u0416") for _ in range(rng.randrange(30, 140)))
        groups.append(([_noisy(truth, rng, 0.1) for _ in range(n)], [rng.randrange(1, 4) for _ in range(n)]))
    alone = [consensus(*g) for g in groups]
    monkeypatch.setattr(module, "_CELLS", cells)
    assert consensuses(groups) == alone


def test_only_what_does_not_stand_there_is_searched_with_errors(spark, tmp_path, monkeypatch):
    rng, asked, real = random.Random(9), [], seqsearch.searched
    texts = ["".join(rng.choice("acgt") for _ in range(300)) for _ in range(20)] + ["a" * 70, "ac" * 40, "acgt", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(seqsearch, "searched", lambda pairs, error: asked.append(pairs.count()) or real(pairs, error))
    got = catalog.clip_consensus(spark, str(tmp_path)).collect()
    assert sorted(r["clip_id"] for r in got) == list(range(22)) and all(r["close"] and r["found"] for r in got)
    assert asked == [0]
