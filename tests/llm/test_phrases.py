"""Phrase mining against a plain count, the summaries' guarantee, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandweave.llm import phrases as ops

DOCS = "doc_id long, text string, lang string, phrase string, f int"


def _brute(rows, p):
    n, f = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + j])) for j in range(1, p.longest + 1) for i in range(len(w) - j + 1))
    out = []
    for lang in n:
        found = []
        long = {w: a for (x, w), a in f.items() if x == lang and len(w) > 1 and a >= p.least}
        gone = {w[i : i + j] for w, a in long.items() for j in range(2, len(w)) for i in range(len(w) - j + 1) if 100 * a >= p.percent * f[lang, w[i : i + j]]}
        for w, a in long.items():
            if w not in gone:
                cuts = [(p.scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
                score, _, left, rest = min(cuts)
                found.append((-score, -a, " ".join(w).encode(), left, rest))
        for i, (s, a, w, left, rest) in enumerate(sorted(found)[: p.top]):
            out.append((lang, i + 1, w.decode(), -a, left, rest, n[lang], -s))
    return sorted(out)


def _rows(rng):
    vocabulary = [f"w{i}" for i in range(25)] + ["Tea", "É", "und"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = []
    for _ in range(150):
        text = ""
        for w in rng.choices(vocabulary, weights, k=rng.randrange(80)):
            text += rng.choice(["", "", "", "New York City Hall "]) + w + rng.choice([" ", " ", "\t", "  ", ", ", ".\n"])
        texts.append((text, rng.choice(["en", "en", "de", None])))
    return texts + [(None, "en"), ("", None), ("tea " * 500, "en"), ("a b", "de")] + [("same text here again", "fr")] * 60


@pytest.mark.parametrize("few", [False, True])
def test_matches_a_plain_count(spark, monkeypatch, few):
    p = ops.Phrases(top=20 if few else 2000, partition_bytes=3000 if few else 16 << 20, pending=2000 if few else 8_000_000)
    if few:  # parts of long texts, summaries of many partitions merged from many parts
        monkeypatch.setattr(ops, "CHUNK_BYTES", 300)
    rows = _rows(random.Random(8))
    df = spark.createDataFrame([(i, t, x, "p", 1) for i, (t, x) in enumerate(rows)], DOCS).repartition(4)
    got = sorted(tuple(r) for r in ops.collocations(df, p).collect())
    assert got == _brute(rows, p) and len(got) > 20


def test_merged_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(2)
    for _ in range(50):
        mass = rng.zipf(1.3, 20_000).astype(np.uint64)
        capacity = len(mass) // 30 + 1
        parts = [ops.reduced(*ops._summed(x), capacity) for x in np.array_split(mass, 9)]
        lost, keys, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for k, c, gone in parts:
            keys, counts = ops._summed(np.concatenate([keys, k]), np.concatenate([counts, c]))
            keys, counts, more = ops.reduced(keys, counts, capacity)
            lost += gone + more
        held = dict(zip(keys.tolist(), counts.tolist(), strict=True))
        true = Counter(mass.tolist())
        assert lost < 30 and len(held) <= capacity
        assert all(true[k] - lost <= held.get(k, 0) <= true[k] for k in true)
        assert {k for k, n in true.items() if n >= 30} <= {k for k, n in held.items() if n + lost >= 30}


def test_keys_are_packed_without_loss():
    rng = np.random.default_rng(4)
    for n, top in ((1, 64), (2, 64), (5, 64), (1000, 64), (1000, 40)):
        keys = np.unique(rng.integers(0, 2**top - 1, n, dtype=np.uint64) & np.uint64(2**64 - 2**16))
        assert (ops._unpacked(ops._packed(keys), len(keys)) == keys).all()


def test_empty_and_rare(spark):
    none = spark.createDataFrame([], DOCS)
    assert ops.collocations(none).collect() == []
    assert ops.collocations(spark.createDataFrame([(1, "a b c", "en", "p", 1)], DOCS)).collect() == []


def test_only_phrases_that_may_rank_are_cut_everywhere(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcdefgh", k=40)), "en") for _ in range(400)] + [("one two three four", "en")] * 40
    p, cuts, real = ops.Phrases(top=5, least=30), [], ops._with_parts

    def counted(rows, known, total):
        cuts.append(rows.count())
        return real(rows, known, total)

    monkeypatch.setattr(ops, "_with_parts", counted)
    df = spark.createDataFrame([(i, t, x, "p", 1) for i, (t, x) in enumerate(rows)], DOCS)
    got = sorted(tuple(r) for r in ops.collocations(df, p).collect())
    assert got == _brute(rows, p)
    whole = sum(r[0] for r in cuts_of(rows, p))
    assert sum(cuts) < whole, (cuts, whole)


def cuts_of(rows, p):
    """(number of cuts,) of each frequent phrase."""
    f = Counter()
    for text, _ in rows:
        w = text.split()
        f.update(tuple(w[i : i + j]) for j in range(2, p.longest + 1) for i in range(len(w) - j + 1))
    return [(len(w) - 1,) for w, a in f.items() if a >= p.least]
