"""Importance resampling against a plain computation, the exact cutoff, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from strandweave.llm import resample as ops

DOCS = "doc_id long, text string, rank int, k0 string, score string"


def _features(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(b" ".join(w[i : i + j])) % 10000 for j in (1, 2, 3) for i in range(len(w) - j + 1)]


def _brute(rows, target):
    got = [(k, *_features(t)) for k, t in rows]
    s, t = Counter(b for g in got for b in g[2]), Counter(b for x in target for b in _features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for k, words, found in got:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): n + 1 for n, r in enumerate(able[: len(able) * 5 // 100])}
    return sorted((tuple(r[:4]) + (drawn.get(id(r)),) for r in out), key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_matches_a_plain_computation(spark, monkeypatch, chunk):
    monkeypatch.setattr(ops, "CHUNK_BYTES", chunk)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "ß9", "x" * 70, "Tea", "don't"]
    rows = [(k, rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(rng.choice([5, 19, 20, 60])))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, "!?"), (None, "Tea " * 30), (None, "Tea " * 30), (7, rows[7][1]), (403, "tea w1 w2 " * 900)]
    rows += [(500, "w1 w2 w3 " * 10)] * 60  # one row many times
    target = [" ".join(rng.choice(words[:40]) for _ in range(50)) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame([(k, t, 1, "a", "b") for k, t in rows], DOCS).repartition(5)
    got = ops.resampled(docs, spark.createDataFrame([(1, t) for t in target], "item_id int, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(rows, target)


def test_cutoff_is_exact_for_every_rank(spark):
    rng = random.Random(5)
    keys = [(rng.randrange(4), rng.randrange(3), 0, i) for i in range(120)]
    df = spark.createDataFrame(keys, "k0 long, k1 long, k2 long, k3 long").repartition(7)
    for k in (1, 2, 37, 60, 119, 120):
        assert ops.cutoff(df, k) == sorted(keys)[k - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ops.resampled(none, none).collect() == []
    some = spark.createDataFrame([(k, "a b c d e f g h i j k l m n o p q r s t " * 2, 1, "a", "b") for k in range(20)], DOCS)
    got = ops.resampled(some, none).collect()
    assert len(got) == 20 and [r["rank"] for r in got if r["rank"]] == [1]
