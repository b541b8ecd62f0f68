"""Near-dedup of texts and vectors against brute force, and edge cases."""

import random
import re

import numpy as np
import pytest

from strandweave.llm.graph import components
from strandweave.llm.minhash_dedup import NearDedup, drop_near_duplicates, near_duplicates
from strandweave.llm.vector_dedup import Descent, near_vectors

DOCS = "doc_id long, text string, id string, n int, sig string"


def _brute(texts: dict, width: int, percent: int = 80) -> dict:
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_matches_brute_force_with_a_large_group(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {}
    for k in range(160):  # copies at all distances, some linked only by way of others
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            t[rng.randrange(120)] = rng.choice(words)
        texts[k] = " ".join(t)
    texts |= {k: " ".join(rng.choice(words) for _ in range(60)) for k in range(160, 200)}
    texts |= {200: "", 201: None, 202: "one", 203: "ONE", 204: " \t\n", 205: "é x", 206: "É x"}
    want = _brute(texts, 2)
    df = spark.createDataFrame([(k, t, "x", 1, "s") for k, t in texts.items()], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, NearDedup(width=2)).collect()}
    assert got == want


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"a{i}" for i in range(40))
    rows = [(5, long, "x", 1, "s"), (5, long, "x", 1, "s"), (7, long + " b", "x", 1, "s"), (None, long, "x", 1, "s"), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (9, 9, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in drop_near_duplicates(df).collect()) == ["5", "5", "9", "None"]
    assert near_duplicates(df.where("false")).count() == 0


def test_prune_keeps_pairs_at_the_threshold():
    p = NearDedup()
    need = p.min_matches()
    assert (np.diff(need) >= 0).all() and need[-1] < 0.8 * p.hashes


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    v[200:] = v[rng.integers(0, 20, 100)] + rng.normal(scale=0.05, size=(100, 16))
    v[250] = v[3]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [], 0), (304, [1.0, None], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = n @ n.T >= 0.95
    np.fill_diagonal(near, False)
    comp = list(range(300))
    for _ in range(300):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(300)]
        if new == comp:
            break
        comp = new
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert all(got[i]["component_id"] == comp[i] and got[i]["n_links"] == near[i].sum() for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (300, 301, 302, 303, 304, None))


@pytest.mark.parametrize("chunk", [16 << 20, 1 << 15])
def test_pairs_beside_a_large_group_of_vectors(spark, chunk):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=32) + rng.normal(scale=0.1, size=(300, 32))
    lone = rng.normal(size=(150, 32))
    v = np.concatenate([hot, lone, lone[:100] + rng.normal(scale=0.2, size=(100, 32))])
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = n @ n.T >= 0.95
    np.fill_diagonal(near, False)
    assert near[300:].sum() > 150
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    p = Descent(trees=1, leaf=8, neighbours=2, rounds=1, more_rounds=0, chunk_bytes=chunk)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, p).collect()}
    assert got == dict(enumerate(near.sum(axis=1)))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 0)]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert near_vectors(df).count() == len(rows)
