"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Metadata are the sizes of a text (bytes, words, lines); its id, language and
source are never read.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),
linear in the features present by the sum-of-squares identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches
from strandweave.llm.textops import chunks, word_hashes


@dataclass(frozen=True)
class FactorMachine:
    """Parameters.

    ``sample``: at most so many labelled rows are fitted, chosen by a hash of
    the id; the rows scored have no bound. ``buckets`` for hashed words.
    """

    sample: int = 6000
    buckets: int = 4096
    factors: int = 8
    epochs: int = 30
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11


#: Structure statistics of a text, then metadata (its length in bytes, words and lines).
STATS = ("upper", "lower", "digit", "space", "punct", "symbol", "pipe", "high", "words_distinct", "mean_word", "top_word", "all_caps", "ends_punct", "line_words", "lines_distinct", "log_bytes", "log_words", "log_lines")

_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
_CLASS[ord("|")] = 6
_CLASS[128:] = 7


def features(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's feature numbers and values: STATS first, then word buckets by relative frequency."""
    n_stats = len(STATS)
    for a, b in chunks(texts):
        hashes, bounds = word_hashes(texts[a:b])
        for i in range(b - a):
            text, words = texts[a + i], hashes[bounds[i] : bounds[i + 1]]
            raw = np.frombuffer(text, dtype=np.uint8)
            share = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
            lines = text.split(b"\n")
            n = len(words)
            _, times = np.unique(words, return_counts=True)
            capital = (np.diff((_CLASS[raw] == 0).astype(np.int8)) == 1).sum() if len(raw) else 0
            stats = [
                *share,
                len(times) / max(1, n) * np.log1p(n) / 5,
                min(3.0, len(raw) / max(1, n) / 6),
                times.max() / n if n else 0.0,
                share[0] / max(1e-9, share[0] + share[1]) if n else 0.0,
                capital / max(1, n),
                min(3.0, n / len(lines) / 40),
                len(set(lines)) / len(lines),
                np.log1p(len(raw)) / 10,
                np.log1p(n) / 8,
                np.log1p(len(lines)) / 5,
            ]
            at, count = np.unique((words % np.uint64(buckets)).astype(np.int64), return_counts=True)
            yield np.concatenate([np.arange(n_stats), at + n_stats]), np.concatenate([stats, np.sqrt(count / max(1, n))])


class Model:
    """A fitted machine; small and of fixed size, so it travels with the task."""

    def __init__(self, p: FactorMachine, bias: float = 0.0):
        rng = np.random.default_rng(p.seed)
        size = len(STATS) + p.buckets
        self.p, self.bias = p, bias
        self.w = np.zeros(size)
        self.v = rng.normal(0, 0.05, (size, p.factors))

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        scaled = self.v[at] * x[:, None]
        s = scaled.sum(axis=0)
        return float(self.bias + self.w[at] @ x + 0.5 * (s @ s - np.einsum("ij,ij->", scaled, scaled)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
        """Logistic loss by AdaGrad in a seeded order."""
        if not len(y):
            return self
        base = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(base / (1 - base)))
        if y.min() == y.max():
            return self
        p, rng = self.p, np.random.default_rng(self.p.seed)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(p.epochs):
            for k in rng.permutation(len(y)):
                at, x = rows[k]
                vx = self.v[at] * x[:, None]
                s = vx.sum(axis=0)
                z = self.bias + self.w[at] @ x + 0.5 * (s @ s - np.einsum("ij,ij->", vx, vx))
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]
                gb += g * g
                self.bias -= p.rate * g / np.sqrt(gb)
                dw = g * x + p.decay * self.w[at]
                gw[at] += dw * dw
                self.w[at] -= p.rate * 5 * dw / np.sqrt(gw[at])
                dv = g * x[:, None] * (s - vx) + p.decay * self.v[at]
                gv[at] += dv * dv
                self.v[at] -= p.rate * dv / np.sqrt(gv[at])
        return self

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, x), -500, 500))))


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, p: FactorMachine = FactorMachine(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows whose crc32(id) mod 4 is not 2, at most ``p.sample`` of them.

    Labels that are null, or whose id is null or not in ``docs``, don't count;
    a repeated label row counts once. No usable label gives score 0.5
    everywhere; labels of one kind give their smoothed share.
    """
    spark = docs.sparkSession
    batches(spark)
    name = F.col(id_col).cast("string")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(name) % 4 != 2))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).distinct()
    chosen = known.orderBy(F.xxhash64("id", F.lit(p.seed)), "id", "y").limit(p.sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            found = [(at.astype(np.int32).tolist(), x.tolist()) for at, x in features(_bytes(rb.column("text")), p.buckets)]
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["id", "y", "at", "x"])

    got = rows.mapInArrow(measure, "id long, y double, at array<int>, x array<double>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    lists = [(np.asarray(a.values), np.asarray(x.values)) for a, x in zip(got["at"], got["x"], strict=True)]
    return Model(p).fit(lists, np.asarray(got["y"], dtype=float))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the score of each whole text, empty and null texts too; a row per row."""
    batches(docs.sparkSession)

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            out = [model.score(at, x) for at, x in features(_bytes(rb.column(1)), model.p.buckets)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(judge, f"`{id_col}` long, score double")


def quality(docs: DataFrame, labels: DataFrame, p: FactorMachine = FactorMachine(), threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: (doc_id, held_out, score, predicted).

    A null id has held_out null. Texts are scored whole, however long; equal
    texts score alike, and rows repeat as they do in ``docs``. Other columns
    aren't read, so their names can't clash. An empty table gives an empty result.
    """
    out = scored(docs, fit(docs, labels, p))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, p: FactorMachine = FactorMachine(), threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows scored under ``threshold``, with all columns, in one pass.

    Null and empty texts are scored as empty ones; rows repeat, and ids may be
    null. Columns must be of types that Arrow carries; none is interpreted but
    the text. An empty table gives an empty result.
    """
    model = fit(docs, labels, p)
    names = docs.columns
    place = names.index("text")

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            good = [model.score(at, x) >= threshold for at, x in features(_bytes(rb.column(place)), p.buckets)]
            yield rb.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(pick, docs.schema)
