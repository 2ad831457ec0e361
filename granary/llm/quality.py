"""Quality classifier on supervised subword embeddings (operator 2).

A document is the average of learned vectors: one for each hashed word and one
for each hashed character 3-, 4- and 5-gram of its words. Before, tokenising
puts the token REPEAT after each word that repeats the one before it, a usual
rule since averages can't tell order; the token has its word and n-grams like
any other. A softmax over the
average tells the classes; vectors and softmax are trained together by
stochastic gradient descent in numpy. As both layers are linear, a trained
model folds to one number for each hash bucket, so scoring is a gather over
arrays of hashes, without any loop over words.

Defined results: null and empty texts have no features and get the score of
the zero vector; every row is scored, repeated rows too; with no usable labels,
or with one class only, every score is that class's prior. Labels, language,
source and id are never inputs. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import mapped, slices
from granary.llm.labelled import labelled_sample, remainder

#: Labelled rows of each class that a model is trained on.
PER_CLASS = 1_500
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 16, 8, 0.5
GRAMS = (3, 4, 5)
#: The token that stands for a repeated word.
REPEAT = "xxwrep"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashes(text: str) -> np.ndarray:
    """Bucket numbers of one text's tokens, repeats of words marked."""
    found, again = _hashes(text)
    return np.concatenate([found, np.tile(_hashes(REPEAT)[0], again)]) if again else found


def _hashes(text: str) -> tuple[np.ndarray, int]:
    """Bucket numbers of the words and character n-grams of one text, with repeats, and how many words repeat the one before.

    Words are runs of bytes between white space; n-grams run over the bytes of a
    word with a mark at either end, so that they don't cross words.
    """
    raw = np.frombuffer(f" {' '.join(text.split())} ".encode("utf-8", "replace"), np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64), 0
    space = raw == 32
    b = raw.astype(np.uint64) + np.uint64(1)
    starts = np.flatnonzero(space)[:-1]
    at = np.arange(len(raw))
    place = at - np.maximum.accumulate(np.where(space, at, 0))
    with np.errstate(over="ignore"):
        powers = _mixed((place.astype(np.uint64) + np.uint64(7)) * _MIX)
        words = _mixed(np.add.reduceat((b * powers)[:-1], starts))
        again = int((words[1:] == words[:-1]).sum())
        out = [words ^ np.uint64(1)]
        inner = np.cumsum(space)
        h = b
        for n in range(2, max(GRAMS) + 1):
            if n > len(raw):
                break
            h = h[: len(raw) - n + 1] * np.uint64(1_000_003) + b[n - 1 :]
            if n in GRAMS:
                # A blank may stand at the ends of an n-gram only.
                ok = inner[n - 2 :][: len(h)] - inner[: len(h)] == 0
                out.append(_mixed(h[ok] * _MIX + np.uint64(n)))
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64), again


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their share of its features."""
    ids, n = np.unique(hashes(text), return_counts=True)
    return ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


class Model:
    """Vectors of the buckets and the softmax over their average."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias
        # Two classes: the log-odds of class 1 is one number for each bucket.
        self.folded = (vectors @ (out[1] - out[0])).astype(np.float32)
        self.offset = float(bias[1] - bias[0])

    def embed(self, text: str) -> np.ndarray:
        ids, share = counted(text)
        return share @ self.vectors[ids] if len(ids) else np.zeros(self.vectors.shape[1], np.float32)

    def score(self, text: str) -> float:
        ids = hashes(text)
        z = self.offset + (float(self.folded[ids].mean(dtype=np.float64)) if len(ids) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """SGD over (buckets, shares, class), classes weighed alike, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    n = np.bincount([y for *_, y in rows], minlength=2)
    if 0 in n:
        p = (n[1] + 0.5) / (n.sum() + 1)
        return Model(np.zeros((BUCKETS, DIM), np.float32), out, np.array([0, np.log(p / (1 - p))], np.float32))
    weight = n.sum() / (2 * n)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share, y = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= np.float32(min(weight[y], 5.0))
            back = p @ out
            out -= rate * np.outer(p, hidden).astype(np.float32)
            bias -= np.float32(0.1 * rate) * p
            if len(ids):
                # The gradient of an average is shared out by its features' counts; scaled so that long texts learn too.
                vectors[ids] -= np.outer(share * np.float32(rate * 10), back)
    return Model(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of the labelled rows that `usable` admits; the driver gets bucket counts only."""
    sample = labelled_sample(docs, labels, "quality", usable, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [counted(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary()), b.column("y")], ["doc_id", "ids", "share", "y"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = mapped(sample.select("doc_id", "text", "y"), run, f"doc_id {kind}, ids binary, share binary, y int").orderBy("doc_id")
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.share, np.float32), r.y) for r in rows.toLocalIterator()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""
    folded = Model.__new__(Model)
    folded.folded, folded.offset = model.folded, model.offset
    shared = docs.sparkSession.sparkContext.broadcast(folded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [shared.value.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows with crc32 remainder 1 of 3 are held out of learning."""
    out = score(docs, fit(docs, labels, remainder("doc_id", 3) != 1))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
