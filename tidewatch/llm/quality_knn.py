"""Document quality by nearest-neighbour voting.

Texts become term vectors (hashed byte n-grams and terms for what a text's shape
shows: share of distinct words, repeated lines, symbols, length); the latent-semantic
space is the truncated singular value decomposition of the labelled sample.
The sample's unit vectors and labels are broadcast; every document's exact
cosines with all of them are computed in blocks, and the ``NEIGHBOURS`` nearest
vote with a weight that grows with similarity.

Bounded: at most ``PER_LABEL`` documents of each label are references, so the
broadcast holds at most 2 x PER_LABEL x DIMS + 2^FEATURE_BITS x DIMS numbers
(about 2 MB) whatever the corpus.

Defined results: null texts count as empty; empty texts are scored like any other
(by the shape terms); without labelled rows every score is 0.5; repeated rows
get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.features import held_out, labelled_sample, ngram_counts, unpack_vectors
from tidewatch.session import ship_package

PER_LABEL = 1500
FEATURE_BITS = 12
ORDERS = (2, 3)
DIMS = 48
NEIGHBOURS = 15
SHARPNESS = 8
THRESHOLD = 0.7
BLOCK = 512
# Weight of the shape terms beside the n-grams (each part is a unit vector).
SHAPE_WEIGHT = 1.0
_STEPS = 8


def _hat(value: float) -> list[float]:
    """A value in 0 .. 1 as weights of the two nearest of _STEPS + 1 marks."""
    at = min(max(value, 0.0), 1.0) * _STEPS
    low = min(int(at), _STEPS - 1)
    out = [0.0] * (_STEPS + 1)
    out[low], out[low + 1] = 1 - (at - low), at - low
    return out


def shape_terms(data: bytes) -> np.ndarray:
    found = data.split()
    n = max(len(found), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    total = max(sum(map(len, found)), 1)
    letters = len(data.translate(None, bytes(c for c in range(128) if not chr(c).isalpha())))
    capitals = total - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ \t\n\r\x0b\x0c"))
    odd = total - len(data.translate(None, b"#*$%&|<>!@^~_={}[]\\/+ \t\n\r\x0b\x0c"))
    again = sum(a == b for a, b in zip(found, found[1:]))
    parts = (len(set(found)) / n, len(set(lines)) / max(len(lines), 1), letters / total, min(capitals / total * 2, 1.0),
             min(odd / total * 4, 1.0), np.log2(n) / 16, again / n, min(total / n / 16, 1.0))
    return np.array([w for p in parts for w in _hat(float(p))], np.float32)


def vector(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    grams = np.sqrt(ngram_counts(data, ORDERS, FEATURE_BITS)).astype(np.float32)
    grams /= max(float(np.linalg.norm(grams)), 1e-9)
    shape = shape_terms(data)
    return np.concatenate([grams, shape * (SHAPE_WEIGHT / max(float(np.linalg.norm(shape)), 1e-9))])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    space: np.ndarray      # features x dims
    vectors: np.ndarray    # references x dims, unit length
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes of the nearest references of every row of ``x``."""
        cosine = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum((1 + np.take_along_axis(cosine, near, axis=1)) / 2, 1e-6).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def fit(x: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    mean = x.mean(axis=0)
    c = x - mean
    del x
    rng = np.random.default_rng(4)
    q = c.T @ rng.standard_normal((len(c), min(dims + 16, *c.shape))).astype(np.float32)
    for _ in range(4):  # range of the largest singular vectors
        q = c.T @ (c @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, _, rotate = np.linalg.svd(c @ q, full_matrices=False)
    space = (q @ rotate.T)[:, :dims].astype(np.float32)
    model = Model(mean, space, np.zeros((0, space.shape[1]), np.float32), labels.astype(np.float64))
    return Model(mean, space, model.project(c + mean).astype(np.float32), model.labels)


def learn(docs: DataFrame, labels: DataFrame, seed: str = "quality-1") -> Model | None:
    ship_package(docs.sparkSession)
    chosen = labelled_sample(labels, "quality", PER_LABEL, 2 * PER_LABEL, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [vector(t.as_py()).astype(np.float16).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(made, pa.binary())], names=["id", "label", "v"])

    rows = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("__label").cast("int").alias("label"), "text")
    rows = rows.mapInArrow(vectors, "id string, label int, v binary")
    # Repeated ids give one row, the least vector: at most 2 * PER_LABEL rows, the same in every run.
    rows = sorted(rows.groupBy("id", "label").agg(F.min("v").alias("v")).collect(), key=lambda r: (r["id"], r["label"]))
    if not rows:
        return None
    y, x = np.array([r["label"] for r in rows]), unpack_vectors(rows)
    del rows
    return fit(x, y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                texts = part.column("text")
                found = own.scores(np.stack([vector(t.as_py()) for t in texts])) if own else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(found, 0, 1), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
