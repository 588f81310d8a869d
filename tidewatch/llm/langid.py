"""Language identification by error-correcting output codes.

Every language gets a codeword of a simplex code: with n languages and 2^m >= n, at least
2^4, words have up to 2^m - 1 bits and any two of them differ in half, so the bits that may be wrong grow
with the languages.  One linear classifier per bit, over hashed character n-grams of the
whole lower-cased text, predicts that bit; decoding sums a loss of every
classifier's margin against a language's codeword, weighted by how well that
classifier did on its training rows, and takes the nearest word.  If a second
language is almost as near, the row is flagged as ambiguous.

Learning uses at most ``SAMPLE_ROWS`` documents (``PER_LANGUAGE`` of each
language); their feature vectors, not their texts, reach the driver.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is everything if nothing could be learned; repeated rows get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidewatch.llm.features import held_out, labelled_sample, ngram_counts, unpack_vectors
from tidewatch.session import ship_package

UNDETERMINED = "und"
SAMPLE_ROWS = 3000
PER_LANGUAGE = 600
FEATURE_BITS = 12
ORDERS = (1, 2, 3)
LEAST_ORDER = 4
RIDGE = 0.3
# Two languages whose decoding losses differ by less than this are too close to call.
AMBIGUITY = 0.02
# ASCII characters other than letters part words; they say nothing about the language.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


def vector(text: str) -> np.ndarray:
    """Unit vector of square-rooted n-gram counts."""
    data = b" ".join(text.lower().encode().translate(_LETTERS).split())
    v = np.sqrt(ngram_counts(b" " + data + b" ", ORDERS, FEATURE_BITS)).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray      # languages x bits, -1 or 1
    weights: np.ndarray   # features + 1 x bits
    trust: np.ndarray     # bits

    def decode(self, v: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = v @ self.weights[:-1] + self.weights[-1]
        loss = (np.log1p(np.exp(-4.0 * self.code * margin)) * self.trust).sum(axis=1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        near = np.exp(-6.0 * (loss - loss[order[0]]))
        gap = float(loss[order[1]] - loss[order[0]])
        return self.languages[order[0]], float(1.0 / near.sum()), gap < AMBIGUITY


def codewords(n: int) -> np.ndarray:
    """n words of a simplex code: word a has the bit <a, x> (sum of products, modulo 2) at place x.  Any two words differ
    in 2^(m - 1) of the 2^m - 1 places.  Few words leave places alike (or without a difference); one of each stays."""
    m = max(LEAST_ORDER, (n - 1).bit_length())
    units = [1 << i for i in range(m)]
    names = np.array([0, *units, *(a for a in range(3, 1 << m) if a & (a - 1))][:n])  # units first: all places differ
    code = np.bitwise_count(names[:, None] & np.arange(1, 1 << m)[None, :]) & 1
    places = {bytes(column): i for i, column in reversed(list(enumerate(code.T.astype(np.uint8)))) if column.any()}
    return code[:, sorted(places.values())].astype(np.int64) * 2 - 1


def fit(x: np.ndarray, y: list[str]) -> Model:
    """Ridge regression of all code bits at once, in its dual form (rows x rows),
    with a constant feature; ``x`` is not copied."""
    languages = tuple(sorted(set(y)))
    code = codewords(len(languages))
    target = code[[languages.index(v) for v in y]].astype(np.float64)
    products = (x @ x.T).astype(np.float64)
    products += 1.0
    products[np.diag_indices_from(products)] += RIDGE
    dual = np.linalg.solve(products, target)
    products[np.diag_indices_from(products)] -= RIDGE
    right = ((products @ dual) * target > 0).mean(axis=0)
    weights = np.vstack([x.T @ dual.astype(np.float32), dual.sum(axis=0, keepdims=True).astype(np.float32)])
    return Model(languages, code, weights, np.maximum(2 * right - 1, 0.01))


def learn(docs: DataFrame, seed: str = "lang-1") -> Model | None:
    ship_package(docs.sparkSession)
    chosen = labelled_sample(docs.select("doc_id", "lang"), "lang", PER_LANGUAGE, SAMPLE_ROWS, seed)
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", "lang").join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__label")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [vector(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("__label"), pa.array([v.astype(np.float16).tobytes() for v in made], pa.binary())],
                                             names=["id", "label", "v"])

    rows = rows.select("doc_id", "__label", "text").mapInArrow(vectors, "id string, label string, v binary")
    # Repeated ids give one row, the least vector: at most SAMPLE_ROWS rows, the same in every run.
    rows = sorted(rows.groupBy("id", "label").agg(F.min("v").alias("v")).collect(), key=lambda r: (r["id"], r["label"]))
    if not rows:
        return None
    y, x = [r["label"] for r in rows], unpack_vectors(rows)
    del rows
    return fit(x, y)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs``, all columns unchanged, plus __lang, __score, __ambiguous."""
    ship_package(docs.sparkSession)
    own, names = ("__lang", "__score", "__ambiguous"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value in b.column("text"):
                text = value.as_py()
                out.append(model.decode(vector(text)) if model and text and has_letter(text) else (UNDETERMINED, 0.0, False))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())],
                names=[*names, *own])

    return docs.mapInArrow(run, StructType([
        *docs.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType()), StructField("__ambiguous", BooleanType())]))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose language could be told, with their own columns only."""
    verdict = identify(docs, model)
    keep = (F.col("__lang") != UNDETERMINED) & ~F.col("__ambiguous")
    return verdict.filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, model: Model | None) -> DataFrame:
    d = identify(docs.select("doc_id", "text"), model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"),
                    F.col("__score").alias("score"), F.col("__ambiguous").alias("ambiguous"))
