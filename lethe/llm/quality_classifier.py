"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Indicators of word unigrams and bigrams, and of unigrams and bigrams of word
shapes, are scaled by class log-count ratios; a linear hinge-loss model is
fitted on them by dual coordinate descent, and its margins become probabilities
by a logistic curve over out-of-fold margins.

Scale: the fit sees at most ``sample`` labelled rows, picked by hash, and of these
as many as have ``MOST_COLUMNS`` indicators in all, however often ids repeat and
however long texts are; scoring is a narrow pass over Arrow batches with one
array of weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, append_columns, release, table
from .linear import DIM, calibrate, columns_of, dual_descent, log_count_ratios, mix64, scaled, sigmoid

#: Most labelled rows that the classifier is fitted on, and most indicators in all of them (64 MB).
SAMPLE = 6_000
MOST_COLUMNS = 1 << 24
THRESHOLD = 0.3
FOLDS = 3
CACHE = 300_000

_word = re.compile(WORD)
_known: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    """Runs of letters and digits by one character each (A, a, 9), other characters as they are, runs cut to two."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out[-1:] != [k] or (not k.isalnum() and out[-2:] != [k, k]):
            out.append(k)
    return "".join(out[:8])


def _hashes(word: str) -> tuple[int, int]:
    found = _known.get(word)
    if found is None:
        if len(_known) >= CACHE:
            _known.clear()
        found = _known[word] = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape(word), 1))
    return found


def features(text: str | None) -> np.ndarray:
    """Columns of the indicators of a text; none for null and empty texts."""
    words = _word.findall(text or "")
    if not words:
        return np.empty(0, np.int32)
    h = np.array([_hashes(w) for w in words], np.uint64)
    word, form = h[:, 0], h[:, 1]
    k = np.uint64(0xD6E8FEB86659FD93)
    same = np.unique(word[1:] == word[:-1]).astype(np.uint64)
    parts = [mix64(word), mix64(word[1:] * k + word[:-1]), mix64(form), mix64(form[1:] * k + form[:-1] + np.uint64(1)), mix64(same + np.uint64(77))]
    return columns_of(np.concatenate(parts))


@dataclass(frozen=True)
class Model:
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, row: np.ndarray) -> float:
        s = self.scale[row].astype(np.float64)
        norm = np.sqrt((s * s).sum())
        return float((s * self.weights[row]).sum() / norm + self.bias) if norm else self.bias

    def score(self, row: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(row) + self.shift))


def _fit(rows: list[np.ndarray], positive: np.ndarray) -> Model:
    scale = log_count_ratios(rows, positive)
    w, u = dual_descent([scaled(r, scale) for r in rows], positive, np.ones((len(rows), 1)))
    return Model(scale, w.astype(np.float32), float(u[0]), 1.0, 0.0)


def fit(rows: list[np.ndarray], positive: np.ndarray) -> Model:
    """A calibrated model; without rows of both classes, a constant one."""
    if not positive.any() or positive.all():
        zero = np.zeros(DIM, np.float32)
        return Model(zero, zero, 0.0, 1.0, float(np.log((positive.sum() + 1) / ((~positive).sum() + 1))))
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        if positive[fold != k].any() and not positive[fold != k].all():
            part = _fit([r for r, f in zip(rows, fold) if f != k], positive[fold != k])
            for i in np.flatnonzero(fold == k):
                margins[i] = part.margin(rows[i])
    slope, shift = calibrate(margins, positive)
    whole = _fit(rows, positive)
    return Model(whole.scale, whole.weights, whole.bias, slope, shift)


def with_labels(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, label, text of the documents of ``sample`` labels, picked by the hash of doc_id; null labels and ids don't count, repeated labels count once."""
    picked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    picked = picked.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, make, most: int = MOST_COLUMNS) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature columns and labels of at most ``sample`` labelled documents with ``most`` columns in all, picked by the hash of doc_id, in a fixed order.

    Documents of one doc_id are rows of their own. The window holds ``sample``
    rows at most.
    """
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([make(t.as_py()) for t in texts], pa.list_(pa.int32()))]

    rows = append_columns(with_labels(docs, labels, label, sample), ["text"], T.StructType([T.StructField("row", T.ArrayType(T.IntegerType()))]), run)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.size("row"), F.xxhash64("row")]
    few = rows.select("doc_id", "label", "row").orderBy(*order).limit(sample)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    release(docs.sparkSession)  # models of earlier runs
    found = few.withColumn("upto", F.sum(F.size("row")).over(upto)).filter(F.col("upto") <= most).drop("upto").toPandas()
    release(docs.sparkSession)  # the JVM's copies of these rows
    found["at"] = [xxhash.xxh64_intdigest(str(d)) for d in found["doc_id"]]
    found["length"] = found["row"].map(len)
    found = found.sort_values(["at", "label", "length"], kind="stable")
    return [np.asarray(r, np.int32) for r in found["row"]], found["label"].to_numpy() == 1


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no label is learned from; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of ``labels[label] == 1``, from rows that are not held out."""
    return fit(*labelled_rows(docs, labels.filter(~held_out(F.col("doc_id"))), label, sample, features))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` and the column ``name``: the probability of label 1.

    Null and empty texts get the score of no indicators; whole texts are read,
    however long; equal texts, and so ties and repeated rows, get equal scores,
    a row for each; an empty table gives no rows; other columns pass through,
    but one called ``name`` gives way to the score.
    """
    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([model.score(features(t.as_py())) for t in texts], pa.float64())]

    return append_columns(docs, ["text"], T.StructType([T.StructField(name, T.DoubleType(), False)]), make)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
