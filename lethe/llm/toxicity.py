"""Toxicity: a classifier chain over toxicity categories.

The chain goes explicit -> severe -> toxic. ``toxic`` is the label given. The
labels mark no finer categories, so the other two are read from the text alone,
be it toxic or not: terms that the labels tie to toxicity form a lexicon; a text
with any of them is explicit, one with a dense use of them is severe. A row's
own label has no part in its categories: they are told by a lexicon of the other
folds. So a quotation or a joke may be explicit and not toxic, and the last link
learns how much an earlier probability says. Each
link is a linear hinge-loss model on term and word-beginning indicators and on
the probabilities of the categories before it; while training, those are
out-of-fold predictions, so that a link sees them as they will be in use.

Scale: the fit sees at most ``sample`` labelled rows, picked by hash; scoring is
a narrow pass over Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, append_columns, table
from .linear import DIM, calibrate, dual_descent, log_count_ratios, scaled, sigmoid
from .quality_classifier import labelled_rows

CATEGORIES = ("explicit", "severe", "toxic")
#: Most labelled rows that the chain is fitted on; folds of out-of-fold predictions; probability that marks a category.
SAMPLE, FOLDS, THRESHOLD = 8_000, 3, 0.5
#: Word beginnings of so many characters are indicators, besides the word.
BEGINNINGS = range(3, 9)
CACHE = 200_000

_word = re.compile(WORD)
_edges = "\"'`.,;:!?()[]{}<>*_-‘’“”«»¡¿…"
_known: dict[str, np.ndarray] = {}


def _columns(word: str) -> np.ndarray:
    found = _known.get(word)
    if found is None:
        if len(_known) >= CACHE:
            _known.clear()
        w = word.lower().strip(_edges)
        keys = [f"={w}", *(f"^{w[:n]}" for n in BEGINNINGS if n <= len(w))] if w else []
        found = _known[word] = np.array([xxhash.xxh3_64_intdigest(k) >> 44 for k in keys], np.int32)
    return found


def features(text: str | None) -> np.ndarray:
    """Columns of the indicators of a text; none for null and empty texts."""
    words = set(_word.findall(text or ""))
    return np.unique(np.concatenate([_columns(w) for w in words])) if words else np.empty(0, np.int32)


@dataclass(frozen=True)
class Link:
    scale: np.ndarray
    weights: np.ndarray
    dense: np.ndarray  # weights of the earlier probabilities and the constant
    slope: float
    shift: float

    def margin(self, row: np.ndarray, earlier: list[float]) -> float:
        s = self.scale[row].astype(np.float64)
        norm = np.sqrt((s * s).sum())
        return float(((s * self.weights[row]).sum() / norm if norm else 0.0) + self.dense @ np.array([*earlier, 1.0]))


def probabilities(chain: list[Link], row: np.ndarray) -> list[float]:
    out: list[float] = []
    for link in chain:
        out.append(float(sigmoid(link.slope * link.margin(row, out) + link.shift)))
    return out


def _fit_link(rows: list[np.ndarray], earlier: np.ndarray, positive: np.ndarray) -> Link:
    scale = log_count_ratios(rows, positive)
    scale[scale < 0] *= 0.25  # rare terms mark a category, common ones seldom mark its absence
    w, u = dual_descent([scaled(r, scale) for r in rows], positive, np.hstack([earlier, np.ones((len(rows), 1))]))
    return Link(scale, w.astype(np.float32), u, 1.0, 0.0)


def derive_categories(rows: list[np.ndarray], toxic: np.ndarray, known: np.ndarray, least_ratio: float = 3.0) -> np.ndarray:
    """One column for each of CATEGORIES, for all rows. known: the rows that the lexicon, and what counts as dense, are drawn from."""
    lexicon = log_count_ratios([r for r, k in zip(rows, known) if k], toxic[known], least=5) >= least_ratio
    hits = np.array([int(lexicon[r].sum()) for r in rows])
    share = hits / np.array([max(1, len(r)) for r in rows])
    explicit = hits > 0
    severe = explicit & (share >= (np.median(share[explicit & known]) if (explicit & known).any() else 1.0))
    return np.stack([explicit, severe, toxic], axis=1)


def fit_chain(rows: list[np.ndarray], categories: np.ndarray, folds: int = FOLDS, of_fold: list[np.ndarray] | None = None) -> list[Link]:
    """Links in the order of the columns of ``categories``; a category without rows of both classes gets a constant link.

    of_fold: for each fold, the categories as they are known without its rows; row i is in fold i % folds.
    """
    n = len(rows)
    of_fold = of_fold or [categories] * folds
    earlier = np.empty((n, 0))
    fold = np.arange(n) % folds
    chain = []
    for k in range(categories.shape[1]):
        y = categories[:, k]
        if not y.any() or y.all():
            zero = np.zeros(DIM, np.float32)
            shift = float(np.log((y.sum() + 1) / ((~y).sum() + 1)))
            chain.append(Link(zero, zero, np.zeros(k + 1), 1.0, shift))
            earlier = np.hstack([earlier, np.full((n, 1), sigmoid(shift))])
            continue
        margins = np.zeros(n)
        for f in range(folds):
            on = fold != f
            seen = of_fold[f][on, k]
            if seen.any() and not seen.all():
                part = _fit_link([r for r, o in zip(rows, on) if o], earlier[on], seen)
                for i in np.flatnonzero(~on):
                    margins[i] = part.margin(rows[i], list(earlier[i]))
        slope, shift = calibrate(margins, y)
        whole = _fit_link(rows, earlier, y)
        chain.append(Link(whole.scale, whole.weights, whole.dense, slope, shift))
        earlier = np.hstack([earlier, sigmoid(slope * margins + shift)[:, None]])
    return chain


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> list[Link]:
    rows, toxic = labelled_rows(docs, labels, label, sample, features)
    if not rows:
        return fit_chain([], np.zeros((0, len(CATEGORIES)), bool))
    fold = np.arange(len(rows)) % FOLDS
    of_fold = [derive_categories(rows, toxic, fold != f) for f in range(FOLDS)]
    return fit_chain(rows, np.stack(of_fold)[fold, np.arange(len(rows))], FOLDS, of_fold)


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """``docs`` and a probability ``<category>_score`` for each of CATEGORIES.

    Null and empty texts get the scores of no indicators; whole texts are read,
    however long; equal texts, and so ties and repeated rows, get equal scores,
    a row for each; an empty table gives no rows; other columns pass through,
    but those of these names give way.
    """
    def make(texts: pa.Array) -> list[pa.Array]:
        found = [probabilities(chain, features(t.as_py())) for t in texts]
        return [pa.array([p[k] for p in found], pa.float64()) for k in range(len(CATEGORIES))]

    fields = [T.StructField(f"{c}_score", T.DoubleType(), False) for c in CATEGORIES]
    return append_columns(docs, ["text"], T.StructType(fields), make)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.col("toxic_score") >= THRESHOLD).alias("toxic"), "toxic_score", "severe_score", "explicit_score")
