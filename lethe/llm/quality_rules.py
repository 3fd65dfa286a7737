"""Quality rules: learned decision lists over document statistics.

Sequential covering: rules for the reject class are grown one condition at a
time by information gain on two thirds of a labelled sample, pruned on the
rest, and taken while they are precise there; what a rule covers leaves both
parts before the next is grown.  The list is emitted as one ordered Spark
conditional expression over the statistics.

Scale: statistics are a narrow pass over Arrow batches, one text at a time; the
fit sees at most ``sample`` labelled rows (a documented bound), picked by hash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD, append_columns, free_name, table
from .quality_classifier import with_labels

#: Most labelled rows that a list is fitted on.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: distinct_ratio counts the distinct words of each span of so many words, so that it doesn't fall with length.
SPAN = 64

_word = re.compile(WORD)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_ratio", "upper_ratio", "shout_ratio", "adjacent_ratio", "repeat_ratio", "dup_line_ratio",
            "distinct_ratio", "mean_word", "digit_ratio", "punctuation_ratio")
STATISTICS = T.StructType([T.StructField(c, T.LongType(), False) for c in _COUNTS]
                          + [T.StructField(c, T.DoubleType(), False) for c in FEATURES])


def repeated_words(ids: np.ndarray, distinct: int, k: int = WINDOW) -> int:
    """Words inside windows of ``k`` words that occur twice or more. ids: a number below ``distinct`` for each word."""
    n = len(ids)
    if n <= k or distinct == n:
        return 0
    m = n - k + 1
    if float(distinct) ** k < 2.0**62:
        key = ids[:m].copy()
        for j in range(1, k):
            key = key * distinct + ids[j:j + m]
    else:  # number the windows of 2, 3, ... words instead
        key = ids
        for j in range(1, k):
            key = np.unique(key[:n - j] * distinct + ids[j:], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    before = np.concatenate([[0], np.cumsum(twice)])
    at = np.arange(n)
    return int(np.count_nonzero(before[np.minimum(at, m - 1) + 1] > before[np.maximum(at - k + 1, 0)]))


def statistics(text: str | None) -> tuple:
    """The values of STATISTICS for one text; null and empty texts have zeros."""
    text = text or ""
    words = _word.findall(text)
    n = len(words)
    if not n:
        return (0,) * len(_COUNTS) + (0.0,) * len(FEATURES)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = lambda chars: int(sum(byte[ord(c)] for c in chars))
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if _word.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text) - int(byte[32] + byte[9:14].sum())
    symbols, repeats = total(SYMBOLS), repeated_words(ids, len(numbers))
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    return (n, chars, symbols, dup, repeats,
            symbols / n, upper / max(1, upper + lower), total("!?") / n, int((ids[1:] == ids[:-1]).sum()) / n, repeats / n,
            dup / lines, len(np.unique(np.arange(n) // SPAN * len(numbers) + ids)) / n, chars / n, int(byte[48:58].sum()) / chars, total(".,;:") / n)


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """``docs`` and a struct column ``name`` of STATISTICS of its ``text``."""
    types = list(to_arrow_schema(STATISTICS))

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = [statistics(t.as_py()) for t in texts]
        return [pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], fields=types)]

    return append_columns(docs, ["text"], T.StructType([T.StructField(name, STATISTICS, False)]), make)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, statistics: Column) -> Column:
        v = statistics[self.feature]
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


def _covers(rule: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.mask(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, thresholds: dict[str, np.ndarray]) -> list[Condition]:
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while len(rule) < 4 and (~y[on]).any():
        p, n = y[on].sum(), (~y[on]).sum()
        base = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for f, cuts in thresholds.items():
            v, good = x[on, FEATURES.index(f)], y[on]
            for cut in cuts:
                over = v > cut
                for above, m in ((True, over), (False, ~over)):
                    pp = int((good & m).sum())
                    if pp and (g := pp * (np.log2(pp / m.sum()) - base)) > gain:
                        best, gain = Condition(f, above, float(cut)), g
        if best is None:
            break
        rule.append(best)
        on &= best.mask(x)
    return rule


def fit_list(x: np.ndarray, y: np.ndarray, min_precision: float = 0.98, min_cover: int = 5, max_rules: int = 16) -> list[list[Condition]]:
    """Rules for the rows where ``y`` is true. x: FEATURES by row, in an order that the caller has shuffled."""
    third = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~third], y[~third], x[third], y[third]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and gy.sum() >= min_cover and py.any():
        thresholds = {f: np.unique(np.quantile(gx[:, i], np.linspace(0, 1, 48), method="lower")) for i, f in enumerate(FEATURES)}
        for i, f in enumerate(FEATURES):  # the reject class's own range, as it may be a small part
            thresholds[f] = np.unique(np.concatenate([thresholds[f], np.quantile(gx[gy, i], np.linspace(0, 1, 24), method="lower")]))
        rule = _grow(gx, gy, thresholds)
        scored = []
        for k in range(len(rule), 0, -1):
            on = _covers(rule[:k], px)
            p, n = int((py & on).sum()), int((~py & on).sum())
            scored.append(((p - n) / max(1, p + n), p, -k, rule[:k]))
        if not scored:
            break
        _, p, _, pruned = max(scored, key=lambda s: s[:3])
        on = _covers(pruned, px)
        if p < min_cover or p / max(1, on.sum()) < min_precision:
            break
        rules.append(pruned)
        gone = _covers(pruned, gx)
        gx, gy, px, py = gx[~gone], gy[~gone], px[~on], py[~on]
    return rules


def verdict(rules: Sequence[Sequence[Condition]], statistics: Column) -> Column:
    """The list as one ordered conditional expression: false from the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column(statistics)
        for c in rule[1:]:
            test &= c.column(statistics)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", reject: int = 0, sample: int = SAMPLE) -> list[list[Condition]]:
    """A decision list for ``labels[label] == reject``; no rules where there are too few labels.

    At most ``sample`` rows of statistics reach the driver, however often ids repeat.
    """
    rows = with_statistics(with_labels(docs, labels, label, sample)).select(
        F.xxhash64("doc_id", "label").alias("at"), "label", *[F.col("statistics")[f].alias(f) for f in FEATURES])
    rows = rows.orderBy("at", *FEATURES).limit(sample).toPandas().sort_values(["at", *FEATURES], kind="stable")
    return fit_list(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy() == reject)


def base_failed(statistics: Column) -> Column:
    return (statistics["n_words"] < 10) | (100 * statistics["n_repeat_words"] > 20 * statistics["n_words"])


def judge(docs: DataFrame, rules: Sequence[Sequence[Condition]], name: str = "statistics") -> DataFrame:
    """``docs`` with the struct ``name``: STATISTICS, base_failed and kept.

    Null and empty texts have no words and fail; very long texts are read
    whole; equal texts get equal verdicts; an empty table gives no rows; other
    columns pass through, whatever their names.
    """
    inner = free_name(docs, "_statistics")
    s = F.col(inner)
    failed = base_failed(s)
    out = with_statistics(docs, inner)
    return out.select(*docs.columns, F.struct(
        *[s[f].alias(f) for f in STATISTICS.names], failed.alias("base_failed"),
        (~failed & verdict(rules, s)).alias("kept")).alias(name))


def filter_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass the base limits and the learned list, columns unchanged."""
    name = free_name(docs, "_verdict")
    return judge(docs, learn_rules(docs, labels, sample=sample), name).filter(F.col(name)["kept"]).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    out = judge(docs.select("doc_id", "text"), rules, "s")
    return out.select("doc_id", *[F.col("s")[c].alias(c) for c in (*_COUNTS, "base_failed", "kept")])
