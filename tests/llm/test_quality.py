import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lethe.llm import bpe as B
from lethe.llm import linear as L
from lethe.llm import quality_classifier as C
from lethe.llm import quality_rules as R
from lethe.llm import token_counts as K
from lethe.llm import toxicity as X
from lethe.llm import transport_stream as S
from lethe.llm.common import WORD, table

from .cases import ROWS, frame

MIDDLE = "/root/testdata/sf0.01"


def brute_statistics(text):
    words = re.findall(WORD, text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_statistics_are_those_of_brute_force(spark):
    rows = table(spark, MIDDLE, "documents").collect()
    got = {r.doc_id: r for r in R.op8_quality_rules(spark, MIDDLE).collect()}
    for d in rows:
        r, (n, chars, symbols, dup, repeat) = got[d.doc_id], brute_statistics(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in table(spark, MIDDLE, "labels").collect()}
    fine = [got[i] for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    assert sum(r.kept for r in fine) >= 0.98 * len(fine)


def test_repeats_with_many_distinct_words():
    words = [f"w{i}" for i in range(9000)] + [f"w{i}" for i in range(100, 110)] + ["end"]
    ids = np.array([int(w[1:]) if w != "end" else 9000 for w in words])
    assert R.repeated_words(ids, 9001) == brute_statistics(" ".join(words))[4] == 20


def test_rules_cover_and_print(spark):
    rng = np.random.default_rng(0)
    x = rng.random((900, len(R.FEATURES)))
    y = (x[:, 0] > 0.7) | ((x[:, 4] > 0.6) & (x[:, 7] <= 0.3))
    rules = R.fit_list(x, y)
    hit = np.zeros(len(x), bool)
    for rule in rules:
        hit |= R._covers(rule, x)
    assert rules and (hit == y).mean() > 0.93 and all(str(c) for rule in rules for c in rule)
    assert R.fit_list(x, np.zeros(900, bool)) == [] and R.fit_list(x[:0], y[:0]) == []


def test_filter_keeps_columns_whatever_their_names(spark):
    docs = frame(spark, clash=True)
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    out = R.filter_quality(docs, labels)
    assert out.columns == docs.columns and {1, 2, 3} <= {r.doc_id for r in out.collect()}


def test_quality_classifier_on_held_out_labels(spark):
    got = {r.doc_id: r for r in C.op4_quality_classifier(spark, "/root/testdata/sf0.1").collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, "/root/testdata/sf0.1", "labels").collect()]
    held = [(got[i], q) for i, q in labels if got[i].held_out]
    assert len(held) > 500 and sum(r.predicted == q for r, q in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_margin_of_log_ratios():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])] * 5
    y = np.array([True, True, False, False] * 5)
    model = C.fit(rows, y)
    assert model.score(np.array([1])) > 0.8 > 0.2 > model.score(np.array([4]))
    assert C.fit(rows, np.ones(20, bool)).score(np.array([4])) > 0.5


def test_toxicity_on_labels_it_has_not_seen(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    held = C.held_out(F.col("doc_id"))
    chain = X.learn(docs, labels.filter(~held))
    out = X.score(docs.select("doc_id", "text"), chain).join(labels.filter(held), "doc_id").collect()
    said = [(r.toxic_score >= X.THRESHOLD, r.toxic == 1) for r in out]
    assert sum(a and b for a, b in said) >= 0.9 * sum(b for _, b in said)
    assert sum(a and not b for a, b in said) <= 0.02 * len(said)
    assert [link.dense.shape for link in chain] == [(1,), (2,), (3,)]


def test_scores_of_awkward_texts(spark):
    chain = X.fit_chain([X.features("you idiot"), X.features("a fine day")] * 9, np.array([[True, False, True], [False, False, False]] * 9))
    rows = X.score(frame(spark), chain).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.toxic_score <= 1 for r in rows)


def solved(x, y, upper, steps=200_000):
    """Weights of the hinge-loss model by projected gradient steps on the dense dual: plain, and slow."""
    q = (y[:, None] * x) @ (y[:, None] * x).T
    a, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(steps):
        new = np.clip(a + rate * (1 - q @ a), 0, upper)
        if np.abs(new - a).max() < 1e-12:
            break
        a = new
    return (a * y) @ x


def test_dual_descent_finds_the_weights_of_a_plain_solver():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(40)]
    positive = np.array([(3 in r) or (rng.random() < 0.2) for r in rows])
    scale = L.log_count_ratios(rows, positive, least=1)
    shown = [L.scaled(r, scale) for r in rows]
    w, u = L.dual_descent(shown, positive, np.ones((40, 1)), epochs=5000)
    x = np.zeros((40, 13))
    for i, (r, v) in enumerate(shown):
        x[i, r] = v
    x[:, 12] = 1
    upper = np.where(positive, 20 / positive.sum(), 20 / (~positive).sum())
    assert np.abs(solved(x, np.where(positive, 1.0, -1.0), upper) - np.append(w[:12], u)).max() < 2e-3


def by_hand(docs, labels, label, features):
    """The rows that a model is fitted on, picked without Spark."""
    texts = {d.doc_id: d.text for d in docs}
    rows = [(xxhash.xxh64_intdigest(str(r.doc_id)), r[label], features(texts[r.doc_id])) for r in labels if r.doc_id in texts]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    return [r[2] for r in rows], np.array([r[1] == 1 for r in rows])


def test_queries_score_as_plain_loops_do(spark):
    docs, labels = table(spark, MIDDLE, "documents").collect(), table(spark, MIDDLE, "labels").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs}
    model = C.fit(*by_hand(docs, [r for r in labels if not held[r.doc_id]], "quality", C.features))
    got = {r.doc_id: r for r in C.op4_quality_classifier(spark, MIDDLE).collect()}
    assert len(got) == len(docs)
    for d in docs:
        x = [(float(model.scale[c]), float(model.weights[c])) for c in C.features(d.text)]
        norm = math.sqrt(sum(s * s for s, _ in x))
        margin = model.bias + (sum(s * w for s, w in x) / norm if norm else 0)
        assert math.isclose(got[d.doc_id].score, 1 / (1 + math.exp(-model.slope * margin - model.shift)), abs_tol=1e-9)
        assert got[d.doc_id].held_out == held[d.doc_id]

    rows, toxic = by_hand(docs, labels, "toxic", X.features)
    fold = [i % X.FOLDS for i in range(len(rows))]
    told = [X.derive_categories(rows, toxic, np.array([g != f for g in fold])) for f in range(X.FOLDS)]
    own = np.array([told[f][i] for i, f in enumerate(fold)])
    chain = X.fit_chain(rows, own, X.FOLDS, told)
    scores = {r.doc_id: r for r in X.op5_toxicity(spark, MIDDLE).collect()}
    assert len(scores) == len(docs)
    for d in docs:
        earlier = []
        for link in chain:
            x = [(float(link.scale[c]), float(link.weights[c])) for c in X.features(d.text)]
            norm = math.sqrt(sum(s * s for s, _ in x))
            margin = (sum(s * w for s, w in x) / norm if norm else 0) + sum(p * w for p, w in zip([*earlier, 1.0], link.dense))
            earlier.append(1 / (1 + math.exp(-link.slope * margin - link.shift)))
        r = scores[d.doc_id]
        assert np.allclose([r.explicit_score, r.severe_score, r.toxic_score], earlier, atol=1e-9)


def test_categories_need_no_label_of_their_own():
    rows = [np.array([1, 2], np.int32)] * 30 + [np.array([2, 3], np.int32)] * 300 + [np.array([1, 3], np.int32)]
    toxic = np.array([True] * 30 + [False] * 301)
    told = X.derive_categories(rows, toxic, np.arange(331) < 330)
    assert told[-1].tolist()[0] and not told[-1][2] and told[:30, 0].all() and not told[30:330, 0].any()
    flipped = toxic.copy()
    flipped[-1] = True  # a row outside the known ones decides nothing but its own label
    assert (X.derive_categories(rows, flipped, np.arange(331) < 330)[:, :2] == told[:, :2]).all()


def test_kept_is_what_the_printed_rules_say(spark):
    rules = R.learn_rules(table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels"))
    assert rules
    rejected = 0
    for r in R.judge(table(spark, MIDDLE, "documents").select("doc_id", "text"), rules, "s").collect():
        value = dict(zip(R.STATISTICS.names, R.statistics(r.text)))
        hit = any(all((value[c.feature] > c.threshold) if c.above else (value[c.feature] <= c.threshold) for c in rule) for rule in rules)
        n, _, _, _, repeat = brute_statistics(r.text)
        failed = n < 10 or 100 * repeat > 20 * n
        assert r.s.kept == (not failed and not hit) and r.s.base_failed == failed
        rejected += hit and not failed
    got = {r.doc_id: r.kept for r in R.op8_quality_rules(spark, MIDDLE).collect()}
    assert rejected and got == {r.doc_id: r.s.kept for r in R.judge(table(spark, MIDDLE, "documents"), rules, "s").collect()}


def test_samples_are_bounded_after_the_join(spark):
    docs = spark.createDataFrame([(i % 3, f"text number {i} of many") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3, i % 2) for i in range(50)] + [(None, 1), (1, None)], "doc_id long, quality int")
    rows, positive = C.labelled_rows(docs, labels, "quality", 2, C.features)
    assert len(rows) == len(positive) == 2
    rows, _ = C.labelled_rows(docs, labels, "quality", 500, C.features, most=100)
    assert rows and sum(map(len, rows)) <= 100
    assert C.labelled_rows(docs.limit(0), labels, "quality", 5, C.features)[0] == []
    assert R.learn_rules(docs, labels, sample=2) == [] and len(X.learn(docs.limit(0), labels.withColumnRenamed("quality", "toxic"))) == 3


def test_new_columns_replace_those_of_their_names(spark):
    docs = frame(spark, clash=True)
    for c in ("Score", "toxic_score", "ids", "decoded", "tree_chars", "n_tokens", "media"):
        docs = docs.withColumn(c, F.lit("x"))
    chain = X.fit_chain([X.features("you idiot"), X.features("a fine day")] * 9, np.array([[True, False, True], [False, False, False]] * 9))
    model = C.fit([np.array([1]), np.array([2])] * 9, np.array([True, False] * 9))
    for out, name, kind in ((C.score(docs, model), "score", "double"), (X.score(docs, chain), "toxic_score", "double"),
                            (B.encode_column(docs), "ids", "array<int>"), (B.decode_column(B.encode_column(docs)), "decoded", "string"),
                            (B.recode_column(docs), "decoded", "string"), (K.build_trees(docs), "n_tokens", "bigint"), (S.store(docs), "media", "binary")):
        assert [c.lower() for c in out.columns].count(name) == 1 and "row" in out.columns and out.count() == len(ROWS)
        assert {c.lower(): t for c, t in out.dtypes}[name] == kind


def test_rows_that_came_to_the_driver_are_let_go_before_the_fit(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(C, "release", lambda s: calls.append(s))
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    rows, y = C.labelled_rows(docs, labels, "quality", 10, C.features)
    assert len(calls) == 2 and len(rows) == 2 and sorted(y) == [False, True]
