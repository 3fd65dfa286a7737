"""Context-tree scores against a tree that is weighted recursively, and base scores against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import context_tree as C

from .cases import CLASHES, frame


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)


class Tree:
    """One decision's context tree, from a dictionary of counts by context."""

    def __init__(self, depth):
        self.depth, self.n = depth, {}

    def add(self, context, bit):
        for d in range(self.depth + 1):
            self.n.setdefault(context[len(context) - d:], [0, 0])[bit] += 1

    def weighted(self, s):
        if s not in self.n:
            return 0.0
        own = kt(*self.n[s])
        if len(s) == self.depth:
            return own
        below = sum(self.weighted(bytes([b]) + s) for b in range(256) if bytes([b]) + s in self.n)
        return np.logaddexp(own, below) - math.log(2)

    def chance(self, context, d=0):
        """Of a 1: half by the node's own estimate, half by what stands below, as the posterior has it."""
        s = context[len(context) - d:]
        if s not in self.n:
            return 0.5
        n0, n1 = self.n[s]
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == self.depth:
            return own
        below = sum(self.weighted(bytes([b]) + s) for b in range(256) if bytes([b]) + s in self.n)
        share = 1 / (1 + math.exp(min(700.0, below - kt(n0, n1))))
        return share * own + (1 - share) * self.chance(context, d + 1)


def brute(rows, depth):
    """(doc_id, score, base_score, n_tokens, n_known) of (doc_id, text, learnt)."""
    trees, words = {}, Counter()
    folded = [(i, (t or "").encode().lower(), k) for i, t, k in rows]

    def decisions(data):
        whole = b"\xff" * depth + data + b"\xff"
        for at in range(depth, len(whole)):
            for j in range(8):
                yield (1 << j) | (whole[at] >> (8 - j)), whole[at - depth:at], whole[at] >> (7 - j) & 1

    for _, data, known in folded:
        if known:
            for node, context, bit in decisions(data):
                trees.setdefault(node, Tree(depth)).add(context, bit)
            words.update([*data.split(), None])
    total, distinct, memo, out = sum(words.values()), len(words), {}, []
    for i, data, _ in folded:
        score = 0.0
        for node, context, bit in decisions(data):
            if (node, context) not in memo:
                memo[node, context] = trees[node].chance(context) if node in trees else 0.5
            p = memo[node, context]
            score += math.log10(p if bit else 1 - p)
        tokens = [*data.split(), None]
        out.append((i, score, sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens), len(tokens), sum(words[w] > 0 for w in tokens)))
    return out


ROWS = [(1, "the cat sat on the mat"), (2, "The cat\tate the rat"), (3, "a new Dog! barks"), (4, ""), (5, None), (6, "zzz \U0001F600 the"), (7, "the cat sat on the mat"), (None, "no id")]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_scores_equal_a_tree_weighted_recursively(spark, depth):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = sorted(map(tuple, C.score(docs, learn, depth).select("doc_id", "score", "base_score", "n_tokens", "n_known").collect()), key=str)
    expected = sorted(brute([(i, t, i is None or i % 3 != 0) for i, t in ROWS], depth), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[0] == b[0] and a[3:] == b[3:]
        assert a[1] == pytest.approx(b[1], rel=1e-8) and a[2] == pytest.approx(b[2], rel=1e-10)


def test_probabilities_of_a_byte_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra abra"), (2, "banana")], "doc_id long, text string")
    grams = C.gram_counts(docs, 2)
    nodes = C.fit(grams, 2)
    context = int.from_bytes(b"br", "big") << 8
    seen = {r.gram: r.n for r in grams.collect()}
    every = spark.createDataFrame([(context + b, seen.get(context + b, 0)) for b in range(256)], "gram long, n long")
    chances = [10 ** r.value for r in C.predict(every, nodes, 2).collect()]
    assert len(chances) == 256 and sum(chances) == pytest.approx(1.0, abs=1e-9)


def test_pieces_change_nothing():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 50, 10_000).astype(np.int64)
    keys, n = C.counted(grams, 6)  # pieces of 256 places
    expected = Counter(grams.tolist())
    assert keys.tolist() == sorted(expected) and n.tolist() == [expected[k] for k in keys.tolist()]
    values, missing = C.looked_up(grams, keys[::2], keys[::2] * 2.0, 6)
    held = np.isin(grams, keys[::2])
    assert (values == np.where(held, grams * 2.0, 0)).all() and missing.tolist() == np.flatnonzero(~held).tolist()


def test_windows_are_bounded_and_leave_nothing_out():
    texts = [b"abcabc", b"", b"x", b"the end of a text " * 9, b"ab"]
    expected = [int.from_bytes((C.END * 4 + t + C.END)[i:i + 5], "big") for t in texts for i in range(len(t) + 1)]
    for size in (1, 3, 7, 1000):
        windows = list(C.gram_windows(texts, 4, size))
        assert max(map(len, windows)) <= size and np.concatenate(windows).tolist() == expected
    assert C.grams_of(texts, 4).tolist() == expected


def test_counts_of_many_megabytes_take_few(monkeypatch):
    import tracemalloc

    class Docs:  # stands for a DataFrame, and keeps the function of its tasks
        def __getattr__(self, name):
            return lambda *a, **k: (setattr(self, "run", a[0]) if name == "mapInArrow" else None, self)[1]

    monkeypatch.setattr(C, "F", Docs())
    docs = Docs()
    C.gram_counts(docs)
    batches = [C.pa.record_batch([C.pa.array([f"some words {k} {i} " * 6_000 for i in range(5)])], ["text"]) for k in range(16)]
    tracemalloc.start()
    total = sum(sum(b.column(1).to_pylist()) for b in docs.run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(len(t) + 1 for b in batches for t in b.column(0).to_pylist()) and total > 7 << 20
    assert peak < 70 << 20


@pytest.mark.parametrize("grams,words", [(1, 1), (40, 5)])
def test_what_is_joined_adds_up_as_what_is_held(spark, monkeypatch, grams, words):
    docs = frame(spark)
    learn = C.learnt_from(F.col("doc_id"))
    whole = sorted(map(tuple, C.score(docs, learn).collect()), key=str)
    for name, value in (("HOT_GRAMS", grams), ("HOT_WORDS", words), ("COUNT_BYTES", 64), ("SCORE_BYTES", 64)):
        monkeypatch.setattr(C, name, value)
    joined = sorted(map(tuple, C.score(docs.repartition(5), learn).collect()), key=str)
    assert len(whole) == len(joined) == 14
    for a, b in zip(whole, joined):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_log_gamma(spark):
    z = [0.5, 1.0, 1.5, 7.25, 1e3, 1e6, 1e12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(C.log_gamma(F.col("z"))).collect()]
    assert got == [pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-10) for x in z]


def test_awkward_tables(spark):
    docs = frame(spark, clash=True)
    for c in ("block", "grams", "score", "word", *CLASHES[:2]):
        docs = docs.withColumn(c, F.lit("x"))
    out = C.score(docs, C.learnt_from(F.col("doc_id"))).collect()
    assert len(out) == 14 and all(r.score < 0 and r.base_score < 0 and r.n_tokens > 0 for r in out)
    assert {r.held_out for r in out if r.doc_id is not None} == {zlib.crc32(str(i).encode()) % 7 == 2 for i in range(1, 13)}
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert C.score(frame(spark, []), F.lit(True)).count() == 0
    nothing_learnt = C.score(frame(spark).limit(3), F.lit(False)).collect()
    assert all(r.score == pytest.approx(-8 * math.log10(2) * (1 + len((t or "").encode()))) for r, t in zip(
        sorted(nothing_learnt, key=lambda r: r.doc_id), [r.text for r in frame(spark).limit(3).orderBy("doc_id").collect()]))
