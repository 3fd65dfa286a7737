"""Periodic runs against brute force, cost on hard words, and awkward rows."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lethe.llm import runs as R

from .cases import frame


def brute(w, least_exponent, least_length):
    """Every maximal stretch with a period that no smaller period explains."""
    out = []
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            smaller = any(all(w[t] == w[t + d] for t in range(start, start + length - d)) for d in range(1, q))
            if length >= max(least_exponent * q, least_length) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


words = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 2), max_size=9), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)).map(lambda x: x[0] + x[1] * x[2] + x[0]))


@settings(max_examples=400, deadline=None)
@given(words)
def test_runs_equal_brute_force(w):
    for e in (2, 3, 4):
        assert R.runs_of(w, e, 2) == brute(w, e, 2)
    texts = [[b"%d" % x for x in w], [], [b"a"] * 7, [b"%d" % x for x in reversed(w)]]
    assert R.runs_of_texts(texts, 4, 6) == [brute(t, 4, 6) for t in texts]


@settings(max_examples=200, deadline=None)
@given(words)
def test_lyndon_array(w):
    following, match, _ = R.lyndon(w)
    for i, j in enumerate(following):
        assert j == next((j for j in range(i + 1, len(w) + 1) if w[j:] < w[i:]), len(w))
        assert w[i:i + match[i]] == w[j:j + match[i]] and (j + match[i] == len(w) or w[i + match[i]] != w[j + match[i]])


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


HARD = {"fibonacci": fibonacci, "thue-morse": lambda n: [bin(i).count("1") & 1 for i in range(n)], "one word": lambda n: [0] * n,
        "ruler": lambda n: [(i & -i).bit_length() for i in range(1, n)], "growing": lambda n: sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5))), []),
        "random": lambda n: random.Random(1).choices((0, 1), k=n), "thrice": lambda n: fibonacci(n // 3) + [9] + fibonacci(n // 3) + [8] + fibonacci(n // 3)}


@pytest.mark.parametrize("name", sorted(HARD))
def test_comparisons_follow_the_length(name):
    w = HARD[name](30_000)
    for order in (w, [-x for x in w], w[::-1]):
        assert R.lyndon(order)[2] <= 3.2 * len(order)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 4, 6)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return (doc_id, len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 120)))) for i in range(150)]
    rows += [(1000, "x y " * 50), (1001, "a a a a a a a b b\na b a b a b a b c"), (1002, None), (1003, "  \n "), (None, "t " * 9), (1000, "x y " * 50)]
    rows.append((1004, " ".join(["one two three"] * 30_000)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in rows if r[0] != 1004]
    assert sorted(map(tuple, got.filter("doc_id is null or doc_id <> 1004").collect()), key=str) == sorted((expected(*r) for r in short), key=str)
    long = got.filter("doc_id = 1004").first()
    assert long.n_runs >= 1 and long.period is not None


def test_general_interface_replaces_clashing_columns(spark):
    docs = frame(spark, clash=True).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit("x"))
    out = R.find_runs(docs.unionByName(docs.limit(1).withColumn("text", F.lit("go go go go go go stop"))))
    assert out.count() == 15 and out.columns[-2:] == ["runs", "collapsed"] and out.columns.count("runs") == 1
    hit = out.filter("text like 'go go%'").first()
    assert hit.collapsed == "go stop" and [tuple(r) for r in hit.runs] == [(0, 6, 1)]
    assert R.find_runs(frame(spark, [])).count() == 0
