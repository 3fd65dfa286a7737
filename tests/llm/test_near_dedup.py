import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import near_dedup as N
from lethe.llm.common import table

from ..support import TESTDATA
from .cases import frame


def brute(rows):
    sets = {i: frozenset(N.shingles(t).tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_same_classes_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, TESTDATA, "documents").collect()]
    got = {r.doc_id: r.class_id for r in N.op3_near_dedup(spark, TESTDATA).collect()}
    assert got == brute(rows)


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    base, passage = [rng.choice(words) for _ in range(200)], " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    for i in range(60, 120):
        rows.append((i, passage + " " + " ".join(rng.choice(words) for _ in range(50)), "en", "s", 1))
    got = {r.doc_id: r.class_id for r in N.classes(frame(spark, rows)).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    wa, wb = np.ones(400), np.ones(400)
    wb[:100] = 3.0
    weight_a, weight_b = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = set(weight_a) | set(weight_b)
    want = 0.0
    for k in set(weight_a) & set(weight_b):
        want += 1 / sum(max(weight_a.get(j, 0) / weight_a[k], weight_b.get(j, 0) / weight_b[k]) for j in keys)
    sa, sb = N.signature(a, wa, 4096), N.signature(b, wb, 4096)
    assert np.mean(sa == sb) == pytest.approx(want, abs=0.03)
    assert (N.signature(a[::-1].copy(), wa, 64) == N.signature(a, wa, 64)).all()
    assert set(N.signature(a[:1], wa[:1], 64).tolist()) == {int(a[0])}


def test_awkward_rows(spark):
    docs = frame(spark, clash=True)
    got = [(r.doc_id, r.class_id) for r in N.classes(docs).collect()]
    assert len(got) == 14
    by = dict(got)
    assert by[1] == by[2] == 1 and by[3] == 1 and by[4] == 4 and by[5] == 5 and by[8] == 8 and by[7] == 7
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12] and ids.count(None) == 1


def test_chains_of_copies_where_only_neighbours_are_similar(spark):
    rng = random.Random(11)
    rows = []
    for chain in range(12):
        words = [f"c{chain}w{i}" for i in range(120)]
        for step in range(10):
            rows.append((len(rows), " ".join(words), "en", "s", 1))
            words = words[11:] + [f"c{chain}s{step}x{i}" for i in range(11)]  # 105 of 127 shingles stay: 0.83; 0.68 two steps on
    rng.shuffle(rows)
    want = brute([(r[0], r[1]) for r in rows])
    assert len(set(want.values())) == 12
    docs = frame(spark, rows)
    # one band, and that of all shingles alike: every document of the corpus is in one bucket
    keyed = N.signatures(docs).withColumn("keys", F.array(F.lit(1).cast("long")))
    nodes = N.materialize(keyed.select("node", F.col("doc_id").alias("rep_id"), "keys"), "test-nodes")
    roots = {r.node: r.root for r in N.find_roots(docs, nodes, 0.8, 5).collect()}
    by_node = {r.node: r.rep_id for r in nodes.collect()}
    got = {}
    for node, i in by_node.items():
        got.setdefault(roots.get(node, node), set()).add(i)
    classes = {}
    for i, c in want.items():
        classes.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_repeated_passages_change_no_band():
    first, second = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    short, long = " ".join([first] * 2 + [second]), " ".join([first] * 40 + [second])
    assert set(N.shingles(short).tolist()) == set(N.shingles(long).tolist())
    assert N.band_keys(short) == N.band_keys(long)


def test_recall_of_pairs_with_repeated_passages():
    shared = 0
    for k in range(300):
        first = [f"p{k}a{i}" for i in range(40)]
        tail = [f"p{k}b{i}" for i in range(160)]
        a = first * 2 + tail
        b = first * 40 + tail[:138]  # 178 of 200 shingles and 14 others
        b += [f"p{k}c{i}" for i in range(14)]
        x, y = " ".join(a), " ".join(b)
        assert 0.8 <= N.jaccard(np.unique(N.shingles(x)), np.unique(N.shingles(y))) < 0.85
        shared += bool(set(N.band_keys(x)) & set(N.band_keys(y)))
    assert shared >= 299


def test_several_groups_of_near_copies_in_one_bucket(spark):
    rng = random.Random(3)
    passage, rows = [f"p{i}" for i in range(60)], []
    for group in range(6):
        base = passage + [f"g{group}w{i}" for i in range(40)]
        for copy in range(2):
            rows.append((len(rows), " ".join(base[:-1] + [f"g{group}c{copy}"]), "en", "s", 1))
    rng.shuffle(rows)
    docs = frame(spark, rows)
    keyed = N.signatures(docs).withColumn("keys", F.array(F.lit(1).cast("long")))
    nodes = N.materialize(keyed.select("node", F.col("doc_id").alias("rep_id"), "keys"), "test-nodes")
    roots = {r.node: r.root for r in N.find_roots(docs, nodes, 0.8, 5).collect()}
    root_of = {r.rep_id: roots.get(r.node, r.node) for r in nodes.collect()}
    want = brute([(r[0], r[1]) for r in rows])
    assert all((root_of[i] == root_of[j]) == (want[i] == want[j]) for i in want for j in want)
    assert len(set(want.values())) == 6


def test_sketches_bound_how_far_sets_differ():
    rng = np.random.default_rng(2)
    for n in (1, 30, 400):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[n // 8:], rng.integers(0, 2**63, n // 6).astype(np.uint64)])
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(N.sketch(a), N.sketch(b)))
        assert bits <= len(np.setxor1d(a, b)) and len(N.sketch(a)) == N.SKETCH // 64


def test_pairs_of_a_large_group_follow_its_size(spark):
    rng = random.Random(8)
    words, count = [f"g{i}" for i in range(150)], 240
    rows = []
    for i in range(count):  # most pairs have a similarity of 0.81 or 0.87, those with two words changed in both 0.76
        copy = list(words)
        for at in rng.sample(range(150), rng.choice((1, 2))):
            copy[at] = f"c{i}x{at}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    docs = frame(spark, rows)
    keyed = N.signatures(docs).select("node", F.col("doc_id").alias("rep_id"), F.array(F.lit(1).cast("long")).alias("keys"))
    nodes = N.materialize(keyed, "test-nodes")
    texts = docs.select(N.node_of("text").alias("node"), "text")
    undecided = nodes.select("node", F.col("node").alias("root"))
    shared = N.shared_rows(N.prefix_rows(texts, undecided, 0.8, 5), undecided)
    assert N.prefix_pairs(shared, 0.8).count() > 10 * count  # without rounds before it, and for true links alone
    done = undecided.select(F.col("node").alias("centre"), "node").limit(0)
    made = []
    whole = N.prefix_pairs
    N.prefix_pairs = lambda *a: made.append(whole(*a).count()) or whole(*a)
    try:
        roots = {r.node: r.root for r in N.link_undecided(texts, undecided, done, 0.8, 5).collect()}
    finally:
        N.prefix_pairs = whole
    by_node = {r.node: r.rep_id for r in nodes.collect()}
    got, want = {}, {}
    for node, i in by_node.items():
        got.setdefault(roots.get(node, node), set()).add(i)
    for i, c in brute([(r[0], r[1]) for r in rows]).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert made[0] < 5 * count
