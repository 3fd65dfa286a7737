from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lethe.llm import mixing
from lethe.llm.common import word_count

from ..support import TESTDATA, assert_matches
from .cases import frame


def test_same_rows_as_sql(spark):
    assert assert_matches(mixing.op2_mix_sources(spark, TESTDATA), TESTDATA, mixing.OP2_SQL) == 200


def test_targets_by_stepwise_resharing(spark):
    sizes = {None: 40, "a": 10, "b": 100, "c": 1000, "d": 0}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, words long"), 1.5, 2.0, (5, 2, 1)).collect()}
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            want[s] = 2.0 * sizes[s] if over else level * weight[s]
        left -= sum(want[s] for s in over)
        free -= over or free
    assert got == pytest.approx(want, abs=1e-5)


def test_taken_words_meet_targets_and_limits(spark):
    rows = mixing.plan_mix(frame(spark)).collect()
    assert len(rows) == 14
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(frame(spark)).collect()))


def test_stream_is_sorted_cut_and_whole(spark):
    docs = frame(spark, clash=True)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = out.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert words == sum(int(r.target) for r in mixing.plan_mix(docs).select("source", "target").distinct().collect())


def test_inversion_follows_the_schedule(spark):
    knots = ((0, 2.0), (0.25, 0.0), (0.5, 0.0), (1, 4.0))
    pieces = mixing.segments(knots)

    def share(t):
        s = [p for p in pieces if p[0] <= t][-1]
        return s[3] + s[1] * (t - s[0]) + s[2] * (t - s[0]) ** 2 / 2

    times = [0.0, 0.1, 0.2, 0.6, 0.75, 1.0]
    got = spark.createDataFrame([(share(t),) for t in times], "s double").select(mixing.invert(F.col("s"), knots)).collect()
    assert [r[0] for r in got] == pytest.approx(times, abs=1e-9)


def test_first_words(spark):
    got = spark.createDataFrame([(" a  b\tc d", 2), ("a", 0), ("a b", 5)], "t string, n long").select(mixing.first_words(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in got] == [" a  b", "", "a b"]
