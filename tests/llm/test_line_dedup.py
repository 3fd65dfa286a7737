import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from lethe.llm import line_dedup
from lethe.llm.common import WORD, table

from ..support import TESTDATA
from .cases import frame


def brute(rows, threshold=Fraction(4, 5), least=1):
    seen, out = [], {}
    for doc_id, text in rows:
        kept = []
        for line in text.split("\n"):
            words = re.findall(WORD, line)
            s = set(words)
            if len(words) >= least:
                hit = any(len(s & o) * threshold.denominator >= len(s | o) * threshold.numerator for o in seen)
                seen.append(s)
                if hit:
                    continue
            kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


def test_same_as_brute_force(spark):
    docs = table(spark, TESTDATA, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in line_dedup.op1_line_dedup(spark, TESTDATA).collect()}
    want = brute(rows)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_kept == (len(want[k].split("\n")) if want[k] else r.n_kept) for k, r in got.items())


def test_awkward_rows(spark):
    docs = frame(spark, clash=True)
    rows = line_dedup.dedup_lines(docs).collect()
    got = {r.doc_id: r.text for r in rows if r.doc_id != 7}
    assert len(rows) == 14 and line_dedup.dedup_lines(docs).columns == docs.columns
    assert got[5] is None and got[4] == "" and got[8] == " \t\n "
    assert got[1].startswith("word0") and got[2] == "" and got[3] == ""
    assert got[9] == "first line of words\nsecond line of words here\n\nend"
    assert got[10] == "something else is here now\nsecond line of words there"
    assert [r.text for r in rows if r.doc_id == 7] == ["one two"] * 2


def test_other_thresholds(spark):
    rows = [(1, "a b c d", "", "", 0), (2, "a b c e", "", "", 0), (3, "a b f g", "", "", 0), (4, "h i j k", "", "", 0)]
    for t in (Fraction(1, 2), Fraction(3, 5), Fraction(1)):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows), t, 1).collect()}
        assert got == brute([(r[0], r[1]) for r in rows], t, 1)


def near_copies(count, words=100, changed=4, seed=3):
    """Texts of one line, each a copy of a base with some words changed; beside each a line that only shares rare words with them."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(count):
        copy = list(base)
        for at in rng.sample(range(words), changed):
            copy[at] = f"c{rng.randrange(10 * count)}"
        other = rng.sample(base, 10) + [f"o{i}x{k}" for k in range(40)]
        rows.append((i, " ".join(copy) + "\n" + " ".join(other), "en", "s", 1))
    return rows


def test_a_large_group_of_near_copies_is_linear_and_exact(spark):
    rows = near_copies(500)
    docs = frame(spark, rows)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute([(r[0], r[1]) for r in rows])
    levels = line_dedup.rarity_levels(docs)
    reps = line_dedup.representatives(docs, levels, Fraction(4, 5), 1)
    settled = line_dedup.settle_large_groups(docs, reps, Fraction(4, 5))
    assert line_dedup.candidate_pairs(reps, Fraction(4, 5), settled).count() < 20 * 500
    assert line_dedup.candidate_pairs(reps, Fraction(4, 5)).count() > 100 * 500


def test_settling_and_broadcasting_change_no_result(spark, monkeypatch):
    rows = near_copies(60, 40, 3, 4) + [(100 + i, t, "en", "s", 1) for i, (_, t, *_) in enumerate(near_copies(60, 40, 4, 5))]
    want = brute([(r[0], r[1]) for r in rows])
    for large, most in ((2, 0), (10_000, 200_000)):
        monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows), large=large).collect()} == want


def test_lines_around_one_passage_meet_the_earliest_of_each_size(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"e{rng.randrange(3000)}" for _ in range(20 if i < 5 else rng.randrange(21))]), "en", "s", 1) for i in range(400)]
    docs = frame(spark, rows)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute([(r[0], r[1]) for r in rows])
    reps = line_dedup.representatives(docs, line_dedup.rarity_levels(docs), Fraction(4, 5), 1)
    settled = line_dedup.settle_large_groups(docs, reps, Fraction(4, 5))
    assert settled.count() > 130  # of 188 that go; 66 by the earliest of all alone


def test_rows_without_an_id_and_clashing_names(spark):
    rows = [(None, "one two three\nfour five", "en", "s", 1), (None, "four five\nsix seven", "en", "s", 2), (1, "six seven\r\none\ttwo  three", "en", "s", 3)]
    docs = frame(spark, rows).withColumn("tag_id", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("line_no", F.lit(3)).withColumn("a.b", F.lit(4))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    lines = [x for r in got.collect() for x in r.text.split("\n") if x]
    assert sorted(lines) == ["four five", "one two three", "six seven"]
    assert got.filter("tag_id = 1 and kept = 2 and line_no = 3").count() == 3
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
