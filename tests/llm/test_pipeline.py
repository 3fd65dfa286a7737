import corpus_pipeline as P
from lethe.llm import bpe, line_dedup, near_dedup, quality_rules
from lethe.llm.common import table

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_classes
from .test_quality import brute_statistics

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    one = P.apply_quality_rules(spark, docs, SF)
    assert one.columns == names
    kept = {r.doc_id: r.text for r in one.collect()}
    for d in docs.collect():
        n, _, _, _, repeat = brute_statistics(d.text)
        assert not (d.doc_id in kept and (n < 10 or 100 * repeat > 20 * n))
    two = P.remove_repeated_lines(spark, one, SF)
    lines = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == names and lines == brute_lines(sorted(kept.items()))
    three = P.drop_near_duplicates(spark, two, SF)
    left = {r.doc_id: r.text for r in three.collect()}
    classes = brute_classes(sorted(lines.items()))
    assert three.columns == names and set(left) == {i for i, c in classes.items() if i == c}
    four = P.mix_to_targets(spark, three, SF)
    taken = four.collect()
    assert four.columns == names and all(left[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in taken)
    five = P.encode(spark, four, SF)
    coded = five.collect()
    assert len(coded) == len(taken)
    c = bpe.codec(bpe.default_path())
    assert sorted(c.decode(r.ids) for r in coded) == sorted(r.text for r in taken)


def test_run(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert P.run(spark, SF).count() > 100
    assert line_dedup and near_dedup and quality_rules
