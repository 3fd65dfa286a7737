"""Boundaries of values are those of the SQL: a character between two values, version words, other scripts."""

import pytest

from lethe.functions import entities as E
from lethe.operators import rewrite
from lethe.plans import catalogue

from .support import assert_matches

TEXTS = [
    "one@a.org\ntwo@b.org three@c.org,four@d.org; five@example.com six@f.org", "two@b.org", "seven@g.org", "eight@h.org\n", "x@y.com@z.com i@j.kl.", "e.nine@k.org",
    "zu ver 42.244.84.203 und Version: 8.8.4.4 hat", "10.1.2.3 10.1.2.4 10.1.2.5,0.1.2.3 10.9.9.9", "a 10.1.2.0/24 b //10.2.2.2 c x/11.1.1.1 /12.1.1.1 5.5.5.5\n6.6.6.6\n7.7.7.7",
    "12.1.1.1\n", "224.0.0.1 255.255.255.0 198.16.0.9 1.2.3.4.5 1.2.3.4+ -1.2.3.4 \u00e41.2.3.4\u00df", "11.1.1.1", "", None,
    "die die\u00dfpf\u00f6 the old man \u00e4the old man\u00df the old man_ the old man, the old x", "token = " + "ab" * 20 + " one@a.org 9.9.9.9",
]
NAMES = ["email_discover", "email_mapping_hash", "email_mapping_serial", "email_scrub", "email_scrub_serial", "ipv4_discover", "ipv4_classify", "ipv4_subnets", "ipv4_mapping",
         "ipv4_scrub", "ipv4_lpm_join", "verify_ip_allowlist", "verify_emails", "verify_mapping_leaks", "names_scrub", "counts_by_category", "coverage_first_seen",
         "topk_docs_by_hits", "tcprewrite_rules"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("forms"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    items = [(0, "the old man went home again"), (1, "die da und dort sind")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, tables, name):
    assert assert_matches(catalogue.QUERIES[name](spark, tables), tables, catalogue.ORACLE_SQL[name])


def test_a_joined_mapping_keeps_the_characters_beside_a_value(spark, tables):
    files = catalogue.documents(spark, tables)
    mapping = catalogue.ipv4_mapping(spark, tables)
    small, large = (dict(rewrite.by_mapping(files, E.IPV4_APART_ENTITY, mapping, most).select("path", "text").collect()) for most in (2_000, 0))
    assert small == large


def test_the_chain_finds_both_of_two_addresses(spark):
    got = spark.createDataFrame([("one@a.org two@b.org",)], "t string").select(E.EMAIL_ENTITY.apply(catalogue.F.col("t"))).first()[0]
    assert "one@" not in got and "two@" not in got


@pytest.mark.parametrize("name", ["bearer_discover", "bearer_scrub", "counts_by_category", "coverage_first_seen", "topk_docs_by_hits"])
def test_tokens_beside_letters_that_fold_to_ascii(spark, tmp_path, name):
    long = "Ab9" * 15
    texts = [f"Bearer {long}\u017f", f"Bearer {long}\u212a/x", f"to\u212aen: {long}", f"Bearer\x0b{long}", f"x-auth-token\n{long}", f"token =\t\"{long}\u0130", long, "token", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert assert_matches(catalogue.QUERIES[name](spark, str(tmp_path)), str(tmp_path), catalogue.ORACLE_SQL[name])
