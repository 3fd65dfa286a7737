import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lethe.llm import bpe, token_counts
from lethe.llm.common import table

from .cases import ROWS

ALPHABET = "ab'stlevd  \n\t é1!<|>ñ中 \x85\U0001F600"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts(n, size, seed):
    rng = random.Random(seed)
    for k in range(n):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(size)))
        yield s + "<|endoftext|>" + s if k % 5 == 0 else s
    yield from ("", "a" * 5000, "ab" * 3000, "é" * 999, " " * 200)


def test_ids_and_text_are_the_librarys(library):
    c = bpe.codec(bpe.default_path())
    for s in [*texts(2000, 50, 1), *(t for _, t, *_ in ROWS if t)]:
        ids = c.encode(s).tolist()
        assert ids == library.encode(s, add_special_tokens=False).ids
        assert c.decode(ids) == s == library.decode(ids, skip_special_tokens=False)


def test_both_merge_orders_agree_and_cuts_are_certain():
    c = bpe.codec(bpe.default_path())
    for s in texts(300, 60, 2):
        piece = s.encode()
        if piece:
            ids = [c.single[b] for b in piece]
            assert list(c.merge(piece)) == list(c.merge_long(ids))
            assert [i for f in c.cuts(piece) for i in c.merge(f)] == list(c.merge_long(ids))
            assert b"".join(c.cuts(piece)) == piece


def test_digests_over_a_table(spark, library):
    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    got = {r.doc_id: r for r in bpe.op6_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in rows:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_counts_follow_random_edits(library):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    c, rng = bpe.codec(bpe.default_path()), random.Random(3)
    for s in list(texts(400, 80, 4)):
        tree = token_counts.CountTree.build(s, c)
        for _ in range(4):
            a = rng.randrange(len(s) + 2)
            b, new = a + rng.randrange(8), "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6)))
            want = s[:min(a, len(s))] + new + s[max(min(b, len(s)), min(a, len(s))):]
            s, _ = tree.edit(s, a, b, new, c)
            assert s == want and tree.chars[1] == len(s)
            assert tree.total == len(plain.encode(s, add_special_tokens=False).ids)


def test_an_edit_reads_little_of_a_long_text():
    c = bpe.codec(bpe.default_path())
    s = " ".join(f"word{i}" for i in range(20_000))
    tree = token_counts.CountTree.build(s, c)
    s, encoded = tree.edit(s, 60_000, 60_010, "new text", c)
    assert encoded < 12 and tree.total == len(c.encode(s, special=False))


def test_edit_lists_in_order(spark):
    edits = spark.createDataFrame([(1, 2, 0, 1, "x"), (1, 1, 0, 0, "ab "), (2, 1, 0, 0, None)], "doc_id long, seq int, start int, end int, text string")
    docs = spark.createDataFrame([(1, "hello"), (2, None), (3, "kept")], "doc_id long, text string")
    out = token_counts.apply_edits(token_counts.build_trees(docs).join(token_counts.edit_lists(edits), "doc_id", "left"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "xb hello", 2: "", 3: "kept"}


def test_query_against_the_library(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    size = lambda s: len(plain.encode(s, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for d in table(spark, "/root/testdata/sf0.001", "documents").collect():
        s, n, r = d.text or "", len(d.text or ""), got[d.doc_id]
        assert r.n_tokens_before == size(s)
        for start, end, new in ((n // 3, n // 3, " some added words"), (n // 2, n // 2 + 7, ""), (n + 6, n + 10, " 2024!")):
            s = s[:start] + new + s[max(end, min(start, len(s))):]
        assert r.n_tokens == size(s) and r.text_sha256 == hashlib.sha256(s.encode()).hexdigest()


def test_edits_at_one_place_split_its_leaf():
    c = bpe.codec(bpe.default_path())
    s = " ".join(f"word{i}" for i in range(200))
    tree = token_counts.CountTree.build(s, c)
    for k in range(300):
        s, encoded = tree.edit(s, 500, 500, f" more{k} of it", c)
        assert encoded <= 24
    assert tree.total == len(c.encode(s, special=False)) and tree.chars[1] == len(s)
    assert max(tree.chars[tree.size:]) < 120


def test_matrix_merges_equal_merges_of_single_pretokens():
    c, rng = bpe.Codec(bpe.default_path()), random.Random(5)
    words = ["".join(rng.choice("aeinrst Ωß漢0#") for _ in range(rng.choice([1, 2, 3, 7, 20, 65, 200]))) for _ in range(600)] + ["a"] * 3
    alone = [[i for f in c.cuts(w.encode()) for i in c.merge(f)] for w in words]
    assert [list(np.frombuffer(x, np.int32)) for x in c.encode_pretokens(words)] == alone
    assert c.encode_pretokens([]) == []


def test_cache_generations_keep_ids(monkeypatch):
    c = bpe.Codec(bpe.default_path())
    texts = [f"word{k % 7} other{k} " + "x" * 90 for k in range(60)]
    whole = [list(c.encode(t)) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 20)
    monkeypatch.setattr(bpe, "TOGETHER", 150)
    assert [list(np.frombuffer(x, np.int32)) for x in c.encode_texts(texts)] == whole
    assert c.counts(["x" * 90, "other"]) == [len(c.encode("x" * 90)), len(c.encode("other"))]


def test_trees_of_many_texts_look_up_pretokens_together(monkeypatch):
    c = bpe.Codec(bpe.default_path())
    many = [*texts(300, 60, 6)]
    alone = [token_counts.CountTree.build(t, c) for t in many]
    calls, look_up = [], c.look_up
    monkeypatch.setattr(c, "look_up", lambda words: (calls.append(len(words)), look_up(words))[1])
    together = list(token_counts.CountTree.build_all(many, c))
    assert len(calls) == 1 and len(together) == len(many)
    monkeypatch.setattr(token_counts, "TOGETHER", 100)
    for trees in (together, list(token_counts.CountTree.build_all(many, c))):
        assert all((a.chars == b.chars).all() and (a.tokens == b.tokens).all() for a, b in zip(alone, trees, strict=True))
