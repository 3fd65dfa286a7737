"""MinHash near-dedup with ProbMinHash signatures.

Shingles of five words weigh the same, however often a document repeats them, as
links are decided by the similarity of sets.  Every shingle is a Poisson process
whose rate is its weight; each arrival falls into one of the signature's slots,
and a slot keeps the shingle that arrives first.  Two documents agree in a slot
with the probability Jaccard similarity of their weights, here that of the sets.  Arrivals are drawn until the next would be later than the latest slot,
so most shingles are drawn once.  Slots are hashed in bands; documents that
share a band are compared exactly (Jaccard similarity of the shingle sets), and
links of 0.8 or more are closed into classes.

Scale: texts give signatures in one narrow pass; equal texts are one node from
then on.  A band's bucket is compared against one centre at a time, never pair
by pair: what fails against the centre stays for a second round with a new
centre.  All members of buckets that hold more than one class after that, linked
ones too, go through an exact prefix-filter join, which finds every pair of
different classes that is similar enough.  Before it, shingles with many nodes of
several classes are compared with one centre at a time as well, so that a large
group of near copies needs no pairs of all its members.  Classes come from alternating large-
and small-star steps.  Every step is an aggregation or an equi-join; each round
is cut into the shared folder; nothing is collected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, append_columns, free_name, materialize, table
from .linear import mix64

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Rounds in which a bucket's members are compared with one centre, before the exact join.
CENTRE_ROUNDS = 2
#: Upper bits of a shingle's hash by which its rarity is counted; the sketch has 2**RANK_BITS counts, however large the corpus.
RANK_BITS = 16
#: Bounds are loosened by this much, so that rounding loses no pair.
SLACK = 1e-6
#: Bits of the sketch that bounds, inside the joins, how far two texts differ; in words of 64.
SKETCH = 512
#: Nodes of other roots than the first from which a shingle's nodes are compared with one of them before the exact join,
#: and rounds of that; each round looks at one pair for each row at most.
LARGE, SETTLING_ROUNDS = 64, 4
CACHE = 150_000

_word = re.compile(WORD)
_known: dict[str, int] = {}
_A = np.uint64(0xD6E8FEB86659FD93)


def _hash(word: str) -> int:
    if len(_known) >= CACHE:
        _known.clear()
    h = _known[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of all shingles of a text in order; of all its words, where there are fewer than ``width``."""
    words = _word.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    get = _known.get
    h = np.array([get(w) or _hash(w) for w in words], np.uint64)
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix64(out * _A + h[j:len(words) - k + 1 + j])
    return out


def signature(elements: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """The ProbMinHash signature of a weighted set: the element that arrives first in each slot."""
    first, owner = np.full(slots, np.inf), np.zeros(slots, np.uint64)
    clock, drawn = np.zeros(len(elements)), 0
    block = max(1, -(-6 * slots // len(elements))) if len(elements) < 4 * slots else 1
    while len(elements):
        step = np.arange(drawn, drawn + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = mix64(elements[:, None] + step[None, :])
        uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        times = clock[:, None] + np.cumsum(-np.log(uniform) / weights[:, None], axis=1)
        slot = (mix64(bits ^ _A) % np.uint64(slots)).astype(np.int64).ravel()
        flat, who = times.ravel(), np.repeat(elements, block)
        sooner = np.flatnonzero(flat < first[slot])
        sooner = sooner[np.argsort(-flat[sooner], kind="stable")]  # the earliest is written last
        first[slot[sooner]] = flat[sooner]
        owner[slot[sooner]] = who[sooner]
        clock, drawn = times[:, -1], drawn + block
        on = clock < first.max()
        elements, weights, clock = elements[on], weights[on], clock[on]
        block = 1 if len(elements) >= 4 * slots else 8
    return owner


def band_keys(text: str | None, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> list[int] | None:
    """A 64-bit key for each band of a text's signature; none for texts without words."""
    found = shingles(text, width)
    if not len(found):
        return None
    elements = np.unique(found)  # links are decided by sets, so every shingle weighs the same
    sig = signature(elements, np.ones(len(elements)), bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * _A + sig[:, j])
    return key.astype(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, node (digest of the text) and keys (of its bands); node is null for texts without words."""
    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([band_keys(t.as_py(), bands, rows, width) for t in texts], pa.list_(pa.int64()))]

    keyed = append_columns(docs.select("doc_id", "text"), ["text"], T.StructType([T.StructField("keys", T.ArrayType(T.LongType()))]), make)
    return keyed.select("doc_id", F.when(F.col("keys").isNotNull(), node_of("text")).alias("node"), "keys")


def node_of(text: str) -> F.Column:
    return F.unhex(F.md5(text))


def compare(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """``pairs`` (centre, node) and the column ``linked``, from the whole texts."""
    left = texts.select(F.col("node"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("centre"), F.col("text").alias("b"))
    both = pairs.join(left, "node").join(right, "centre").select("centre", "node", "a", "b")

    def make(a: pa.Array, b: pa.Array) -> list[pa.Array]:
        out, last, held = [], None, None
        for x, y in zip(a, b):
            if (other := y.as_py()) != last:  # rows of one centre mostly stand together
                last, held = other, np.unique(shingles(other, width))
            out.append(jaccard(np.unique(shingles(x.as_py(), width)), held) >= similarity)
        return [pa.array(out, pa.bool_())]

    return append_columns(both, ["a", "b"], T.StructType([T.StructField("linked", T.BooleanType())]), make).select("centre", "node", "linked")


def find_roots(docs: DataFrame, nodes: DataFrame, similarity: float, width: int) -> DataFrame | None:
    """node, root (see close_links()) for the texts that are linked to others; None if there are none.

    nodes: node, rep_id, keys.
    """
    members = nodes.select("node", F.explode("keys").alias("key"))
    texts = done = first = None
    for _ in range(CENTRE_ROUNDS):
        centres = members.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        open_ = materialize(members.join(centres, "key").filter("node <> centre"), "dedup-buckets")
        if open_.isEmpty():
            break
        pairs = open_.select("centre", "node").distinct()
        if texts is None:  # of all that share a bucket; later rounds compare the same nodes
            first = open_
            wanted = open_.select("node").union(open_.select(F.col("centre").alias("node"))).distinct()
            wanted = wanted.join(nodes.select("node", "rep_id"), "node")
            own = docs.select(F.col("doc_id").alias("rep_id"), "text").withColumn("node", node_of("text"))
            texts = materialize(own.join(wanted, (own.node == wanted.node) & own.rep_id.eqNullSafe(wanted.rep_id), "left_semi")
                                .select("node", "text").dropDuplicates(["node"]), "dedup-texts")
        judged = materialize(compare(pairs, texts, similarity, width), "dedup-judged")
        links = judged.filter("linked").select("centre", "node")
        done = links if done is None else done.union(links)
        members = open_.join(judged.filter("not linked"), ["centre", "node"]).select("node", "key")
    if first is None:
        return None
    roots = close_links(done)
    undecided = materialize(mixed_members(first, roots), "dedup-undecided")
    if not undecided.isEmpty():
        more = link_undecided(texts, undecided, done, similarity, width)
        roots = roots if more is None else more
    return roots


def mixed_members(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root for all members of the buckets (key, centre, node) that hold more than one root."""
    own = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    other = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    both = own.join(other, "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
    mixed = both.filter("root <> centre_root").select("key").distinct()
    held = both.join(mixed, "key", "left_semi")
    return held.select("node", "root").union(held.select("centre", "centre_root")).distinct()


def _part(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - RANK_BITS)).astype(np.int64)


def rarity_ranks(texts: DataFrame, width: int) -> np.ndarray:
    """The rank by count of each of 2**RANK_BITS parts of the shingles' hashes, rarest first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                n += np.bincount(_part(np.unique(shingles(t.as_py(), width))), minlength=len(n))
        part = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["part", "n"])

    found = texts.select("text").mapInArrow(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << RANK_BITS, np.int64)
    total[found["part"].to_numpy()] = found["n"].to_numpy()
    ranks = np.empty(len(total), np.uint64)
    ranks[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return ranks


def rarest_first(text: str | None, ranks: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a text as numbers whose order is one by rarity."""
    low = np.uint64(64 - RANK_BITS)
    found = np.unique(shingles(text, width))
    return np.sort((ranks[_part(found)] << low) | (found & np.uint64((1 << (64 - RANK_BITS)) - 1)))


def sketch(elements: np.ndarray) -> list[int]:
    """SKETCH bits: which of as many classes of shingles a set has an odd number of.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    odd = np.bincount((elements & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


_BITS = [f"s{k}" for k in range(SKETCH // 64)]


def prefix_rows(texts: DataFrame, undecided: DataFrame, similarity: float, width: int) -> DataFrame:
    """id, n (shingles), the sketch, pos and shingle for each shingle of the prefixes of ``undecided`` nodes; a table of its own."""
    own = texts.join(undecided, "node").select(F.xxhash64("node").alias("id"), "text")
    own = materialize(own, "dedup-undecided-texts")
    ranks = rarity_ranks(own, width)

    def make(column: pa.Array) -> list[pa.Array]:
        sizes, prefixes, sketches = [], [], []
        for t in column:
            ordered = rarest_first(t.as_py(), ranks, width)
            sizes.append(n := len(ordered))
            prefixes.append(ordered[:n - math.ceil(n * similarity - SLACK) + 1].astype(np.int64))
            sketches.append(sketch(ordered))
        return [pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]

    longs = T.ArrayType(T.LongType())
    fields = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("prefix", longs), T.StructField("sketch", longs)])
    bits = [F.get("sketch", F.lit(k)).alias(c) for k, c in enumerate(_BITS)]
    rows = append_columns(own, ["text"], fields, make).select("id", "n", *bits, F.posexplode("prefix").alias("pos", "shingle"))
    return materialize(rows, "dedup-prefixes")


def shared_rows(rows: DataFrame, undecided: DataFrame) -> DataFrame:
    """``rows`` whose shingle several roots have, with root, most (the root that most nodes of the shingle have) and off (its nodes of others).

    Sizes and sketches, most of a row, join what is found, once for each node.
    """
    rooted = rows.select("id", "pos", "shingle").join(undecided.select(F.xxhash64("node").alias("id"), F.xxhash64("root").alias("root")), "id")
    held = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("shingle").agg(
        F.max_by("root", "m").alias("most"), F.count(F.lit(1)).alias("roots"), (F.sum("m") - F.max("m")).alias("off")).filter("roots > 1").drop("roots")
    sets = rows.filter("pos = 0").select("id", "n", *_BITS)
    return materialize(rooted.join(held, "shingle").join(sets, "id"), "dedup-shared")


def _apart(a: str, b: str, similarity: float) -> F.Column:
    """Whether sizes and sketches of two sets (aliases a and b) leave room for the similarity."""
    an, bn = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITS[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return ((F.least(an, bn) >= F.greatest(an, bn) * similarity - SLACK)
            & (bits <= (an + bn) * ((1 - similarity) / (1 + similarity)) + 2 * SLACK))


def centre_pairs(shared: DataFrame, similarity: float, turn: int = 0, large: int = LARGE) -> DataFrame:
    """Pairs (a, b) of ids: the nodes of a shingle with ``large`` nodes of other roots or more, and one of them, another for each shingle and turn."""
    hot = shared.filter(F.col("off") >= large)
    one = hot.groupBy("shingle").agg(F.min_by(F.struct("id", "root", "n", *_BITS), F.xxhash64(F.lit(turn), "shingle", "id")).alias("c")).select("shingle", "c.*")
    met = hot.alias("a").join(one.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & _apart("a", "b", similarity))
    return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def prefix_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids of nodes of different roots, all those of the similarity among them.

    An exact prefix-filter join: two sets that are similar enough share one of
    their first n - ceil(similarity n) + 1 shingles in any order, here by rarity.
    Sizes, positions and sketches are compared inside the join. Of each shingle, the root
    that most nodes have is only met from the other roots' side, so that the
    pairs looked at are at most twice those of different roots.
    """
    a, b = shared.filter("root <> most").alias("a"), shared.alias("b")
    an, bn = F.col("a.n"), F.col("b.n")
    once = (F.col("b.root") == F.col("b.most")) | (F.col("a.id") < F.col("b.id"))
    needed = (an + bn) * (similarity / (1 + similarity)) - SLACK
    joined = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & once
                    & (F.least(an - F.col("a.pos"), bn - F.col("b.pos")) >= needed) & _apart("a", "b", similarity))
    return joined.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def link_undecided(texts: DataFrame, undecided: DataFrame, done: DataFrame, similarity: float, width: int) -> DataFrame | None:
    """Roots as of find_roots(), with the links among ``undecided`` (node, root) added to ``done``; None if there are no more links.

    Nodes of a large group of near copies need one link each: those of much
    shared shingles are compared with one node of the shingle at a time, for
    a few rounds, and only what then has different roots goes through the exact join.
    """
    rows = prefix_rows(texts, undecided, similarity, width)
    ids = undecided.select("node", F.xxhash64("node").alias("id"))
    roots = None

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "dedup-pairs")
        named = pairs.join(ids.select(F.col("id").alias("a"), F.col("node").alias("centre")), "a").join(ids.select(F.col("id").alias("b"), "node"), "b")
        return materialize(compare(named.select("centre", "node"), texts, similarity, width).filter("linked").select("centre", "node"), "dedup-links")

    for turn in range(SETTLING_ROUNDS + 1):
        shared = shared_rows(rows, undecided)
        few = turn == SETTLING_ROUNDS or shared.filter(F.col("off") >= LARGE).isEmpty()
        more = None if few else linked(centre_pairs(shared, similarity, turn))
        if few or more.count() < LARGE:  # another round would save little
            last = linked(prefix_pairs(shared, similarity))
            last = last if few else last.union(more)
            return roots if last.isEmpty() else close_links(done.union(last))
        done = done.union(more)
        roots = close_links(done)
        undecided = materialize(undecided.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "dedup-undecided")
    raise AssertionError("the last turn returns")


def close_links(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (two columns): root is the least node that it is connected to."""
    a, b = links.columns
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "dedup-edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        hooked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v")))
        edges = materialize(hooked.distinct(), "dedup-edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, node, class_id: one row for each row of ``docs``.

    class_id is the least doc_id of the class. Equal texts, repeated rows among
    them, are in one class. Texts without words, null ones among them, are
    alone: node is null and class_id their own doc_id. Texts of fewer than five
    words have one shingle, all their words. Null ids count as the least.
    Whole texts are read, however long; an empty table gives no rows; other
    columns don't matter.
    """
    keyed = materialize(signatures(docs, bands, rows, width), "dedup-signatures")
    worded = keyed.filter(F.col("node").isNotNull())
    nodes = worded.groupBy("node").agg(F.min(F.struct("doc_id", "keys"))["doc_id"].alias("rep_id"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "dedup-nodes")
    roots = find_roots(docs, nodes, similarity, width)
    own = nodes.select("node", "rep_id")
    if roots is None:
        named = own.withColumnRenamed("rep_id", "class_id")
    else:
        rooted = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min(F.struct("rep_id", "root"))["rep_id"].alias("class_id"))
        named = rooted.join(least, "root").select("node", "class_id")
    named = materialize(named, "dedup-classes")
    rest = keyed.filter(F.col("node").isNull()).select("doc_id", "node", F.col("doc_id").alias("class_id"))
    return worded.select("doc_id", "node").join(named, "node").select("doc_id", "node", "class_id").unionByName(rest)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, one of each class (that of the class's id), columns unchanged; texts without words all stay."""
    node = free_name(docs, "node")
    found = classes(docs, similarity)
    kept = found.filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", F.col("node").alias(node)).distinct()
    kept = materialize(kept, "dedup-kept")
    marked = docs.withColumn(node, F.when(F.col("text").rlike(WORD), node_of("text")))
    own = marked.filter(F.col(node).isNotNull())
    one = own.join(kept.withColumnRenamed("doc_id", f"{node}_id"), (own[node] == kept[node]) & own["doc_id"].eqNullSafe(F.col(f"{node}_id")), "left_semi")
    return one.dropDuplicates(["doc_id", node]).select(*docs.columns).unionByName(marked.filter(F.col(node).isNull()).select(*docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
