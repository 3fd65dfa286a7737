"""Line dedup by an exact set-similarity join [native].

Lines are sets of words.  A line goes if an earlier line of the corpus (by
doc_id, then line number) has a Jaccard similarity of at least the threshold.

Candidates come from prefix filtering: words are ordered by rarity, and two
similar lines must share one of their first n - ceil(t n) + 1 words; of the
smaller of the two, fewer do.  Pairs that share such a word pass the length
filter, the positional filter (enough words can follow the shared one) and a
parity filter (a few bits bound how far two sets differ) inside the join, and
are then verified on their whole sets.  Equal sets are one class from the start,
represented by its first line, so that a line in a third of all documents enters
the join once.

A line goes for one earlier match, so a group of near copies needs no pairs of
all its lines.  Before the join, lines that share a key (two of their least words
under some hashes) with many others are verified against the earliest of
these of each size; those that match are settled.  Settled lines stay in the join as the
earlier side, for what is open, but are never met with each other, so the join's
work follows the open lines.  This only saves work: the join decides for every
open line, exactly.

Rarity: counts of all words of the corpus in 2**LEVEL_BITS hash buckets, by their
logarithm.  A word's number is its bucket's level before the lower 56 bits of
its hash, so that numeric order is an order by rarity; prefix filtering is exact
under any total order.  Words are compared by these numbers.

Scale: lines leave the documents as narrow rows (a place, a digest, the prefix);
texts move once, for the result, and lines to verify only if they are more than
a broadcast of bounded size holds.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, discard, materialize, table

THRESHOLD = Fraction(4, 5)
#: Lines of fewer words stay.
MIN_WORDS = 1
#: Buckets of the word counts, and steps of their logarithm an octave.
LEVEL_BITS, STEPS = 18, 4
#: Sets of more words have parities of twice 64 bits, as 64 tell little of them.
WIDE = 64
#: Lines of one key from which the rounds before the join compare them with the earliest; lines settled by one
#: earliest line from which another round follows. A copy escapes a round about once in 20 times and meets its whole
#: group in the join, so that below AGAIN some AGAIN / 20 pairs for each line of a group are left.
LARGE, AGAIN = 8, 1_000
#: Sizes of sets are told apart in so many steps of their logarithm an octave, to choose earliest lines of each. Lines that share a passage
#: are alike if what they add to it is short, so that the earliest of all, which may add much, is like few of them.
SIZE_STEPS = 14
#: Most rows that are broadcast; a join with more shuffles.
MOST_BROADCAST = 200_000
#: Most hashes in sets that are broadcast, 32 MB.
MOST_HASHES = 4_000_000

_PLACE = ("doc_id", "tag", "line_no")
_ODD = "\t\x0b\x0c\r\n"


def _words(text: Column) -> Column:
    """The words of a text, empty strings among them; other white space becomes spaces, so that no pattern is needed."""
    for c in _ODD:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def rarity_levels(docs: DataFrame) -> list[int]:
    """The logarithm of the count of each of 2**LEVEL_BITS buckets of word hashes, in steps from 0 to 127."""
    words = docs.select(F.explode(_words(F.col("text"))).alias("w")).filter("w <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(127), F.floor(F.log2(F.col("n").cast("double")) * STEPS) + 1).cast("int")
    packed = counts.select(F.struct("b", level.alias("level")).alias("s")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat_ws(":", s["b"].cast("string"), s["level"].cast("string"))), ","))
    levels = [0] * (1 << LEVEL_BITS)
    for pair in filter(None, (packed.first()[0] or "").split(",")):
        b, _, n = pair.partition(":")
        levels[int(b)] = int(n)
    return levels


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS).cast("int")


def word_hashes(line: Column) -> Column:
    """The distinct words of a line as hashes."""
    return F.array_distinct(F.transform(F.array_remove(_words(line), ""), lambda w: F.xxhash64(w)))


def word_keys(hashes: Column, levels: list[int]) -> Column:
    """Words as numbers, rarest first: the level of a hash's bucket before the lower 56 bits of the hash."""
    # what turns the upper 8 bits of a hash, which its bucket tells, into its level; never null, so that longs are sorted as such
    masks = ",".join(str((b >> (LEVEL_BITS - 8)) ^ n) for b, n in enumerate(levels))
    mask = F.expr(f"cast(split('{masks}', ',') as array<bigint>)")
    return F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(F.shiftleft(F.coalesce(F.get(mask, _bucket(h)), F.lit(0).cast("long")), 56))))


def marks(keys: str) -> Column:
    """Three words of the rarer three quarters of a line, each the least (one: the greatest) under some order of hashes; similar lines share most of them.

    Frequent words would bring lines together that share little else.
    """
    rare = F.slice(keys, F.lit(1), F.floor((3 * F.size(keys) + 3) / 4).cast("int"))
    low, lower = F.transform(rare, lambda k: F.shiftleft(k, 8)), F.transform(rare, lambda k: F.shiftleft(k, 29))
    return F.array(F.array_min(low), F.array_max(low), F.array_min(lower))


def eligible(line: Column, min_words: int = MIN_WORDS) -> Column:
    """Whether a line has ``min_words`` words."""
    word = r"[^\x20\x09-\x0D]"
    return line.rlike(rf"{word}+{GAP}" * (max(1, min_words) - 1) + word)


def _ceil(numerator: Column, fraction: Fraction) -> Column:
    """ceil(numerator * fraction), in whole numbers."""
    return F.floor((numerator * fraction.numerator + (fraction.denominator - 1)) / fraction.denominator).cast("int")


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a digest of the text, which tells rows of one doc_id apart) and text."""
    return docs.select("doc_id", tag_of("text").alias("tag"), "text").filter(F.col("text").isNotNull())


def tag_of(text: str) -> Column:
    return F.unhex(F.md5(text))


def parity(keys: str, half: bool = False) -> Column:
    """64 bits: which of 64 classes of words a set has an odd number of. half: of one half of the words only.

    Two sets differ in at least as many words as their parities differ in bits.
    """
    own = "(k & 64) = 0" if half else "true"
    return F.expr(f"aggregate({keys}, 0L, (bits, k) -> if({own}, bits ^ shiftleft(1L, cast(k & 63 as int)), bits))")


def representatives(docs: DataFrame, levels: list[int], threshold: Fraction, min_words: int) -> DataFrame:
    """The first line of each set of words; a table of its own.

    Columns: id (a number), its place, n (words in the set), parity,
    half (in sets over WIDE words, the parity of one half of the classes), marks (its least
    words under three hashes), and prefix, its rarest words.
    """
    lines = _tagged(docs).select("doc_id", "tag", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hashed = lines.filter(eligible(F.col("line"), min_words)).select(*_PLACE, word_hashes(F.col("line")).alias("hashes"))
    keyed = hashed.select(*_PLACE, word_keys(F.col("hashes"), levels).alias("keys"))
    n = F.size("keys")
    rows = keyed.select(F.xxhash64("keys").alias("set"), F.hash("keys", F.lit(1)).alias("set2"), F.struct(*_PLACE).alias("place"),
                        n.alias("n"), parity("keys").alias("parity"), F.when(n > WIDE, parity("keys", True)).alias("half"),
                        marks("keys").alias("marks"), F.slice("keys", F.lit(1), n - _ceil(n, threshold) + 1).alias("prefix"))
    first = rows.groupBy("set", "set2").agg(F.min(F.struct("place", "n", "parity", "half", "marks", "prefix")).alias("m"))
    return materialize(first.select(F.monotonically_increasing_id().alias("id"), "m.place.*", "m.n", "m.parity", "m.half", "m.marks", "m.prefix"), "lines-first")


def _apart(a: str, b: str, an: Column, bn: Column, threshold: Fraction) -> Column:
    """Whether sizes and parities of two sets (aliases a and b) leave room for the threshold."""
    most = an + bn - 2 * _ceil(an + bn, threshold / (1 + threshold))  # words in which the two may differ
    bits = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    ap, bp, ah, bh = (F.col(f"{x}.{c}") for c in ("parity", "half") for x in (a, b))
    both = bits(ah, bh) + bits(ap.bitwiseXOR(ah), bp.bitwiseXOR(bh))
    return ((F.least(an, bn) * threshold.denominator >= F.greatest(an, bn) * threshold.numerator)
            & (bits(ap, bp) <= most) & (F.coalesce(both, F.lit(0)) <= most))


def _least_key(words: str, number: int) -> Column:
    """The least of an array of word numbers under the ``number``-th of a family of hashes."""
    low = (1 << 56) - 1
    mask = F.lit(0x9E3779B97F4A7C15 * (number + 1) & low)
    return F.array_min(F.transform(words, lambda w: w.bitwiseAND(F.lit(low)).bitwiseXOR(mask)))


def settle_large_groups(docs: DataFrame, reps: DataFrame, threshold: Fraction, large: int = LARGE) -> DataFrame | None:
    """Places of lines that share a key with ``large`` open lines or more and match the earliest of these of some size; None if there are none.

    Lines meet by any two of their three marks. A key has at most SIZE_STEPS earliest lines for an octave of sizes, and a line
    meets those of a size that leaves room for the threshold, so that the pairs follow the lines. Later rounds look at the lines
    that are open after the one before, by marks of their prefixes under other hashes.
    """
    settled, turn = None, 0
    while True:
        own = reps
        if settled is not None:
            own = own.join(settled, _same_place(own, settled), "left_anti")
        if turn:  # those that share the marks of the round before have met its earliest lines
            own = own.withColumn("marks", F.array(*[_least_key("prefix", 3 * turn + k) for k in range(3)]))
        keyed = own.select("id", *_PLACE, "n", "parity", "half", F.explode(_pairs_of("marks")).alias("key"))
        hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= large).select("key"), "lines-hot")
        many = hot.count()
        if not many:
            return settled
        shared = materialize(keyed.join(F.broadcast(hot) if many <= MOST_BROADCAST else hot, "key"), "lines-shared")
        first = shared.groupBy("key", _size_step(F.col("n")).alias("step")).agg(F.min(F.struct(*_PLACE, "id", "n", "parity", "half")).alias("b"))
        first = materialize(first.select("key", "b.*"), "lines-earliest")
        a, b = shared.alias("a"), (F.broadcast(first) if first.count() <= MOST_BROADCAST else first).alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.struct(*[F.col(f"b.{c}") for c in _PLACE]) < F.struct(*[F.col(f"a.{c}") for c in _PLACE]))
                     & _apart("a", "b", F.col("a.n"), F.col("b.n"), threshold))
        pairs = materialize(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "lines-met")
        discard(hot, shared, first)
        similar = similar_pairs(docs, reps, pairs, threshold)
        largest = similar.groupBy("b").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
        if largest:
            gone = later_places(similar)
            settled = gone if settled is None else materialize(settled.unionByName(gone), "lines-settled")
        if largest < AGAIN:
            return settled
        turn += 1


def _size_step(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * SIZE_STEPS).cast("int")


def _pairs_of(marks: str) -> Column:
    """A key for each two of three marks."""
    m = [F.get(marks, F.lit(k)) for k in range(3)]
    return F.array(*[F.xxhash64(F.lit(j), m[j], m[(j + 1) % 3]) for j in range(3)])


def candidate_pairs(reps: DataFrame, threshold: Fraction, settled: DataFrame | None = None) -> DataFrame:
    """Pairs of ids that share a word of their prefixes and pass the length, positional
    and parity filters, all inside the join, but for pairs of settled lines; a table of its own.

    Every pair of open lines is met once, the smaller set on the left with the
    shorter prefix that suffices there; settled lines are on the left only.
    """
    open_ = F.lit(True)
    if settled is not None:
        known = settled.withColumn("done", F.lit(True))
        known = F.broadcast(known) if settled.count() <= MOST_BROADCAST else known
        reps = reps.join(known, _same_place(reps, known), "left").select(reps["*"], "done")
        open_ = F.col("done").isNull()
    rows = reps.select("id", "n", "parity", "half", open_.alias("open"), F.posexplode("prefix").alias("pos", "key"))
    rows = rows.withColumn("word", F.shiftright("key", 16))  # enough of it to meet; pairs are verified by whole words
    shorter = F.col("n") - _ceil(F.col("n"), 2 * threshold / (1 + threshold)) + 1
    left, right = rows.filter(~F.col("open") | (F.col("pos") < shorter)), rows.filter("open")
    size = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("size")  # both in one field: these rows are the bulk of what moves
    a = left.select("word", F.when(F.col("open"), F.col("id")).otherwise(-1 - F.col("id")).alias("id"), size, "parity", "half").alias("a")
    b = right.select("word", "id", size, "parity", "half").alias("b")
    an, bn = (F.shiftright(f"{x}.size", 32).cast("int") for x in ("a", "b"))
    ap, bp = (F.col(f"{x}.size").cast("long").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") for x in ("a", "b"))
    once = (F.col("a.id") < 0) | (an < bn) | ((an == bn) & (F.col("a.id") < F.col("b.id")))
    needed = _ceil(an + bn, threshold / (1 + threshold))
    joined = a.join(b, (F.col("a.word") == F.col("b.word")) & once & (F.least(an - ap, bn - bp) >= needed)
                    & _apart("a", "b", an, bn, threshold))
    known = F.when(F.col("a.id") < 0, -1 - F.col("a.id")).otherwise(F.col("a.id"))
    return materialize(joined.select(known.alias("a"), F.col("b.id").alias("b")).distinct(), "lines-pairs")


def similar_pairs(docs: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """Places (a, b) of the pairs of ids whose sets of words have at least the threshold's Jaccard similarity; a table of its own."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = reps.select("id", *_PLACE).join(ids, "id").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))
    wanted = materialize(wanted, "lines-wanted")
    small = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] <= MOST_BROADCAST
    w = (F.broadcast(wanted) if small else wanted).alias("w")
    found = docs.select("doc_id", "text").alias("t").join(w, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).filter(tag_of("text") == F.col("w.tag"))
    found = found.select("t.doc_id", "w.tag", "wanted", F.split("text", "\n").alias("lines"))
    each = F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["line_no"].alias("line_no"), F.get("lines", w["line_no"]).alias("line")))
    found = found.select("doc_id", "tag", F.explode(each).alias("w"))  # a row holds its own line alone, however long the text
    found = found.select("w.id", F.struct("doc_id", "tag", "w.line_no").alias("place"), word_hashes(F.col("w.line")).alias("keys"))
    sets = materialize(found.dropDuplicates(["id"]), "lines-sets")  # an id is a place; fully repeated rows give it more than once
    few = sets.agg(F.coalesce(F.sum(F.size("keys") + 4), F.lit(0))).first()[0] <= MOST_HASHES
    met = F.broadcast(sets) if few else sets  # an earliest line may have a third of all pairs; Spark splits such partitions where it shuffles
    both = pairs.join(met.select(F.col("id").alias("a"), F.col("place").alias("pa"), F.col("keys").alias("ka")), "a").join(
        met.select(F.col("id").alias("b"), F.col("place").alias("pb"), F.col("keys").alias("kb")), "b")
    common = F.size(F.array_intersect("ka", "kb"))
    union = F.size("ka") + F.size("kb") - common
    alike = both.filter(common * threshold.denominator >= union * threshold.numerator)
    out = materialize(alike.select(F.col("pa").alias("a"), F.col("pb").alias("b")), "lines-similar")
    discard(pairs, wanted, sets)
    return out


def later_places(similar: DataFrame) -> DataFrame:
    """The later place of each pair, once each; a table of its own."""
    return materialize(similar.select(F.greatest("a", "b").alias("p")).distinct().select("p.*"), "lines-gone")


def _same_place(x: DataFrame, y: DataFrame) -> Column:
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["tag"] == y["tag"]) & (x["line_no"] == y["line_no"])


def kept_lines(docs: DataFrame, threshold: Fraction = THRESHOLD, min_words: int = MIN_WORDS, large: int = LARGE) -> DataFrame:
    """doc_id, tag and kept, the numbers of a document's lines (from 0) that are eligible and stay."""
    levels = rarity_levels(docs)
    reps = representatives(docs, levels, threshold, min_words)
    settled = settle_large_groups(docs, reps, threshold, large)
    gone = later_places(similar_pairs(docs, reps, candidate_pairs(reps, threshold, settled), threshold))
    gone = gone if settled is None else gone.unionByName(settled)
    left = reps.select(*_PLACE).join(gone, _same_place(reps, gone), "left_anti")
    return left.groupBy("doc_id", "tag").agg(F.collect_list("line_no").alias("kept"))


def dedup_lines(docs: DataFrame, threshold: Fraction = THRESHOLD, min_words: int = MIN_WORDS, counts: tuple[str, str] | None = None,
                large: int = LARGE) -> DataFrame:
    """``docs`` with the lines that repeat earlier ones taken out of ``text``.

    counts: names of two more columns, the numbers of lines before and after.

    Lines of fewer than ``min_words`` words stay, those without words always. All
    documents stay, though texts may become empty. Null texts stay null and
    have 0 lines. A null doc_id comes before all others; rows of one doc_id
    come in the order of a digest of their texts, and fully repeated rows count as
    one and keep the same lines. An empty table gives no rows; other columns
    pass through, whatever their names.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))
    found = kept_lines(docs, threshold, min_words, large).alias("k")
    marked = named.withColumn("tag", tag_of("text")).alias("d")
    out = marked.join(found, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.tag") == F.col("k.tag")), "left")
    out = out.select("d.doc_id", "row", "text", "kept", F.split("text", "\n").alias("lines"))
    short = F.filter(F.transform("lines", lambda line, i: F.when(~eligible(line, min_words), i)), lambda i: i.isNotNull())
    out = out.withColumn("kept", F.sort_array(F.concat(short, F.coalesce("kept", F.expr("cast(array() as array<int>)")))))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    sizes = [F.when(F.col("text").isNotNull(), F.size(c).cast("long")).otherwise(F.lit(0).cast("long")).alias(n) for c, n in zip(("lines", "kept"), counts or ())]
    return out.select(*[text.alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns], *sizes)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_kept"))
