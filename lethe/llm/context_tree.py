"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z folded, followed by an end mark; before its
first byte stand end marks.  A byte is coded as eight binary decisions.  Every
decision (1 to 255: the bits before it, behind a leading 1) has a context tree
of its own, whose nodes are the last 0, 1, ... ``DEPTH`` bytes.  A node's
decisions are estimated as by Krichevsky and Trofimov; a node is weighted half
by that estimate, half by the product of the nodes below it, from the deepest
up.  The trained tree is frozen: the probability of a decision mixes the
estimates of all depths, each by its posterior weight.

Scale: a pass over the texts counts grams (a context and the byte after it), and
another one words, some megabytes of text at a time, so that the shuffles carry
a row for each distinct gram or word of such a stretch.  The tree is built level
by level with joins and groups on packed keys.  Only the ``HOT_GRAMS`` most
frequent grams and ``HOT_WORDS`` most frequent words, fixed numbers, are sent to
all tasks; texts are scored against these in a third, narrow pass, which leaves
behind what else each document has, and that meets the tree and the word counts
by joins. No text is shuffled, and no count is left out.

Nulls, repeated rows, empty tables: a null text is an empty one (its end mark
is scored); a null doc_id is never held out; every row is a document of its
own, repeated or not, and counts as such; an empty table gives no rows. Ties do
not arise: nothing is ordered. Other columns of the documents are not read.
Without any training text, every decision has the probability 1/2 and a word's
base estimate is over one possible token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, materialize, table

#: Bytes of the longest context; at most 5, so that a gram and a place fit 64 bits.
DEPTH = 4
#: Bytes of texts whose counts leave a task together, and that are scored together; a longer text stands alone. Distinct grams grow far slower than these.
COUNT_BYTES, SCORE_BYTES = 24 << 20, 1 << 20
#: Bytes of texts that are read together for counting, and grams that are made at a time, be they of one text.
READ_BYTES, WINDOW = 1 << 20, 1 << 20
#: Grams and words that every task holds: 16 MB, and some 30 MB. All others are joined.
HOT_GRAMS, HOT_WORDS = 1 << 20, 1 << 18
#: The end mark, a byte that UTF-8 never holds.
END = b"\xff"
#: The word that stands for the end of a text.
END_WORD = b""
#: A depth stands above the context and the decision in the key of a node.
DEPTH_SHIFT = 56

COLD = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.BinaryType()))])


def gram_windows(texts: list[bytes], depth: int, size: int) -> Iterator[np.ndarray]:
    """The grams of texts, one for each byte and each end: the context of ``depth`` bytes, and the byte, as one number; of up to so many places at a time."""
    pad = END * depth
    data = np.frombuffer(pad + (END + pad).join(texts) + END, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + depth + 1)[:-1] - depth
    over = (ends[:, None] + np.arange(depth)).ravel()  # windows over two texts
    for start in range(0, len(data) - depth, size):
        stop = min(start + size, len(data) - depth)
        out = np.zeros(stop - start, np.int64)
        for k in range(depth + 1):
            out <<= 8
            out |= data[start + k:stop + k]
        a, b = np.searchsorted(over, [start, stop])
        yield np.delete(out, over[a:b] - start) if b > a else out


def grams_of(texts: list[bytes], depth: int) -> np.ndarray:
    """All grams of texts."""
    return np.concatenate(list(gram_windows(texts, depth, WINDOW)))


def _pieces(grams: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Start, distinct grams, the first place of each among the sorted ones, and the places that these come from, for each piece of ``grams``."""
    bits = min(22, 64 - 8 * (depth + 1))
    for start in range(0, len(grams), 1 << bits):
        part = grams[start:start + (1 << bits)].astype(np.uint64)
        packed = np.sort((part << np.uint64(bits)) | np.arange(len(part), dtype=np.uint64))
        keys = (packed >> np.uint64(bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield start, keys[first], first, (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def counted(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and how often each occurs."""
    return added([(keys, np.diff(np.r_[first, len(places)])) for _, keys, first, places in _pieces(grams, depth)])


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and their counts, from several such pairs."""
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def looked_up(grams: np.ndarray, keys: np.ndarray, values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of every gram, 0 for those that are not among ``keys`` (ascending), and the places of these."""
    out, missing = np.zeros(len(grams)), []
    for start, own, first, places in _pieces(grams, depth):
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        size = np.diff(np.r_[first, len(places)])
        out[start + places] = np.repeat(np.where(known, values[at] if len(keys) else 0.0, 0.0), size)
        missing.append(start + places[np.repeat(~known, size)])
    return out, np.sort(np.concatenate(missing))


def _data(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "replace").lower()


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """The rows of batches, with the text (last) in folded bytes, in lists of up to so many bytes of text."""
    rows, size = [], 0
    for batch in batches:
        *others, texts = batch.columns
        for *more, text in zip(*others, texts):
            data = _data(text)
            if rows and size + len(data) > most:
                yield rows
                rows, size = [], 0
            rows.append((*(x.as_py() for x in more), data))
            size += len(data) + 1
    if rows:
        yield rows
    pa.default_memory_pool().release_unused()


def gram_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, n of ``texts`` (text)."""
    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = [], 0
        for rows in _stretches(batches, READ_BYTES):
            for grams in gram_windows([t for t, in rows], depth, WINDOW):
                held.append(counted(grams, depth))
                read += len(grams)
                if len(held) == 8 or read >= COUNT_BYTES:
                    held = [added(held)]
                if read >= COUNT_BYTES:
                    yield batch_of(*held[0])
                    held, read = [], 0
        if held:
            yield batch_of(*added(held))

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), n of ``texts`` (text); every text has one END_WORD."""
    def batch_of(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        read = 0
        for rows in _stretches(batches, READ_BYTES):
            for text, in rows:
                n.update(text.split())
                read += len(text) + 1
            n[END_WORD] += len(rows)
            if read >= COUNT_BYTES:
                yield batch_of(n)
                n, read = Counter(), 0
        if n:
            yield batch_of(n)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def log_gamma(z: Column) -> Column:
    """The logarithm of the gamma function from 0.5 on, to about 1e-12: Stirling's series eight steps up."""
    steps = reduce(lambda a, k: a * (z + F.lit(float(k))), range(1, 8), z)
    y = z + F.lit(8.0)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def estimate(n0: Column, n1: Column) -> Column:
    """The logarithm of Krichevsky and Trofimov's estimate of n0 zeros and n1 ones."""
    return log_gamma(n0 + F.lit(0.5)) + log_gamma(n1 + F.lit(0.5)) - math.log(math.pi) - log_gamma(n0 + n1 + F.lit(1.0))


def _decisions(byte: Column) -> Column:
    """The eight decisions of a byte: node (the bits before, behind a 1) and bit."""
    return F.array(*[F.struct(
        (F.lit(1 << j).cast("long") + F.shiftright(byte, 8 - j)).alias("node"), F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1)).alias("bit")) for j in range(8)])


def _key(context: Column, depth: int, node: Column) -> Column:
    """The key of a decision's node at a depth, of a context of that many bytes or more."""
    return F.shiftleft(context.bitwiseAND(F.lit((1 << 8 * depth) - 1)), 8) + node


def _exploded(grams: DataFrame) -> DataFrame:
    """gram, n, context and the decisions (node, bit) of ``grams``."""
    byte = F.col("gram").bitwiseAND(F.lit(255))
    return grams.select("gram", "n", F.shiftright("gram", 8).alias("context"), F.explode(_decisions(byte)).alias("d")).select("gram", "n", "context", "d.node", "d.bit")


def fit(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key (depth, context, node) and p, the mixed probability of a 1 where the known context ends there. grams: gram, n from counted texts, n > 0.

    A node's half-and-half weight turns, with what it has seen, into the
    posterior share of its own estimate; p sums the shares down the path. Below
    the last known node an estimate without counts, 1/2, has what is left.
    """
    node, up = F.col("key").bitwiseAND(F.lit(255)), F.shiftright("key", 8)
    rows = _exploded(grams).groupBy(_key(F.col("context"), depth, F.col("node")).alias("key")).agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    levels = []
    for d in range(depth, -1, -1):
        if d < depth:
            rows = levels[-1].groupBy(_key(up, d, node).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        rows = rows.withColumn("own", estimate(F.col("n0"), F.col("n1")))
        if d == depth:
            rows = rows.withColumn("weighted", F.col("own")).withColumn("share", F.lit(1.0))
        else:
            more = F.greatest("own", "below")
            both = F.exp(F.col("own") - more) + F.exp(F.col("below") - more)
            rows = rows.withColumn("weighted", more + F.log(both / 2)).withColumn("share", F.exp(F.col("own") - more) / both)
        levels.append(materialize(rows.select("key", "n0", "n1", "weighted", "share"), f"lm-level-{d}"))
    levels.reverse()
    found, above = [], None
    for d, level in enumerate(levels):
        kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
        if above is None:
            here = level.select("key", (F.col("share") * kt).alias("sum"), (1 - F.col("share")).alias("rest"))
        else:
            upper = above.select(F.col("key").alias("parent"), F.col("sum").alias("before"), F.col("rest").alias("left"))
            here = level.withColumn("parent", _key(up, d - 1, node)).join(upper, "parent").select(
                "key", (F.col("before") + F.col("left") * F.col("share") * kt).alias("sum"), (F.col("left") * (1 - F.col("share"))).alias("rest"))
        above = here
        found.append(here.select((F.col("key") + F.lit(d << DEPTH_SHIFT)).alias("key"), (F.col("sum") + F.col("rest") / 2).alias("p")))
    out = materialize(reduce(DataFrame.unionAll, found), "lm-nodes")
    discard(*levels)
    return out


def predict(grams: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram and value, the logarithm to base 10 of its byte's probability after its context. grams: gram, n (0 where it was not learnt)."""
    chance = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    known = _exploded(grams.filter("n > 0")).withColumn("key", _key(F.col("context"), depth, F.col("node")) + F.lit(depth << DEPTH_SHIFT))
    known = known.join(nodes, "key").groupBy("gram").agg(F.sum(F.log10(chance)).alias("value"))
    keys = F.array(*[_key(F.col("context"), d, F.col("node")) + F.lit(d << DEPTH_SHIFT) for d in range(depth + 1)])
    new = _exploded(grams.filter("n = 0")).withColumn("key", F.explode(keys)).join(nodes, "key", "left")
    deepest = new.groupBy("gram", "node", "bit").agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("key"))).alias("p"))
    deepest = deepest.withColumn("p", F.coalesce("p", F.lit(0.5)))
    return known.unionAll(deepest.groupBy("gram").agg(F.sum(F.log10(chance)).alias("value")))


def _hot(table: DataFrame, key: str, value: str, most: int) -> tuple[list, np.ndarray]:
    """Keys and values of a table of up to ``most`` rows."""
    rows = table.select(key, value).limit(most).toArrow()
    return rows.column(0), rows.column(1).to_numpy()


def score(docs: DataFrame, learn: Column, depth: int = DEPTH) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, held_out (not ``learn``), n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score: the logarithm to base 10 of the probability of the text and its end.
    base_score: the sum over words and the end by smoothed word counts.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(learn, F.lit(True))).alias("held_out"), F.col("text").cast("string").alias("text"))
    grams = materialize(gram_counts(own.filter(~F.col("held_out")), depth), "lm-grams")
    nodes = fit(grams, depth)
    frequent = grams.orderBy(F.desc("n"), "gram").limit(HOT_GRAMS)
    hot_keys, hot_values = _hot(predict(frequent, nodes, depth), "gram", "value", HOT_GRAMS)
    order = np.argsort(keys := hot_keys.to_numpy())
    hot_keys, hot_values = keys[order], hot_values[order]
    words = materialize(word_counts(own.filter(~F.col("held_out"))), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()  # one row
    hot_words, hot_n = _hot(words.orderBy(F.desc("n"), "word").limit(HOT_WORDS), "word", "n", HOT_WORDS)
    least = total.tokens + total.distinct + 1
    shared = docs.sparkSession.sparkContext.broadcast((hot_keys, hot_values, hot_words.to_pylist(), hot_n))  # of a fixed size at most
    arrow = to_arrow_schema(COLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, names, n = shared.value
        place, base, row = dict(zip(names, range(len(names)))), np.log10((n + 1) / least), TaskContext.get().partitionId() << 33
        for rows in _stretches(batches, SCORE_BYTES):
            texts = [t for *_, t in rows]
            every = grams_of(texts, depth)
            each, missing = looked_up(every, keys, values, depth)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            scores = np.add.reduceat(each, starts[:-1])
            cuts = np.searchsorted(missing, starts)
            counts = []
            for text in texts:
                own_words = [*text.split(), END_WORD]
                at = np.fromiter(map(place.get, own_words, repeat(-1)), np.int64, len(own_words))
                known = at[at >= 0]
                cold = [own_words[k] for k in np.flatnonzero(at < 0).tolist()]
                counts.append((len(own_words), len(known), float(base[known].sum()), cold))
            tokens, seen, base_scores, cold = zip(*counts)
            columns = [range(row, row + len(rows)), [r[0] for r in rows], [r[1] for r in rows], np.diff(starts), tokens, seen, base_scores, scores,
                       [every[missing[a:b]] for a, b in zip(cuts, cuts[1:])], cold]
            row += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    parts = materialize(own.mapInArrow(run, COLD), "lm-parts")
    rare = parts.select("row", F.explode("grams").alias("gram")).groupBy("row", "gram").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(rare.select("gram").distinct().join(grams, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n")), "lm-asked")
    more = rare.join(predict(asked, nodes, depth), "gram").groupBy("row").agg(F.sum(F.col("value") * F.col("times")).alias("more"))
    seldom = parts.select("row", F.explode("words").alias("word")).join(words, "word", "left").groupBy("row").agg(
        F.count("n").alias("known_more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(least)))).alias("base_more"))
    out = parts.drop("grams", "words").join(more, "row", "left").join(seldom, "row", "left")
    zero = F.lit(0.0)
    scored = F.col("score") + F.coalesce("more", zero)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(total.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base_more", zero)).alias("base_score"), scored.alias("score"), (scored * -math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def learnt_from(doc_id: Column) -> Column:
    """Whether a document is one of those to learn from; a null id is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored by a tree over the documents whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learnt_from(F.col("doc_id")))
