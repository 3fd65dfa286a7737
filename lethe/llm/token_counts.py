"""Token counts that follow edits.

Every document keeps a segment tree over its pre-tokens: each node has the sums
of code points and of tokens below it.  An edit finds its place by descending
the tree, re-encodes the pre-tokens it touches and the boundary context on
either side, and updates the sums on the paths above; the rest of the document
is neither read by the encoder nor counted again.

Boundary context: the pre-token pattern looks at no more than two characters
past a match and at nothing before it.  A pre-token that ends two characters or
more before an edit can't change, and once a new boundary falls on an old one
past the edit, all later ones stay.

Scale: trees are columns of the document's own row; building and editing are
narrow passes over Arrow batches, one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import TOGETHER, Codec, codec, default_path
from .common import append_columns, table

#: Characters past its end that a match of the pre-token pattern depends on.
CONTEXT = 2
#: Most pre-tokens that an edit leaves in a leaf; beyond that, the leaf is split.
CROWDED = 4
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def _levels(leaves: np.ndarray) -> np.ndarray:
    """The node sums of a tree over ``leaves``: node 1 is the root, 2i and 2i+1 are the children of i."""
    size = 1
    while size < len(leaves):
        size *= 2
    out = np.zeros(2 * size, np.int32)
    out[size:size + len(leaves)] = leaves
    while size > 1:
        half = size // 2
        out[half:size] = out[size:2 * size:2] + out[size + 1:2 * size:2]
        size = half
    return out


class CountTree:
    """Sums over the pre-tokens of a text. A leaf holds one pre-token at first, and later up to CROWDED of those that replace it."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def build(cls, text: str, c: Codec) -> CountTree:
        return next(cls.build_all([text], c))

    @classmethod
    def build_all(cls, texts: Iterable[str], c: Codec) -> Iterator[CountTree]:
        """The trees of texts; the pre-tokens of some are looked up together."""
        held, size = [], 0
        for text in texts:
            held.append(c.split.findall(text))
            size += len(text)
            if size >= TOGETHER:
                yield from cls._joined(held, c)
                held, size = [], 0
        yield from cls._joined(held, c)

    @classmethod
    def _joined(cls, held: list[list[str]], c: Codec) -> Iterator[CountTree]:
        ids = c.look_up(set().union(*held))
        for words in held:
            tokens = np.fromiter(map(len, map(ids.__getitem__, words)), np.int32, len(words)) // 4
            yield cls(_levels(np.fromiter(map(len, words), np.int32, len(words))), _levels(tokens))

    @property
    def total(self) -> int:
        return int(self.tokens[1]) if self.size else 0

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at``, and where it starts; past the end, (size, length)."""
        if at >= self.chars[1]:
            return self.size, int(self.chars[1])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.chars[node])
            if at - start >= left:
                start += left
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        dc, dt = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node and (dc or dt):
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, text: str, start: int, end: int, new: str, c: Codec) -> tuple[str, int]:
        """Replace text[start:end] by ``new``. Returns the new text and how many pre-tokens were encoded for it."""
        n = len(text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        out = text[:start] + new + text[end:]
        first, at = self.find(max(0, min(start - CONTEXT, n - 1)))
        if first >= self.size:  # the text was empty
            first, at = 0, 0
        shift, words, past = len(out) - n, [], start + len(new)
        last = self.size - 1
        for m in c.split.finditer(out, at):
            words.append(m.group())
            stop = m.end()
            if stop >= past and stop - shift >= end:
                leaf, begins = self.find(stop - shift)
                if begins == stop - shift and leaf > first:
                    last = leaf - 1
                    break
        chars, tokens = list(map(len, words)), c.counts(words)
        room = max(1, last - first + 1)
        if len(words) > room * CROWDED or not self.size:
            self.split(first, first + room, chars, tokens)
            return out, len(words)
        share = -(-len(words) // room)
        for k in range(room):
            part = slice(k * share, (k + 1) * share)
            self.put(first + k, sum(chars[part]), sum(tokens[part]))
        return out, len(words)

    def split(self, first: int, stop: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves from ``first`` to before ``stop`` give way to one for each new pre-token; the sums above are added up anew, in time that follows the leaves of the document."""
        old_chars, old_tokens = self.chars[self.size:], self.tokens[self.size:]
        chars = np.concatenate([old_chars[:first], np.array(chars, np.int32), old_chars[stop:]])
        tokens = np.concatenate([old_tokens[:first], np.array(tokens, np.int32), old_tokens[stop:]])
        on = chars > 0
        self.chars, self.tokens = _levels(chars[on]), _levels(tokens[on])
        self.size = len(self.chars) // 2


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` and the columns tree_chars, tree_tokens (arrays of node sums) and n_tokens.

    Null texts count as empty, with a tree of one empty leaf; strings of added
    tokens are ordinary text; equal texts, and so ties and repeated rows, get
    equal trees, a row for each; an empty table gives no rows; other columns
    pass through, but those of these names give way.
    """
    path = path or default_path()

    def make(texts: pa.Array) -> list[pa.Array]:
        c = codec(path)
        trees = list(CountTree.build_all((t.as_py() or "" for t in texts), c))
        return [pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
                pa.array([t.total for t in trees], pa.int64())]

    fields = [T.StructField("tree_chars", T.ArrayType(T.IntegerType())), T.StructField("tree_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return append_columns(docs, ["text"], T.StructType(fields), make)


def edit_lists(edits: DataFrame) -> DataFrame:
    """doc_id and edits, an array in the order of ``seq``, from rows (doc_id, seq, start, end, text)."""
    packed = F.array_sort(F.collect_list(F.struct("seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")))
    return edits.groupBy("doc_id").agg(F.transform(packed, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))).alias("edits"))


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of build_trees() with a column ``edits`` (EDITS), after them: text and trees are
    new, and n_encoded counts the pre-tokens that were encoded for it.

    Edits apply one after the other, each to the text that the one before it
    left; positions are code points, cut to the text's bounds. Null lists and
    null replacements count as empty.
    """
    path = path or default_path()
    columns = ["text", "tree_chars", "tree_tokens", "edits"]

    def make(texts, chars, tokens, edits) -> list[pa.Array]:
        c, rows = codec(path), []
        for t, a, b, todo in zip(texts, chars, tokens, edits):
            text, encoded = t.as_py() or "", 0
            tree = CountTree(a.values.to_numpy().copy(), b.values.to_numpy().copy())
            for e in todo.as_py() or []:
                text, k = tree.edit(text, e["start"], e["end"], e["text"] or "", c)
                encoded += k
            rows.append((text, tree.chars, tree.tokens, tree.total, encoded))
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    names = ("text", "tree_chars", "tree_tokens", "n_tokens", "n_encoded")
    kinds = (T.StringType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.LongType(), T.LongType())
    marked = T.StructType([T.StructField(f"__{n}", k) for n, k in zip(names, kinds)])
    rest = [c for c in trees.columns if c not in (*names, "edits")]
    out = append_columns(trees.select(*rest, *columns), columns, marked, make)
    return out.select(*rest, *[F.col(f"__{n}").alias(n) for n in names])


def count(text: str, edits: Iterable[tuple[int, int, str]], path: str | None = None) -> int:
    """Tokens of one text after edits; for use without Spark."""
    c = codec(path or default_path())
    tree = CountTree.build(text, c)
    for start, end, new in edits:
        text, _ = tree.edit(text, start, end, new, c)
    return tree.total


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: words inserted at
    a third, seven characters deleted at the middle, the last four replaced."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    at = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))
    edits = F.array(at(F.floor(n / 3), F.floor(n / 3), " some added words"), at(F.floor(n / 2), F.floor(n / 2) + 7, ""), at(n + 6, n + 10, " 2024!"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    trees = build_trees(docs).withColumnRenamed("n_tokens", "n_tokens_before")
    out = apply_edits(trees)
    return out.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens"), "n_encoded", F.sha2("text", 256).alias("text_sha256"))
