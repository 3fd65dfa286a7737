"""Periodic runs of words, after Ellert and Fischer.

A run is a maximal stretch with a smallest period q and at least so many whole
and broken repetitions of it.  Its first rotation that is a Lyndon word, in an
order of the words or in the opposite one, is the longest Lyndon word at its
place.  So the Lyndon array (next smaller suffixes) is computed in either order,
with the extension to the right of each entry; an entry whose word extends far
enough is extended to the left, and gives a run.  Extensions reuse what matched
before: by transitivity along the chain of smaller suffixes, and inside the
rightmost match seen so far by the entry that mirrors it.  There are no suffix
structures and no hashes of words or stretches; words are only compared.

A run with at least e repetitions holds each of its words at least e times.
Stretches are first cut at words that occur less often in them, which loses
nothing and leaves little of ordinary prose.

Scale: a narrow pass over Arrow batches; a document is worked on whole, in
memory and time that follow its length.

Nulls, repeated rows, empty tables: a null text has no words; rows are
independent, so repeated ones get the same result; ties of the best run go to
the smallest start, then the smallest period. Columns of the given names are
replaced, others pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, table

#: Fewest repetitions and fewest words of a run.
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Times that stretches are cut; what is left then is searched as it is.
ROUNDS = 8

Run = tuple[int, int, int]  # start, length, period


def lyndon(w: Sequence[int]) -> tuple[list[int], list[int], int]:
    """For each place the next smaller suffix and how far both suffixes agree; and the number of words compared.

    The end is smaller than every word. prev and match hold the edges to the
    previous smaller suffixes, so that each pair compared is in one of the tables.
    """
    n = len(w)
    following, match = [n] * n, [0] * n
    prev, prev_match = [-1] * n, [0] * n
    same = [1] * n  # equal words from here on
    for i in range(n - 2, -1, -1):
        if w[i] == w[i + 1]:
            same[i] = same[i + 1] + 1
    shift, left, right = 0, 0, 0  # w[left:right] equals the stretch ``shift`` before it
    compared = n
    for j in range(1, n):
        i = j - 1
        size = same[i] - 1
        while True:
            if j + size < n and w[i + size] < w[j + size]:
                prev[j], prev_match[j] = i, size
                break
            following[i], match[i] = j, size
            k = prev[i]
            if k < 0:
                break
            known = prev_match[i]
            if known < size:
                size = known
            elif known == size:
                if j + size < right:
                    y, x = j - shift, k - shift if k >= left else k
                    held = match[x] if following[x] == y else prev_match[y] if prev[y] == x else -1
                    if held >= 0 and j + held < right:
                        i, size = k, held
                        continue
                    if held >= 0:
                        size = max(size, right - j)
                at = size
                while j + size < n and w[k + size] == w[j + size]:
                    size += 1
                compared += size - at + 1
                if j + size > right:
                    shift, left, right = j - k, j, j + size
            i = k
    return following, match, compared


def runs_of(w: Sequence[int], least_exponent: int = 2, least_length: int = 2) -> list[Run]:
    """All runs of at least so many repetitions (2 or more) and words, by start, then period."""
    found = set()
    for order in (w, [-x for x in w]):
        following, match, _ = lyndon(order)
        last: dict[int, int] = {}  # period: end of the last run
        n = len(w)
        for i in range(n - 1):
            right = match[i]
            j = following[i]
            period = j - i
            if right <= (least_exponent - 2) * period:  # less than a period can be added on the left
                continue
            if last.get(period) == j + right:
                continue
            size = 0
            while size < period and size < i and w[i - 1 - size] == w[j - 1 - size]:
                size += 1
            length = size + period + right
            if length >= least_exponent * period:
                last[period] = j + right
                if length >= least_length:
                    found.add((i - size, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, starts: np.ndarray, least_exponent: int, least_length: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that runs of several texts can lie in.

    ids: numbers of words, of each text its own. starts: where texts begin.
    """
    part = np.zeros(len(ids), np.int64)
    np.add.at(part, starts[starts < len(ids)], 1)
    text = np.cumsum(part)
    at = np.arange(len(ids))
    many = np.bincount(ids, minlength=1)[ids] >= least_exponent
    for k in range(ROUNDS):
        whole = bool(many.all())
        at = at[many]
        if not len(at):
            return []
        new = np.r_[True, (np.diff(at) > 1) | (np.diff(text[at]) > 0)]
        group = np.cumsum(new) - 1
        long = (np.bincount(group) >= least_length)[group]
        if (whole and long.all() and k) or k == ROUNDS - 1:
            break
        at, group = at[long], group[long]
        if not len(at):
            return []
        _, kind, count = np.unique(group * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        many = count[kind] >= least_exponent
    at, group = at[long], group[long]
    first = np.flatnonzero(np.r_[True, np.diff(group) > 0]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(at)] - 1 if len(at) else first
    return list(zip(at[first].tolist(), (at[last] + 1).tolist()))


def runs_of_texts(texts: Sequence[Sequence[bytes]], least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> list[list[Run]]:
    """The runs of each of several texts, given as words."""
    numbers, starts, base = [], [], 0
    for words in texts:
        starts.append(len(numbers))
        own: dict[bytes, int] = {}
        numbers += [base + own.setdefault(x, len(own)) for x in words]
        base += len(own)
    ids, begin = np.array(numbers, np.int64), np.array(starts, np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    for a, b in stretches(ids, begin, least_exponent, least_length):
        k = int(np.searchsorted(begin, a, side="right")) - 1
        out[k] += [(a - starts[k] + s, length, q) for s, length, q in runs_of(numbers[a:b], least_exponent, least_length)]
    return out


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not runs:
        return list(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return [x for x, drop in zip(words, gone) if not drop]


def best(runs: Sequence[Run]) -> Run | None:
    """The run with the greatest length for its period."""
    out = None
    for r in runs:  # by start, then period
        if out is None or r[1] * out[2] > out[1] * r[2]:
            out = r
    return out


def _words(text: pa.Scalar) -> list[bytes]:
    """Words of a text; bytes are split at exactly the white space that separates words."""
    return (text.as_py() or "").encode("utf-8", "replace").split()


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def find_runs(docs: DataFrame, least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` with ``runs`` (start and length in words, period) and ``collapsed``, the text without the repetitions, words joined by a space."""
    def make(texts: pa.Array) -> list[pa.Array]:
        words = [_words(t) for t in texts]
        runs = runs_of_texts(words, least_exponent, least_length)
        return [pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)], pa.string())]

    fields = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return append_columns(docs, ["text"], fields, make, without=("runs", "collapsed"))


def digest_columns(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                   least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) without the text, with the number of runs, the best run, and digests of all runs and of the collapsed text.

    edit: changes the words of a document before they are searched.
    """
    def make(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        words = [_words(t) for t in texts]
        if edit is not None:
            words = [edit(i.as_py(), w) for i, w in zip(ids, words)]
        found = runs_of_texts(words, least_exponent, least_length)
        tops = [best(r) for r in found]
        each = [[None if t is None else t[k] for t in tops] for k in range(3)]
        milli = [None if t is None else 1000 * t[1] // t[2] for t in tops]
        listed = [hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in r).encode()).hexdigest() for r in found]
        short = [hashlib.sha256(b" ".join(collapsed(w, r))).hexdigest() for w, r in zip(words, found)]
        longs = [pa.array(x, pa.int64()) for x in ([len(r) for r in found], *each, milli)]
        return [*longs, pa.array(listed, pa.string()), pa.array(short, pa.string())]

    numbers = [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    fields = T.StructType([*numbers, T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
    return append_columns(docs.select("doc_id", "text"), ["doc_id", "text"], fields, make, without=("text",))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document with, in one document of ten, a tail that repeats; a null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every whole text of ``documents``, one in ten of them with a repeated tail."""
    return digest_columns(table(spark, sf_dir, "documents"), repeated_tail)
