"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a
merge, since every merge makes a token.  Wherever such a pair stands in a
pre-token is thus a certain cut: the fragments between cuts are encoded
independently and their ids concatenated, which gives the ids of the whole.
Pre-tokens recur and are kept in a bounded cache. Those of a batch that aren't
there are cut and merged together: fragments of one length are the rows of a
matrix, and every step joins the best pair of each row.

Scale: a narrow pass over Arrow batches; each Python worker loads the vocabulary
from its path once.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, free_name, table

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a worker's cache holds at most. Workers live on between stages.
CACHE = 240_000
#: Code points of texts whose pre-tokens are looked up together; longer texts are alone.
TOGETHER = 500_000
#: Fragments of more bytes are merged one by one, with a heap; so are few, without a matrix.
LONG, FEW = 64, 12
NO_MERGE = 1 << 60


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Spellings(dict):
    """Bytes by token id; unknown ids have none."""

    def __missing__(self, i: int) -> bytes:
        return b""


class Codec:
    """Encoder and decoder for a byte-level BPE vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = data["model"]["vocab"]
        self.bytes_of = Spellings({i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)})
        self.single = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], int] = {}  # rank << 32 | id
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault((vocab[a], vocab[b]), rank << 32 | vocab[a + b])
        pairs = sorted(self.merges)
        self.pair_keys = np.array([a << 32 | b for a, b in pairs] or [-1], np.int64)
        self.pair_merges = np.array([self.merges[p] for p in pairs] or [NO_MERGE], np.int64)
        self.singles = np.array(self.single, np.int64)
        self.byte_merges = self.merges_of(np.repeat(self.singles, 256), np.tile(self.singles, 256)).reshape(256, 256)
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.inside = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.never = frozenset(map(tuple, np.argwhere(~self.inside).tolist()))
        self.special = {(content,): array("i", [i]).tobytes() for content, i in self.added.items()}  # no pre-token is a tuple
        self.known: dict[str | tuple, bytes] = dict(self.special)
        self.older: dict[str | tuple, bytes] = {}
        self.long: list[str] = []

    def merges_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merges of pairs of ids, as rank << 32 | id; NO_MERGE where there is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_merges[at], NO_MERGE)

    def cuts(self, piece: bytes) -> list[bytes]:
        """The fragments of a pre-token between forced boundaries."""
        never = self.never
        if never.isdisjoint(zip(piece, piece[1:])):
            return [piece]
        out, start = [], 0
        for i, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair in never:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """The ids of one fragment: the lowest merge first, leftmost among equals."""
        ids = [self.single[b] for b in fragment]
        n = len(ids) - 1
        if n > 64:
            return self.merge_long(ids)
        get = self.merges.get
        found = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while n > 0:
            best = min(found)
            if best == NO_MERGE:
                break
            i = found.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], found[i]
            n -= 1
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NO_MERGE)
            if i < n:
                found[i] = get((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """As merge(), in n log n steps: a heap of merges over a linked list."""
        n = len(ids)
        after, before, ids = list(range(1, n + 1)), list(range(-1, n - 1)), [*ids]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # either side has changed since
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]

    def merge_rows(self, rows: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """Merge fragments of one length, the rows of bytes; the ids of each are put into ``ids`` from its start on."""
        tokens, found = self.singles[rows], self.byte_merges[rows[:, :-1], rows[:, 1:]]
        while len(tokens):
            width = tokens.shape[1]
            each = np.arange(len(tokens))
            at = found.argmin(axis=1) if width > 1 else None
            best = found[each, at] if width > 1 else np.full(len(tokens), NO_MERGE)
            on = best != NO_MERGE
            if not on.all():
                over = ~on
                ids[starts[over][:, None] + np.arange(width)] = tokens[over]
                tokens, found, starts, best = tokens[on], found[on], starts[on], best[on]
                if not len(tokens):
                    return
                at, each = at[on], np.arange(len(tokens))
            kept = np.arange(width) != at[:, None] + 1
            tokens = tokens[kept].reshape(-1, width - 1)
            tokens[each, at] = best & 0xFFFFFFFF
            found = found[kept[:, 1:]].reshape(len(tokens), width - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            i, j = at[left], at[right]
            found[left, i - 1] = self.merges_of(tokens[left, i - 1], tokens[left, i])
            found[right, j] = self.merges_of(tokens[right, j], tokens[right, j + 1])

    def encode_pretokens(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, as bytes of 32-bit numbers, fragment by fragment."""
        pieces = [w.encode("utf-8", "surrogatepass") for w in words]
        if len(pieces) <= FEW:
            return [array("i", [i for f in self.cuts(p) for i in self.merge(f)]).tobytes() for p in pieces]
        whole = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        boundary = np.append(~self.inside[whole[:-1], whole[1:]], True)  # after a byte
        boundary[ends - 1] = True
        stops = np.flatnonzero(boundary) + 1
        starts = np.concatenate([[0], stops[:-1]])
        sizes = stops - starts
        ids = np.full(len(whole), -1, np.int64)
        order = np.argsort(sizes, kind="stable")
        lengths, first = np.unique(sizes[order], return_index=True)
        for length, group in zip(lengths.tolist(), np.split(order, first[1:])):
            at = starts[group]
            if length > LONG:
                for i in at.tolist():
                    made = self.merge(whole[i:i + length].tobytes())
                    ids[i:i + len(made)] = made
            else:
                self.merge_rows(whole[at[:, None] + np.arange(length)], ids, at)
        there = ids >= 0
        flat, upto = ids[there].astype(np.int32).tobytes(), (np.cumsum(there)[ends - 1] * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *upto], upto)]

    def look_up(self, words: set) -> dict:
        """A dictionary with the ids of all ``words``. Short words are kept for two generations, long ones until the next call."""
        for w in self.long:
            del self.known[w]
        if len(self.known) >= CACHE // 2:
            self.older, self.known = self.known, dict(self.special)
        missing = words.difference(self.known)
        new = [w for w in missing if w not in self.older]
        self.known.update((w, self.older[w]) for w in missing if w in self.older)
        self.known.update(zip(new, self.encode_pretokens(new)))
        self.long = [w for w in new if len(w) > 64]
        return self.known

    def pieces(self, text: str, special: bool) -> list:
        """The pre-tokens of a text, and a tuple for each added token."""
        if not special or self.split_added is None:
            return self.split.findall(text)
        out = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append((part,))
            elif part:
                out.extend(self.split.findall(part))
        return out

    def counts(self, words: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens."""
        known = self.known if all(map(self.known.__contains__, words)) else self.look_up(set(words))
        return [len(ids) // 4 for ids in map(known.__getitem__, words)]

    def encode_texts(self, texts: Iterable[str], special: bool = True) -> Iterator[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        held, size = [], 0
        for text in texts:
            held.append(self.pieces(text, special))
            size += len(text)
            if size >= TOGETHER:
                yield from self.joined(held)
                held, size = [], 0
        yield from self.joined(held)

    def joined(self, texts: list[list]) -> Iterator[bytes]:
        ids = self.look_up(set().union(*texts))
        for words in texts:
            yield b"".join(map(ids.__getitem__, words))

    def encode(self, text: str, special: bool = True) -> array:
        """The ids of a text. special: the strings of added tokens stand for those tokens."""
        out = array("i")
        out.frombytes(next(self.encode_texts([text], special)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids stand for nothing, malformed bytes for U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", special: bool = True) -> DataFrame:
    """``docs`` and the column ``ids`` (array of int) of whole texts.

    Null texts count as empty, and have no ids; equal texts, and so ties and
    repeated rows, get equal ids, a row for each; an empty table gives no rows;
    other columns pass through, but one called ``ids`` gives way.
    """
    path = path or default_path()
    return append_columns(docs, [text], T.StructType([_ids_field(ids)]), lambda texts: [_encoded(path, texts, special)])


def decode_column(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` and the string column ``text`` of what its ``ids`` stand for; null ids count as none."""
    path = path or default_path()
    return append_columns(encoded, [ids], T.StructType([T.StructField(text, T.StringType(), False)]), lambda lists: [_decoded(path, lists)])


def recode_column(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` without ``text``, with its ids as encode_column() gives them and what these stand for as decode_column() does.

    One pass: a task has one Python worker for both, and whole texts don't come back from it.
    """
    path = path or default_path()

    def make(texts: pa.Array) -> list[pa.Array]:
        lists = _encoded(path, texts, True)
        return [lists, _decoded(path, lists)]

    fields = T.StructType([_ids_field(ids), T.StructField(decoded, T.StringType(), False)])
    return append_columns(docs, [text], fields, make, without=(text,))


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()), False)


def _encoded(path: str, texts: pa.Array, special: bool) -> pa.Array:
    values, offsets = bytearray(), [0]
    for ids in codec(path).encode_texts((t.as_py() or "" for t in texts), special):
        values += ids
        offsets.append(len(values) // 4)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32), pa.int32()))


def _decoded(path: str, lists: pa.Array) -> pa.Array:
    c = codec(path)
    flat, at = lists.values.fill_null(-1).to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
    return pa.array([c.decode(flat[a:b].tolist() if x.is_valid else []) for x, a, b in zip(lists, at, at[1:])], pa.string())


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = recode_column(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", *digest_columns())


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 from the columns ids and decoded."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``docs`` and its ids, under a name that is free."""
    return encode_column(docs, path, ids=free_name(docs, "ids"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, then decoded."""
    return digests(table(spark, sf_dir, "documents"))
