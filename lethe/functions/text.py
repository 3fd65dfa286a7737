"""Finding and rewriting matches with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, leftmost first."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def splice(text: Column, pattern: str, replacements: Callable[[Column], Column]) -> Column:
    """``text`` with its matches replaced: ``replacements`` maps the array of matches to an array of strings."""
    gaps = F.split(text, pattern, -1)
    new = replacements(find_all(text, pattern))
    return F.array_join(F.zip_with(gaps, new, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def mentions(text: Column, *words: str) -> Column:
    """Whether a text holds one of some lower-case words, in any case."""
    low = F.lower(text)
    return any_of(low.contains(w) for w in words)


def rewrite(text: Column, pattern: str, fake: Callable[[Column], Column], gate: Column | None = None) -> Column:
    """``text`` with every match m replaced by ``fake(m)``.

    gate: a test that costs little, and that all texts with a match pass; others
    are left alone unread.
    """
    out = splice(text, pattern, lambda hits: F.transform(hits, fake))
    return F.when(text.rlike(pattern) if gate is None else gate & text.rlike(pattern), out).otherwise(text)


def literal(value: str) -> str:
    """A Java pattern that matches exactly ``value``."""
    return "".join(c if c.isalnum() or c in "_" or ord(c) > 127 else f"\\{c}" for c in value)


def trie_pattern(values) -> str:
    """One pattern for many literals, with shared beginnings factored out; the longest match wins."""
    root: dict = {}
    for value in values:
        node = root
        for c in value:
            node = node.setdefault(c, {})
        node[""] = {}

    def emit(node: dict) -> str:
        branches = [literal(c) + emit(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + ("?" if "" in node else "")

    return emit(root)


def digest(value: Column, length: int = 12) -> Column:
    """The first hexadecimal digits of SHA-256: a fake's number that needs no coordination."""
    return F.substring(F.sha2(value, 256), 1, length)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
