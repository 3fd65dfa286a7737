"""Rewriting: mappings applied to texts in the order of the chain."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import entities as E
from ..functions import ipv4
from ..functions.text import literal, mentions, rewrite, splice, trie_pattern
from ..sources.tables import materialize
from . import contain
from .allocate import SubnetMap

#: Entries of a mapping that travel as a literal; larger ones are joined.
MOST_ENTRIES = 2_000
#: Names of a product that stay whole, and loopback names.
PRODUCT_NAMES = ("uyuni", "uyuni-server", "uyuni-db", "uyuni-hub-xmlrpc", "uyuni-hub", "uyuni-proxy", "uyuni-proxy-httpd",
                 "uyuni-proxy-salt-broker", "uyuni-proxy-squid", "uyuni-proxy-ssh", "uyuni-proxy-tftpd")
LOOPBACK_NAMES = ("localhost", "ipv6-localhost", "ipv6-loopback", "ipv6-localnet", "ipv6-mcastprefix", "ipv6-allnodes", "ipv6-allrouters",
                  "ipv6-allhosts", "ip6-localhost", "ip6-loopback", "ip6-localnet", "ip6-mcastprefix", "ip6-allnodes", "ip6-allrouters", "ip6-allhosts")
TOP_LIKE = ("com", "org", "net", "edu", "gov", "mil", "int", "arpa", "local", "lan", "internal", "corp", "intranet")


def lookup(mapping: Mapping[str, str]) -> Column:
    """A mapping as one literal column."""
    keys, values = list(mapping), list(mapping.values())
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(v) for v in values]))


def smallest(pairs) -> dict[str, str]:
    """A dictionary of pairs; of several values of a key, the smallest."""
    return dict(sorted(pairs, key=lambda kv: kv[1], reverse=True))


def by_dictionary(text: Column, mapping: Mapping[str, str], before: str = "", after: str = "", flags: str = "(?iu)", fold: bool = True, gate: Column | None = None) -> Column:
    """``text`` with the keys of ``mapping`` replaced where the boundaries allow; the longest key wins.

    fold: in any case; of keys that differ in case only, the smallest fake is taken.
    """
    if not mapping:
        return text
    table = smallest((k.lower() if fold else k, v) for k, v in mapping.items())
    pattern = f"{flags}{before}(?:{trie_pattern(table)}){after}"
    m = lookup(table)
    return rewrite(text, pattern, lambda hit: F.coalesce(F.try_element_at(m, F.lower(hit) if fold else hit), hit), gate)


def keywords(text: Column, mapping: Mapping[str, str]) -> Column:
    return by_dictionary(text, mapping)


def hostnames(text: Column, mapping: Mapping[str, str], preserve: tuple[str, ...] = ()) -> Column:
    """Host names by token; product names and ``preserve`` stay, and protect what they contain."""
    kept = {n.lower() for n in (*PRODUCT_NAMES, *LOOPBACK_NAMES, *preserve)}
    table = smallest((k.lower(), v) for k, v in mapping.items() if k.lower() not in kept)
    if not table:
        return text
    shield = trie_pattern([*PRODUCT_NAMES, *[p.lower() for p in preserve]])
    pattern = rf"(?iu)(?:(?<![A-Za-z0-9])(?:{shield})(?![A-Za-z0-9])|(?<![A-Za-z])(?:{trie_pattern(table)})(?![A-Za-z0-9]))"
    m = lookup(table)
    return rewrite(text, pattern, lambda hit: F.coalesce(F.try_element_at(m, F.lower(hit)), hit))


def usernames(text: Column, mapping: Mapping[str, str]) -> Column:
    return by_dictionary(text, mapping, r"\b", r"\b", "(?U)", fold=False)


def serials(text: Column, mapping: Mapping[str, str]) -> Column:
    return by_dictionary(text, mapping, flags="", fold=False)


def domains(text: Column, mapping: Mapping[str, str]) -> Column:
    """Dotted, underscored and DC= forms of domains, whole, by single label, and by cut label."""
    if not mapping:
        return text
    plain = smallest((k.lower(), v) for k, v in mapping.items())
    both = {k.replace(".", "_"): v.replace(".", "_") for k, v in plain.items()} | plain
    joined = text.rlike(r"[A-Za-z0-9][._][A-Za-z0-9]") if all(re.search(r"[A-Za-z0-9][._][A-Za-z0-9]", k) for k in both) else None
    out = by_dictionary(text, both, r"(?<![A-Za-z0-9-])", r"(?![A-Za-z0-9-])", gate=joined)
    parts = lambda t: mentions(t, "dc=")
    chain = lambda d: ",".join(f"DC={x}" for x in d.split("."))
    out = by_dictionary(out, {chain(k).lower(): chain(v) for k, v in plain.items()}, gate=parts(out))
    labels = smallest((k.split(".")[0], v.split(".")[0]) for k, v in plain.items())
    labels = {k: v for k, v in labels.items() if len(k) >= 4 and k not in TOP_LIKE}
    out = by_dictionary(out, {f"dc={k}": f"DC={v}" for k, v in labels.items()}, r"\b", r"\b", gate=parts(out))
    cut = smallest((f"dc={k[:n]}", f"DC={v}") for k, v in labels.items() for n in range(8, len(k)))
    return by_dictionary(out, cut, r"\b", r"(?![A-Za-z0-9-])", gate=parts(out))


def system_ids(text: Column, mapping: Mapping[str, str]) -> Column:
    """SAP<id>, <id>adm and bare ids in one pass, so that no fake is read again."""
    if not mapping:
        return text
    table = {}
    for k, v in mapping.items():
        table |= {f"SAP{k}": f"SAP{v}", f"{k.lower()}adm": f"{v.lower()}adm", k: v}
    ids = "|".join(map(literal, mapping))
    low = "|".join(literal(k.lower()) + "adm" for k in mapping)
    pattern = rf"SAP(?:{ids})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:{low}|{ids})(?![A-Za-z0-9])"
    m = lookup(table)
    return rewrite(text, pattern, lambda hit: F.coalesce(F.try_element_at(m, hit), hit))


def addresses(text: Column, subnets: SubnetMap, private: bool = True, public: bool = True) -> Column:
    """IPv4 addresses by their networks' fakes, prefix lengths kept. Only matches go to Python."""
    import ipaddress

    stays = [ipaddress.IPv4Network(n) for n in ("0.0.0.0/8", "127.0.0.0/8", "224.0.0.0/4", *subnets.pools.values())]
    masks = {*ipv4.NETMASKS, "255.255.255.255"}
    private_nets = {k: ipaddress.IPv4Network(v) for k, v in ipv4.PRIVATE.items()}
    lengths = subnets.lengths()

    def one(hit: str) -> str:
        head, slash, prefix = hit.partition("/")
        ip = ipaddress.IPv4Address(head)
        pool = next((k for k, n in private_nets.items() if ip in n), "public")
        if head in masks or any(ip in n for n in stays) or (slash and int(prefix) == 0) or not (public if pool == "public" else private):
            return hit
        return f"{ipaddress.IPv4Address(subnets.fake(int(ip), pool, lengths))}{slash}{prefix}"

    @F.pandas_udf("array<string>")
    def run(hits: pd.Series) -> pd.Series:
        return hits.map(lambda x: [one(t) for t in x])

    may = text.rlike(ipv4.MAY_HOLD)
    safe = F.when(may, text).otherwise(F.lit(""))  # the full pattern, and Python, see only texts that may have an address in them
    return F.when(may, splice(safe, ipv4.TOKEN, run)).otherwise(text)


def by_mapping(files: DataFrame, entity: E.Entity, mapping: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """``files`` with an entity's values replaced by ``mapping`` (real, fake); unmapped values stay.

    A mapping of up to ``most`` entries (counted) becomes a literal. A larger one
    is joined: matches leave their texts, meet their fakes, and come back.
    """
    head = mapping.select("real", "fake").limit(most + 1).collect()
    if len(head) <= most:
        if not head:
            return files
        m = lookup({r.real: r.fake for r in head})
        return files.withColumn("text", entity.apply(F.col("text"), lambda v: F.coalesce(F.try_element_at(m, v), v)))
    hits = F.regexp_extract_all("text", F.lit(entity.pattern), F.lit(0))
    own = F.md5("text").alias("own")  # a path may occur twice; rows of one path and text are the same row
    each = files.filter(F.col("text").rlike(entity.pattern)).select("path", own, F.posexplode(hits).alias("i", "hit"))
    each = each.withColumn("real", entity.value_of(F.col("hit")))
    if entity.keep:
        each = each.withColumn("real", F.when(~entity.keep(F.col("real")), F.col("real")))
    met = each.join(mapping.select("real", "fake"), "real", "left").withColumn("new", F.coalesce(entity.replaced(F.col("hit"), F.col("fake")), "hit"))
    back = met.groupBy(F.col("path").alias("of_path"), "own").agg(F.array_sort(F.collect_set(F.struct("i", "new"))).alias("new"))
    gaps = F.split("text", entity.pattern, -1)
    joined = files.join(back, F.col("path").eqNullSafe(F.col("of_path")) & (F.md5("text") == F.col("own")), "left")
    out = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new"), i)["new"], F.lit("")))), "")
    return joined.withColumn("text", F.when(F.col("new").isNotNull(), out).otherwise(F.col("text"))).drop("new", "of_path", "own")


# --- the same for mappings that are tables: names meet texts by a join, however many there are ---

#: A pass: entries (real, fake, kind), the boundaries of each kind, flags of these, and whether case doesn't matter.
Pass = tuple[DataFrame, Sequence[tuple[str, str]], str, bool]


def by_names(files: DataFrame, entries: DataFrame, boundaries: Sequence[tuple[str, str]] = (("", ""),), flags: str = "", fold: bool = False, text: str = "text") -> DataFrame:
    """``files`` with the reals of ``entries`` replaced by their fakes, as by_dictionary() does: leftmost, then of the lowest kind, then longest.

    entries: real, fake (null: it stays, and protects what it contains) and kind, a place in ``boundaries``. All places of all
    names are found and tested; those of a text then come together, and what
    overlaps is settled in one go from the left. The result is written once.
    """
    own = files.withColumn("_own", F.md5(text))  # a path may occur twice; rows of one path and text are the same row
    found = contain.occurrences(own, entries.select(F.col("real").alias("value")), ("path", "_own"), text, fold)
    hits = found.join(entries, F.col("value") == F.col("real"))
    fits = reduce(lambda w, k: w.when(F.col("kind") == k, contain.bounded(*boundaries[k], flags)), range(1, len(boundaries)),
                  F.when(F.col("kind") == 0, contain.bounded(*boundaries[0], flags)))
    each = F.struct("start", F.col("kind").cast("int").alias("kind"), (-F.col("size")).alias("less"), "fake")
    of = hits.filter(fits).groupBy(F.col("path").alias("_path"), F.col("_own").alias("_of")).agg(F.array_sort(F.collect_set(each)).alias("_hits"))
    joined = own.join(of, F.col("path").eqNullSafe(F.col("_path")) & (F.col("_own") == F.col("_of")), "left").drop("_path", "_of", "_own")
    return materialize(_spliced(joined, text), "names").select(*files.columns)


def _spliced(files: DataFrame, text: str) -> DataFrame:
    """``files`` with ``_hits`` (start, kind, -size, fake, in this order) put in place of what they cover."""
    columns = [c for c in files.columns if c != "_hits"]
    schema = T.StructType([files.schema[c] for c in columns])
    at, hits_at = columns.index(text), files.columns.index("_hits")

    def one(whole: str | None, hits: list[dict] | None) -> str | None:
        if whole is None or not hits:
            return whole
        out, end = [], 0
        for h in hits:
            if h["start"] >= end:
                here, end, last = h["start"], h["start"] - h["less"], end
                out += (whole[last:here], whole[here:end] if h["fake"] is None else h["fake"])
        return "".join((*out, whole[end:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([one(t.as_py(), h.as_py()) for t, h in zip(batch.column(at), batch.column(hits_at))], batch.schema.field(at).type)
            rest = [batch.column(k) for k in range(batch.num_columns) if k != hits_at]
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(rest)], columns)

    return files.mapInArrow(run, schema)


def _entries(table: DataFrame, real, fake, kind: int = 0) -> DataFrame:
    return table.select(real.alias("real"), fake.alias("fake"), F.lit(kind).alias("kind"))


def keyword_passes(table: DataFrame) -> list[Pass]:
    return [(_entries(table, F.col("real"), F.col("fake")), [("", "")], "", True)]


def hostname_passes(table: DataFrame, preserve: tuple[str, ...] = ()) -> list[Pass]:
    """Kept names come first where both could stand, and stay."""
    kept = [n.lower() for n in (*PRODUCT_NAMES, *preserve)]
    own = table.filter(~F.lower("real").isin(*kept, *LOOPBACK_NAMES))
    shield = table.sparkSession.createDataFrame([(n,) for n in kept], "real string")
    return [(_entries(shield, F.col("real"), F.lit(None).cast("string")).unionAll(_entries(own, F.col("real"), F.col("fake"), 1)),
             [("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"), ("(?<![A-Za-z])", "(?![A-Za-z0-9])")], "", True)]


def username_passes(table: DataFrame, boundaries: tuple[str, str] = (r"\b", r"\b")) -> list[Pass]:
    """boundaries: before and after a name; by default those of words in any script."""
    return [(_entries(table, F.col("real"), F.col("fake")), [boundaries], "(?U)", False)]


def serial_passes(table: DataFrame) -> list[Pass]:
    return [(_entries(table, F.col("real"), F.col("fake")), [("", "")], "", False)]


def domain_passes(table: DataFrame) -> list[Pass]:
    """Dotted and underscored forms; DC= chains; single labels; cut labels."""
    real, fake = F.lower("real"), F.col("fake")
    dotted = _entries(table, real, fake).unionAll(_entries(table, F.replace(real, F.lit("."), F.lit("_")), F.replace(fake, F.lit("."), F.lit("_"))))
    chain = lambda c: F.concat(F.lit("DC="), F.replace(c, F.lit("."), F.lit(",DC=")))
    first = table.select(F.substring_index(real, ".", 1).alias("label"), F.substring_index(fake, ".", 1).alias("f")).groupBy("label").agg(F.min("f").alias("f"))
    first = first.filter((F.char_length("label") >= 4) & ~F.col("label").isin(*TOP_LIKE))
    label = F.concat(F.lit("dc="), "label")
    new = F.concat(F.lit("DC="), "f")
    cut = first.filter(F.char_length("label") > 8).withColumn("n", F.explode(F.sequence(F.lit(8), F.char_length("label") - 1)))
    return [(dotted, [("(?<![A-Za-z0-9-])", "(?![A-Za-z0-9-])")], "", True), (_entries(table, chain(real), chain(fake)), [("", "")], "", True),
            (_entries(first, label, new), [(r"\b", r"\b")], "", True),
            (_entries(cut, F.concat(F.lit("dc="), F.left(F.col("label"), F.col("n"))), new), [(r"\b", "(?![A-Za-z0-9-])")], "", True)]


def system_id_passes(table: DataFrame) -> list[Pass]:
    """SAP<id>, <id>adm and bare ids in one pass, so that no fake is read again."""
    real, fake = F.col("real"), F.col("fake")
    marked = _entries(table, F.concat(F.lit("SAP"), real), F.concat(F.lit("SAP"), fake))
    bare = _entries(table, real, fake, 1).unionAll(_entries(table, F.concat(F.lower("real"), F.lit("adm")), F.concat(F.lower("fake"), F.lit("adm")), 1))
    return [(marked.unionAll(bare), [("", "(?![A-Za-z0-9])"), ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])")], "", False)]


def in_passes(files: DataFrame, passes: Sequence[Pass], text: str = "text") -> DataFrame:
    """``files`` after several passes of by_names()."""
    return reduce(lambda df, p: by_names(df, *p, text=text), passes, files)
