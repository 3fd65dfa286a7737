"""Domains: extraction with parents, and hierarchical fakes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mentions
from ..sources.tables import materialize
from .discover import numbered

#: A word with a dot in it, and what follows of labels and dots. Flat, so that a match's length costs no depth.
CHUNK = r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++\.[A-Za-z0-9.-]+"
DC_CHAIN = r"(?i)(DC=[A-Za-z0-9-]++(?:,DC=[A-Za-z0-9-]++)++)"
#: A name has 253 characters at most.
MOST_LABELS = 127
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
# Generic and country top-level names.
TOP_NAMES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "arpa", "io", "co", "biz", "info", "name", "mobi", "tel", "cat", "jobs", "pro",
    "aero", "coop", "museum", "travel", "cloud", "tech", "dev", "app", "ai", "online", "digital", "global", "email", "zone", "host",
    "data", "software", "asia", "xxx", "post", "box", "local", "lan", "internal", "home", "corp", "intranet", "us", "eu", "uk",
    "ac", "ad", "ae", "af", "ag", "al", "am", "ao", "ar", "at", "au", "az", "ba", "bb", "bd", "be", "bf", "bg", "bh", "bi", "bj", "bm",
    "bn", "bo", "br", "bs", "bt", "bw", "by", "bz", "ca", "cd", "cf", "cg", "ch", "ci", "ck", "cl", "cm", "cn", "cr", "cu", "cv", "cy",
    "cz", "de", "dj", "dk", "dm", "do", "dz", "ec", "ee", "eg", "er", "es", "et", "fi", "fj", "fo", "fr", "ga", "gd", "ge", "gh", "gm",
    "gn", "gr", "gt", "gw", "gy", "hk", "hn", "hr", "ht", "hu", "id", "ie", "il", "in", "iq", "ir", "is", "it", "jm", "jo", "jp", "ke",
    "kg", "kh", "km", "kn", "kp", "kr", "kw", "kz", "la", "lb", "lc", "li", "lk", "lr", "ls", "lt", "lu", "lv", "ly", "ma", "mc", "md",
    "me", "mg", "mk", "ml", "mm", "mn", "mr", "mt", "mu", "mv", "mw", "mx", "my", "mz", "na", "ne", "ng", "ni", "nl", "no", "np", "nr",
    "nz", "om", "pa", "pe", "ph", "pk", "pl", "pt", "pw", "py", "qa", "ro", "rs", "ru", "rw", "sa", "sb", "sc", "sd", "se", "sg", "si",
    "sk", "sl", "sm", "sn", "so", "sr", "ss", "st", "sv", "sy", "sz", "td", "tg", "th", "tj", "tl", "tm", "tn", "to", "tr", "tt", "tv",
    "tz", "ua", "ug", "uy", "uz", "va", "vc", "ve", "vn", "vu", "ws", "ye", "za", "zm", "zw")


def _label(x: Column) -> Column:
    """Whether a word of letters, digits and hyphens is a label."""
    return (x != "") & (F.length(x) <= 63) & ~x.startswith("-") & ~x.endswith("-")


def _known(domain: Column, trusted: bool) -> Column:
    """Whether labels end in a top-level name, or are at least no IPv4 address. trusted: the top-level name may be any."""
    return ~domain.rlike(IPV4) if trusted else F.substring_index(domain, ".", -1).isin(*TOP_NAMES)


def _names(chunk: Column) -> Column:
    """The longest stretches of two labels or more in a chunk."""
    labels = F.transform(F.split(chunk, r"\."), lambda x: F.when(_label(x), x).otherwise(""))
    return F.filter(F.transform(F.split(F.array_join(labels, "."), r"\.\.+"), lambda d: F.btrim(d, F.lit("."))), lambda d: d.contains("."))


def parents(domain: Column) -> Column:
    """A domain and its parents of two labels or more. Names have at most MOST_LABELS labels; of longer chains, the last so many count."""
    labels = F.split(F.substring_index(domain, ".", -MOST_LABELS), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def may_hold(text: Column) -> Column:
    """A test that costs little, and that all texts with a domain pass."""
    return text.rlike(r"[A-Za-z0-9-]\.[A-Za-z0-9-]") | mentions(text, "dc=")


def domains_in(text: Column, trusted: bool = False) -> Column:
    """Valid domains in a text and their valid parents, lower-cased, as often as they occur."""
    plain = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), lambda c: _names(F.lower(c))))
    chains = F.when(F.lower(text).contains("dc="), F.transform(
        F.regexp_extract_all(text, F.lit(DC_CHAIN), F.lit(1)), lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"(?i)\bDC=", "")), ",", ".")))
    chains = F.filter(F.coalesce(chains, F.array().cast("array<string>")), lambda d: F.forall(F.split(d, r"\."), _label))
    known = F.filter(F.concat(plain, chains), lambda d: _known(d, trusted))
    out = F.flatten(F.transform(known, parents))
    return F.filter(out, lambda d: _known(d, trusted)) if trusted else out  # a parent ends as its child does


def extract(files: DataFrame, trusted: bool = False, text: str = "text", key: str = "path") -> DataFrame:
    """path, pos, real: the domains of every file."""
    dotted = files.filter(may_hold(F.col(text)))
    return dotted.select(F.col(key).alias("path"), F.posexplode(domains_in(F.col(text), trusted)).alias("pos", "real"))


def tld_name(n: int) -> str:
    """Three letters for a counter."""
    return "".join(chr(97 + n // k % 26) for k in (676, 26, 1))


def hierarchy(seen: DataFrame, known: DataFrame | None = None, tlds: dict[str, str] | None = None) -> DataFrame:
    """real, fake, labels: domain_N.<fake top-level name> for a domain without a mapped parent, sub_K.<parent's fake> below one.

    seen: real, first_path, first_pos. Numbers follow (labels, path, pos, value).
    Domains come in levels of labels; each level joins the one above it, or a
    domain of ``known`` (real, fake), whose rows are not given again; numbers go on
    after those of ``known``. tlds: fake top-level names by real ones; new ones are added.
    """
    tlds, spark = {} if tlds is None else tlds, seen.sparkSession
    old = spark.createDataFrame([], "real string, fake string") if known is None else known.select("real", "fake")
    seen = seen.select("real", "first_path", "first_pos").join(old, "real", "left_anti")
    labels = F.size(F.split("real", r"\."))
    d = materialize(seen.select("real", "first_path", "first_pos", labels.alias("labels")), "domains-seen")
    d = d.withColumn("parent", F.regexp_replace("real", r"^[^.]*\.", ""))
    above = d.select("real").unionByName(old.select("real")).select(F.col("real").alias("parent"), F.lit(True).alias("below")).distinct()
    d = d.join(above, "parent", "left").withColumn("below", F.coalesce("below", F.lit(False)))
    order, rows = ["labels", "first_path", "first_pos", "real"], d.count()
    last = old.agg(*[F.max(F.expr(f"try_cast(regexp_extract(fake, '^{kind}_([0-9]+)[.]', 1) as long)")).alias(kind) for kind in ("domain", "sub")]).first()
    taken = {kind: 0 if last[kind] is None else last[kind] + 1 for kind in ("domain", "sub")}
    tops = d.filter(~F.col("below")).withColumn("tld", F.substring_index("real", ".", -1))
    by_tld = tops.groupBy("tld").agg(F.min(F.struct(*order)).alias("m"))  # at most as many as there are valid or trusted top-level names
    for r in by_tld.filter(~F.col("tld").isin(list(tlds))).orderBy("m").select("tld").toLocalIterator():
        tlds[r.tld] = tld_name(len(tlds))
    fakes = spark.createDataFrame(list(tlds.items()), "tld string, t string")
    tops = numbered(tops, taken["domain"], order, rows).join(fakes, "tld")
    tops = tops.select("real", F.concat(F.lit("domain_"), F.col("number").cast("string"), F.lit("."), "t").alias("fake"), "labels")
    depth = max(0, (d.agg(F.max("labels")).first()[0] or 0) - 1)
    subs = numbered(d.filter("below"), taken["sub"], order, rows).select("real", "parent", "labels", F.col("number").alias("n"))
    levels, above = [tops], tops.select("real", "fake").unionByName(old)
    for _ in range(depth):
        above = subs.join(above.select(F.col("real").alias("parent"), F.col("fake").alias("up")), "parent").select(
            "real", F.concat(F.lit("sub_"), F.col("n").cast("string"), F.lit("."), "up").alias("fake"), "labels")
        levels.append(above)
    return reduce(DataFrame.unionByName, levels)
