"""Serial fakes of IPv6 networks: numbered by first sight, without a hash and without a table in the driver.

An address belongs to the network that is written with it, no wider than /48, to
a written or known one that holds it, or to its /64.  Networks of a pool are laid out one after the other, the widest
lengths first, by first sight within a length: sizes are powers of two, so that
each starts where the one before ends, aligned and apart from all others.  A
network's place is then the count of those before it, which needs no search for
a gap.  What comes later goes on behind what is known, from an aligned place.
Networks of one length get the places that a search one by one would give them.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import ipv6
from ..sources.tables import materialize
from .discover import first_seen, numbered
from .rewrite import by_mapping

POOLS = {"wide": ipv6.POOL_WIDE, "narrow": ipv6.POOL_NARROW}
#: Matches as they stand in texts. Tagged ones go first; what they become ends in a pool, and stays.
TAGGED = E.Entity("ipv6_tagged", "ipv6", ipv6.TAGGED, lambda v, n: v, 0, ("[AF_INET6]",))
PLAIN = E.Entity("ipv6", "ipv6", rf"(?<!\[AF_INET6\]){ipv6.CANDIDATE}", lambda v, n: v, 0)
NETWORKS = "net string, prefixlen int, fake string"


class PoolFull(ValueError):
    pass


def pool_of(prefixlen: int) -> str:
    return "wide" if prefixlen <= 48 else "narrow"


def parsed(token: str, private: bool = False) -> tuple[ipaddress.IPv6Address, int | None, str, str] | None:
    """The address of a match, its prefix length, and what stands before and after it; None for what is no address or stays."""
    before, rest = ("[AF_INET6]", token[len("[AF_INET6]"):]) if token.startswith("[AF_INET6]") else ("", token)
    head, slash, prefix = rest.partition("/")
    body, _, port = head.rpartition(":")
    colons = head.count(":")
    try:
        if before or ("::" not in head and "." not in head and colons == 8 and port.isdigit() and int(port) <= 65535):
            ip, length, after = ipaddress.IPv6Address(body), None, f":{port}"
        elif "::" not in head and colons != 7 and not (colons == 6 and "." in head):
            return None
        else:
            ip, length, after = ipaddress.IPv6Address(head), int(prefix) if slash else None, f"{slash}{prefix}"
    except ValueError:
        return None
    if length is not None and length > 128 or ipv6.stays(ip, private):
        return None
    return ip, length, before, after


def network_of(ip: ipaddress.IPv6Address, prefixlen: int) -> str:
    return str(ipaddress.IPv6Address(int(ip) >> (128 - prefixlen) << (128 - prefixlen)))


@dataclass
class Networks:
    """Known networks (net, prefixlen, fake: all without a length), and the first free offset in each pool."""

    table: DataFrame | None = None
    cursor: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> dict:
        """ipv6_subnet: real to fake, in prefix notation; state: the cursors. Networks pass one partition at a time."""
        rows = [] if self.table is None else self.table.orderBy("prefixlen", "net").toLocalIterator()
        return {"ipv6_subnet": {f"{r.net}/{r.prefixlen}": f"{r.fake}/{r.prefixlen}" for r in rows},
                "state": {f"ipv6_cursor_{k}": v for k, v in self.cursor.items()}}

    @classmethod
    def from_json(cls, data: Mapping, spark) -> Networks:
        rows = [(*real.split("/"), fake.split("/")[0]) for real, fake in data.get("ipv6_subnet", {}).items()]
        table = spark.createDataFrame([(n, int(p), f) for n, p, f in rows], NETWORKS) if rows else None
        return cls(table, {k.removeprefix("ipv6_cursor_"): int(v) for k, v in data.get("state", {}).items() if k.startswith("ipv6_cursor_")})


def tokens(files: DataFrame, private: bool = False) -> DataFrame:
    """path, pos, token, ip, anchor (the length of its own network), written (whether that is given), net, before, after: the addresses that get a fake."""
    text = F.col("text")
    hits = F.when(text.rlike(ipv6.MAY_HOLD), F.concat(TAGGED.values(text), PLAIN.values(text)))
    rows = files.select("path", F.posexplode(hits).alias("pos", "token"))

    @F.pandas_udf("ip string, anchor int, written boolean, net string, before string, after string")
    def parse(token: pd.Series) -> pd.DataFrame:
        out = []
        for t in token:
            if (p := parsed(t, private)) is None:
                out.append((None,) * 6)
            else:
                anchor = 64 if p[1] is None else max(48, p[1])
                out.append((str(p[0]), anchor, p[1] is not None, network_of(p[0], anchor), p[2], p[3]))
        return pd.DataFrame(out, columns=["ip", "anchor", "written", "net", "before", "after"]).astype({"anchor": "Int32", "written": "boolean"})

    return rows.withColumn("p", parse("token")).filter(F.col("p.ip").isNotNull()).select("path", "pos", "token", "p.*")


def _above(lengths: list[int]):
    """A function of a column of addresses: the networks of these lengths that hold them."""
    @F.pandas_udf("array<struct<net:string,prefixlen:int>>")
    def nets(ip: pd.Series) -> pd.Series:
        return ip.map(lambda a: [{"net": network_of(ipaddress.IPv6Address(a), p), "prefixlen": p} for p in lengths])

    return nets


def _lengths(nets: DataFrame) -> list[int]:
    return sorted(r.prefixlen for r in nets.select("prefixlen").distinct().collect())  # at most one for each length


def allocate(found: DataFrame, known: Networks | None = None) -> Networks:
    """``known`` and a fake for each further network (path, pos, net, anchor, written) of ``found``."""
    known = known or Networks()
    seen = materialize(first_seen(found.withColumnRenamed("anchor", "prefixlen"), "net", "prefixlen", "written").drop("n"), "networks6-seen")
    held = seen.filter("written").select("net", "prefixlen")
    held = (held if known.table is None else held.unionByName(known.table.select("net", "prefixlen"))).distinct()
    own = seen.filter("not written")
    inside = own.select("net", F.explode(_above(_lengths(held))("net")).alias("a")).join(held.select(F.struct("net", "prefixlen").alias("a")), "a").select("net")
    seen = seen.filter("written").unionByName(own.join(inside, "net", "left_anti")).drop("written")
    if known.table is not None:
        seen = seen.join(known.table.select("net", "prefixlen"), ["net", "prefixlen"], "left_anti")
    ranked = materialize(numbered(seen, 0, ["prefixlen", "first_path", "first_pos", "net"]), "networks6-ranked")
    lengths = ranked.groupBy("prefixlen").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("least")).orderBy("prefixlen").collect()  # at most one for each length
    cursor, bases = dict(known.cursor), {}
    for r in lengths:
        pool, step = pool_of(r.prefixlen), 1 << (128 - r.prefixlen)
        at = -(-cursor.get(pool, 0) // step) * step  # only the first length of a pool has to skip anything
        bases[r.prefixlen] = int(POOLS[pool].network_address) + at - r.least * step
        cursor[pool] = at + r.n * step
        if cursor[pool] > POOLS[pool].num_addresses:
            raise PoolFull(f"{POOLS[pool]} has no room for {r.n} networks of length {r.prefixlen}")

    @F.pandas_udf("string")
    def fake(prefixlen: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([str(ipaddress.IPv6Address(bases[p] + n * (1 << (128 - p)))) for p, n in zip(prefixlen.tolist(), number.tolist())], dtype=object)

    new = ranked.select("net", "prefixlen", fake("prefixlen", "number").alias("fake"))
    table = materialize(new if known.table is None else known.table.select("net", "prefixlen", "fake").unionByName(new), "networks6")
    return Networks(table, cursor)


def mapping(found: DataFrame, networks: Networks) -> DataFrame:
    """real (a match as it is written) and fake, by the longest network that holds its address."""
    own = found.select("token", "ip", "before", "after").distinct()

    @F.pandas_udf("string")
    def moved(ip: pd.Series, net: pd.Series, fake: pd.Series) -> pd.Series:
        number = lambda a: int(ipaddress.IPv6Address(a))
        return pd.Series([str(ipaddress.IPv6Address(number(f) + number(i) - number(n))) for i, n, f in zip(ip, net, fake)], dtype=object)

    each = own.select("*", F.inline(_above(_lengths(networks.table))("ip")))
    met = each.join(networks.table, ["net", "prefixlen"]).groupBy("token", "ip", "before", "after").agg(F.max(F.struct("prefixlen", "net", "fake")).alias("b"))
    return met.select(F.col("token").alias("real"), F.concat("before", moved("ip", "b.net", "b.fake"), "after").alias("fake"))


def rewrite_serial(files: DataFrame, private: bool = False, known: Networks | None = None) -> tuple[DataFrame, Networks]:
    """``files`` with serial fakes of IPv6 addresses, prefix lengths and ports kept, and all networks."""
    found = materialize(tokens(files, private), "tokens6")
    networks = allocate(found, known)
    pairs = materialize(mapping(found, networks), "mapping6")
    return by_mapping(by_mapping(files, TAGGED, pairs), PLAIN, pairs), networks
