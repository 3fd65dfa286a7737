"""Allocation: a consistent fake for every distinct real value."""

from __future__ import annotations

import hashlib
import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import ipv4
from ..sources.tables import materialize
from .discover import FEW_ROWS, first_seen, networks, numbered

#: Smallest block that a network takes in its pool, as a prefix length.
SLOT = 24


def hash_mapping(found: DataFrame, which=E.PATTERN_ENTITIES) -> DataFrame:
    """category, real, fake, first_path, first_pos from candidates, by hash fakes; the first kind to see a value names it."""
    fake = None
    for e in which:
        fake = F.when(F.col("kind") == e.name, e.hash_fake(F.col("real"))) if fake is None else fake.when(F.col("kind") == e.name, e.hash_fake(F.col("real")))
    order = {e.name: i for i, e in enumerate(which)}
    rank = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    kinds = found.groupBy("category", "real").agg(F.min_by("kind", rank).alias("kind"))
    return first_seen(found, "category", "real").join(kinds, ["category", "real"]).select("category", "real", fake.alias("fake"), "first_path", "first_pos")


def serial_mapping(found: DataFrame, form, start: int = 1, rows: int | None = None) -> DataFrame:
    """real, fake, first_path, first_pos: fakes numbered by first sight. form: (real, number as string) to a fake. rows: as in numbered()."""
    seen = numbered(first_seen(found, "real"), start, rows=rows)
    return seen.select("real", form(F.col("real"), F.col("number").cast("string")).alias("fake"), "first_path", "first_pos")


def mac_number(number: Column) -> Column:
    """The colon form of a counter, for serial fakes of hardware addresses; beyond 24 bits it goes on behind a colon, and is never cut."""
    n = number.cast("long")
    h = F.substring(F.hex(n.bitwiseAND(F.lit(0xFFFFFF)) + F.lit(1 << 24)), 2, 6)
    low = F.concat_ws(":", F.lit(E.MAC_OUI), F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2))
    return F.when(n < 1 << 24, low).otherwise(F.concat(low, F.lit(":"), F.hex(F.shiftright(n, 24))))


@dataclass
class SubnetMap:
    """Real networks and their fakes, with the pools' cursors. Bounded: a pool of /12 has 4,096 blocks."""

    pools: dict[str, str] = field(default_factory=lambda: dict(ipv4.POOLS))
    nets: dict[tuple[int, int], int] = field(default_factory=dict)  # (real network, prefix length): fake network
    used: dict[str, set[int]] = field(default_factory=dict)
    cursor: dict[str, int] = field(default_factory=dict)
    infer: int = 24

    def allocate(self, real: int, prefixlen: int, pool: str) -> int | None:
        """The fake network of a real one; None once its pool is full."""
        key = (real, prefixlen)
        if key in self.nets:
            return self.nets[key]
        space = ipaddress.IPv4Network(self.pools[pool])
        blocks = 1 << max(0, SLOT - space.prefixlen)
        need = 1 << max(0, SLOT - max(prefixlen, space.prefixlen))
        used, at = self.used.setdefault(pool, set()), self.cursor.get(pool, 0)
        for k in range(0, blocks, need):
            slot = (at + k + need - 1) // need * need % blocks
            if not any(s in used for s in range(slot, slot + need)):
                used.update(range(slot, slot + need))
                self.cursor[pool] = slot + need
                self.nets[key] = int(space.network_address) + (slot << (32 - SLOT))
                return self.nets[key]
        return None

    def full(self, pool: str) -> bool:
        """Whether no block of a pool is left."""
        return len(self.used.get(pool, ())) >= 1 << max(0, SLOT - ipaddress.IPv4Network(self.pools[pool]).prefixlen)

    def lengths(self) -> list[int]:
        """The prefix lengths of the real networks, longest first."""
        return sorted({p for _, p in self.nets}, reverse=True)

    def fake(self, address: int, pool: str, lengths: list[int] | None = None) -> int:
        """The fake of an address: the longest known network, offset kept; else its pool's hash block."""
        for p in self.lengths() if lengths is None else lengths:
            real = address >> (32 - p) << (32 - p)
            if (real, p) in self.nets:
                space = ipaddress.IPv4Network(self.pools[pool])
                return self.nets[real, p] + (address - real) % (1 << (32 - max(p, space.prefixlen)))
        space = ipaddress.IPv4Network(self.pools[pool])
        head = ".".join(str(address >> k & 255) for k in (24, 16, 8))
        slots = 1 << max(0, SLOT - space.prefixlen)
        return int(space.network_address) + (int(hashlib.md5(head.encode()).hexdigest()[:8], 16) % slots << 8) + (address & 255)

    def rows(self) -> list[tuple[str, str]]:
        """(real, fake) in prefix notation, most specific first."""
        text = lambda n, p: f"{ipaddress.IPv4Address(n)}/{p}"
        return [(text(r, p), text(f, p)) for (r, p), f in sorted(self.nets.items(), key=lambda kv: (-kv[0][1], kv[0][0]))]

    def state(self) -> dict[str, int]:
        return {f"pool_cursor_{k}": v for k, v in self.cursor.items()}


def allocate_subnets(found: DataFrame, private: bool = True, public: bool = True, known: SubnetMap | None = None) -> SubnetMap:
    """Networks of ipv4_candidates(): written ones by first sight, then the /24s of addresses outside them.

    The fold runs on the driver, network by network. Every pool is folded on its
    own, and only until no block of the smallest size is left in it: whatever
    comes after would find it full, and takes a hash block.
    """
    out = known or SubnetMap()
    _fold(out, networks(found, private).withColumn("plen", F.col("prefixlen")), ["first_path", "first_pos", "real_net", "prefixlen"])
    rest = found.filter(~ipv4.kept(F.col("address"), F.col("real"), private, public) & (F.coalesce("prefixlen", F.lit(1)) != 0))
    if out.nets:
        spark = found.sparkSession
        nets = spark.createDataFrame([(p, n, 0) for n, p in out.nets], "prefixlen int, real_net long, fake_net long")
        inside = longest_prefix(rest.select("address").distinct(), nets, sorted({p for _, p in out.nets})).filter(F.col("prefixlen").isNotNull())
        rest = rest.join(inside.select("address"), "address", "left_anti")
    bits = 32 - out.infer
    inferred = first_seen(rest.withColumn("real_net", F.shiftleft(F.shiftright("address", bits), bits)), "real_net")
    _fold(out, inferred.withColumn("category", ipv4.category(F.col("real_net"))).withColumn("plen", F.lit(out.infer)), ["first_path", "first_pos", "real_net"])
    return out


def _fold(out: SubnetMap, nets: DataFrame, order: list[str]) -> None:
    """Allocate ``nets`` (real_net, plen, category) in order, pool by pool."""
    nets = materialize(nets, "subnets-first")
    held = {r.category: r["count"] for r in nets.groupBy("category").count().collect()}  # at most one for each pool
    if sum(held.values()) <= FEW_ROWS:
        for r in nets.orderBy(*order).select("real_net", "plen", "category").collect():
            out.allocate(r.real_net, r.plen, r.category)
        return
    for pool in out.pools.keys() & held.keys():
        for r in nets.filter(F.col("category") == pool).orderBy(*order).select("real_net", "plen").toLocalIterator():
            if out.full(pool):
                break
            out.allocate(r.real_net, r.plen, pool)


def subnet_table(found: DataFrame) -> DataFrame:
    """The closed form for addresses without written networks: real_net, category, fake_net, for each inferred /24."""
    rows = found.filter(~ipv4.kept(F.col("address"), F.col("real")))
    seen = first_seen(rows.withColumn("real_net", F.shiftleft(F.shiftright("address", 8), 8)), "real_net").withColumn("category", ipv4.category(F.col("real_net")))
    own = numbered(seen.withColumn("real", F.col("real_net").cast("string")), 0, ["category", "first_path", "first_pos", "real"])
    first = own.groupBy("category").agg(F.min("number").alias("least"))  # a row for each pool
    base = F.element_at(F.create_map(*[F.lit(x) for pool, cidr in ipv4.POOLS.items() for x in (pool, ipv4.bounds(cidr)[0])]), F.col("category"))
    return own.join(F.broadcast(first), "category").select("real_net", "category", (base.cast("long") + (F.col("number") - F.col("least")) * 256).alias("fake_net"))


def longest_prefix(addresses: DataFrame, nets: DataFrame, prefixes: list[int]) -> DataFrame:
    """``addresses`` (with a long ``address``) and real_net, prefixlen, fake_net of the longest network of
    ``nets`` that holds them; null where none does. prefixes: the lengths that occur in ``nets``."""
    tries = F.array(*[F.struct(F.lit(p).alias("prefixlen"), F.shiftleft(F.shiftright("address", 32 - p), 32 - p).alias("real_net")) for p in prefixes])
    each = addresses.select("address").distinct().select("address", F.explode(tries).alias("t")).select("address", "t.*")
    hit = each.join(nets, ["prefixlen", "real_net"]).groupBy("address").agg(F.max(F.struct("prefixlen", "real_net", "fake_net")).alias("best"))
    return addresses.join(hit, "address", "left").select(*addresses.columns, "best.prefixlen", "best.real_net", "best.fake_net")
