"""Serial IPv6 networks: against a search one by one, mixed lengths, known networks, and rewriting."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lethe.functions import ipv6
from lethe.operators import networks6 as N


def frame(spark, *texts):
    return spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "path string, text string")


def searched(nets, taken=()):
    """Fakes of networks in order, each at the first aligned place from a cursor on that overlaps none."""
    held, cursor, out = list(taken), {}, {}
    for net in nets:
        pool = N.POOLS[N.pool_of(net.prefixlen)]
        step, at = 1 << (128 - net.prefixlen), cursor.get(pool, 0)
        while True:
            place = ipaddress.IPv6Network((int(pool.network_address) + at // step * step, net.prefixlen))
            if not any(place.overlaps(h) for h in held):
                break
            at += step
        held.append(place)
        cursor[pool] = int(place.network_address) - int(pool.network_address) + step
        out[net] = place
    return out


def known(networks):
    return {ipaddress.IPv6Network((r.net, r.prefixlen)): ipaddress.IPv6Network((r.fake, r.prefixlen)) for r in networks.table.collect()}


def test_one_length_gets_the_places_of_a_search(spark):
    rng = random.Random(1)
    nets = [ipaddress.IPv6Network((0x2600 << 112 | rng.getrandbits(40) << 64, 64)) for _ in range(60)]
    files = frame(spark, *[f"at {n.network_address + rng.getrandbits(60)} and {n.network_address + 7}" for n in nets])
    got = N.allocate(N.tokens(files))
    assert known(got) == searched(nets) and got.cursor == {"narrow": 60 << 64}


@pytest.mark.parametrize("seed", range(3))
def test_mixed_lengths_are_aligned_and_apart(spark, seed):
    rng = random.Random(seed)
    lengths = [32, 48, 52, 56, 64, 64, 80, 127, 128]
    files = frame(spark, *[f"{ipaddress.IPv6Address(0x2600 << 112 | rng.getrandbits(100))}/{rng.choice(lengths)}" for _ in range(50)])
    first = N.allocate(N.tokens(files))
    more = frame(spark, *[f"{ipaddress.IPv6Address(0x2A00 << 112 | rng.getrandbits(100))}/{rng.choice(lengths)}" for _ in range(40)], *[r.text for r in files.limit(5).collect()])
    again = N.Networks.from_json(first.to_json(), spark)
    assert known(again) == known(first) and again.cursor == first.cursor
    second = N.allocate(N.tokens(more), again)
    both = known(second)
    assert {k: both[k] for k in known(first)} == known(first) and len(both) == 90
    fakes = sorted(both.values(), key=lambda n: int(n.network_address))
    assert all(int(a.broadcast_address) < int(b.network_address) for a, b in zip(fakes, fakes[1:]))
    for real, fake in both.items():
        assert real.prefixlen == fake.prefixlen >= 48 and fake.subnet_of(N.POOLS[N.pool_of(real.prefixlen)])


def test_rewriting_keeps_offsets_lengths_and_ports(spark):
    text = "a 2600:1f16:aaa:bbb:1:2:3:4/64 b 2600:1f16:aaa:bbb::9 c ::1 fe80::1 [AF_INET6]2600:1f16::5:1194 d 2600:1f16:aaa:bbb:1:2:3:4:443 12:30:45 e 2a00:1:2::/40 2a00:1:2::1"
    files = frame(spark, text, None, "", "none", text)
    out, networks = N.rewrite_serial(files)
    rows = {r.path: r.text for r in out.collect()}
    got = rows["000"].split()
    assert rows["000"] == rows["004"] and rows["001"] is None and rows["002"] == "" and rows["003"] == "none"
    assert got[1] == "2001:db8:0:1:1:2:3:4/64" and got[3] == "2001:db8:0:1::9" and got[5:7] == ["::1", "fe80::1"]
    assert got[7] == "[AF_INET6]2001:db8::5:1194" and got[9] == "2001:db8:0:1:1:2:3:4:443" and got[10] == "12:30:45"
    assert got[12] == "fd00::/40" and got[13] == "fd00::1"
    assert len(known(networks)) == 3


def test_a_full_pool_is_an_error(spark, monkeypatch):
    monkeypatch.setitem(N.POOLS, "narrow", ipaddress.IPv6Network("2001:db8::/63"))
    files = frame(spark, *[f"2600:0:0:{i:x}::1" for i in range(1, 4)])
    with pytest.raises(N.PoolFull):
        N.allocate(N.tokens(files))
    assert N.allocate(N.tokens(files.limit(2))).cursor == {"narrow": 2 << 64}


def test_without_addresses_there_are_no_networks(spark):
    out, networks = N.rewrite_serial(frame(spark, "nothing at 12:30:45", None))
    assert networks.table.count() == 0 and out.count() == 2 and networks.to_json() == {"ipv6_subnet": {}, "state": {}}
    assert N.parsed("fd00::1") is None and N.parsed("fd00::1", True) is not None and ipv6.replace("zz") == "zz"
