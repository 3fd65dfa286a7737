"""IPv6 addresses: strict parsing in Arrow batches of matches, never of whole texts."""

from __future__ import annotations

import hashlib
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import splice

CANDIDATE = r"(?<![A-Za-z0-9:_-])([0-9A-Fa-f:.]*(?:[0-9A-Fa-f]|::))(?:/(\d{1,3}))?(?![A-Za-z0-9_-])(?!:[0-9A-Fa-f])"
#: What every address holds: two colons side by side, or groups between six colons.
MAY_HOLD = r":(?::|(?:[0-9A-Fa-f]{1,4}:){5})"
TAGGED = r"(\[AF_INET6\])([0-9A-Fa-f:]+):(\d{1,5})\b"
# Scopes and pools of fakes.
POOL_WIDE, POOL_NARROW = ipaddress.IPv6Network("fd00::/8"), ipaddress.IPv6Network("2001:db8::/32")
UNSPECIFIED, LOOPBACK, MULTICAST = (ipaddress.IPv6Network(n) for n in ("::/128", "::1/128", "ff00::/8"))
LINK_LOCAL, LOCAL, GLOBAL = (ipaddress.IPv6Network(n) for n in ("fe80::/10", "fc00::/7", "2000::/3"))


def stays(ip: ipaddress.IPv6Address, private: bool) -> bool:
    """Whether an address is out of scope, or a fake already."""
    if ip in UNSPECIFIED or ip in LOOPBACK or ip in MULTICAST or ip in POOL_NARROW:
        return True
    if ip in LINK_LOCAL or ip in LOCAL:
        return not private
    return ip not in GLOBAL


def fake(ip: ipaddress.IPv6Address, prefixlen: int | None = None) -> ipaddress.IPv6Address:
    """The fake of an address: its network's hash block in a pool, offset kept."""
    anchor = max(48, prefixlen) if prefixlen is not None else 64
    net = ipaddress.IPv6Network((int(ip) >> (128 - anchor) << (128 - anchor), anchor))
    pool = POOL_WIDE if anchor <= 48 else POOL_NARROW
    slots = 1 << (anchor - pool.prefixlen)
    slot = int(hashlib.blake2b(str(net).encode(), digest_size=8).hexdigest(), 16) % slots
    return ipaddress.IPv6Address(int(pool.network_address) + (slot << (128 - anchor)) + int(ip) - int(net.network_address))


def replace(token: str, private: bool = False) -> str:
    """What stands for one match: its fake, with its prefix length or port, or the match itself."""
    head, slash, prefix = token.partition("/")
    body, _, port = head.rpartition(":")
    colons = head.count(":")
    try:
        if "::" not in head and "." not in head and colons == 8 and port.isdigit() and int(port) <= 65535:
            ip = ipaddress.IPv6Address(body)
            return token if stays(ip, private) else f"{fake(ip)}:{port}"
        if "::" not in head and colons != 7 and not (colons == 6 and "." in head):
            return token
        ip = ipaddress.IPv6Address(head)
        length = int(prefix) if slash else None
        if length is not None and length > 128 or stays(ip, private):
            return token
        return f"{fake(ip, length)}{slash}{prefix}"
    except ValueError:
        return token


def replace_tagged(token: str, private: bool = False) -> str:
    """As replace(), for [AF_INET6]address:port."""
    address, _, port = token[len("[AF_INET6]"):].rpartition(":")
    try:
        ip = ipaddress.IPv6Address(address)
    except ValueError:
        return token
    return token if stays(ip, private) else f"[AF_INET6]{fake(ip)}:{port}"


def rewrite(text: Column, private: bool = False) -> Column:
    """``text`` with IPv6 addresses replaced. Only matches go to Python."""
    def by(one):
        @F.pandas_udf("array<string>")
        def run(hits: pd.Series) -> pd.Series:
            return hits.map(lambda x: [one(t, private) for t in x])
        return run

    tagged, plain = by(replace_tagged), by(replace)
    may = text.rlike(MAY_HOLD)
    safe = F.when(may, text).otherwise(F.lit(""))  # the full patterns, and Python, see only texts that may hold an address
    first = splice(safe, TAGGED, tagged)
    # A tagged fake and its port must not be read as one address again: they end in the pool and stay.
    return F.when(may, splice(first, rf"(?<!\[AF_INET6\]){CANDIDATE}", plain)).otherwise(text)
