"""IPv4 addresses as numbers, and the rules on which are rewritten."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
#: What may stand between a version word and its number, white space of any script included.
BETWEEN = r"""[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}:="']"""
#: A version word in the 20 characters before an address; what is before these is not looked at. {1,2}: a letter may be of two units.
VERSIONED = rf"(?i:(?<![\p{{L}}\p{{N}}]{{1,2}})ver(?:{BETWEEN}{{0,17}}|sion{BETWEEN}{{0,13}})|ver(?:{BETWEEN}{{17}}|sion{BETWEEN}{{13}}))"
#: Not after a version word, nor after a slash unless that ends a scheme or follows a digit.
CONTEXT = rf"(?=[1-9])(?<!{VERSIONED})(?:(?<!/)|(?<=://)|(?<=\p{{Nd}}{{1,2}}/))"
ADDRESS = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"
#: What every address holds. It begins with a digit before a dot, and so costs little in texts without addresses.
MAY_HOLD = r"\d\.\d{1,3}\.\d{1,3}\.\d"
TOKEN = rf"(?<![A-Za-z0-9.\-]){CONTEXT}({ADDRESS})(?![A-Za-z0-9.\-+])(?:/(\d{{1,2}}))?"
#: An address without regard to version words, prefixes and slashes; a match takes the characters beside it.
APART = rf"(^|[^A-Za-z0-9.\-])({ADDRESS})(\z|[^A-Za-z0-9.\-+])"

#: Pools of fakes by category, and the private networks that they stand for.
POOLS = {"public": "198.16.0.0/12", "priv10": "100.80.0.0/12", "priv172": "100.96.0.0/12", "priv192_168": "100.112.0.0/12", "linklocal": "100.79.0.0/16"}
PRIVATE = {"priv10": "10.0.0.0/8", "priv172": "172.16.0.0/12", "priv192_168": "192.168.0.0/16", "linklocal": "169.254.0.0/16"}
SAFE = ("127.0.0.0/8", "0.0.0.0/32", "255.255.255.255/32", "224.0.0.0/4", "255.0.0.0/8", "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")
NETMASKS = tuple(str(ipaddress.IPv4Network((0, p)).netmask) for p in range(8, 33))


def bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.IPv4Network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def number(address: Column) -> Column:
    """The address as a long."""
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long"))


def dotted(n: Column) -> Column:
    part = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def within(n: Column, *cidrs: str) -> Column:
    out = F.lit(False)
    for lo, hi in map(bounds, cidrs):
        out = out | n.between(lo, hi)
    return out


def category(n: Column) -> Column:
    """The pool of an address."""
    out = None
    for name, cidr in PRIVATE.items():
        out = F.when(within(n, cidr), name) if out is None else out.when(within(n, cidr), name)
    return out.otherwise("public")


def kept(n: Column, text: Column, private: bool = True, public: bool = True) -> Column:
    """Whether an address stays: special ones, netmasks, own fakes, and what the configuration leaves alone."""
    out = within(n, "0.0.0.0/8", "127.0.0.0/8", "224.0.0.0/4", *POOLS.values()) | text.isin("255.255.255.255", *NETMASKS)
    if not private:
        out = out | (category(n) != "public")
    if not public:
        out = out | (category(n) == "public")
    return out
