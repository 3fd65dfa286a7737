"""ipv4_discover leaves out what stands after version words and slashes, as the reference does, and so does its SQL."""

import random
import re

import pytest

from lethe.plans import catalogue

from .support import assert_matches

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
CIDR = re.compile(rf"(?<![A-Za-z0-9.\-])({OCTET}(?:\.{OCTET}){{3}})(?![A-Za-z0-9.\-+])(?:/[0-9]{{1,2}})?")
FOUND = {
    "zu ver 42.244.84.203 und Version: 8.8.4.4 hat 9.9.9.9": ["9.9.9.9"],
    "10.1.2.3 10.1.2.4,10.1.2.5": ["10.1.2.3", "10.1.2.4", "10.1.2.5"],  # one character between two values
    "a/1.1.1.1 /2.2.2.2 //3.3.3.3 http://4.4.4.4 24/5.5.5.5": ["4.4.4.4", "5.5.5.5"],
    "/1.1.1.1": [], "//1.1.1.1": [], "://1.1.1.1": ["1.1.1.1"], "1.1.1.0/24": ["1.1.1.0"],
    "1.1.1.1/2.2.2.2/3.3.3.3": ["1.1.1.1", "3.3.3.3"],  # the second one's first digit is read as a prefix
    "0.1.1.1/2.2.2.2/3.3.3.3 ver 4.4.4.4/5.5.5.5": ["2.2.2.2", "5.5.5.5"],  # what is left alone takes no prefix
    "db_ver=\"1.1.1.1 VERSION='2.2.2.2 driver 3.3.3.3 äver 4.4.4.4 verä 5.5.5.5 versions 6.6.6.6": ["3.3.3.3", "4.4.4.4", "5.5.5.5", "6.6.6.6"],
    "version:\u00a01.1.1.1 version\u20282.2.2.2 ver\x1c3.3.3.3 ver\u200b4.4.4.4": ["4.4.4.4"],
    "ver" + " " * 17 + "1.1.1.1": [], "ver" + " " * 18 + "1.1.1.1": ["1.1.1.1"], "version" + " " * 13 + "1.1.1.1": [], "version" + " " * 14 + "1.1.1.1": ["1.1.1.1"],
    "server" + " " * 16 + "1.1.1.1": ["1.1.1.1"], "server" + " " * 17 + "1.1.1.1": [],  # only 20 characters are looked at
    "٣/1.1.1.1 \U0001d7cf/1.1.1.2 \U0001d400/1.1.1.3 x\U0001d400ver 2.2.2.2 \U0001f600ver 3.3.3.3": ["1.1.1.1", "1.1.1.2", "2.2.2.2"],
    "1.1.1.1+ 2.2.2.2. 3.3.3.3\n": ["3.3.3.3"], "": [],
}


def read(text: str) -> list[str]:
    """Addresses by the reference's rules, one after the other; but what is left alone takes no prefix."""
    out, at = [], 0
    while m := CIDR.search(text, at):
        before = text[max(0, m.start() - 20):m.start()].lower()
        left = m[1].startswith("0.") or re.search(r"(?:\b|_)ver(?:sion)?[\s:=\"']*$", before.rstrip())
        left = left or before.endswith("/") and not before.endswith("://") and not before[-2:-1].isdigit()
        out += [] if left else [m[1]]
        at = m.end(1) if left else m.end()
    return out


def made(k: int) -> str:
    pick = random.Random(k)
    address = lambda: ".".join(str(pick.choice((0, 1, 9, 10, 99, 255, 256))) for _ in range(4))
    words = ["ver", "version", "Ver", "VERSION", "server", "_ver", "äver", "x", "http:", "12", "٣", "+", "-", ".", "/", "//", "://", ":", "=", '"', "'", "_", "\n", "\u00a0", "\x0b", "\u2003", "\U0001d400", "\U0001d7cf", "\U0001f600"]
    parts = []
    for _ in range(pick.randint(1, 12)):
        parts.append(address() if pick.random() < 0.4 else " " * pick.choice((1, 1, 9, 13, 16, 17)) if pick.random() < 0.3 else pick.choice(words))
    return "".join(parts)


def table(spark, folder, rows) -> str:
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def values(rows) -> dict[str, list[str]]:
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.pos)):
        out.setdefault(r.path, []).append(r.real)
    return out


@pytest.mark.parametrize("name", ["listed", "made"])
def test_context_of_addresses(spark, tmp_path, name):
    wanted = list(FOUND.items()) if name == "listed" else [(t, read(t)) for t in map(made, range(3_000))]
    where = table(spark, tmp_path, [(k, t) for k, (t, _) in enumerate(wanted)] + [(len(wanted), None)])
    got = catalogue.ipv4_discover(spark, where)
    assert values(got.collect()) == {f"{k:020d}": w for k, (_, w) in enumerate(wanted) if w}
    assert_matches(got, where, catalogue.ORACLE_SQL["ipv4_discover"])


def test_listed_texts_are_read_alike():
    assert {t: read(t) for t in FOUND} == FOUND


def test_documents_of_one_id_are_numbered_apart(spark, tmp_path):
    where = table(spark, tmp_path, [(1, "1.1.1.1 2.2.2.2"), (1, "3.3.3.3"), (None, "4.4.4.4 5.5.5.5")])
    assert assert_matches(catalogue.ipv4_discover(spark, where), where, catalogue.ORACLE_SQL["ipv4_discover"]) == 5
