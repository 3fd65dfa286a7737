"""Many names, long texts, long numbers: what must not depend on how much there is."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lethe import engine
from lethe.functions import entities as E
from lethe.operators import allocate, contain, domains, names, rewrite, verify
from lethe.sources import files as S
from lethe.sources import sinks
from lethe.sources.config import Config

ALPHABET = "abAB \n-éÉ\U0001F600K.x"


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


# --- places of many values ---

@pytest.mark.parametrize("fold", [False, True])
def test_places_equal_a_search_for_each_value(spark, fold):
    rng = random.Random(1)
    rows = [(f"f{i}", "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80)))) for i in range(50)] + [("n", None), ("e", "")]
    values = sorted({"".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 9))) for _ in range(300)})
    form = contain.folded if fold else str
    expected = []
    for path, text in rows:
        text = form(text or "")
        for v in values:
            key, i = form(v), text.find(form(v))
            while i >= 0:
                expected.append((path, i, len(key), text[:i].count("\n"), v, text[i - 1] if i else "", text[i + len(key):i + len(key) + 1]))
                i = text.find(key, i + 1)
    found = contain.occurrences(frame(spark, rows).repartition(3), spark.createDataFrame([(v,) for v in [*values, "", None]], "value string"), fold=fold)
    assert sorted((r.path, r.start, r.size, r.inner_line, r.value, r.before, r.after) for r in found.collect()) == sorted(expected)


def test_no_values_have_no_places(spark):
    none = spark.createDataFrame([], "value string")
    assert contain.occurrences(frame(spark, [("a", "text")]), none).count() == 0


def test_leaks_anywhere_need_no_product(spark):
    rng = random.Random(2)
    serials = [f"SERIAL-{rng.randrange(10**9):09d}" for _ in range(5_000)]
    lines = [f"line {i} with {rng.choice(serials) if i % 7 == 0 else 'nothing'}x and more" for i in range(700)]
    texts = frame(spark, [(f"{i:02}", "\n".join(lines[i * 70:i * 70 + 70])) for i in range(10)])
    mapping = spark.createDataFrame([("serial", s, "SERIAL_1") for s in serials], "category string, real string, fake string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = verify.mapping_leaks(verify.lines_of(texts), mapping)
        identity = verify.identity_leaks(verify.lines_of(texts), mapping.select(F.lower("real").alias("value")))
        for df in (found, identity):
            plan = df._jdf.queryExecution().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
        expected = {(f"{i // 70:02}", i % 70 + 1, s) for i, line in enumerate(lines) for s in re.findall(r"SERIAL-\d{9}", line)}
        assert {(r.file, r.line, r.value) for r in found.collect() if r.category == "serial/UUID"} == expected
        assert {(r.file, r.line, r.value.upper()) for r in identity.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- names without a limit ---

TEXTS = [
    ("a", "Alpha beta-gamma ALPHA alphabet web.corp.io x.WEB.corp.io. corp_io DC=corp,DC=io dc=megacompany dc=megacomp uyuni-server server"),
    ("b", "user bob, bobby a.bob bob_x é-bob; SN 4C4C-XYZ 4C4C-XYZ9 QX1 SAPQX1 qx1adm QX12 SAPQX1_ HA1 (QX1)"), ("c", None), ("d", ""), ("a", "Alpha again"), ("a", "Alpha again"),
    ("e", "alphaalpha beta beta-gamma-delta 2024web01 DAA_web01 web012 myserver \U0001F600bob\U0001F600")]
NAMES = {
    "keyword": {"alpha": "keyword_1", "Beta": "keyword_2", "beta-gamma": "keyword_3", "ALPHA": "keyword_9"},
    "hostname": {"server": "hostname_0", "web01": "hostname_1", "web": "hostname_2", "beta": "hostname_3"},
    "domain": {"corp.io": "domain_0.aaa", "web.corp.io": "sub_0.domain_0.aaa", "megacompany.local": "domain_1.aab", "megacorp.io": "domain_2.aaa"},
    "user": {"bob": "user_0", "bobby": "user_1", "é": "user_2"}, "serial": {"4C4C-XYZ": "SERIAL_1"}, "sid": {"QX1": "HA1", "HA1": "HA2"}}
STEPS = {"keyword": (rewrite.keywords, rewrite.keyword_passes), "hostname": (rewrite.hostnames, rewrite.hostname_passes), "domain": (rewrite.domains, rewrite.domain_passes),
         "user": (rewrite.usernames, rewrite.username_passes), "serial": (rewrite.serials, rewrite.serial_passes), "sid": (rewrite.system_ids, rewrite.system_id_passes)}


def both_ways(spark, category, mapping, files):
    by_pattern, by_table = STEPS[category]
    table = spark.createDataFrame(list(mapping.items()), "real string, fake string")
    one = files.withColumn("text", by_pattern(F.col("text"), mapping))
    other = rewrite.in_passes(files, by_table(table))
    assert other.columns == files.columns
    return [sorted(map(tuple, df.collect()), key=str) for df in (one, other)]


@pytest.mark.parametrize("category", sorted(NAMES))
def test_tables_rewrite_as_patterns_do(spark, category):
    one, other = both_ways(spark, category, NAMES[category], frame(spark, TEXTS).repartition(2))
    assert one == other and any(NAMES[category][k].split(".")[0] in str(r) for k in NAMES[category] for r in other)


@pytest.mark.parametrize("category", ["keyword", "user", "hostname"])
def test_tables_rewrite_random_texts_as_patterns_do(spark, category):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB_-1 .é") for _ in range(n))
    mapping = {w: f"N{i}" for i, w in enumerate(sorted({word(rng.randint(1, 4)).strip() for _ in range(60)} - {""}))}
    one, other = both_ways(spark, category, mapping, frame(spark, [(str(i), word(60)) for i in range(60)]))
    assert one == other


def test_a_chain_with_tables_equals_one_with_patterns(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    logs = "\n".join(f"session opened for user person{i}x\nnfs: server files{i}y.lab{i % 9}.corp.io down" for i in range(40))
    files = frame(spark, [("a", logs), ("b", " ".join(f"person{rng.randrange(50)}x at files{rng.randrange(50)}y.lab{i % 12}.corp.io" for i in range(60))), ("c", None)])
    config = Config(obfuscate_private_ip=True)
    small = engine.learn(files, config, from_text=True, keywords=["down"])
    monkeypatch.setattr(engine, "MOST_NAMES", 5)
    large = engine.learn(files, config, from_text=True, keywords=["down"])
    assert not small.tables and set(large.tables) == {"domain", "hostname", "user"}
    assert {c: {r.real: r.fake for r in t.collect()} for c, t in large.tables.items()} == {c: small.names[c] for c in large.tables}
    with pytest.raises(KeyError):
        large.category("user")
    texts = [sorted((r.path, r.text, r.changed) for r in engine.apply(files, m, config).collect()) for m in (small, large)]
    assert texts[0] == texts[1] and "person1x" not in texts[0][0][1]
    path = sinks.save_mapping(large, str(tmp_path / "m.json"))
    again = sinks.load_mapping(path, spark=spark)
    assert {c: t.count() for c, t in again.tables.items()} == {c: t.count() for c, t in large.tables.items()}
    with pytest.raises(ValueError):
        sinks.save_mapping(large, str(tmp_path / "n.json"), "secret")
    more = engine.learn(frame(spark, [("z", "session opened for user person1x\nsession opened for user newcomer")]), config, again, {"user": ["seeded"]}, from_text=True)
    users = {r.real: r.fake for r in more.tables["user"].collect()}
    assert users["person1x"] == small.names["user"]["person1x"] and users["seeded"] == "user_40" and users["newcomer"] == "user_41" and len(users) == 42
    assert engine.mapping_table(files, large, config).filter("category = 'user'").count() == 40


# --- texts of any length, for every pattern ---

REPEATS = 100_000
LONG = {
    "labels": ("a." * REPEATS + "com", lambda t: domains.domains_in(t)), "dc": ("DC=a," * REPEATS + "DC=b", lambda t: F.regexp_extract_all(t, F.lit(domains.DC_CHAIN), F.lit(1))),
    "chunks": ("a." * REPEATS + "com", lambda t: F.regexp_extract_all(t, F.lit(domains.CHUNK), F.lit(0))),
    "names": ("CN=ab," * REPEATS, lambda t: F.regexp_extract_all(t, F.lit(verify.DISTINGUISHED), F.lit(0))),
    "mixed": ("CN=" + "a\U0001F600" * REPEATS + ",OU=bb,DC=cc", lambda t: F.regexp_extract_all(t, F.lit(verify.DISTINGUISHED), F.lit(0))),
    "realm": ("user@AB" + ".CD" * REPEATS, lambda t: F.regexp_extract_all(t, F.lit(verify.PRINCIPAL), F.lit(0))),
    "serial": ("\n" * REPEATS + "Serial Number: ABC123", lambda t: F.regexp_extract_all(t, F.lit(names.SERIAL), F.lit(2)))}
LONG |= {f"entity {e.name}": ("a.b@" * REPEATS, e.apply) for e in E.PATTERN_ENTITIES}
LONG |= {f"secret {name}": ("eyJ-----BEGIN " * REPEATS, lambda t, p=p: F.regexp_extract_all(t, F.lit(p), F.lit(0))) for p, name in verify.SECRETS}
LONG |= {f"log {i}": ("pam_unix(" * REPEATS, lambda t, p=p: F.regexp_extract_all(t, F.lit(p), F.lit(1))) for i, p in enumerate(names.LOG_PATTERNS) if not p.startswith("pam")}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts_pass_every_pattern(spark, name):
    text, expression = LONG[name]
    assert frame(spark, [("a", text)]).select(expression(F.col("text"))).count() == 1
    frame(spark, [("a", text)]).select(expression(F.col("text"))).collect()


def test_verification_passes_long_lines(spark):
    texts = ["word." * REPEATS + "com", "CN=ab," * REPEATS + "x", "u@AB" + ".CD" * REPEATS]
    found = verify.verify(frame(spark, list(zip("abc", texts))), spark.createDataFrame([("domain", "corp.io", "x"), ("serial", "123456", "y")], "category string, real string, fake string"))
    assert {r.category for r in found.collect()} >= {"LDAP DN"}


@pytest.mark.parametrize("text,expected", [
    ("a.b-.c.com", ["c.com"]), ("x.-a.b.com", ["b.com"]), ("..a.com..b.org.", ["a.com", "b.org"]), ("a" * 64 + ".b.com", ["b.com"]), ("A.Com-", []), ("x.y.com-z", []), ("q_a.com", ["a.com"]),
    ("one.two.three.de", ["one.two.three.de", "two.three.de", "three.de"]), ("1.2.3.4 5.6.7.com", ["5.6.7.com", "6.7.com", "7.com"]), ("DC=a,DC=-b DC=lab,DC=de", ["lab.de"])])
def test_domains_as_written(spark, text, expected):
    assert frame(spark, [("a", text)]).select(domains.domains_in(F.col("text"))).first()[0] == expected


# --- keys and numbers are never cut ---

def test_numbers_keep_their_digits(spark):
    numbers = spark.range(1, 1_002).select(names.system_id_fake(F.lit(""), F.col("id").cast("string")).alias("f"))
    assert numbers.distinct().count() == 1_001 and numbers.first()[0] == "HA1"
    assert [r[0] for r in spark.createDataFrame([(9,), (10,), (99,), (100,)], "id long").select(names.system_id_fake(F.lit(""), F.col("id").cast("string"))).collect()] == ["HA9", "H10", "H99", "H100"]
    macs = spark.createDataFrame([((1 << 24) - 1,), (1 << 24,), ((1 << 24) + 1,), (1,)], "n long").select(allocate.mac_number(F.col("n"))).collect()
    assert len({r[0] for r in macs}) == 4 and macs[3][0] == "00:1A:2B:00:00:01"


def test_long_and_negative_keys_stay_apart(spark):
    keys = [1234567890121, 1234567890122, 9223372036854775807, -9223372036854775808, -5, 5, None]
    name = lambda k: f"k{k}".replace("-", "minus")
    files = S.from_table(spark.createDataFrame([(k, f"mail {name(k)}@corp.io and bb@corp.io") for k in keys], "doc_id long, text string"), "doc_id")
    assert len({r.path for r in files.collect()}) == len(keys)
    mapping = spark.createDataFrame([("bb@corp.io", "B")] + [(f"{name(k)}@corp.io", f"F{k}") for k in keys], "real string, fake string")
    for most in (0, 1_000):
        got = sorted(r.text for r in rewrite.by_mapping(files, E.EMAIL_ENTITY, mapping, most).collect())
        assert got == sorted(f"mail F{k} and B" for k in keys)


def test_rows_of_one_path_stay_apart(spark):
    files = frame(spark, [("a", "x1@corp.io"), ("a", "no x1@corp.io x2@corp.io"), ("a", "x1@corp.io"), (None, "x2@corp.io")])
    mapping = spark.createDataFrame([("x1@corp.io", "A"), ("x2@corp.io", "B")], "real string, fake string")
    assert sorted(r.text for r in rewrite.by_mapping(files, E.EMAIL_ENTITY, mapping, 0).collect()) == ["A", "A", "B", "no A B"]
