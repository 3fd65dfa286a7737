"""The whole run: discover, allocate, rewrite, verify.

``learn`` reads the corpus once for each source of knowledge and freezes a
``Mapping``; ``apply`` is a narrow pass that uses it, the same in batch and in
streams; ``run`` does both and verifies.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping as MappingType
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entities as E
from .functions import ipv6
from .functions.text import basename
from .operators import allocate, discover, domains, names, rewrite, verify
from .operators.allocate import SubnetMap
from .sources.config import Config
from .sources.tables import materialize

HEADER = "#" + "-" * 93 + "\n# INFO: sensitive data was removed from this file. Review before sharing.\n#" + "-" * 93 + "\n\n"
#: Most names of a category that travel as a pattern; more are a table, and meet the texts by a join.
MOST_NAMES = 5_000
#: file: headers of the sections from which domains are learned; those in TRUSTED may have any top-level name.
DOMAIN_SECTIONS = {
    "network.txt": ("# /etc/hosts", "# /etc/resolv.conf", "# /bin/nmcli", "# /usr/bin/nmcli"), "nfs.txt": ("# /bin/egrep",),
    "ntp.txt": ("# /etc/ntp.conf", "# /etc/chrony.conf"), "sssd.txt": ("# /etc/sssd/sssd.conf",)}
TRUSTED = ("# /etc/hosts", "# /etc/resolv.conf")
USER_FILES = ("messages.txt", "security-apparmor.txt", "sssd.txt")
STEPS = ("ip", "ipv6", "mac", "keyword", "email", "hostname", "domain", "ldap_dn", "user", "password", "cloud_token", "serial", "sid")


def split_seeds(value: str | None) -> list[str]:
    """Names of a comma-, semicolon- or space-separated list; no empty ones."""
    return [x for x in re.split(r"[,\s;]+", value or "") if x]


@dataclass
class Mapping:
    """Frozen knowledge: dictionaries by category, or tables (real, fake) where they are large, networks, and the seeds that came with it."""

    names: dict[str, dict[str, str]] = field(default_factory=dict)  # domain, hostname, user, keyword, serial, sid
    subnets: SubnetMap = field(default_factory=SubnetMap)
    tld_map: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)  # of categories that are in no dictionary

    def category(self, name: str) -> dict[str, str]:
        """A category's dictionary; of one that is a table there is none."""
        if name in self.tables:
            raise KeyError(f"{name} is a table of more than {MOST_NAMES} names")
        return self.names.setdefault(name, {})

    def known(self, name: str, spark: SparkSession) -> DataFrame:
        """A category's names as real, fake."""
        return self.tables[name] if name in self.tables else spark.createDataFrame(list(self.names.get(name, {}).items()), "real string, fake string")

    def hold(self, name: str, found: DataFrame) -> None:
        """Add ``found`` (real, fake) to a category, in the order of the numbers in its fakes."""
        held = self.names.setdefault(name, {})
        rows = [] if name in self.tables else found.select("real", "fake").limit(MOST_NAMES + 1 - len(held)).collect()
        if name not in self.tables and len(rows) + len(held) <= MOST_NAMES:
            number = lambda r: int("0" + "".join(re.findall(r"\d+", r.fake)[:1]))
            rows.sort(key=lambda r: (r.fake.count("."), number(r), r.real))
            held |= {r.real: r.fake for r in rows}
        else:
            self.tables[name] = materialize(found.select("real", "fake"), f"names-{name}").unionByName(self.known(name, found.sparkSession))
            self.names[name] = {}

    def size(self, name: str) -> int:
        return self.tables[name].count() if name in self.tables else len(self.names.get(name, {}))


def _extend(out: Mapping, category: str, found: DataFrame, form, start: int, seeds: list[str] = ()) -> None:
    """Add ``seeds``, and then what ``found`` has besides, numbered by first sight."""
    spark = found.sparkSession
    out.names.setdefault(category, {})
    known = out.known(category, spark)
    any_known, own = category in out.tables or bool(out.names[category]), list(dict.fromkeys(seeds))  # seeds are what the caller passed
    if own and any_known:
        given = spark.createDataFrame([(s, i) for i, s in enumerate(own)], "real string, i long").join(known, "real", "left_anti")
        own = [r.real for r in given.orderBy("i").collect()]
    for s, n in zip(own, range(out.size(category) + start, 1 << 62)):
        fake = spark.range(1).select(form(F.lit(s), F.lit(str(n)))).first()[0]
        if category in out.tables:
            out.hold(category, spark.createDataFrame([(s, fake)], "real string, fake string"))
        else:
            out.names.setdefault(category, {})[s] = fake
    if any_known or own:
        found = found.join(out.known(category, spark).select("real"), "real", "left_anti")
    new = materialize(found.select("real", "path", "pos"), f"new-{category}")
    if rows := new.count():
        out.hold(category, allocate.serial_mapping(new, form, out.size(category) + start, rows))


def _named(prefix: str):
    return lambda _, n: F.concat(F.lit(prefix), n)


def learn(files: DataFrame, config: Config | None = None, known: Mapping | None = None, seeds: MappingType[str, list[str]] | None = None,
          keywords: list[str] = (), from_text: bool | None = None) -> Mapping:
    """What is to be replaced in ``files`` (path, text).

    from_text: names come from all texts, and not from the sections of a system
    report. By default, texts serve where no file is a report's (basic-environment.txt).
    """
    config, known, seeds = config or Config(), known or Mapping(), seeds or {}
    if from_text is None:
        from_text = files.filter(basename(F.col("path")) == "basic-environment.txt").isEmpty()
    out = Mapping({k: dict(v) for k, v in known.names.items()}, copy.deepcopy(known.subnets), dict(known.tld_map), dict(known.tables))
    out.subnets.pools, out.subnets.infer = config.pools, config.default_infer_prefixlen
    parts = discover.sections(files)
    seen_in_texts = materialize(names.in_texts(files), "learned") if from_text else None  # one pass for all categories
    of = lambda category: seen_in_texts.filter(F.col("category") == category).select("path", "pos", "real")
    if config.obfuscate_private_ip or config.obfuscate_public_ip:
        addresses = discover.ipv4_parsed(of("ip").withColumnRenamed("real", "hit")) if from_text else discover.ipv4_candidates(files)
        allocate.allocate_subnets(addresses, config.obfuscate_private_ip, config.obfuscate_public_ip, out.subnets)
    if config.obfuscate_domain:
        if from_text:
            found = of("domain")
        else:
            wanted = discover.any_of((basename(F.col("path")) == f) & F.col("header").isin(*h) for f, h in DOMAIN_SECTIONS.items())
            own = parts.filter(wanted).withColumn("line", F.substring_index("line", "#", 1))
            found = domains.extract(own.filter(F.col("header").isin(*TRUSTED)), True, "line").unionByName(
                domains.extract(own.filter(~F.col("header").isin(*TRUSTED)), False, "line"))
        seen = discover.first_seen(found, "real").drop("n")
        if given := seeds.get("domain"):
            extra = files.sparkSession.createDataFrame([(d.lower().strip("."),) for d in given], "d string").select(F.explode(domains.parents(F.col("d"))).alias("real"))
            seen = discover.first_seen(found.unionByName(extra.select(F.lit("").alias("path"), F.lit(0).alias("pos"), "real")), "real").drop("n")
        out.names.setdefault("domain", {})
        seen = materialize(seen, "domains-found")
        if not seen.isEmpty():
            out.hold("domain", domains.hierarchy(seen, out.known("domain", files.sparkSession), out.tld_map))
    if config.obfuscate_hostname:
        found = names.hosts_found(of("nfs"), of("log")) if from_text else names.hosts_from_sections(parts.filter(basename(F.col("path")).contains("network.txt")))
        found = found.filter(~F.lower("real").isin(*config.preserve)) if config.preserve else found
        _extend(out, "hostname", found, _named("hostname_"), 0, seeds.get("hostname", []))
    if config.obfuscate_username:
        if from_text:
            found = names.users_found(of("user"))
        else:
            found = names.users_from_text(files.filter(basename(F.col("path")).isin(*USER_FILES)))
            found = names.users_from_sections(parts.filter(basename(F.col("path")).contains("pam.txt"))).unionByName(found)
        _extend(out, "user", found, _named("user_"), 0, seeds.get("user", []))
    none = files.sparkSession.createDataFrame([], "path string, pos int, real string")
    _extend(out, "keyword", none, _named("keyword_"), 1, [k.lower() for k in keywords if k.strip()])
    if config.obfuscate_serial:
        found = of("serial").filter(~names.skipped_serial(F.col("real"))) if from_text else names.serials_in(files.filter(names.in_serial_files(F.col("path"))))
        _extend(out, "serial", found, names.serial_fake, 1)
    found = of("sid").filter(~F.col("real").isin(*names.RESERVED_IDS)) if from_text else names.system_ids_in(files.filter(names.in_id_files(F.col("path"))))
    _extend(out, "sid", found, names.system_id_fake, 1)
    return out


def rewritten(text: Column, path: Column, mapping: Mapping, config: Config | None = None) -> list[tuple[str, Column | list[rewrite.Pass]]]:
    """The chain: (step, its expression over a column ``text``, or its passes over a table of names), in order.

    Steps that the configuration closes are absent.
    """
    config = config or Config()
    file = basename(path)
    steps: dict[str, Column | list[rewrite.Pass]] = {}

    def named(category: str, by_pattern, by_table, *more):
        return by_table(mapping.tables[category], *more) if category in mapping.tables else by_pattern(text, mapping.category(category), *more)

    if config.obfuscate_private_ip or config.obfuscate_public_ip:
        steps["ip"] = rewrite.addresses(text, mapping.subnets, config.obfuscate_private_ip, config.obfuscate_public_ip)
    if config.obfuscate_ipv6:
        steps["ipv6"] = ipv6.rewrite(text, config.obfuscate_private_ip)
    if config.obfuscate_mac:
        steps["mac"] = F.when(file.isin(*E.MAC_SKIP_FILES), text).otherwise(E.MAC_ENTITY.apply(text))
    steps["keyword"] = named("keyword", rewrite.keywords, rewrite.keyword_passes)
    steps["email"] = E.EMAIL_ENTITY.apply(text)
    if config.obfuscate_hostname:
        steps["hostname"] = named("hostname", rewrite.hostnames, rewrite.hostname_passes, config.preserve)
    if config.obfuscate_domain:
        steps["domain"] = named("domain", rewrite.domains, rewrite.domain_passes)
    steps["ldap_dn"] = E.apply_ldap(text)
    if config.obfuscate_username:
        steps["user"] = named("user", rewrite.usernames, rewrite.username_passes)
    steps["password"] = E.PASSWORD_ENTITY.apply(text)
    for e in E.CLOUD_ENTITIES:
        steps[f"cloud_token:{e.name}"] = e.apply(text)
    if config.obfuscate_serial:
        steps["serial"] = named("serial", rewrite.serials, rewrite.serial_passes)
    steps["sid"] = named("sid", rewrite.system_ids, rewrite.system_id_passes)
    return list(steps.items())


def apply(files: DataFrame, mapping: Mapping, config: Config | None = None, header: bool = False) -> DataFrame:
    """``files`` with ``text`` rewritten and ``changed``. A step that fails fails the run: no text leaves half done.

    header: a banner before changed texts; of files in blocks, before the first
    block if that has changed. Null texts stay null. Categories that
    are tables make it more than a narrow pass, and of no use to a stream.
    """
    out = files.withColumn("_before", F.col("text"))
    for _, step in rewritten(F.col("text"), F.col("path"), mapping, config):
        out = out.withColumn("text", step) if isinstance(step, Column) else rewrite.in_passes(out, step)
    out = out.withColumn("changed", F.coalesce(F.col("text") != F.col("_before"), F.lit(False)))
    if header:
        first = F.col("start") == 0 if "start" in out.columns else F.lit(True)
        out = out.withColumn("text", F.when(F.col("changed") & first, F.concat(F.lit(HEADER), "text")).otherwise(F.col("text")))
    return out.drop("_before")


def mapping_table(files: DataFrame, mapping: Mapping, config: Config | None = None) -> DataFrame:
    """category, real, fake: the names of ``mapping``, and the pattern values and addresses of ``files`` as the chain replaces them."""
    spark, config = files.sparkSession, config or Config()
    found = allocate.hash_mapping(discover.all_candidates(files)).select("category", "real", "fake")
    rows = [(c, k, v) for c, m in mapping.names.items() for k, v in m.items()]
    named = reduce(DataFrame.unionByName, [t.select(F.lit(c).alias("category"), "real", "fake") for c, t in mapping.tables.items()],
                   spark.createDataFrame(rows, "category string, real string, fake string"))
    ips = discover.ipv4_candidates(files).select("real").distinct()
    ips = ips.select(F.lit("ip").alias("category"), "real", rewrite.addresses(F.col("real"), mapping.subnets, config.obfuscate_private_ip, config.obfuscate_public_ip).alias("fake"))
    return found.unionByName(named).unionByName(ips.filter("real <> fake"))


@dataclass
class Result:
    files: DataFrame
    mapping: Mapping
    findings: DataFrame | None

    @property
    def status(self) -> int:
        """0, or 3 if verification found leaks."""
        return 0 if self.findings is None or self.findings.isEmpty() else 3


def run(files: DataFrame, config: Config | None = None, known: Mapping | None = None, seeds=None, keywords=(), from_text: bool | None = None,
        check: bool = True, header: bool = False) -> Result:
    """Learn, apply and (with ``check``) verify."""
    config = config or Config()
    mapping = learn(files, config, known, seeds, keywords, from_text)
    done = apply(files, mapping, config, header)
    if check:  # the detectors read the rewritten texts several times
        done = materialize(done, "rewritten")
    findings = verify.verify(done, mapping_table(files, mapping, config), verify.identity(files, discover.sections(files)), config.obfuscate_private_ip) if check else None
    return Result(done, mapping, findings)
