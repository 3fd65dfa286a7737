"""Names that are learned from particular places: hosts, users, serial numbers, system ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ipv4
from ..functions.text import any_of, basename, find_all, mentions
from . import domains
from .rewrite import LOOPBACK_NAMES, PRODUCT_NAMES

# Accounts of the system, log patterns, labels, contexts and reserved words.
SYSTEM_USERS = (
    "root", "bin", "daemon", "lp", "mail", "news", "uucp", "games", "man", "wwwrun", "ftp", "nobody", "messagebus", "systemd-timesync",
    "uuidd", "at", "polkitd", "rpc", "nscd", "sshd", "statd", "ntp", "vnc", "hacluster", "ssm-user", "hapadm", "sapadm", "postfix",
    "pimuser", "rtkit", "pulse", "daaadm", "ubroker", "openslp", "scard", "ftpsecure", "cwagent", "aoc", "systemd-network", "tftp",
    "srvGeoClue", "flatpak", "mysql", "usbmux", "avahi", "dnsmasq", "nm-openconnect", "nm-openvpn", "sddm", "svn", "citrixlog", "salt",
    "dockremap", "chrony", "laptop", "qemu", "tss", "wsdd", "gdm", "zabbix", "vscan", "lldpd", "?", "(unknown)", "uid", "gid", "pid",
    "sudo", "su", "login", "session", "auth")
LOG_PATTERNS = (
    r"session opened for user (\w+)",
    r"(?i)\b(?:user|logname)\s*=\s*([A-Za-z0-9._-]+)",
    r'acct="([^"]+)"',
    r"(?i)NCE/USER/[^/]+/([A-Za-z0-9._-]+)",
    r"pam_unix\([^)]+\):.*?\[([A-Za-z0-9._-]+)\]",
    r"password check failed for user \(([A-Za-z0-9._-]+)\)")
LOG_TRIGGER = r'(?i)user|logname|acct="|pam_unix'
SERIAL = r"(?im)^([^\S\n]*(?:Serial\s+Number|Asset\s+Tag|Part\s+Number|UUID)\s*:\s*)(\S[^\n]*)$"
EMPTY_SERIALS = (
    "", "not specified", "not present", "unknown", "n/a", "none", "to be filled by o.e.m.", "default string", "invalid", "0000000000",
    "00000000000000000000", "chassis serial number", "system serial number", "base board serial number", "not applicable",
    "not available", "no asset information", '"not available"', '"no asset information"', '"none"')
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SERIAL_FILES = ("basic-environment.txt", "boot.txt", "hardware.txt")
SYSTEM_ID = "[A-Z][A-Z0-9]{2}"
ID_CONTEXTS = (
    rf"/usr/sap/({SYSTEM_ID})(?![A-Za-z0-9])", rf"/sapmnt/({SYSTEM_ID})(?![A-Za-z0-9])", rf"SAPSYSTEMNAME\s*[=:]\s*({SYSTEM_ID})",
    rf"\brsc_[A-Za-z]*SAP[A-Za-z]*_({SYSTEM_ID})_", rf"\bSAP({SYSTEM_ID})_", rf"\b({SYSTEM_ID})_(?:D|ASCS|ERS|SCS|HDB|J|W|G)\d\d\b")
ID_TRIGGER = r"_(?:D|ASCS|ERS|SCS|HDB|J|W|G)\d\d"
RESERVED_IDS = (
    "ADD", "ALL", "AND", "ANY", "ASC", "AUX", "AVG", "BIN", "BIT", "CDC", "COM", "CON", "DBA", "DBM", "DEV", "EPS", "FOR", "GID", "IBM",
    "INT", "KEY", "LOG", "LPT", "MAX", "MIN", "MON", "NIX", "NOT", "NUL", "OFF", "OLD", "OMS", "OUT", "PAD", "PRN", "RAW", "REF", "ROW",
    "SAP", "SET", "SGA", "SHG", "SID", "SQL", "SUM", "SYS", "TMP", "TOP", "UID", "USE", "USR", "VAR", "ADM", "ALT", "TBD")
ID_FILES = ("basic-environment.txt", "ha.txt", "systemd.txt", "ps.txt", "fs-diskio.txt", "open-files.txt", "cib.xml", "pacemaker.log")
NFS_SERVER = r"nfs: server (\w[\w.-]*)"
SYSLOG_HOST = r"(?m)^\d{4}-\d{2}-\d{2}T[\d:.+-]+\s+(\w[\w-]*)\b"


def common_host(name: Column) -> Column:
    return F.lower(name).isin(*PRODUCT_NAMES, *LOOPBACK_NAMES)


def hosts_from_sections(sections: DataFrame) -> DataFrame:
    """path, pos, real: names of /etc/hosts rows (four characters or more), and the value below /bin/hostname."""
    line = F.trim(F.substring_index("line", "#", 1))
    rows = sections.filter(F.col("header").startswith("# /etc/hosts") & (line != ""))
    fields = F.slice(F.split(line, r"\s+"), 2, 1_000_000)
    names = rows.select("path", "line_no", F.posexplode(fields).alias("i", "f")).withColumn("real", F.substring_index("f", ".", 1))
    names = names.filter((F.char_length("real") >= 4) & ~common_host(F.col("real"))).select("path", (F.col("line_no") * 1000 + F.col("i")).alias("pos"), "real")
    own = sections.filter(F.col("header").startswith("# /bin/hostname") & (F.trim("line") != ""))
    own = own.groupBy("path", "header").agg(F.min(F.struct("line_no", F.trim("line").alias("v"))).alias("m"))
    own = own.select("path", (F.col("m.line_no") * 1000).alias("pos"), F.substring_index("m.v", ".", 1).alias("real"))
    return names.unionByName(own.filter(~common_host(F.col("real"))))


def nfs_servers(text: Column) -> Column:
    return F.when(text.contains("nfs: server "), F.transform(find_all(text, NFS_SERVER, 1), lambda v: F.substring_index(v, ".", 1)))


def log_hosts(text: Column) -> Column:
    return F.when(text.rlike(r"\d{4}-\d{2}-\d{2}T"), find_all(text, SYSLOG_HOST, 1))


def hosts_found(nfs: DataFrame, log: DataFrame, least: int = 3) -> DataFrame:
    """path, pos, real: the servers ``nfs``, and those of the host columns ``log`` that occur ``least`` times in their text (both path, real)."""
    nfs = nfs.select("path", "real").filter(F.char_length("real") >= 3)
    log = log.filter(F.char_length("real") >= 3).groupBy("path", "real").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("path", "real")
    return nfs.unionByName(log).filter(~common_host(F.col("real"))).distinct().withColumn("pos", F.lit(0))


def hosts_from_text(files: DataFrame, least: int = 3) -> DataFrame:
    """path, pos, real: servers of NFS messages, and host columns of syslog lines that occur ``least`` times in their text."""
    each = lambda values: files.select("path", F.explode(values(F.col("text"))).alias("real"))
    return hosts_found(each(nfs_servers), each(log_hosts), least)


def excluded_user(name: Column) -> Column:
    return (F.char_length(name) < 3) | name.isin(*SYSTEM_USERS) | ((F.char_length(name) == 6) & name.endswith("adm"))


def users_from_sections(sections: DataFrame) -> DataFrame:
    """path, pos, real: accounts of passwd sections, from uid 1000 on."""
    rows = sections.filter(F.col("header").isin("# /usr/bin/getent passwd", "# /etc/passwd") & (F.trim("line") != ""))
    parts = F.split(F.trim("line"), ":")
    uid = F.expr("try_cast(get(split(trim(line), ':'), 2) as int)")
    rows = rows.filter(uid.isNull() | (uid >= 1000)).select("path", F.col("line_no").alias("pos"), F.get(parts, F.lit(0)).alias("real"))
    return rows.filter(~excluded_user(F.col("real")))


def users_in(text: Column) -> Column:
    """pos, real: the first match of each log pattern in each line, empty where there is none."""
    def matches(line: Column, i: Column) -> Column:
        each = F.transform(F.array(*[F.regexp_extract(line, p, 1) for p in LOG_PATTERNS]), lambda v: F.struct(i.alias("pos"), v.alias("real")))
        return F.when(line.rlike(LOG_TRIGGER), each).otherwise(F.array().cast("array<struct<pos:int,real:string>>"))

    return F.when(mentions(text, "user", "logname", 'acct="', "pam_unix"), F.flatten(F.transform(F.split(text, "\n"), matches)))


def users_found(rows: DataFrame) -> DataFrame:
    """``rows`` (path, pos, real) without accounts of the system."""
    return rows.filter((F.col("real") != "") & ~excluded_user(F.col("real")))


def users_from_text(files: DataFrame) -> DataFrame:
    """path, pos, real: the first match of each log pattern in each line."""
    return users_found(files.select("path", F.explode(users_in(F.col("text"))).alias("u")).select("path", "u.pos", "u.real"))


def skipped_serial(value: Column) -> Column:
    return F.lower(value).isin(*EMPTY_SERIALS) | value.rlike(r"^0{8}-0{4}-0{4}-0{4}-0{12}$") | (F.char_length(F.regexp_replace(value, "[^A-Za-z0-9]", "")) < 4)


def serial_values(text: Column) -> Column:
    return F.when(mentions(text, "serial", "asset", "part", "uuid"), F.transform(find_all(text, SERIAL, 2), lambda v: F.trim(v)))


def serials_in(files: DataFrame) -> DataFrame:
    """path, pos, real: labelled serial numbers, tags, part numbers and UUIDs that are no placeholders."""
    return files.select("path", F.posexplode(serial_values(F.col("text"))).alias("pos", "real")).filter(~skipped_serial(F.col("real")))


def serial_fake(real: Column, number: Column) -> Column:
    hexed = F.lpad(F.lower(F.hex(number.cast("long"))), 12, "0")
    return F.when(real.rlike(UUID), F.concat(F.lit("00000000-0000-0000-0000-"), hexed)).otherwise(F.concat(F.lit("SERIAL_"), number))


def system_ids(text: Column) -> Column:
    """pos (in its context), real: three-character system ids in their strong contexts."""
    each = [F.transform(find_all(text, p, 1), lambda v, i: F.struct(i.alias("pos"), v.alias("real"))) for p in ID_CONTEXTS]
    return F.when(any_of(text.contains(x) for x in ("SAP", "/usr/sap/", "/sapmnt/")) | text.rlike(ID_TRIGGER), F.concat(*each))


def system_ids_in(files: DataFrame) -> DataFrame:
    """path, pos, real: three-character system ids in their strong contexts, reserved words aside."""
    rows = files.select("path", F.explode(system_ids(F.col("text"))).alias("s")).select("path", "s.pos", "s.real")
    return rows.filter(~F.col("real").isin(*RESERVED_IDS))


def system_id_fake(_: Column, number: Column) -> Column:
    n = number.cast("long")
    return F.when(n < 10, F.concat(F.lit("HA"), number)).otherwise(F.concat(F.lit("H"), number))


def in_serial_files(path: Column) -> Column:
    return basename(path).isin(*SERIAL_FILES)


def in_id_files(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.isin(*ID_FILES) | name.rlike("sap|crm|hana|pacemaker")


def in_texts(files: DataFrame) -> DataFrame:
    """category, path, pos, real: all that is learned from texts, in one pass over them.

    Categories: ip (matches as they are written), domain, nfs and log (see
    hosts_found()), user, serial, sid. Nothing is left out yet but what the
    patterns leave out.
    """
    text = F.col("text")

    def plain(category: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(category).alias("category"), i.alias("pos"), v.alias("real")))

    def placed(category: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), v["pos"].alias("pos"), v["real"].alias("real")))

    ips = F.when(text.rlike(ipv4.MAY_HOLD), find_all(text, ipv4.TOKEN))
    dotted = F.when(domains.may_hold(text), domains.domains_in(text))
    parts = [plain("ip", ips), plain("domain", dotted), plain("nfs", nfs_servers(text)), plain("log", log_hosts(text)),
             placed("user", users_in(text)), plain("serial", serial_values(text)), placed("sid", system_ids(text))]
    none = F.array().cast("array<struct<category:string,pos:int,real:string>>")
    return files.select("path", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("c")).select("c.category", "path", "c.pos", "c.real")
