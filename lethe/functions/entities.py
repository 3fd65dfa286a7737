"""Pattern entities: what is found by its form alone, and what replaces it.

An entity is discovered, allocated and rewritten from one specification.  In
hash mode a fake is a function of the real value, so that rewriting is a narrow
pass without a mapping; in serial mode fakes are numbered by first sight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ipv4
from .text import any_of, digest, find_all, mentions, rewrite

# Patterns, suffixes and names that the results depend on.
EMAIL = (r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,})(?![A-Za-z0-9._%+-])")
UNIT_SUFFIXES = (".service", ".socket", ".timer", ".target", ".mount", ".slice", ".scope", ".path", ".device", ".conf", ".tmp", ".catalog")
SAFE_EMAIL_DOMAINS = ("example.com", "example.org", "example.net", "localhost", "localhost.localdomain", "localdomain")
MAC = r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})(?![0-9A-Fa-f:])"
SAFE_MACS = ("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00")
MAC_SKIP_FILES = ("modules.txt", "security-apparmor.txt", "drbd.txt", "security-audit.txt", "fs-btrfs.txt")
MAC_OUI = "00:1A:2B"
PASSWORD = r"""(?i)(\b(?:password|passwd)\s*[:=]\s*["']?)(?!\*REMOVED)(?!scrubbed_pass_)([A-Za-z0-9+/]{8,})"""
JWT = r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)"
IDENTITY = r"(<identity>|identity:\s*)(eyJ[A-Za-z0-9_+/=-]{20,})"
AWS_KEY = r"(AKIA[0-9A-Z]{16})"
AWS_TEMPORARY_KEY = r"(ASIA[0-9A-Z]{16})"
AWS_SECRET = r"""(?i)((?:aws_secret_access_key|SecretAccessKey|aws_session_token|SessionToken)\s*[:=]\s*["']?)([A-Za-z0-9+/=_-]{20,})"""
AZURE_KEY = r"(AccountKey\s*=\s*)([A-Za-z0-9+/=]{20,})"
AZURE_SAS = r"([?&](?:sig|sv|se|sp|spr|srt|ss)=)([A-Za-z0-9%+/=]{20,})"
GCP_KEY = r"""("private_key"\s*:\s*")(-----BEGIN[^"]+-----)(?=")"""
BEARER = r"""(?i)((?:Bearer|X-Auth-Token)\s+|(?:Authorization|token)\s*[:=]\s*(?:Bearer\s+)?["']?)([A-Za-z0-9._+/=-]{40,})"""
SSH_COMMENT = r"""(\b(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-nistp\d+)\s+[A-Za-z0-9+/=]{40,}[ \t]+)(?!SCRUBBED_)([^\s"']+)"""
LDAP = r"(?i)(\b(?:CN|OU)=)([^,\s]+)"
DIRECTORY_TERMS = (
    "aggregate", "schema", "configuration", "sites", "subnets", "servers", "services", "partitions", "builtin", "users", "computers",
    "system", "container", "config", "domain", "default", "lostandfound", "adminsdholder", "keys", "extended-rights",
    "dfsr-globalsettings", "policies", "adrm", "dns", "microsoftdns", "top", "organizationalunit", "person", "user", "group", "computer")
CLOUD_REGIONS = (
    "east-us", "east-us-2", "west-us", "west-us-2", "west-us-3", "central-us", "north-central-us", "south-central-us", "west-central-us",
    "north-europe", "west-europe", "uk-south", "uk-west", "france-central", "germany-west-central", "switzerland-north", "norway-east",
    "sweden-central", "east-asia", "southeast-asia", "japan-east", "japan-west", "korea-central", "australia-east", "australia-southeast",
    "canada-central", "canada-east", "brazil-south", "south-africa-north", "uae-north", "india-central", "azure-west-europe",
    "azure-east-us", "azure-north-europe")
OWN_FAKE_NAME = r"^(?i)(?:hostname_\d+|user_\d+|domain_\d+|keyword_\d+|cn_(?:\d+|[0-9a-f]{12})|ou_(?:\d+|[0-9a-f]{12}))(?:\.[a-z]{2,})?$"


@dataclass(frozen=True)
class Entity:
    """One kind of value.

    pattern: its last group is the value; with two groups, the first is kept; with three, the second is the value and the others are kept.
    form: a fake's text for its number. category: under which its values are mapped.
    gates, words, quick: strings, lower-case words of any case, and a pattern of which every text with a match has one.
    """

    name: str
    category: str
    pattern: str
    form: Callable[[Column, Column], Column]
    groups: int = 1
    gates: tuple[str, ...] = ()
    keep: Callable[[Column], Column] | None = None
    normal: Callable[[Column], Column] = lambda v: v
    skip_files: tuple[str, ...] = ()
    digits: int = 12
    words: tuple[str, ...] = ()
    quick: str = ""

    @property
    def group(self) -> int:
        """The group of the value."""
        return min(self.groups, 2)

    @property
    def inner(self) -> str:
        """The pattern for a match on its own, which has nothing after it."""
        return self.pattern.removesuffix('(?=")')

    def may_hold(self, text: Column) -> Column | None:
        """A test that costs little; None if there is none."""
        tests = [text.contains(g) for g in self.gates] + ([mentions(text, *self.words)] if self.words else []) + ([text.rlike(self.quick)] if self.quick else [])
        return any_of(tests) if tests else None

    def values(self, text: Column) -> Column:
        """The real values in a text, normalised, as often as they occur."""
        gate = self.may_hold(text)
        hits = find_all(text, self.pattern, self.group)
        found = F.transform(hits if gate is None else F.when(gate, hits).otherwise(F.array().cast("array<string>")), self.normal)
        return F.filter(found, lambda v: ~self.keep(v)) if self.keep else found

    def value_of(self, hit: Column) -> Column:
        """The real value of a match, normalised."""
        return self.normal(F.regexp_extract(hit, self.inner, self.group) if self.groups > 1 else hit)

    def replaced(self, hit: Column, new: Column) -> Column:
        """A match with ``new`` for its value; null where that is."""
        kept = [F.regexp_extract(hit, self.inner, k) for k in range(1, self.groups + 1) if k != self.group]
        return F.concat(*kept[:1], new, *kept[1:])

    def hash_fake(self, value: Column) -> Column:
        return self.form(value, digest(value, self.digits))

    def apply(self, text: Column, fake: Callable[[Column], Column] | None = None) -> Column:
        """``text`` with the values replaced; by hash fakes unless told otherwise."""
        fake = fake or self.hash_fake

        def one(hit: Column) -> Column:
            value = self.value_of(hit)
            new = F.coalesce(self.replaced(hit, fake(value)), hit)
            return F.when(self.keep(value), hit).otherwise(new) if self.keep else new

        return rewrite(text, self.pattern, one, self.may_hold(text))


def _keep_email(v: Column) -> Column:
    out = F.lower(F.substring_index(v, "@", -1)).isin(*SAFE_EMAIL_DOMAINS, "scrubbed.local")
    for suffix in UNIT_SUFFIXES:
        out = out | v.endswith(suffix)
    return out


def _keep_name(v: Column) -> Column:
    low = F.lower(v)
    return F.regexp_replace(low, r"\$$", "").isin(*DIRECTORY_TERMS) | low.isin(*CLOUD_REGIONS, "rid manager$") | v.rlike(OWN_FAKE_NAME)


def _mac_form(_: Column, number: Column) -> Column:
    n = F.upper(number)
    return F.concat_ws(":", F.lit(MAC_OUI), F.substring(n, 1, 2), F.substring(n, 3, 2), F.substring(n, 5, 2))


def _token(kind: str) -> Callable[[Column, Column], Column]:
    return lambda _, n: F.concat(F.lit(f"SCRUBBED_{kind}_"), n)


MAC_ENTITY = Entity("mac", "mac", MAC, _mac_form, 1, (), lambda v: v.isin(*SAFE_MACS) | v.startswith(MAC_OUI.lower()), F.lower, MAC_SKIP_FILES, 6,
                    quick=r"[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]")
EMAIL_ENTITY = Entity("email", "email", EMAIL, lambda _, n: F.concat(F.lit("email_"), n, F.lit("@scrubbed.local")), 1, ("@",), _keep_email)
#: As SQL without look-around reads them: a match takes the characters beside its value, so that of two values with one character between them the first counts.
EMAIL_APART_ENTITY = replace(EMAIL_ENTITY, groups=3, pattern=r"(^|[^A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,})(\z|[^A-Za-z0-9._%+-])")
#: As SQL reads bearer tokens: white space has no vertical tab, and letters of any case are also the long s and the Kelvin sign.
BEARER_APART = (BEARER.replace(r"\s", r"[ \t\n\f\r]").replace("To", "to").replace("token", r"to[k\u212A]en").replace("=-]", r"=\u017F\u212A-]"))
IPV4_APART_ENTITY = Entity("ip", "ip", ipv4.APART, lambda _, n: n, 3, keep=lambda v: v.startswith("0."), quick=ipv4.MAY_HOLD)
LDAP_ENTITY = Entity("ldap_dn", "ldap_dn", LDAP, lambda v, n: F.concat(F.lit("cn_"), n), 2, ("=",), _keep_name, F.lower)
PASSWORD_ENTITY = Entity("password", "password", PASSWORD, lambda _, n: F.concat(F.lit("scrubbed_pass_"), n), 2, words=("passw",))
CLOUD_ENTITIES = (
    Entity("jwt", "cloud_token", JWT, _token("JWT"), 1, ("eyJ",)),
    Entity("identity", "cloud_token", IDENTITY, _token("IDENTITY"), 2, ("eyJ",)),
    Entity("aws_key", "cloud_token", AWS_KEY, _token("AWSKEY"), 1, ("AKIA",)),
    Entity("aws_temporary_key", "cloud_token", AWS_TEMPORARY_KEY, _token("AWSKEY"), 1, ("ASIA",)),
    Entity("aws_secret", "cloud_token", AWS_SECRET, _token("AWSSECRET"), 2, words=("secret", "session")),
    Entity("azure_key", "cloud_token", AZURE_KEY, _token("AZUREKEY"), 2, ("AccountKey",)),
    Entity("azure_sas", "cloud_token", AZURE_SAS, _token("AZURESAS"), 2, ("=",)),
    Entity("gcp_key", "cloud_token", GCP_KEY, _token("GCPKEY"), 2, ("-----BEGIN",)),
    Entity("bearer", "cloud_token", BEARER, _token("BEARER"), 2, (), lambda v: v.contains("SCRUBBED_"), words=("bearer", "x-auth-token", "authorization", "token")),
    Entity("ssh_comment", "cloud_token", SSH_COMMENT, _token("SSHCOMMENT"), 2, ("ssh-", "ecdsa-")),
)
BEARER_APART_ENTITY = replace(next(e for e in CLOUD_ENTITIES if e.name == "bearer"), pattern=BEARER_APART)


def apply_ldap(text: Column, fake: Callable[[Column, Column], Column] | None = None) -> Column:
    """CN= and OU= values replaced by cn_ and ou_ fakes, the label kept as it is written."""
    def one(hit: Column) -> Column:
        label, value = F.regexp_extract(hit, LDAP, 1), F.regexp_extract(hit, LDAP, 2)
        kind = F.concat(F.lower(F.substring(label, 1, 2)), F.lit("_"))
        new = fake(F.lower(value), kind) if fake else F.concat(kind, digest(F.lower(value)))
        return F.when(_keep_name(value), hit).otherwise(F.concat(label, F.coalesce(new, value)))

    return rewrite(text, LDAP, one, text.contains("="))


#: In the order of the rewrite chain.
PATTERN_ENTITIES = (MAC_ENTITY, EMAIL_ENTITY, LDAP_ENTITY, PASSWORD_ENTITY, *CLOUD_ENTITIES)
