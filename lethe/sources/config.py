"""Configuration: ``key = value`` lines into a typed record."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from ..functions.ipv4 import POOLS

PLACES = ("/etc/lethe/lethe.conf", "/usr/etc/lethe/lethe.conf")


@dataclass
class Config:
    """What is rewritten, from which pools, and where results go."""

    obfuscate_private_ip: bool = False
    obfuscate_public_ip: bool = True
    obfuscate_domain: bool = True
    obfuscate_username: bool = True
    obfuscate_hostname: bool = True
    obfuscate_mac: bool = True
    obfuscate_ipv6: bool = True
    obfuscate_serial: bool = True
    dataset_dir: str = "/var/tmp"
    secure_tmp: bool = False
    encrypt_mappings: bool = False
    verbose: bool = True
    log_level: str = "verbose"
    use_key_words_file: bool = False
    key_words_file: str = ""
    public_pool: str = POOLS["public"]
    pool_10: str = POOLS["priv10"]
    pool_172: str = POOLS["priv172"]
    pool_192_168: str = POOLS["priv192_168"]
    pool_169_254: str = POOLS["linklocal"]
    default_infer_prefixlen: int = 24
    hostname_preserve: str = ""
    extra: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_dict(cls, values: dict[str, str]) -> Config:
        """Only ``yes``, in any case, is true; unknown keys are dropped."""
        known = {f.name: f.type for f in fields(cls) if f.name != "extra"}
        out = {}
        for k, v in values.items():
            if k in known:
                out[k] = str(v).strip().lower() == "yes" if known[k] == "bool" else int(v) if known[k] == "int" else v
        return cls(**out)

    @classmethod
    def from_text(cls, text: str) -> Config:
        """No comments after values; a line without ``=`` ends the reading."""
        values = {}
        for line in map(str.strip, text.splitlines()):
            if line and not line.startswith("#"):
                key, equals, value = line.partition("=")
                if not equals:
                    break
                values[key.strip()] = value.strip()
        return cls.from_dict(values)

    @classmethod
    def from_file(cls, path: str | None = None) -> Config:
        """From ``path``, or the first usual place that exists, or the defaults."""
        for place in [path] if path else PLACES:
            if Path(place).is_file():
                return cls.from_text(Path(place).read_text())
        if path:
            raise FileNotFoundError(path)
        return cls()

    @property
    def preserve(self) -> tuple[str, ...]:
        return tuple(n.strip().lower() for n in self.hostname_preserve.split(",") if n.strip())

    @property
    def pools(self) -> dict[str, str]:
        return {"public": self.public_pool, "priv10": self.pool_10, "priv172": self.pool_172, "priv192_168": self.pool_192_168, "linklocal": self.pool_169_254}
