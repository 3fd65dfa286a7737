"""Names of outputs: the marker ``_scrubbed`` once, before the extension, compression outermost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rewrite import by_dictionary

MARK = "_scrubbed"
COMPRESSED = r"(?i)\.(?:gz|xz|bz2)$"
ARCHIVE = r"(?i)\.(?:txz|tgz|tbz|tbz2|tar|tar\.(?:gz|xz|bz2))$"


def output_path(path: Column) -> Column:
    """The output's path for a file's path. Tar endings don't count as compression."""
    end = F.when(path.rlike(COMPRESSED) & ~path.rlike(ARCHIVE), F.regexp_extract(path, COMPRESSED, 0)).otherwise("")
    stem = F.substring(path, F.lit(1), F.char_length(path) - F.char_length(end))
    name = F.regexp_extract(stem, "[^/]*$", 0)
    ext = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    root = F.substring(stem, F.lit(1), F.char_length(stem) - F.char_length(ext))
    return F.when(F.lower(root).endswith(MARK), path).otherwise(F.concat(root, F.lit(MARK), ext, end))


def renamed(path: Column, *mappings: dict[str, str]) -> Column:
    """A path with domains and then host names replaced as plain strings, the longest that fits at each place."""
    for mapping in mappings:
        path = by_dictionary(path, {real: fake for real, fake in mapping.items() if real}, flags="", fold=False)
    return path


def artifact_names(stamp: str, host: str | None = None) -> dict[str, str]:
    base = f"obfuscation{'_' + host if host else ''}_{stamp}"
    return {k: f"{base}_{k}.json" for k in ("mappings", "audit", "report")}
