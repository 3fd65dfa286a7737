"""Secret scans with corpus-wide ownership frequency [native].

Candidates are found per document as spans; the hash of each candidate's value
is counted over the distinct owners and repositories that hold it.  A value
that many owners or many repositories hold is a copied example; a value of few
that doesn't look like a placeholder is live.  In the documents table, the source
stands for the owner and a document for the repository.  Candidates of the wider patterns are reported
only if they are live.

Scale: one pass over the texts yields a narrow table of candidates, cut into the
shared folder.  Frequencies aggregate distinct (value, owner, repository) rows
before counting; verdicts go back over a salted join, as one value may be in a
third of all documents; rows without candidates take no part in either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: The repeated group of WIDER is possessive: what is not goes a level deeper with each repetition.
#: Kinds in the order of reports: name, pattern, group of the value, least code points of the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WIDER = (r"(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}"
         r"|AIza[A-Za-z0-9_-]{30,}|sk_live_[A-Za-z0-9]{16,}|-----BEGIN[A-Z ]*PRIVATE KEY-----(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=]{16,})*+|[Bb]earer +[A-Za-z0-9._~+/-]{20,})")
KINDS = (("assign", ASSIGN, 1, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16), ("wider", WIDER, 0, 12))
BASE_KINDS = 3
#: Strings without one of which (in lower case) a pattern can't match.
GATES = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "wider": ("eyj", "gh", "xox", "aiza", "sk_live_", "-----begin", "bearer ")}
#: Owners, and repositories, from which a value counts as a copied example; distinct characters of a live value.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_CHARS = 3, 10, 6
SALTS = 16
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once; a lambda would evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array, block by block: quadratic in no array's length."""
    def sums(x: Column, starts: Column) -> Column:
        return F.transform(x, lambda _, i: F.element_at(starts, F.floor(i / BLOCK).cast("int") + 1)
                           + _sum(F.slice(x, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))

    def blocks(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: _sum(F.slice(x, j * BLOCK + 1, F.lit(BLOCK))))

    def starts(x: Column) -> Column:
        return let(blocks(x), lambda b: F.transform(b, lambda _, j: _sum(F.slice(b, F.lit(1), j))))

    return let(numbers, lambda x: let(starts(x), lambda s: sums(x, s)))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def spans(text: Column, kind: int) -> Column:
    """The matches of a kind: array of (start, kind, end, value), leftmost first, in code points."""
    name, pattern, group, least = KINDS[kind]

    def starts(hits: Column, gaps: Column) -> Column:
        return prefix_sums(F.transform(hits, lambda h, i: F.char_length(F.element_at(gaps, i + 1))
                                       + F.when(i > 0, F.char_length(F.get(hits, i - 1))).otherwise(0)))

    def found(hits: Column, at: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(
            F.get(at, i).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + F.char_length(h)).alias("end"),
            (F.regexp_extract(h, pattern, group) if group else h).alias("value")))

    everything = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(
        F.split(text, pattern, -1), lambda gaps: let(starts(hits, gaps), lambda at: found(hits, at))))
    return F.filter(everything, lambda s: F.char_length(s["value"]) >= least)


def candidates(text: Column) -> Column:
    """All candidates of a text by start, then kind; values are hashed, and their distinct characters counted."""
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    low = F.lower(text)
    parts = []
    for k, (name, pattern, _, _) in enumerate(KINDS):
        gate = None
        for word in GATES.get(name, ()):
            gate = low.contains(word) if gate is None else gate | low.contains(word)
        found = text.rlike(pattern)
        parts.append(F.when(found if gate is None else gate & found, spans(text, k)).otherwise(nothing))
    return F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.md5(s["value"]).alias("value"),
        F.size(F.array_distinct(F.split(s["value"], ""))).alias("chars")))


def _joined(found: Column) -> Column:
    kind = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, owner, repository, found (see candidates()) and tag, a digest of ``found``; a table of its own."""
    found = docs.select("doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
                        candidates(F.coalesce("text", F.lit(""))).alias("found"))
    tag = F.md5(F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["start"].cast("string"), s["kind"].cast("string"), s["value"])), ","))
    return materialize(found.withColumn("tag", tag), "secret-candidates")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """value, n_owners, n_repositories and widespread, over the rows of find_candidates().

    Null owners count as one owner, null repositories of an owner as one repository.
    """
    held = found.select(F.explode(F.transform("found", lambda s: s["value"])).alias("value"), F.coalesce("owner", F.lit("")).alias("owner"),
                        F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")).withColumn(
        "widespread", (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Spans with verdicts: doc_id, found, verdicts (array of (start, kind, end, widespread, live)), a row for each row of ``docs``.

    Null texts count as empty and have no spans; whole texts are searched;
    repeated rows get the same spans and count once for each owner and
    repository; an empty table gives no rows; other columns don't matter.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("doc_id") if repository is None else repository
    found = find_candidates(docs, owner, repository)
    with_any = found.filter(F.size("found") > 0)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    each = with_any.select("doc_id", "tag", salt.alias("salt"), F.explode("found").alias("s")).select("doc_id", "tag", "salt", "s.*")
    counted = ownership(found).select("value", "widespread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = each.join(counted, ["value", "salt"]).select(
        "doc_id", "tag", F.struct("start", "kind", "end", "widespread", (~F.col("widespread") & (F.col("chars") >= LIVE_CHARS)).alias("live")).alias("s"))
    verdicts = judged.groupBy(F.col("doc_id").alias("doc_id_"), F.col("tag").alias("tag_")).agg(F.array_sort(F.collect_set("s")).alias("verdicts"))
    back = with_any.join(verdicts, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("tag") == F.col("tag_"))).select("doc_id", "found", "verdicts")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,widespread:boolean,live:boolean>>)")
    return back.unionByName(found.filter(F.size("found") == 0).select("doc_id", "found", none.alias("verdicts")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < BASE_KINDS)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    kept = F.filter("verdicts", lambda s: (s["kind"] < BASE_KINDS) | s["live"])
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(kept).alias("spans"),
        F.size(F.filter("verdicts", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("verdicts", lambda s: s["widespread"])).cast("long").alias("n_widespread"))


def _sql_pattern(pattern: str) -> str:
    """``pattern`` for DuckDB, which never goes deeper and has no possessive groups."""
    return pattern.replace(")*+", ")*").replace("'", "''")


OP9_SQL = """
WITH kinds(kind, name, pattern, grp, least) AS (VALUES
""" + ",\n".join(f"  ({k}, '{n}', '{_sql_pattern(p)}', {g}, {m})" for k, (n, p, g, m) in enumerate(KINDS)) + """),
texts AS (SELECT row_number() OVER () AS row_id, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
hits AS (
""" + "\n  UNION ALL ".join(f"""SELECT row_id, {k} AS kind, {m} AS least, regexp_extract_all(text, '{_sql_pattern(p)}') AS hits,
         regexp_extract_all(text, '{_sql_pattern(p)}', {g}) AS vals, regexp_split_to_array(text, '{_sql_pattern(p)}') AS gaps
  FROM texts WHERE regexp_matches(text, '{_sql_pattern(p)}')""" for k, (n, p, g, m) in enumerate(KINDS)) + """),
each AS (
  SELECT row_id, kind, least, unnest(vals) AS val, unnest(list_transform(hits, lambda h: len(h))) AS size,
         unnest(list_transform(hits, lambda h, i: list_sum(list_transform(gaps[1:i], lambda g: len(g)))
                                                + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0))) AS start
  FROM hits),
cands AS (
  SELECT row_id, kind, start::BIGINT AS start, (start + size)::BIGINT AS stop, md5(val) AS value, len(list_distinct(string_split(val, ''))) AS chars
  FROM each WHERE len(val) >= least),
owned AS (
  SELECT value, count(DISTINCT coalesce(source, '')) >= 3 OR count(DISTINCT (coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) >= 10 AS widespread FROM cands JOIN texts USING (row_id) GROUP BY value),
judged AS (SELECT *, NOT widespread AND chars >= 6 AS live FROM cands JOIN owned USING (value) JOIN (SELECT kind, name FROM kinds) USING (kind)),
agg AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (widespread) AS n_widespread
  FROM judged GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_widespread, 0)::BIGINT AS n_widespread
FROM texts LEFT JOIN agg USING (row_id)
"""
