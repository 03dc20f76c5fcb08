"""Secret scan with the corpus-wide frequency of owners. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import stage

#: Fixed patterns of the kinds, and the least length of what counts: group 2 of an assignment, else the whole match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
#: A match of these is a run that no match within it can outlive, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Kinds that the method adds: connection strings with a password, private key headers and signed web tokens.
URL = r"[a-z][a-z0-9+]{1,11}://[^\s:@/]{1,64}:[^\s:@/]{8,128}@[A-Za-z0-9.-]+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "url", "private_key", "web_token")


@dataclass(frozen=True)
class SecretConfig:
    #: A value that this many owners hold, or this many repositories, is an example that people copy.
    copied_owners: int = 3
    copied_repos: int = 10
    #: Least number of different characters of a value that looks live.
    distinct_chars: int = 8


_SPAN = "struct<kind:int,start:int,stop:int,value:string>"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _starts(steps: Column) -> Column:
    """Where each match begins, from ``(piece, match)``: the lengths of the text before it and of itself.

    A list that grows by each match is copied by each match. So the running lengths are taken in groups of about the root of their
    number, each from where the groups before it end: 300,000 matches of a text are some seconds, not hours.
    """

    def grouped(s: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int")), lambda g: F.slice(s, g * size + 1, size))

    def ends(groups: Column) -> Column:
        whole = lambda g: F.aggregate(g, F.lit(0), lambda n, x: n + x["piece"] + x["match"])
        return F.aggregate(groups, F.array(F.lit(0)).cast("array<int>"), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + whole(g))))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["piece"]
        return F.struct((start + x["match"]).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    def within(g: Column, begin: Column) -> Column:
        return F.aggregate(g, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

    return _bound(_bound(steps, grouped), lambda groups: F.flatten(F.zip_with(groups, F.slice(ends(groups), 1, F.size(groups)), within)))


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of the leftmost matches that do not overlap, in code points.

    Where a match stands follows from the lengths of the pieces between the matches, which ``split`` gives; so texts
    without a match, nearly all, cost one pass.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{_SPAN}>")
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("piece"), F.length(m).alias("match")))
    placed = F.arrays_zip(_starts(steps).alias("start"), F.transform(found, F.length).alias("length"), values.alias("value"))
    spans = F.transform(
        placed.cast("array<struct<start:int,length:int,value:string>>"),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + x["length"]).alias("stop"), x["value"].alias("value")).cast(_SPAN),
    )
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def spans_of(text: Column) -> Column:
    """All spans of a text in the order of start and kind."""
    text = F.coalesce(text, F.lit(""))
    each = [
        _spans(text, ASSIGN, 0, ASSIGN_LENGTH), _spans(text, ACCESS, 1), _spans(text, HEX, 2),
        _spans(text, URL, 3), _spans(text, PRIVATE_KEY, 4), _spans(text, WEB_TOKEN, 5),
    ]
    order = F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.sha2(s["value"].cast("binary"), 256).alias("hash"), _live_shape(s["value"]).alias("shape")))
    return F.array_sort(order)


def _live_shape(value: Column) -> Column:
    """Number of different characters of a value that is no placeholder, else 0."""
    plain = F.lower(value)
    fake = plain.rlike(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|(.)\1{7}|0123456|123456789|abcdef0|deadbeef")
    return F.when(fake, 0).otherwise(F.size(F.array_distinct(F.split(value, ""))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", text: str = "text", id_: str = "doc_id", config: SecretConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans of each row, and what the corpus knows about each value.

    First result: ``(rid, id, spans)`` for every row, ``spans`` an array of start, kind, stop, hash of the value and shape.
    Second: ``(hash, owners, repos, rows, copied, live)``; a value that few owners hold and that looks like no placeholder is live.
    Values leave the first pass as hashes only. Counts go by distinct owner and repository, each step combined before it is
    shuffled, so a value that a third of all rows hold is a few rows by then. A null owner is one owner, a null repository one
    repository of its owner. Null texts are empty; repeated rows are scanned each; an empty table gives empty results. A text may
    be of any length and hold any number of matches.
    """
    config = config or SecretConfig()
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_).alias("id"), F.col(owner).alias("owner"), F.col(repo).cast("string").alias("repo"), spans_of(F.col(text)).alias("spans")
    )
    rows = stage(found, "secrets")
    each = rows.where(F.size("spans") > 0).select("owner", "repo", F.explode("spans").alias("s")).select("owner", "repo", F.col("s.hash").alias("hash"), F.col("s.shape").alias("shape"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("rows"), F.max("shape").alias("shape"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"), F.max("shape").alias("shape"))
    values = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("rows").alias("rows"), F.max("shape").alias("shape"))
    copied = (F.col("owners") >= config.copied_owners) | (F.col("repos") >= config.copied_repos)
    values = values.withColumn("copied", copied).withColumn("live", ~copied & (F.col("shape") >= config.distinct_chars)).drop("shape")
    return rows.select("rid", "id", "spans"), values


def report(docs: DataFrame, config: SecretConfig | None = None, **columns: str) -> DataFrame:
    """One row for each row of ``docs``: counts and digest of the base spans, all spans, and how many of them are copied or live.

    Null and empty texts, and texts without a match, have zero counts, the digest of nothing and no spans; repeated rows come each.
    """
    rows, values = scan(docs, config=config, **columns)
    kept = values.select("hash", "copied", "live")
    by_row = rows.where(F.size("spans") > 0).select("rid", F.explode("spans").alias("s")).select("rid", F.col("s.hash").alias("hash")).join(kept, "hash")
    by_row = by_row.groupBy("rid").agg(F.sum(F.col("copied").cast("long")).alias("n_copied"), F.sum(F.col("live").cast("long")).alias("n_live"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    return rows.join(by_row, "rid", "left").select(
        F.col("id").alias("doc_id"), *[_count(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )


def _sql_spans(kind: int, pattern: str, least: int = 0) -> str:
    """Spans in SQL: pieces between the matches, running lengths, the matches that are long enough."""
    value = f"regexp_extract_all(t, '{pattern}', 2)" if least else f"regexp_extract_all(t, '{pattern}')"
    keep = f"WHERE length(v) >= {least}" if least else ""
    return f"""SELECT doc_id, rid, {kind} AS kind, start, start + length(m) AS stop, v FROM (
  SELECT doc_id, rid, m, v, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, rid, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i, unnest(regexp_extract_all(t, '{pattern}')) AS m,
               unnest({value}) AS v, unnest(list_slice(regexp_split_to_array(t, '{pattern}'), 1, len(regexp_extract_all(t, '{pattern}')))) AS p FROM docs)
  WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)) {keep}"""


def _sql() -> str:
    quote = lambda p: p.replace("'", "''")
    kinds = [(0, ASSIGN, ASSIGN_LENGTH), (1, ACCESS, 0), (2, HEX, 0), (3, URL, 0), (4, PRIVATE_KEY, 0), (5, WEB_TOKEN, 0)]
    spans = "\nUNION ALL\n".join(_sql_spans(k, quote(p), n) for k, p, n in kinds)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    fake = quote(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0123456|123456789|abcdef0|deadbeef")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
spans AS ({spans}),
listed AS (SELECT rid, kind, start, {names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s, sha256(v) AS hash,
  CASE WHEN regexp_matches(lower(v), '{fake}') OR list_bool_or(list_transform(list_distinct(string_split(lower(v), '')), lambda c: contains(lower(v), repeat(c, 8)))) THEN 0
       ELSE len(list_distinct(string_split(v, ''))) END AS shape FROM spans),
values_ AS (SELECT hash, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos, max(shape) AS shape FROM listed JOIN docs USING (rid) GROUP BY hash),
judged AS (SELECT hash, owners >= 3 OR repos >= 10 AS copied, NOT (owners >= 3 OR repos >= 10) AND shape >= 8 AS live FROM values_),
by_row AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (copied) AS n_copied, count(*) FILTER (live) AS n_live FROM listed JOIN judged USING (hash) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN by_row USING (rid)"""


ORACLE = _sql()
