"""Operator 3: secret scans told apart by corpus-wide ownership. DataFrame functions only.

Candidates are the base patterns' matches and, wider, whole runs of 20 letters and digits or more that have both.
Over the whole corpus a candidate value's hash is counted by distinct repositories (documents) and owners
(sources). A value that more than ``OWNERS`` owners or more than ``REPOS`` repositories hold is a copied example;
any other is owner-specific and looks live. Base spans always stay; a wide run is added, as kind ``live``, if it
looks live and touches no base span, so that no secret is given twice by it. The counts of live and copied values
are of different values.

Positions come from the text between the matches: a match starts after the lengths of all that is before.
Positions are code points, ends exclusive.

Nulls: a null text is empty; a null source is an owner, a null id a repository. Empty texts have no spans.
Repeated rows are each returned and are one repository. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_joined, stored, table

KINDS = ("assign", "access", "hex", "live")
OWNERS, REPOS = 2, 8
#: Patterns in Java's syntax. A run of 16 is matched as its whole run, so the least length is in the pattern;
#: an assignment that is too short still takes its place, so its length is looked at afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, WIDE = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}", r"[A-Za-z0-9]{20,}"
_CHUNK = 512


def _sums(lengths: Column, first: Column) -> Column:
    """Running sums that include each entry; ``first`` is added to all."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    return F.slice(F.aggregate(lengths, F.array(first), step), 2, F.greatest(F.size(lengths), F.lit(1)))


def _running(lengths: Column) -> Column:
    """Running sums in chunks, so that a text with very many matches doesn't cost their square."""
    n = F.ceil(F.size(lengths) / _CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(lengths, k * _CHUNK + 1, F.lit(_CHUNK)))
    totals = F.transform(chunks, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b))
    before = F.concat(F.array(F.lit(0)), _sums(totals, F.lit(0)))
    return F.flatten(F.transform(chunks, lambda x, k: _sums(x, F.get(before, k))))


def _matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Kind, start, end and value of each match; the value is the group's."""
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    n = F.size(whole)
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.length(F.get(gaps, k)) + F.when(k > 0, F.length(F.get(whole, k - 1))).otherwise(0))
    found = F.transform(
        F.arrays_zip(_running(steps).alias("start"), whole.alias("whole"), value.alias("value")),
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(kind).alias("kind"),
            (x["start"] + F.length(x["whole"])).alias("end"),
            x["value"].alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(found_type))


found_type = "array<struct<start: int, kind: int, end: int, value: string>>"


def candidates(text: Column) -> Column:
    """Every candidate of a text, base and wide."""
    assign = F.filter(_matches(text, 0, ASSIGN, 2), lambda x: F.length(x["value"]) >= 12)
    wide = F.filter(_matches(text, 3, WIDE), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    return F.concat(assign, _matches(text, 1, ACCESS), _matches(text, 2, HEX), wide)


def scan(
    docs: DataFrame,
    id_col="doc_id",
    text_col="text",
    owner_col="source",
    repo_col="doc_id",
    owners: int = OWNERS,
    repos: int = REPOS,
) -> DataFrame:
    """``doc_id`` and ``spans`` (start, kind, end, hash, live, n_owners, n_repos) of each document: base spans, and wide ones that look live."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(F.col(owner_col).alias("owner")).alias("owner"),
        F.struct(F.col(repo_col).alias("repo")).alias("repo"),
        F.md5(text.cast("binary")).alias("digest"),
        candidates(text).alias("found"),
    )
    hashed = F.transform(
        "found",
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.md5(x["value"].cast("binary")).alias("hash")),
    )
    rows = stored(rows.withColumn("found", hashed), "secrets")
    none = F.array().cast("array<struct<start: int, kind: int, end: int, hash: string, live: boolean, n_owners: bigint, n_repos: bigint>>")
    empty = rows.where(F.size("found") == 0).select("doc_id", none.alias("spans"))  # they meet nothing
    some = rows.where(F.size("found") > 0)
    seen = some.select("owner", "repo", F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash"))
    by_owner = seen.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    value = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))
    # texts alike in every byte have the same spans
    texts = some.groupBy("digest").agg(F.first("found").alias("found"), F.count("*").alias("copies"))
    each = stored(texts.select("digest", "copies", F.explode("found").alias("x")).select("digest", "copies", "x.*"), "secret-places")
    value = value.join(each.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    value = stored(value.withColumn("live", (F.col("n_owners") <= owners) & (F.col("n_repos") <= repos)), "secret-values")
    each = hot_joined(each, value, ["hash"])
    spans = each.groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "live", "n_owners", "n_repos"))).alias("spans"),
        F.first("copies").alias("n"),
    )
    base = F.filter("spans", lambda x: x["kind"] < 3)
    spans = spans.withColumn("base", base)
    apart = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    spans = spans.withColumn("spans", F.filter("spans", lambda x: (x["kind"] < 3) | (x["live"] & apart(x)))).drop("base")
    return empty.unionByName(hot_joined(some.select("doc_id", "digest"), stored(spans, "secret-spans"), ["digest"]).select("doc_id", "spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])))


def op3_secrets(spark, sf_dir):
    rows = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    values = lambda test: F.size(F.array_distinct(F.transform(F.filter("spans", test), lambda x: x["hash"]))).cast("long")
    return rows.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        values(lambda x: x["live"]).alias("n_live"),
        values(lambda x: ~x["live"]).alias("n_copied"),
    )


def _sql_kind(name: str, pattern: str, group: int, least: int, test: str = "true") -> str:
    return f"""
{name} AS (
  SELECT k, source, doc_id, start, '{name}' AS kind, start + length(whole) AS stop, v FROM (
    SELECT k, source, doc_id, unnest(m) AS whole, unnest(vs) AS v,
           unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1],
               lambda x: length(x))), 0)))::BIGINT AS start
    FROM (SELECT k, source, doc_id, regexp_extract_all(text, $p${pattern}$p$) AS m, regexp_extract_all(text, $p${pattern}$p$, {group}) AS vs,
                 string_split_regex(text, $p${pattern}$p$) AS gaps FROM docs WHERE regexp_matches(text, $p${pattern}$p$)))
  WHERE length(v) >= {least} AND {test})"""


SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),"
    + _sql_kind("assign", ASSIGN, 2, 12)
    + ","
    + _sql_kind("access", r"AKIA[A-Z0-9]+", 0, 18)
    + ","
    + _sql_kind("hex", r"[0-9a-f]+", 0, 16)
    + ","
    + _sql_kind("live", r"[A-Za-z0-9]{20,}", 0, 20, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")
    + """,
everything AS (SELECT *, 0 AS nth FROM assign UNION ALL SELECT *, 1 FROM access UNION ALL SELECT *, 2 FROM hex UNION ALL SELECT *, 3 FROM live),
owned AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) <= 2 AND count(DISTINCT (source, doc_id)) <= 8 AS live FROM everything GROUP BY v),
spans AS (SELECT e.*, o.live FROM everything e JOIN owned o USING (v)
          WHERE nth < 3 OR o.live AND NOT EXISTS (SELECT 1 FROM everything b WHERE b.nth < 3 AND b.k = e.k AND b.start < e.stop
              AND e.start < b.stop)),
joined AS (
  SELECT k, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (nth < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans,
         count(DISTINCT v) FILTER (live) AS n_live, count(DISTINCT v) FILTER (NOT live) AS n_copied
  FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM docs LEFT JOIN joined USING (k)
"""
)
