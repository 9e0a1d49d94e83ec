"""Operator 8: information-theoretic sanitisation of personal data.

Protected entities are what the base patterns find. Corpus co-occurrence tells how much of an entity's
information a term of the same document reveals: with counts over all documents, PMI(t; e) =
log(N n(t,e) / (n(t) n(e))) against IC(e) = log(N / n(e)). A term whose share PMI / IC reaches ``DISCLOSURE``
is generalised like the entity wherever it stands in a text that holds the entity. No term is too short and no
entity too rare: a term of a single document reveals an entity of that document only.

Base patterns, as stated with the query: email, ip, card, phone. Scans are linear in the text: an address
is sought from its ``@``, a dotted number as one run. Positions are code points, ends exclusive.

Nulls: a null text is empty; empty texts have no spans. Repeated rows are each returned and counted. Empty table: no
rows. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, flat, hot_joined, small, small_batches, stored, table, word_hashes, word_spans

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information.
DISCLOSURE = 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts, a = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((a, b))
            a = b + 1
    return out


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base(text: str | None) -> list[tuple[int, int, int]]:
    """Kind, start and end of what the patterns find, by kind as listed, then start."""
    if not text:
        return []
    found = [(0, *x) for x in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, *x) for x in ips(text)] + [(2, *x) for x in cards(text)]
        found += [(3, *x) for x in phones(text)] if "+" in text else []
    return found


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of all the text's terms that are in no entity."""
    data, offsets = flat(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = word_spans(data, offsets, ALNUM)
    hashes = word_hashes(data, starts, ends).view(np.int64)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts, ends = lead[starts], lead[ends]
    free = np.ones(len(starts), bool)
    for _, a, b in spans:
        free[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = False
    return hashes[free], starts[free], ends[free]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SPAN_DDL = "array<struct<kind: int, start: int, end: int>>"
_TERMS_DDL = "struct<entities: array<string>, terms: array<bigint>, starts: array<int>, ends: array<int>>"


def _base(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in base(text)] for text in texts.to_pylist()], pa.list_(_SPAN))


def _terms(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The different entities of each text, and all its terms with their places."""
    entities, found = [], []
    for text, own in zip(texts.to_pylist(), spans.to_pylist()):
        own = [(x["kind"], x["start"], x["end"]) for x in own]
        entities.append(sorted({text[a:b] for _, a, b in own}))
        found.append(free_terms(text, own))
    ends = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
    columns = [np.concatenate([x[k] for x in found] or [[]]) for k in range(3)]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))]
    return pa.StructArray.from_arrays([pa.array(entities, pa.list_(pa.string())), *lists], names=["entities", "terms", "starts", "ends"])


def _term_counts(batches):
    """For each batch the terms and in how many of its documents each stands; summed by the caller."""
    for batch in batches:
        data, offsets = flat(batch.column(0))
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        terms, n = np.unique(hashes[new], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``digest, term``: the terms of a text that reveal enough of an entity in it. ``found``: one row a distinct text, with its copies."""
    total = F.broadcast(texts.select(F.count("*").alias("all_docs")))  # one row
    each = found.select("digest", "copies", F.explode("entities").alias("entity"))
    n_e = each.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    n_t = texts.mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    each = each.join(n_e, "entity")
    # n(t,e) is n(e) at most, so a term that reaches the share has n(t) <= N^(1-D) n(e)^D
    most = each.groupBy("digest").agg(F.max("n_e").alias("most"))
    terms = found.select("digest", F.explode(F.array_distinct("terms")).alias("term"))
    terms = terms.join(most, "digest").join(n_t, "term").crossJoin(total)
    bound = lambda n: F.pow("all_docs", F.lit(1 - DISCLOSURE)) * F.pow(n, F.lit(DISCLOSURE)) * 1.000001
    terms = stored(terms.where(F.col("n_t") <= bound("most")).select("digest", "term", "n_t", "all_docs"), "rare-terms")
    pairs = stored(terms.join(each, "digest").where(F.col("n_t") <= bound("n_e")), "term-pairs")
    n_te = pairs.groupBy("entity", "term").agg(
        F.sum("copies").alias("n_te"),
        F.first("n_e").alias("n_e"),
        F.first("n_t").alias("n_t"),
        F.first("all_docs").alias("all_docs"),
    )
    information = F.log(F.col("all_docs") / F.col("n_e"))
    pmi = F.log(F.col("all_docs") * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    reveal = n_te.where((information > 0) & (pmi >= DISCLOSURE * information)).select("entity", "term")
    return pairs.join(reveal, ["entity", "term"]).select("digest", "term").distinct()


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest, base`` of each document, and ``digest, base, added, n`` of each distinct text that has spans.

    The patterns go over every text once; terms are cut out of the distinct texts with entities only, which are
    fetched by digest; the terms of all texts are counted in a scan of their own.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("digest"), F.arrow_udf(_base, _SPAN_DDL)(text).alias("base")),
        "base-spans",
    )
    held = stored(rows.where(F.size("base") > 0).groupBy("digest").agg(F.count("*").alias("copies"), F.first("base").alias("base")), "private")
    names = held.select("digest")
    texts = docs.select(_digest(text).alias("digest"), text.alias("text")).join(F.broadcast(names) if small(held) else names, "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(held, "digest")
    found = stored(
        texts.select("digest", "copies", F.arrow_udf(_terms, _TERMS_DDL)("text", "base").alias("f")).select("digest", "copies", "f.*"),
        "private-terms",
    )
    places = found.select("digest", F.explode(F.arrays_zip("terms", "starts", "ends")).alias("x"))
    places = places.select(
        "digest",
        F.col("x.terms").alias("term"),
        F.struct(F.lit(len(KINDS)).alias("kind"), F.col("x.starts").alias("start"), F.col("x.ends").alias("end")).alias("span"),
    )
    added = places.join(
        disclosing(found, docs.select(text)),
        ["digest", "term"],
    ).groupBy("digest").agg(F.array_sort(F.collect_set("span")).alias("added"))
    none = F.array().cast(_SPAN_DDL)
    return rows, stored(
        held.join(added, "digest", "left").select("digest", "base", F.coalesce("added", none).alias("added"), F.col("copies").alias("n")),
        "spans",
    )


def spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, base, added`` of each document (arrays of kind, start, end)."""
    rows, found = _scanned(docs, id_col, text_col)
    none = F.array().cast(_SPAN_DDL)
    clean = rows.where(F.size("base") == 0).select("doc_id", none.alias("base"), none.alias("added"))
    return clean.unionByName(
        hot_joined(rows.where(F.size("base") > 0).select("doc_id", "digest"), found, ["digest"]).select("doc_id", "base", "added")
    )


def written(found: Column, kinds=(*KINDS, "term")) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])))


def _generalise(texts: pa.Array, found: pa.Array) -> pa.Array:
    """Each span replaced by its kind in brackets; of overlapping spans the one that begins first names the whole."""
    out = []
    for text, all_spans in zip(texts.to_pylist(), found.to_pylist()):
        if text and all_spans:
            parts, end = [], 0
            for a, k, b in sorted((x["start"], x["kind"], x["end"]) for x in all_spans):
                if a >= end:
                    parts += [text[end:a], f"[{(*KINDS, 'term')[k].upper()}]"]
                end = max(end, b)
            text = "".join([*parts, text[end:]])
        out.append(text)
    return pa.array(out, pa.string())


def sanitised(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with every span of personal data, base or added, replaced by its kind in brackets."""
    _, found = _scanned(docs, id_col, text_col)
    found = found.select("digest", F.concat("base", "added").alias("every"))
    rows = docs.select(F.struct("*").alias("row"), _digest(F.col(text_col)).alias("digest"))
    rows = rows.join(F.broadcast(found) if small(found) else found, "digest", "left")
    text = F.col(f"row.`{text_col}`")
    clean = F.when(F.col("every").isNull(), text).otherwise(F.arrow_udf(_generalise, "string")(text, "every"))
    return rows.select(*((clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op8_private(spark, sf_dir):
    rows = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    by_kind = F.array_sort(F.concat("base", "added"))  # kind as listed, then start
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(written(F.array_sort("base")), 256).alias("base_sha256"),
        written(by_kind).alias("spans"),
    )


def _sql_matches(name: str, kind: int, pattern: str, test: str) -> str:
    """Matches with their places: a match starts after the lengths of all that is before."""
    return f"""
{name} AS (
  SELECT k, {kind} AS kind, start, start + length(v) AS stop, v FROM (
    SELECT k, unnest(m) AS v,
           unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1],
               lambda x: length(x))), 0)))::BIGINT AS start
    FROM (SELECT k, regexp_extract_all(text, $p${pattern}$p$) AS m, string_split_regex(text, $p${pattern}$p$) AS gaps FROM docs
        WHERE regexp_matches(text, $p${pattern}$p$)))
  WHERE {test})"""


_LUHN = "list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE (2 * c::INT) // 10 + (2 * c::INT) % 10 END)) % 10 = 0"
_N_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),"
    + _sql_matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")
    + ","
    + _sql_matches("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: x::HUGEINT > 255)) = 0")
    + ","
    + _sql_matches("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"{_N_DIGITS} BETWEEN 16 AND 19 AND {_LUHN}")
    + ","
    + _sql_matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"{_N_DIGITS} BETWEEN 8 AND 15")
    + r""",
base AS (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone),
lowered AS (SELECT k, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM docs),
counted AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT k, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
    AS term FROM lowered) GROUP BY term),
cut AS (
  SELECT k, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS m, string_split_regex(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS gaps
  FROM lowered WHERE k IN (SELECT k FROM base)),
stepped AS (SELECT k, unnest(m) AS term, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(range(1, len(m) + 1), lambda
    i: length(gaps[i])))::BIGINT AS gap FROM cut),
placed AS (SELECT k, term, (sum(gap + length(term)) OVER (PARTITION BY k ORDER BY i) - length(term))::BIGINT AS start FROM stepped),
free AS (SELECT p.* FROM placed p WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = p.k AND b.start < p.start + length(p.term)
    AND p.start < b.stop)),
held AS (SELECT DISTINCT k, v AS entity FROM base),
n_e AS (SELECT entity, count(*) AS n_e FROM held GROUP BY entity),
n_te AS (SELECT entity, term, count(*) AS n_te FROM held JOIN (SELECT DISTINCT k, term FROM free) USING (k) GROUP BY entity, term),
reveal AS (
  SELECT entity, term FROM n_te JOIN n_e USING (entity) JOIN counted USING (term), (SELECT count(*) AS n FROM docs)
  WHERE n > n_e AND ln(n * n_te / (n_t * n_e)) >= 0.9::DOUBLE * ln(n / n_e)),
added AS (SELECT DISTINCT f.k, 4 AS kind, f.start, f.start + length(f.term) AS stop FROM free f JOIN held USING (k) JOIN reveal USING (entity, term)),
named AS (SELECT k, kind, start, stop, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop AS w
    FROM (SELECT k, kind, start, stop FROM base UNION ALL SELECT * FROM added)),
joined AS (
  SELECT k, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*)
      FILTER (kind = 3) AS n_phone,
         string_agg(w, ',' ORDER BY kind, start) FILTER (kind < 4) AS base, string_agg(w, ',' ORDER BY kind, start) AS spans
  FROM named GROUP BY k)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
    coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (k)
"""
)
