"""Operator 2: mixing sources to target weights, by systematic sampling. DataFrame functions only.

A document's expected copies are its source's target over its source's size. Within a source the
documents stand in an order that puts like sizes side by side; the expected copies are summed along it,
one random offset is added, and a document is emitted once for each integer that its stretch crosses.

The running sum needs a document's rank in its source. A source can hold a third of all rows, so the rank
is the number of documents in earlier blocks (a block: source, size class, 8 bits of a hash) plus the
place in the block; no task sorts a source. A source has at most some 500 size classes x 256 blocks.

Nulls: a null text has size 0; a null source is a source of its own, the last; null ids sort first.
Empty table: no rows. Repeated rows: each is a document. Ties in the order are broken by id and size; rows alike
in id and text are alike, and all in one block. Other columns are carried as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, 7
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between white space; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size`` with ``target`` and ``rate``: one row a source, as many as the mix names.

    Sources that reach ``cap`` times their size keep that; the rest share what is left by weight. Ordered by
    size over weight, the sources that stop are a prefix, so one ordered pass finds the final level.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(by_source) - 1
    rows = per_source.select(
        "source",
        "source_size",
        F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights)))).alias("weight"),
        place.alias("place"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("goal"),
    ).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("goal") - before) / after)
    stops = F.col("most") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~stops, F.struct("place_in_order", "level"))).over(everything)["level"]
    rows = rows.withColumn("place_in_order", F.row_number().over(order))
    target = F.when(stops, F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def _fraction(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    id_col="doc_id",
    text_col="text",
    source_col="source",
    weights=WEIGHTS,
    share=SHARE,
    cap=CAP,
    seed=SEED,
    carry: bool = False,
) -> DataFrame:
    """One row a document: ``doc_id, source, size, source_size, target, copies, taken``; with ``carry`` also ``row``, all its columns."""
    # of the text too: null or repeated ids don't put their documents side by side
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    ident = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("name"),  # the source as a key that is never null
        word_count(F.col(text_col)).alias("size"),
        ident.alias("ident"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    bits = F.bin("size")
    rows = thin.withColumns({"length": F.length(bits), "lead": F.substring(bits, 1, 4), "part": F.substring("ident", 1, 2)})
    if not carry:  # else the texts would be written once more; they are counted a second time instead
        rows = stored(rows, "mix")
    key = ["length", "lead", "part"]
    blocks = rows.groupBy("name", "source", *key).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    blocks = stored(blocks, "mix-blocks")
    goals = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goals = goals.withColumn("offset", _fraction(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))))
    goals = goals.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    along = Window.partitionBy("name").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("source", "n", "words").join(goals, "name")
    # the documents are dealt by block once, for their place in it and for what the block brings
    inside = Window.partitionBy("name", *key).orderBy("ident", "doc_id", "size")
    out = rows.withColumn("place", F.row_number().over(inside)).join(blocks, ["name", *key]).withColumn("rank", F.col("before") + F.col("place"))
    upto = F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    upto_last = F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    copies = F.least(upto - upto_last, F.ceil("rate")).cast("long")  # the bound only guards against rounding
    return out.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else [])
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: the carried row of each document, once for each copy, numbered in ``copy`` (``copy_1`` and so on where
        the documents have that) from 1."""
    some = mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("number"))
    names = [c.lower() for c in some.select("row.*").columns]
    name = next(c for c in ("copy", *(f"copy_{k}" for k in range(1, len(names) + 2))) if c not in names)
    return some.select("row.*", F.col("number").alias(name))


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ident
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal, source_size * 2 AS most
  FROM per),
levels AS (
  SELECT *, row_number() OVER o AS nth,
         (goal - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / weight, place)),
cut AS (SELECT level AS final FROM levels WHERE most > level * weight ORDER BY nth LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most::DOUBLE ELSE (SELECT final FROM cut) * weight END AS target,
         ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels),
ranked AS (
  SELECT s.*, g.source_size, g.target, g.shift, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY length(bin(size)), substr(bin(size), 1, 4), ident, doc_id NULLS FIRST, size) AS rank
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       (floor(rank * rate + shift) - floor((rank - 1) * rate + shift))::BIGINT AS copies,
       (floor(rank * rate + shift) - floor((rank - 1) * rate + shift))::BIGINT * size AS taken
FROM ranked
"""
