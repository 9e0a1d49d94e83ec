"""Column expressions that every layer shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Columns that a record's hash leaves out.
TECHNICAL = ("validation_timestamp", "batch_date", "source_file", "ingestion_timestamp", "record_hash")


def missing(c: Column) -> Column:
    """Null, blank, or a word that stands for null."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "null", "none", "nan")


def require(df: DataFrame, names: list[str], table: str) -> None:
    """Fails where the table lacks any of the columns."""
    if lacking := [n for n in names if n not in df.columns]:
        raise ValueError(f"{table} is missing required columns: {lacking}")


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that the table has, in the list's order."""
    return df.select(*(n for n in names if n in df.columns))


def first_present(df: DataFrame, *names: str) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} among {df.columns}")


def key_of(*parts: Column) -> Column:
    """sha256 of the parts as text, null written NULL, joined by ``||``."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts)), 256)


def record_hash(df: DataFrame) -> Column:
    return key_of(*(F.col(c) for c in df.columns if c not in TECHNICAL))


def instant(c: Column, loose: bool = False) -> Column:
    """A timestamp in either of the two formats, else null; with ``loose`` also in any that Spark reads by itself."""
    formats = [F.try_to_timestamp(c, F.lit(x)) for x in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")]
    return F.coalesce(*formats, *([F.try_to_timestamp(c)] if loose else []))


def title(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(c)))


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def ratio(a: Column, b: Column) -> Column:
    """Money over a count, to the nearest cent, halves up, by whole numbers; 0 where the divisor is 0 or null."""
    count = F.when(b > 0, b.cast("bigint"))
    doubled = 2 * (a * 100).cast("bigint") + count
    cents = (doubled - F.pmod(doubled, 2 * count)) / (2 * count)
    return F.coalesce(cents.cast("double") / 100, F.lit(0.0))
