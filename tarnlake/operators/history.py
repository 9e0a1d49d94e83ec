"""Type 2 history of a dimension, and the lookup of the version that held at a date. Intervals are closed; null is open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_of

OPEN = "1900-01-01"


def begun(rows: DataFrame, batch: str, version: int = 1, since: str = OPEN) -> DataFrame:
    return rows.withColumns(
        {
            "effective_from": F.to_date(F.lit(since)),
            "effective_to": F.lit(None).cast("date"),
            "is_current": F.lit(True),
            "record_version": F.lit(version),
            "scd_initial_load_date": F.to_date(F.lit(batch)) if since == OPEN else F.lit(None).cast("date"),
        }
    )


def advanced(history: DataFrame, changed: DataFrame, batch: str, keys: list[str]) -> DataFrame:
    """Expires the current version of updated and deleted keys the day before the batch; inserted keys start at version 1."""
    marks = changed.where("change_type in ('UPDATED', 'DELETED')").select(*keys, F.lit(True).alias("_ends"))
    ends = F.coalesce("_ends", F.lit(False)) & F.col("is_current")
    old = history.join(marks, keys, "left").withColumns(
        {
            "effective_to": F.when(ends, F.date_sub(F.to_date(F.lit(batch)), 1)).otherwise(F.col("effective_to")),
            "is_current": F.col("is_current") & ~ends,
        }
    ).drop("_ends")
    new = begun(changed.where("change_type in ('INSERTED', 'UPDATED')"), batch, 1, batch)
    last = history.groupBy(*keys).agg(F.max("record_version").alias("_last"))
    version = F.when(F.col("change_type") == "UPDATED", F.coalesce("_last", F.lit(0)) + 1).otherwise(F.lit(1)).cast("int")
    new = new.join(last, keys, "left").withColumn("record_version", version).drop("_last", "change_type")
    return old.unionByName(new, allowMissingColumns=True)


def sound(history: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys with several current versions, intervals that end before they begin, current versions that end."""
    per_key = history.groupBy(*keys).agg(
        F.count_if("is_current").alias("n"),
        F.count_if(F.col("effective_to") < F.col("effective_from")).alias("back"),
        F.count_if(F.col("is_current") & F.col("effective_to").isNotNull()).alias("ended"),
    )
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("several_current"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("backwards"),
        F.coalesce(F.sum("ended"), F.lit(0)).alias("current_ended"),
    )


def version_key(key: str):
    return key_of(F.col(key), F.col("effective_from"), F.col("record_version"))


def as_of(facts: DataFrame, history: DataFrame, key: str, date: str, name: str) -> DataFrame:
    """``name``: the surrogate key of the version that held on the fact's date; the newest where several did; null where none.

    A key's versions travel as one array, so facts are shuffled once, by that key, and never ranked.
    """
    order = F.coalesce("record_version", F.lit(-(2**31))).alias("nth")
    version = F.struct("effective_from", order, "effective_to", version_key(key).alias("sk"))
    versions = history.where("effective_from is not null").groupBy(F.col(key).alias("_k")).agg(
        F.array_sort(F.collect_list(version)).alias("_versions")
    )
    day = F.col(date)
    held = F.filter("_versions", lambda v: (day >= v["effective_from"]) & (v["effective_to"].isNull() | (day <= v["effective_to"])))
    rows = facts.join(versions, F.col(key) == F.col("_k"), "left")
    return rows.withColumn(name, F.try_element_at(held, F.lit(-1))["sk"]).drop("_k", "_versions")


def version_at(facts: DataFrame, history: DataFrame, key: str, date: str, name: str) -> DataFrame:
    """As :func:`as_of`, but ``name`` is what the surrogate key is made of: two short fields instead of 64 characters."""
    order = F.coalesce("record_version", F.lit(-(2**31))).alias("nth")
    version = F.struct("effective_from", order, "effective_to", "record_version")
    versions = history.where("effective_from is not null").groupBy(F.col(key).alias("_k")).agg(
        F.array_sort(F.collect_list(version)).alias("_versions")
    )
    day = F.col(date)
    held = F.filter("_versions", lambda v: (day >= v["effective_from"]) & (v["effective_to"].isNull() | (day <= v["effective_to"])))
    last = F.try_element_at(held, F.lit(-1))
    rows = facts.join(versions, F.col(key) == F.col("_k"), "left")
    kept = F.when(last.isNotNull(), F.struct(last["effective_from"].alias("since"), last["record_version"].alias("version")))
    return rows.withColumn(name, kept).drop("_k", "_versions")


def key_at(key: str, name: str):
    """The surrogate key of a version found by :func:`version_at`."""
    return F.when(F.col(name).isNotNull(), key_of(F.col(key), F.col(f"{name}.since"), F.col(f"{name}.version")))


def unmatched(facts: DataFrame, *names: str) -> DataFrame:
    """Rows without one of the surrogate keys."""
    test = F.lit(False)
    for n in names:
        test |= F.col(n).isNull()
    return facts.where(test)


def enriched_soundly(facts: DataFrame, source: DataFrame, key: str, names: list[str], shown: int = 10) -> None:
    """The gate of enriched facts: each row has its surrogate keys, the fact's key is unique, and no row came or went.

    Of rows without a key some are shown in the error.
    """
    lost = unmatched(facts, *names)
    if n := lost.count():
        examples = [
            r.asDict() for r in lost.select(key, *(c for c in facts.columns if c.endswith("_id") and c != key), *names).limit(shown).collect()
        ]
        raise ValueError(f"{n} rows of {key} without {names} at their date, such as {examples}")
    repeated = facts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").count()
    if repeated:
        raise ValueError(f"{repeated} values of {key} come more than once after enrichment")
    before, after = source.count(), facts.count()
    if before != after:
        raise ValueError(f"{key}: {before} rows before enrichment, {after} after")


def assembled(previous: DataFrame, changed: DataFrame, final: DataFrame) -> None:
    """Fails unless the new history has the previous one's rows and one for each inserted or updated key."""
    came = changed.where("change_type in ('INSERTED', 'UPDATED')").count()
    if (want := previous.count() + came) != (got := final.count()):
        raise ValueError(f"history has {got} rows, {want} expected")
