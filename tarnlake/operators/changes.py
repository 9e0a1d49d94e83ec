"""Changes between two snapshots, in one full outer join, and the merge of a change set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import record_hash

KINDS = ["INSERTED", "UPDATED", "UNCHANGED", "DELETED"]


def changes(current: DataFrame, previous: DataFrame | None, keys: list[str]) -> DataFrame:
    """Each key's row (the previous one where it is deleted) with its ``change_type``. No previous: all inserted."""
    if previous is None:
        return current.withColumn("change_type", F.lit("INSERTED"))
    cur = current.select(*keys, F.struct(*current.columns).alias("_cur"), record_hash(current).alias("_h"))
    old = previous.select(
        *keys,
        F.struct(*(F.col(c) if c in previous.columns else F.lit(None).cast(t).alias(c) for c, t in current.dtypes)).alias("_old"),
        record_hash(previous).alias("_g"),
    )
    kind = F.when(F.col("_old").isNull(), "INSERTED").when(F.col("_cur").isNull(), "DELETED").when(F.col("_h") == F.col("_g"),
        "UNCHANGED").otherwise("UPDATED")
    rows = cur.join(old, keys, "full").select(
        F.when(F.col("_cur").isNull(), F.col("_old")).otherwise(F.col("_cur")).alias("_row"),
        kind.alias("change_type"),
    )
    return rows.select("_row.*", "change_type")


def counts(changed: DataFrame) -> DataFrame:
    """One row with the number of each kind."""
    return changed.groupBy().pivot("change_type", KINDS).count().na.fill(0)


def reconciled(changed: DataFrame, n_current: int, n_previous: int) -> None:
    n = counts(changed).first()
    if n.INSERTED + n.UPDATED + n.UNCHANGED != n_current or n.UPDATED + n.UNCHANGED + n.DELETED != n_previous:
        raise ValueError(f"changes {n} against {n_current} current and {n_previous} previous rows")


def merged_soundly(previous: DataFrame, changed: DataFrame, final: DataFrame, keys: list[str]) -> None:
    """Fails unless the merged snapshot's keys are unique and it has the previous rows, plus inserted, less deleted ones."""
    n = counts(changed).first()
    want = previous.count() + n.INSERTED - n.DELETED
    found = final.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if found.repeated:
        raise ValueError(f"{found.repeated} values of {keys} come more than once after the merge")
    if (found["rows"] or 0) != want:
        raise ValueError(f"{want} rows expected after the merge, {found['rows'] or 0} found")


def merged(previous: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """The previous snapshot without updated and deleted keys, with inserted and updated rows."""
    gone = changed.where("change_type in ('UPDATED', 'DELETED')").select(*keys)
    new = changed.where("change_type in ('INSERTED', 'UPDATED')").drop("change_type")
    return previous.join(gone, keys, "left_anti").unionByName(new, allowMissingColumns=True)
