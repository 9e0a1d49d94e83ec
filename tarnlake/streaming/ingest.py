"""Files that keep arriving, taken up by Structured Streaming into versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import record_hash
from ..operators.changes import changes, merged
from ..sources.files import exists, layer_root


def newest(rows: DataFrame, keys: list[str], arrived: str) -> DataFrame:
    """The last row of each key to arrive; of those of one file the one with the largest hash."""
    own = [c for c in rows.columns if c != arrived]
    order = F.struct(F.col(arrived), record_hash(rows.select(*own)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), order).alias("_row")).select("_row.*")


def follow(
    spark: SparkSession,
    source: str,
    schema: StructType,
    keys: list[str],
    root,
    dataset: str,
    accept: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> str | None:
    """Takes all files of ``source`` not yet taken (the checkpoint knows which) and stops; returns the latest version's path.

    Each micro-batch passes ``accept`` (validation, say), is compared with the version before, and is written as
    the next one: inserted and updated rows replace, keys that don't arrive stay. A micro-batch that is run again
    after a failure overwrites its own version, so nothing is taken twice. Null keys don't arrive.
    """
    base = f"{layer_root(root, 'stream')}/{dataset}"
    last: list[str] = []

    def land(rows: DataFrame, number: int) -> None:
        path, before = f"{base}/version={number}", f"{base}/version={number - 1}"
        rows = newest(accept(rows).dropna(subset=keys), keys, "_arrived")
        old = spark.read.schema(rows.schema).parquet(before) if exists(spark, before) else None
        found = changes(rows, old, keys).where("change_type in ('INSERTED', 'UPDATED')")
        out = merged(old, found, keys) if old is not None else found.drop("change_type")
        out.write.mode("overwrite").parquet(path)
        last.append(path)

    stream = spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST").csv(source).select(
        "*",
        F.col("_metadata.file_modification_time").alias("_arrived"),
    )
    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return last[-1] if last else None
