"""Sources, sinks and the batch folder: <root>/<layer>/batch_date=<d>/<dataset>."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import record_hash
from .storage import Storage


class LayerMissing(FileNotFoundError):
    """A layer that an operator needs isn't there."""


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV under a contract: header names and order are checked, and a row that breaks the schema fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def profile_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row: lines, and lines that don't fit the schema (ragged rows or text in a number)."""
    wide = StructType([*schema.fields]).add("_corrupt", "string")
    rows = spark.read.schema(wide).option("header", True).option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(path)
    return rows.select(F.struct(*rows.columns).alias("r")).agg(F.count("*").alias("n_rows"), F.count("r._corrupt").alias("n_broken"))


def layer_root(root: str | Storage, layer: str) -> str:
    return root.path(layer) if isinstance(root, Storage) else f"{root.rstrip('/')}/{layer}"


def layer_path(root: str | Storage, layer: str, batch: str, dataset: str) -> str:
    return f"{layer_root(root, layer)}/batch_date={batch}/{dataset}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def stage_snapshot(spark: SparkSession, root: str | Storage, source: str, batch: str, names: tuple[str, ...], waiting: list[str]) -> str:
    """Copies the whole source snapshot into the batch's incoming folder; nothing stays there unless all of it does.

    All datasets are staged even if one file changed, since validation looks across them. The folder's manifest
    tells what was copied and which files asked for it.
    """
    conf = spark._jsc.hadoopConfiguration()
    folder = f"{layer_root(root, 'incoming')}/batch_date={batch}"
    target, to = _path(spark, folder)
    to.delete(target, True)
    copied = []
    try:
        for name in names:
            file, fs = _path(spark, f"{source.rstrip('/')}/{name}.csv")
            if not fs.exists(file) or not fs.getFileStatus(file).isFile():
                raise FileNotFoundError(f"{source}/{name}.csv")
            copy, _ = _path(spark, f"{folder}/{name}.csv")
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, file, to, copy, False, conf)
            copied.append({"dataset": name, "bytes": to.getFileStatus(copy).getLen()})
        about = spark.createDataFrame([(batch, json.dumps(waiting), json.dumps(copied))], "batch_date string, triggered_by string, files string")
        write_audit(about, f"{folder}/_manifest")
    except Exception:
        to.delete(target, True)
        raise
    return folder


def read_layer(spark: SparkSession, root: str | Storage, layer: str, batch: str, dataset: str) -> DataFrame:
    path = layer_path(root, layer, batch, dataset)
    if not exists(spark, path):
        raise LayerMissing(path)
    return spark.read.parquet(path)


def write_layer(df: DataFrame, root: str | Storage, layer: str, batch: str, dataset: str) -> None:
    df.write.mode("overwrite").parquet(layer_path(root, layer, batch, dataset))


def read_audit(spark: SparkSession, path: str, kind: str = "json", limit: int = 200) -> list[dict]:
    """The first rows of a report that :func:`write_audit` wrote; none where it isn't there."""
    if not exists(spark, path):
        return []
    rows = spark.read.json(path) if kind == "json" else spark.read.option("header", True).csv(path)
    return [r.asDict(recursive=True) for r in rows.limit(limit).collect()]


def write_audit(df: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as one file."""
    one = df.coalesce(1).write.mode("overwrite")
    one.json(path) if kind == "json" else one.option("header", True).csv(path)


def commit(spark: SparkSession, root: str | Storage, batch: str) -> None:
    """Marks the batch as whole: later batches compare with committed ones only."""
    p, fs = _path(spark, f"{layer_root(root, 'committed')}/{batch}")
    fs.create(p, True).close()


def previous_batch(spark: SparkSession, root: str | Storage, batch: str) -> str | None:
    """The latest committed batch before this one."""
    p, fs = _path(spark, layer_root(root, "committed"))
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return max((n for n in names if n < batch), default=None)


def bronze(df: DataFrame, batch: str, keys: list[str], gate: bool = True) -> DataFrame:
    """Technical columns; with ``gate`` a null or repeated primary key fails the batch."""
    out = df.withColumn("record_hash", record_hash(df)).withColumns(
        {"batch_date": F.to_date(F.lit(batch)), "source_file": F.input_file_name(), "ingestion_timestamp": F.current_timestamp()}
    )
    if gate:
        groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
        null = F.lit(False)
        for k in keys:
            null |= F.col(k).isNull()
        found = groups.agg(F.count_if(null).alias("nulls"), F.count_if((F.col("n") > 1) & ~null).alias("repeated")).first()
        if found.nulls or found.repeated:
            raise ValueError(f"{found.nulls} null and {found.repeated} repeated keys in {keys}")
    return out


# The manifest of source files: NEW, CHANGED or UNCHANGED by content, and how far each has come.


def scan_files(root: str, pattern: str, manifest: dict) -> dict:
    """Each file's hash and what it is against the manifest; files that an interrupted run left are pending again."""
    out = {}
    for path in sorted(Path(root).glob(pattern)):
        name, digest = str(path.relative_to(root)), hashlib.sha256(path.read_bytes()).hexdigest()
        old = manifest.get(name)
        change = "NEW" if old is None else "UNCHANGED" if old["sha256"] == digest else "CHANGED"
        done = change == "UNCHANGED" and old["state"] == "PROCESSED"
        out[name] = {"sha256": digest, "change": change, "state": "PROCESSED" if done else "PENDING"}
    return out


STATES = {"PENDING": {"PROCESSING"}, "PROCESSING": {"PROCESSED", "FAILED", "PENDING"}, "FAILED": {"PENDING"}, "PROCESSED": {"PENDING"}}


def advance(manifest: dict, name: str, state: str) -> None:
    if state not in STATES[manifest[name]["state"]]:
        raise ValueError(f"{name}: {manifest[name]['state']} to {state}")
    manifest[name]["state"] = state


def save_manifest(manifest: dict, path: str) -> None:
    """Written beside and moved into place."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(manifest, indent=1, sort_keys=True))
    os.replace(part, path)
