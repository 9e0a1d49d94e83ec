"""What a run found: facts of the source files, the layers that a batch has written, and the index of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from .files import _path, exists, layer_root


def _bytes(spark: SparkSession, path: str) -> tuple[int, bool]:
    """Size of the file or of the files of a folder, and whether each of them ends with a newline."""
    p, fs = _path(spark, path)
    size, whole = 0, True
    for f in fs.listStatus(p):
        if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            size += f.getLen()
            stream = fs.open(f.getPath())
            stream.seek(f.getLen() - 1)
            whole &= stream.read() == 10
            stream.close()
    return size, whole


def source_facts(spark: SparkSession, path: str, schema: StructType, key: str) -> dict:
    """Rows, ragged rows, columns too many or missing, values that don't cast, and repeated keys of a CSV source: one pass."""
    if not exists(spark, path):
        return {"exists": False}
    size, whole = _bytes(spark, path)
    header = spark.read.option("header", True).csv(path).columns
    wanted = schema.names
    as_text = StructType()
    for c in header:
        as_text.add(c, "string")
    rows = spark.read.schema(as_text.add("_corrupt", "string")).option("header", True).option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning",
        False).csv(path)
    rows = rows.select(F.struct(*rows.columns).alias("r"))
    numbers = [f for f in schema.fields if isinstance(f.dataType, NumericType) and f.name in header]
    measures = [F.count("*").alias("rows"), F.count("r._corrupt").alias("ragged")]
    if key in header:
        measures.append((F.count("*") - F.countDistinct(F.coalesce(f"r.{key}", F.lit("")))).alias("repeated"))
    for k, f in enumerate(numbers):
        c = F.trim(f"r.{f.name}")
        bad = F.when((c != "") & c.try_cast(f.dataType).isNull(), c)
        measures += [F.count(bad).alias(f"bad{k}"), F.min(bad).alias(f"low{k}"), F.max(bad).alias(f"high{k}")]
    found = rows.agg(*measures).first().asDict()
    unfit = [
        {
            "column": f.name,
            "expected_type": f.dataType.typeName(),
            "rows": found[f"bad{k}"],
            "examples": sorted({found[f"low{k}"], found[f"high{k}"]}),
        }
        for k, f in enumerate(numbers) if found[f"bad{k}"]
    ]
    return {
        "exists": True, "size_bytes": size, "ends_with_newline": whole, "rows_excluding_header": found["rows"], "rows_with_wrong_column_count":
            found["ragged"],
        "received_columns": header, "added_columns": [c for c in header if c not in wanted], "missing_columns": [c for c in wanted
            if c not in header],
        "primary_key": key, "duplicate_primary_keys": found.get("repeated"), "values_not_matching_schema_type": unfit,
    }


def layers_present(spark: SparkSession, root, batch: str, layers: tuple[str, ...]) -> dict[str, list[str]]:
    """The datasets that each layer holds of a batch."""
    out = {}
    for layer in layers:
        p, fs = _path(spark, f"{layer_root(root, layer)}/batch_date={batch}")
        out[layer] = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []
    return out


def run_index(spark: SparkSession, root) -> DataFrame:
    """A row for each run of any batch: its log and when it began."""
    return spark.read.schema(
        "run_id string, batch_date string, status string, started_at string, log string"
    ).json(f"{layer_root(root, 'audit')}/batch_date=*/runs/*").orderBy("started_at")
