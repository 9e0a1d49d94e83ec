"""Made-up days through the lake, the strict profile, the snapshot of sources, paths and the stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake import run as batch
from tarnlake.operators import strict
from tarnlake.sources import files, generate, snapshot
from tarnlake.sources.storage import LAYERS, Storage, joined
from tarnlake.streaming.ingest import follow


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """Folders of a clean day, the day after and a dirty day."""
    base = tmp_path_factory.mktemp("days")
    read = lambda d: {n: files.read_csv(spark, f"{base}/{d}/{n}.csv", StructType.fromDDL(batch.SCHEMAS[n])) for n in batch.NAMES}
    generate.write(generate.clean(spark, 200, 40, 300), f"{base}/one")
    generate.write(generate.next_day(read("one"), "2026-07-21", upgrades=20, moves=10, sign_ups=8, prices=6, orders=60), f"{base}/two")
    generate.write(generate.dirty(read("one")), f"{base}/dirty")
    return base, read


def test_two_made_up_days_run_through(spark, days, tmp_path):
    base, read = days
    one, two = read("one"), read("two")
    assert {n: one[n].count() for n in ("customers", "products", "orders", "payments")} == {"customers": 200, "products": 40, "orders": 300, "payments": 300}
    assert two["customers"].count() == 208 and two["orders"].count() == 360
    assert two["order_items"].where("quantity = -2").count() == 8 and two["order_items"].where("product_id = 'PROD99999'").count() == 5
    assert two["orders"].where("customer_id = 'CUST999999'").count() == 6 and two["payments"].where("payment_amount is null").count() == 5
    root = Storage(root=str(tmp_path / "lake"))
    manifest = str(tmp_path / "m.json")
    assert len(batch.ingest(spark, root, f"{base}/one", "*.csv/part-*.csv", None, manifest, scan_only=True)["waiting"]) >= 5
    assert batch.ingest(spark, root, f"{base}/one", "*.csv/part-*.csv", "2026-07-20", manifest)["status"] == "SUCCESS"
    assert batch.ingest(spark, root, f"{base}/one", "*.csv/part-*.csv", "2026-07-20", manifest)["waiting"] == []
    assert batch.run(spark, root, None, "2026-07-20", "changes")["status"] == "SUCCESS"
    assert batch.run(spark, root, f"{base}/two", "2026-07-21")["status"] == "SUCCESS"
    kinds = {r.change_type: r["count"] for r in files.read_layer(spark, root, "changes", "2026-07-21", "customers").groupBy("change_type").count().collect()}
    assert kinds["INSERTED"] == 8 and 20 <= kinds["UPDATED"] <= 30 and "DELETED" not in kinds
    assert files.read_layer(spark, root, "quarantine", "2026-07-21", "order_items").count() >= 13
    facts = batch.snapshot(spark, root, f"{base}/two", "2026-07-21")
    assert facts["layers"]["gold"] == ["dim_customer", "dim_date", "dim_product", "fact_payment", "fact_sales"]
    assert facts["source_files"]["orders"]["rows_excluding_header"] == 360 and facts["source_files"]["orders"]["ends_with_newline"]
    assert [r.status for r in snapshot.run_index(spark, root).collect()] == ["SUCCESS"] * 3


def test_strict_profile_finds_the_defects(spark, days):
    tables = days[1]("dirty")
    checked = strict.everything(tables, F.lit("2027-01-01").cast("timestamp"))
    count = lambda name, code: checked[name].where(F.col("rejection_reason").contains(code)).count()
    assert count("customers", "INVALID_VALUE:customer_segment") >= 5 and count("customers", "MISSING_REQUIRED_VALUE:email") >= 1
    assert count("products", "INVALID_NUMERIC_VALUE:price") >= 5 and count("orders", "INVALID_OR_FUTURE_DATE:order_date") >= 5
    assert count("order_items", "OUT_OF_RANGE:discount_percentage") >= 10 and count("payments", "INVALID_FOREIGN_KEY:order_id") >= 10
    assert all(checked[n].count() == tables[n].count() for n in tables)
    good = strict.split(checked["orders"])[0]
    assert good.join(strict.split(checked["customers"])[0], "customer_id", "left_anti").count() == 0
    rows = {r.dataset_name: r for r in strict.audit(checked).collect()}
    assert all(r.input_record_count == r.valid_record_count + r.invalid_record_count for r in rows.values()) and rows["customers"].invalid_record_count >= 20
    with pytest.raises(ValueError):
        strict.everything({**tables, "customers": tables["customers"].drop("city")})


def test_strict_audit_of_nothing(spark, days):
    checked = strict.everything({n: df.limit(0) for n, df in days[1]("one").items()})
    assert {(r.input_record_count, r.validation_success_rate) for r in strict.audit(checked).collect()} == {(0, 0.0)}


def test_facts_of_a_broken_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_id,product_name,category,brand,currency,price\nP1,a,b,c,EUR,N/A\nP1,a,b,c,EUR,2\nP2,a")
    found = snapshot.source_facts(spark, str(tmp_path / "p.csv"), StructType.fromDDL(batch.SCHEMAS["products"]), "product_id")
    assert found["added_columns"] == ["currency"] and found["missing_columns"] == ["stock_quantity"] and not found["ends_with_newline"]
    assert found["rows_excluding_header"] == 3 and found["rows_with_wrong_column_count"] == 1 and found["duplicate_primary_keys"] == 1
    assert found["values_not_matching_schema_type"] == [{"column": "price", "expected_type": "double", "rows": 1, "examples": ["N/A"]}]
    assert snapshot.source_facts(spark, str(tmp_path / "none.csv"), StructType(), "x") == {"exists": False}


def test_paths():
    cloud = Storage.from_env({"STORAGE_MODE": "ADLS", "ADLS_STORAGE_ACCOUNT": "acc", "ADLS_GOLD_CONTAINER": "mine"})
    assert cloud.path("gold", "batch_date=2026-01-01") == "abfss://mine@acc.dfs.core.windows.net/batch_date=2026-01-01"
    assert cloud.path("cdc", "", None, "/x/") == "abfss://silver@acc.dfs.core.windows.net/cdc/x"
    assert files.layer_path(cloud, "silver", "d", "orders") == "abfss://silver@acc.dfs.core.windows.net/standardized/batch_date=d/orders"
    assert Storage(root="/data").path("bronze", "a", "b") == "/data/bronze/a/b" and len(LAYERS) == 17
    assert joined("s3://b/", "x") == "s3://b/x" and joined("/a/", "b") == "/a/b"
    with pytest.raises(KeyError):
        cloud.path("other")
    with pytest.raises(ValueError):
        Storage.from_env({"STORAGE_MODE": "adls"}).path("gold")
    with pytest.raises(ValueError):
        Storage("ftp")


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, root, schema = tmp_path / "in", str(tmp_path / "lake"), StructType.fromDDL("id string, v int")
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\nx,1\ny,2\n,9\n")
    take = lambda: follow(spark, str(folder), schema, ["id"], root, "things")
    rows = lambda path: sorted(map(tuple, spark.read.parquet(path).collect()))
    assert rows(take()) == [("x", 1), ("y", 2)]
    (folder / "b.csv").write_text("id,v\ny,3\nz,4\n")
    assert rows(take()) == [("x", 1), ("y", 3), ("z", 4)]
    assert take() is None
