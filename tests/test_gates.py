"""The gates between the layers, what a failure tells, staging, and the order of reports: each fails without its part."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnlake import run as batch
from tarnlake.functions.columns import first_present, instant
from tarnlake.operators import assertions, changes, cleaning, history, star, validation
from tarnlake.plans import marts, queries
from tarnlake.sources import files

from test_lake import SF, day_one, source


def test_root_error_is_the_innermost_cause():
    lines = [
        "24/01/01 10:00:00 ERROR Executor: Exception in task 0.0 in stage 1.0 (TID 1)",
        "org.apache.spark.SparkException: [FAILED_READ_FILE.NO_HINT] Encountered error while reading file a.csv.",
        "Caused by: org.apache.spark.SparkException: [MALFORMED_RECORD_IN_PARSING.WITHOUT_SUGGESTION] Malformed",
        'Caused by: java.lang.NumberFormatException: For input string: "x"',
        "\tat org.apache.spark.Something(Some.scala:1)",
        "Traceback (most recent call last):",
        "py4j.protocol.Py4JJavaError: An error occurred while calling o1.parquet.",
        "some.module.PipelineExecutionError: stage failed with exit code 1.",
    ]
    found = batch.failure(lines)
    assert found["root_error"] == 'java.lang.NumberFormatException: For input string: "x"'
    assert found["error_type"] == "some.module.PipelineExecutionError"
    assert not any(x.startswith(("Traceback", "24/01/01")) for x in found["key_error_lines"])


def test_root_error_without_a_cause_is_the_first_that_wraps_nothing():
    found = batch.failure(["m.PipelineExecutionError: failed", "ValueError: orders has 8 repeated keys", "m.PipelineExecutionError: failed"])
    assert found["root_error"] == "ValueError: orders has 8 repeated keys" and len(found["key_error_lines"]) == 2
    assert batch.failure(["/x/lib/site-packages/a.py: ValueError: no"])["root_error"] is None
    assert batch.cause(ValueError("plain"))["cause"] == "ValueError: plain"


def test_refunds_of_the_source_are_kept(spark):
    made = "select 'Y' || id as payment_id, 'O1' as order_id, 'K' as order_sk, status as payment_status, cast(10 as decimal(18,2)) as payment_amount, {} date'2024-01-01' as payment_day from values (1, 'REFUNDED'), (2, 'SUCCESS'), (3, 'REFUNDED') as t(id, status)"
    orders = spark.sql("select 'O1' as order_id, 'K' as order_sk, 'C' as customer_sk")
    told = spark.sql(made.format("case id when 1 then 3.00bd when 2 then null else 0 end as refund_amount,"))
    get = lambda df: {r.payment_id: (r.refund_amount, r.net_payment_amount) for r in star.fact_payment(df, orders).collect()}
    assert get(told) == {"Y1": (Decimal("3.00"), Decimal("7.00")), "Y2": (Decimal("0.00"), Decimal("10.00")), "Y3": (Decimal("0.00"), Decimal("10.00"))}
    assert get(spark.sql(made.format(""))) == {"Y1": (Decimal("10.00"), Decimal("0.00")), "Y2": (Decimal("0.00"), Decimal("10.00")), "Y3": (Decimal("10.00"), Decimal("0.00"))}


def test_a_third_timestamp_format_is_for_typed_rows_only(spark):
    text = spark.sql("select * from values ('2024-01-02T03:04:05'), ('2024-01-02 03:04:05'), ('soon') as t(x)")
    assert [r[0] is not None for r in text.select(instant(F.col("x"), loose=True)).collect()] == [True, True, False]
    assert [r[0] is not None for r in text.select(instant(F.col("x"))).collect()] == [False, True, False]
    orders = text.select(F.lit("O").alias("order_id"), F.lit("new").alias("order_status"), F.col("x").alias("order_date"))
    assert [r.order_year for r in cleaning.orders(orders).collect()] == [2024, 2024, None]


def test_enrichment_gate(spark):
    facts = spark.sql("select * from values (1, 'a', 'C1'), (2, 'b', 'C2') as t(order_item_id, order_sk, customer_id)")
    history.enriched_soundly(facts, facts, "order_item_id", ["order_sk"])
    with pytest.raises(ValueError, match="without .*'customer_id': 'C9'"):
        history.enriched_soundly(facts.unionAll(spark.sql("select 3, null, 'C9'")), facts, "order_item_id", ["order_sk"])
    with pytest.raises(ValueError, match="more than once"):
        history.enriched_soundly(facts.unionAll(facts.limit(1)), facts, "order_item_id", ["order_sk"])
    with pytest.raises(ValueError, match="2 rows before enrichment, 1 after"):
        history.enriched_soundly(facts.limit(1), facts, "order_item_id", ["order_sk"])


def test_merge_and_history_gates(spark):
    old = spark.sql("select * from values (1, 'a'), (2, 'b') as t(id, v)")
    changed = spark.sql("select * from values (2, 'c', 'UPDATED'), (1, 'a', 'DELETED'), (3, 'd', 'INSERTED') as t(id, v, change_type)")
    good = changes.merged(old, changed, ["id"])
    changes.merged_soundly(old, changed, good, ["id"])
    with pytest.raises(ValueError, match="2 rows expected after the merge, 3 found"):
        changes.merged_soundly(old, changed, good.unionAll(spark.sql("select 9, 'x'")), ["id"])
    with pytest.raises(ValueError, match="more than once"):
        changes.merged_soundly(old, changed, good.unionAll(good), ["id"])
    first = history.begun(old, "2024-01-01")
    history.assembled(first, changed, history.advanced(first, changed, "2024-01-02", ["id"]))
    with pytest.raises(ValueError, match="2 rows, 4 expected"):
        history.assembled(first, changed, first)


def test_a_batch_that_loses_rows_fails(spark, tmp_path, monkeypatch):
    folder = source(tmp_path / "d", day_one())
    write = files.write_layer

    def losing(layer, name):
        monkeypatch.setattr(files, "write_layer", lambda df, root, to, b, n: write(df.limit(1) if (to, n) == (layer, name) else df, root, to, b, n))

    for layer, stage in (("bronze", "bronze"), ("typed", "silver"), ("enriched", "facts")):
        losing(layer, "orders")
        log = batch.run(spark, str(tmp_path / layer), folder, "2026-01-10")
        assert (log["status"], log["stages"][-1]["stage"]) == ("FAILED", stage), log


def test_required_columns(spark):
    t = queries.build(spark, SF)
    with pytest.raises(ValueError, match="fact_sales is missing required columns: .'quantity'"):
        assertions.suite(t | {"fact_sales": t["fact_sales"].drop("quantity")}, t)
    rows = t["fact_payment"].withColumn("customer_sk", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        star.gated(rows, *[star.REQUIRED["fact_payment"][0], star.REQUIRED["fact_payment"]])
    with pytest.raises(ValueError, match="effective_from"):
        star.dim_customer(t["dim_customer"].drop("effective_from"))


def test_dimensions_keep_listed_columns_only(spark):
    rows = history.begun(spark.sql("select 'C1' as customer_id, 'x' as internal_note, 'active' as customer_status"), "2024-01-01")
    made = star.dim_customer(rows)
    assert "internal_note" not in made.columns and made.first().is_active
    goods = history.begun(spark.sql("select 'P1' as product_id, 'x' as note, 4.0bd as unit_price, 3.0bd as cost_price"), "2024-01-01")
    assert "note" not in star.dim_product(goods).columns and star.dim_product(goods).first().margin_percentage == 25
    assert first_present(rows, "status", "customer_status") == "customer_status"
    with pytest.raises(ValueError):
        first_present(rows, "status")


def test_order_of_marts_and_reports(spark):
    t = queries.build(spark, SF)
    days = [r.order_date for r in marts.daily_sales(t["fact_sales"]).collect()]
    assert days == sorted(days) and len(days) > 1
    worth = [r.net_revenue for r in marts.product_performance(t["fact_sales"], t["dim_product"]).collect()]
    assert worth == sorted(worth, reverse=True)
    spent = [r.total_spent for r in marts.customer_performance(t["fact_sales"], t["dim_customer"]).collect()]
    assert spent == sorted(spent, reverse=True)
    found = [(r.dataset, -r.failed) for r in validation.report(validation.everything(queries._raw(spark, SF))).collect()]
    assert found == sorted(found)


def test_snapshots_are_staged_whole_or_not_at_all(spark, tmp_path):
    folder, root = source(tmp_path / "d", day_one()), str(tmp_path / "lake")
    staged = files.stage_snapshot(spark, root, folder, "2026-01-10", batch.NAMES, ["orders.csv"])
    assert {f"{n}.csv" for n in batch.NAMES} <= {p.name for p in (tmp_path / "lake/incoming/batch_date=2026-01-10").iterdir()}
    about = files.read_audit(spark, f"{staged}/_manifest")
    assert json.loads(about[0]["triggered_by"]) == ["orders.csv"] and len(json.loads(about[0]["files"])) == 5
    (tmp_path / "d/payments.csv").unlink()
    with pytest.raises(FileNotFoundError):
        files.stage_snapshot(spark, root, folder, "2026-01-10", batch.NAMES, [])
    assert not (tmp_path / "lake/incoming/batch_date=2026-01-10").exists()
    assert files.read_audit(spark, str(tmp_path / "nothing")) == []


def test_reports_as_csv(spark, tmp_path):
    files.write_audit(spark.sql("select 1 as a, 'x' as b"), str(tmp_path / "r"), "csv")
    assert files.read_audit(spark, str(tmp_path / "r"), "csv") == [{"a": "1", "b": "x"}]


def test_strict_profile_of_a_batch(spark, tmp_path):
    batch.strict_batch(spark, str(tmp_path / "lake"), source(tmp_path / "d", day_one()), "2026-01-10")
    kept = files.read_layer(spark, str(tmp_path / "lake"), "processed", "2026-01-10", "orders")
    held = files.read_layer(spark, str(tmp_path / "lake"), "quarantine", "2026-01-10", "strict_orders")
    assert kept.count() + held.count() == 3
