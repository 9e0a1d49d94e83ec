"""The star: dimensions, facts, and the gate before they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONEY, key_of, money, present, require
from .history import as_of, version_key

# Fixed values.
ACTIVE = ("ACTIVE", "ENABLED", "CURRENT")
PAID = ("SUCCESS", "SUCCESSFUL", "COMPLETED", "PAID", "CAPTURED")


#: Columns that a dimension may have, in order.
CUSTOMER = (
    "customer_sk customer_id customer_full_name customer_name first_name last_name email phone gender city state country postal_code "
    "customer_segment customer_status status signup_date registration_date date_of_birth"
).split()
PRODUCT = "product_sk product_id product_name category subcategory brand supplier price unit_price cost_price stock_quantity quantity_available product_status status".split()
VERSION = "effective_from effective_to is_current record_version scd_initial_load_date record_hash batch_date ingestion_timestamp".split()
#: Key and required columns of each table of the star.
REQUIRED = {
    "dim_customer": ["customer_sk"],
    "dim_product": ["product_sk"],
    "dim_date": ["date_key"],
    "fact_sales": ["sales_sk", "order_sk", "customer_sk", "product_sk"],
    "fact_payment": ["payment_sk", "order_sk", "customer_sk"],
}


def dim_customer(history: DataFrame) -> DataFrame:
    require(history, ["customer_id", "effective_from", "record_version"], "the history of customers")
    rows = present(history.withColumn("customer_sk", version_key("customer_id")), [*CUSTOMER, *VERSION])
    status = next((c for c in ("customer_status", "status") if c in rows.columns), None)
    return rows.withColumn("is_active", F.upper(status).isin(*ACTIVE) if status else F.col("is_current"))


def dim_product(history: DataFrame) -> DataFrame:
    require(history, ["product_id", "effective_from", "record_version"], "the history of products")
    out = present(history.withColumn("product_sk", version_key("product_id")), [*PRODUCT, *VERSION])
    price = next((c for c in ("price", "unit_price") if c in out.columns), None)
    if price and "cost_price" in out.columns:
        margin = F.col(price) - F.col("cost_price")
        share = F.when(F.col(price) > 0, F.round(margin * 100 / F.col(price), 2))
        out = out.withColumns({"unit_margin": money(margin), "margin_percentage": share})
    return out


def dim_date(*days: DataFrame) -> DataFrame:
    """A row for each day from the first to the last date of the given one-column relations."""
    every = days[0].toDF("d")
    for other in days[1:]:
        every = every.unionAll(other.toDF("d"))
    span = every.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null")  # one row, never collected
    d = F.col("d")
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d")).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d.alias("calendar_date"), F.dayofmonth(d).alias("day_number"),
            F.date_format(d, "EEEE").alias("day_name"),
        F.dayofweek(d).alias("day_of_week"), F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month_number"), F.date_format(d,
            "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter_number"), F.concat(F.lit("Q"), F.quarter(d)).alias("quarter_name"), F.year(d).alias("year_number"),
            F.date_format(d, "yyyy-MM").alias("year_month"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )


def enriched_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    out = as_of(orders, customers, "customer_id", "order_day", "customer_sk")
    return out.withColumn("order_sk", key_of(F.lit("ORDER"), F.col("order_id")))


#: What items take from their order, in the one join with it.
CONTEXT = ["order_id", "order_sk", "customer_sk", "customer_id", "order_day", "order_status"]


def enriched_items(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Products as of the order's date."""
    own = items.drop(*(c for c in CONTEXT[1:] if c in items.columns))
    return as_of(own.join(orders.select(*CONTEXT), "order_id", "left"), products, "product_id", "order_day", "product_sk")


def enriched_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    return payments.join(orders.select("order_id", "order_sk").dropDuplicates(["order_id"]), "order_id", "left")


def amounts(items: DataFrame) -> DataFrame:
    """Gross, discount, tax and net; a percentage replaces a net amount that doesn't know of it."""
    gross = F.col("gross_amount") if "gross_amount" in items.columns else money(F.col("quantity").cast(MONEY) * F.col("unit_price").cast(MONEY))
    out = items.withColumn("gross_amount", gross.cast(MONEY))
    if "discount_amount" not in items.columns:
        share = F.coalesce("discount_percentage", F.lit(0)) if "discount_percentage" in items.columns else F.lit(0)
        out = out.drop("net_amount").withColumn("discount_amount", money(F.col("gross_amount") * share / 100))
    if "tax_amount" not in out.columns:
        out = out.withColumn("tax_amount", F.lit(0).cast(MONEY))
    if "net_amount" not in out.columns:
        out = out.withColumn("net_amount", (F.col("gross_amount") - F.col("discount_amount") + F.col("tax_amount")).cast(MONEY))
    return out


def fact_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items of known orders; an order's status and customer came with the enrichment, or come from ``orders``."""
    rows = amounts(items)
    if {"order_status", "customer_id"} <= set(items.columns):
        rows = rows.where("order_sk is not null")
    else:
        rows = rows.join(orders.select("order_id", "order_sk", "order_status", "customer_id"), ["order_id", "order_sk"], "inner")
    key = key_of(F.col("order_item_id"), F.col("order_sk"), F.col("product_sk"))
    return rows.withColumns({"sales_sk": key, "order_date_key": F.date_format("order_day", "yyyyMMdd").cast("int")})


def fact_payment(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """A refund that the source tells is kept, null as 0; where it tells none, a REFUNDED payment gives all of it back."""
    rows = payments.join(orders.select("order_id", "order_sk", "customer_sk"), ["order_id", "order_sk"], "left")
    status = F.upper(F.trim("payment_status"))
    nothing = F.lit(0).cast(MONEY)
    whole = F.when(status == "REFUNDED", F.col("payment_amount")).otherwise(nothing)
    refund = (F.coalesce("refund_amount", nothing) if "refund_amount" in payments.columns else whole).cast(MONEY)
    return rows.withColumns(
        {
            "payment_sk": key_of(F.col("payment_id"), F.col("order_sk")),
            "is_successful": status.isin(*PAID),
            "refund_amount": refund,
            "net_payment_amount": money(F.col("payment_amount") - refund),
            "payment_date_key": F.date_format("payment_day", "yyyyMMdd").cast("int"),
        }
    )


def gated(table: DataFrame, key: str, required: list[str]) -> None:
    """Fails unless the table has rows, its key is unique and nothing required is null."""
    require(table, [key, *required], key)
    n = table.agg(
        F.count("*").alias("n"),
        F.countDistinct(key).alias("keys"),
        *(F.count_if(F.col(c).isNull()).alias(c) for c in required),
    ).first().asDict()
    if not n["n"] or n["keys"] != n["n"] or any(n[c] for c in required):
        raise ValueError(f"{key}: {n}")
