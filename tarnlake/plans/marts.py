"""Business marts over the star, and the roll-ups drawn from them. Cancelled orders and failed payments count, as defined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators.changes import KINDS


def _sum(c: str, name: str):
    return F.sum(c).cast("decimal(38,2)").alias(name)


_GROSS = (("gross_amount", "gross_revenue"), ("discount_amount", "total_discount"), ("tax_amount", "total_tax"), ("net_amount", "net_revenue"))


def _by_order(sales: DataFrame) -> DataFrame:
    """One row an order: it has one day and one customer, so orders need no distinct count."""
    sums = [_sum(c, name) for c, name in _GROSS]
    return sales.groupBy("order_sk", "order_day", "customer_id").agg(F.count("*").alias("items"), *sums)


def daily_sales(sales: DataFrame) -> DataFrame:
    sums = [_sum(name, name) for _, name in _GROSS]
    rows = _by_order(sales).groupBy(F.col("order_day").alias("order_date")).agg(
        F.count("order_sk").alias("total_orders"), F.sum("items").alias("total_items"), *sums, F.countDistinct("customer_id").alias("unique_customers")
    )
    return rows.withColumn("average_order_value", ratio(F.col("net_revenue"), F.col("total_orders"))).orderBy("order_date")


def product_performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    """One row a product version, sold or not."""
    rows = sales.groupBy("product_sk").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.countDistinct("order_sk").alias("total_orders"),
        _sum("gross_amount", "gross_revenue"),
        _sum("net_amount", "net_revenue"),
    )
    out = products.select("product_sk", "product_id", "category").join(rows, "product_sk", "left")
    out = out.na.fill(0, ["total_quantity_sold", "total_orders", "gross_revenue", "net_revenue"])
    out = out.withColumn("average_selling_price", ratio(F.col("net_revenue"), F.col("total_quantity_sold")))
    return out.orderBy(F.desc("net_revenue"), "product_sk")


def customer_performance(sales: DataFrame, customers: DataFrame) -> DataFrame:
    rows = sales.groupBy("customer_sk").agg(
        F.countDistinct("order_sk").alias("total_orders"),
        F.count("*").alias("total_items"),
        _sum("net_amount", "total_spent"),
        F.min("order_day").alias("first_order_date"),
        F.max("order_day").alias("latest_order_date"),
    )
    out = customers.select("customer_sk", "customer_id", F.col("customer_full_name").alias("customer_name"), "customer_segment")
    out = out.join(rows, "customer_sk", "left").na.fill(0, ["total_orders", "total_items", "total_spent"])
    out = out.withColumn("average_order_value", ratio(F.col("total_spent"), F.col("total_orders")))
    return out.orderBy(F.desc("total_spent"), "customer_sk")


def payment_summary(payments: DataFrame) -> DataFrame:
    unknown = lambda c: F.coalesce(F.col(c), F.lit("UNKNOWN")) if c in payments.columns else F.lit("UNKNOWN")
    key = [
        F.col("payment_day").alias("payment_date"),
        unknown("payment_method").alias("payment_method"),
        unknown("payment_status").alias("payment_status"),
    ]
    sums = [_sum(c, c) for c in ("payment_amount", "refund_amount", "net_payment_amount")]
    return payments.groupBy(*key).agg(F.count("*").alias("payment_count"), *sums).orderBy("payment_date", "payment_method", "payment_status")


def executive(sales: DataFrame, payments: DataFrame) -> DataFrame:
    orders = _by_order(sales).agg(
        F.count("order_sk").alias("total_orders"),
        F.sum("items").alias("total_items_sold"),
        F.countDistinct("customer_id").alias("total_customers"),
        *(_sum(name, name) for _, name in _GROSS),
    )
    products = sales.agg(F.countDistinct("product_id").alias("total_products_sold"))
    paid = payments.agg(
        F.count_if("is_successful").alias("successful_payments"), _sum(
            "payment_amount",
            "total_payment_amount",
        ), _sum("refund_amount", "total_refund_amount")
    )
    one = orders.crossJoin(products).crossJoin(paid)  # of single rows
    one = one.withColumn("total_items_sold", F.coalesce("total_items_sold", F.lit(0)))
    return one.withColumn("average_order_value", ratio(F.col("net_revenue"), F.col("total_orders")))


def monthly_breakdown(sales: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """By month, category, the customer's segment at the sale, and order status."""
    rows = sales.join(products.select("product_sk", "category"), "product_sk", "left").join(
        customers.select("customer_sk", "customer_segment"),
        "customer_sk",
        "left",
    )
    return rows.groupBy(F.trunc("order_day", "month").alias("month"), "category", "customer_segment", "order_status").agg(
        _sum("net_amount", "net_revenue"),
        _sum("discount_amount", "discount"),
        F.sum("quantity").alias("items"),
        F.countDistinct("order_sk").alias("orders"),
    )


def top(mart: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """Versions rolled up to their business key; the n largest, ties by key."""
    return mart.groupBy(key).agg(F.sum(value).cast("decimal(38,2)").alias(value)).orderBy(F.desc(value), key).limit(n)


def with_history(history: DataFrame, key: str) -> DataFrame:
    """All versions of the keys that have several."""
    return history.withColumn("n_versions", F.count("*").over(Window.partitionBy(key))).where("n_versions > 1")


def repeat_customers(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.countDistinct("order_sk").alias("total_orders")).where("total_orders >= 2")


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in layers.items():
        one = df.agg(F.lit(name).alias("layer"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def change_summary(changed: dict[str, DataFrame]) -> DataFrame:
    """Rows of each kind of change in each dataset."""
    out = None
    for name, rows in changed.items():
        one = rows.groupBy("change_type").agg(F.count("*").alias("records")).select(F.lit(name).alias("dataset"), "change_type", "records")
        out = one if out is None else out.unionByName(one)
    return out


def change_pivot(summary: DataFrame) -> DataFrame:
    return summary.groupBy("dataset").pivot("change_type", KINDS).sum("records").na.fill(0)


def product_rollup(mart: DataFrame, products: DataFrame) -> DataFrame:
    """Versions rolled up to the product, under the name of the newest."""
    rows = mart.join(products.select("product_sk", "product_name", "record_version"), "product_sk")
    return rows.groupBy("product_id", "category").agg(
        F.max_by("product_name", "record_version").alias("product_name"),
        F.sum("total_quantity_sold").alias("units"),
        F.sum("total_orders").alias("orders"),
        _sum("net_revenue", "net_revenue"),
    )


def customer_rollup(mart: DataFrame, customers: DataFrame) -> DataFrame:
    rows = mart.join(customers.select("customer_sk", "record_version"), "customer_sk")
    return rows.groupBy("customer_id").agg(
        F.max_by("customer_name", "record_version").alias("customer_name"),
        F.sum("total_orders").alias("orders"),
        _sum("total_spent", "total_spent"),
        F.max("latest_order_date").alias("latest_order"),
    )


def revenue_by(breakdown: DataFrame, column: str) -> DataFrame:
    """The monthly breakdown by one of its columns."""
    return breakdown.groupBy(column).agg(_sum("net_revenue", "net_revenue"), F.sum("orders").alias("orders"))


def paid_by_method(summary: DataFrame) -> DataFrame:
    return summary.where("payment_status = 'SUCCESS'").groupBy("payment_method").agg(_sum("payment_amount", "payment_amount"))


def payments_by_status(summary: DataFrame) -> DataFrame:
    return summary.groupBy("payment_status").agg(_sum("payment_amount", "amount"), F.sum("payment_count").alias("payments"))


def version_history(dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All versions of the keys that have several, of every dimension (table and business key)."""
    out = None
    for name, (rows, key) in dims.items():
        one = with_history(rows, key).select(
            F.lit(name).alias("dimension"),
            F.col(key).alias("business_key"),
            "effective_from",
            "effective_to",
            "is_current",
            "record_version",
        )
        out = one if out is None else out.unionByName(one)
    return out


def funnel(summary: DataFrame, changed: DataFrame, versions: DataFrame, sales: DataFrame, checks: DataFrame, kept=lambda part: part) -> DataFrame:
    """One row: what came in, was held back, changed, was kept and built, and the checks passed. ``kept`` is done to each part."""
    parts = [
        summary.agg(F.sum("total").alias("raw_rows"), F.sum("invalid").alias("quarantined_rows"), F.sum("valid").alias("valid_rows")),
        changed.where("change_type <> 'UNCHANGED'").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("changes")),
        versions.agg(F.count_if("is_current").alias("new_versions")),
        sales.agg(F.count("*").alias("sales_rows")),
        checks.agg(F.count_if(F.col("status") == "PASS").alias("checks_passed"), F.count("*").alias("checks_run")),
    ]
    out, *others = map(kept, parts)
    for one in others:
        out = out.crossJoin(one)  # of single rows
    return out
