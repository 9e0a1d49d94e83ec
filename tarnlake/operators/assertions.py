"""Data-quality assertions. The checks that look at single rows share one aggregate a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require


def not_null(c: str):
    return f"not_null_{c}", F.col(c).isNull()


def non_negative(c: str):
    return f"non_negative_{c}", F.col(c) < 0


def positive(c: str):
    return f"positive_{c}", F.col(c).isNull() | (F.col(c) <= 0)


def equation(name: str, left: Column, right: Column):
    return name, F.round(left, 2) != F.round(right, 2)


def date_key(key: str, day: str):
    return f"date_key_consistency_{key}", F.col(day).isNull() | F.col(key).isNull() | (F.date_format(day, "yyyyMMdd").cast("int") != F.col(key))


def date_range():
    backward = F.col("effective_to") < F.col("effective_from")
    return "valid_scd_date_range", F.col("effective_from").isNull() | (
        ~F.col("is_current") & F.col("effective_to").isNull()
    ) | F.coalesce(backward, F.lit(False))


def current_end():
    return "current_scd_end_date", F.col("is_current") & F.col("effective_to").isNotNull()


def _result(df: DataFrame, name: str, table: str) -> DataFrame:
    """From one column ``n``."""
    return df.select(F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), F.coalesce("n", F.lit(0)).cast("long").alias("failed_count"))


#: Columns that the checks of each table read.
_VERSIONED = ["effective_from", "effective_to", "is_current", "record_version"]
NEEDED = {
    "dim_customer": ["customer_sk", "customer_id", *_VERSIONED],
    "dim_product": ["product_sk", "product_id", *_VERSIONED],
    "dim_date": ["date_key", "calendar_date"],
    "fact_sales": "sales_sk order_sk customer_sk product_sk order_date_key order_day quantity gross_amount discount_amount tax_amount net_amount".split(),
    "fact_payment": "payment_sk payment_id order_sk payment_date_key payment_day payment_amount refund_amount net_payment_amount".split(),
}


def _short(key: str) -> list[Column]:
    """Two 64-bit hashes that stand for a key: of its 64 characters a quarter is shuffled."""
    text = F.col(key).cast("string")
    return [F.xxhash64(F.lit(n), text).alias(f"h{n}") for n in (1, 2)]


def row_checks(df: DataFrame, table: str, tests: list) -> DataFrame:
    one = df.agg(*(F.count_if(test).alias(name) for name, test in tests))
    rows = F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(name).alias("failed_count")) for name, _ in tests))
    return one.select(F.explode(rows).alias("c")).select(F.lit(table).alias("table_name"), "c.check_name", "c.failed_count")


def unique_key(df: DataFrame, table: str, key: str) -> DataFrame:
    return _result(df.groupBy(*_short(key)).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")), "unique_key", table)


def current_unique(df: DataFrame, table: str, key: str) -> DataFrame:
    return _result(
        df.where("is_current").groupBy(key).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")),
        "current_scd_uniqueness",
        table,
    )


def foreign_key(df: DataFrame, table: str, column: str, dim: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are not null and not in the dimension."""
    ids = df.where(F.col(column).isNotNull()).select(*_short(column)).distinct()
    return _result(ids.join(dim.select(*_short(key)), ["h1", "h2"], "left_anti").agg(F.count("*").alias("n")), f"foreign_key_{column}", table)


def same_count(source: DataFrame, target: DataFrame, table: str) -> DataFrame:
    both = source.agg(F.count("*").alias("a")).crossJoin(target.agg(F.count("*").alias("b")))
    return _result(both.select(F.abs(F.col("a") - F.col("b")).alias("n")), "row_count_reconciliation", table)


def suite(t: dict[str, DataFrame], sources: dict[str, DataFrame]) -> DataFrame:
    """All checks of the five tables, with their status. A table that lacks a column that they read fails at once."""
    for name, columns in NEEDED.items():
        require(t[name], columns, name)

    def dims(key: str, name: str) -> list:
        return [*map(not_null, (f"{name}_sk", key, "effective_from", "is_current", "record_version")), date_range(), current_end()]

    sales = [
        *map(not_null, ("sales_sk", "order_sk", "customer_sk", "product_sk", "order_date_key")),
        *map(non_negative, ("gross_amount", "discount_amount", "tax_amount", "net_amount")),
        positive("quantity"),
        equation("sales_amount_equation", F.col("gross_amount") - F.col("discount_amount") + F.col("tax_amount"), F.col("net_amount")),
        date_key("order_date_key", "order_day"),
    ]
    pays = [
        *map(not_null, ("payment_sk", "order_sk", "payment_id", "payment_date_key")),
        *map(non_negative, ("payment_amount", "refund_amount", "net_payment_amount")),
        equation("payment_amount_equation", F.col("payment_amount") - F.col("refund_amount"), F.col("net_payment_amount")),
        date_key("payment_date_key", "payment_day"),
    ]
    people, goods, days, sold, paid = (t[n] for n in ("dim_customer", "dim_product", "dim_date", "fact_sales", "fact_payment"))
    parts = [
        row_checks(people, "dim_customer", dims("customer_id", "customer")),
        unique_key(people, "dim_customer", "customer_sk"),
        current_unique(people, "dim_customer", "customer_id"),
        row_checks(goods, "dim_product", dims("product_id", "product")),
        unique_key(goods, "dim_product", "product_sk"),
        current_unique(goods, "dim_product", "product_id"),
        row_checks(days, "dim_date", [not_null("date_key"), not_null("calendar_date")]),
        unique_key(days, "dim_date", "date_key"),
        row_checks(sold, "fact_sales", sales),
        unique_key(sold, "fact_sales", "sales_sk"),
        foreign_key(sold, "fact_sales", "customer_sk", people, "customer_sk"),
        foreign_key(sold, "fact_sales", "product_sk", goods, "product_sk"),
        foreign_key(sold, "fact_sales", "order_date_key", days, "date_key"),
        same_count(sources["order_items"], sold, "fact_sales"),
        row_checks(paid, "fact_payment", pays),
        unique_key(paid, "fact_payment", "payment_sk"),
        foreign_key(paid, "fact_payment", "payment_date_key", days, "date_key"),
        same_count(sources["payments"], paid, "fact_payment"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("failed_count") == 0, "PASS").otherwise("FAIL"))
