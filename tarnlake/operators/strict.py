"""The standalone profile of validation: every column is asked for, and parents count only where they are valid themselves.

Rows keep their columns and gain ``rejection_reason``, empty where nothing is wrong. Null passes the rules on
values, addresses and parents (what is missing is told by its own rule) and fails those on numbers and dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validation import EMAIL, KEYS

# Fixed values.
REQUIRED = {
    "customers": ["customer_id", "first_name", "last_name", "email", "city", "state", "country", "signup_date", "customer_segment"],
    "products": ["product_id", "product_name", "category", "brand", "price", "stock_quantity"],
    "orders": ["order_id", "customer_id", "order_date", "order_status", "shipping_city", "shipping_state"],
    "order_items": ["order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_percentage"],
    "payments": ["payment_id", "order_id", "payment_method", "payment_status", "payment_amount", "payment_date"],
}
VALUES = {
    "customer_segment": ["Regular", "Silver", "Gold", "Platinum"],
    "category": ["Electronics", "Fashion", "Furniture", "Books", "Sports", "Beauty", "Home", "Toys"],
    "order_status": ["Delivered", "Cancelled", "Pending", "Returned", "Shipped"],
    "payment_method": ["UPI", "Credit Card", "Debit Card", "Net Banking", "Wallet"],
    "payment_status": ["Success", "Failed", "Refunded", "Pending"],
}
RULES = {
    "customers": [("INVALID_EMAIL", "email"), ("INVALID_VALUE", "customer_segment"), ("INVALID_OR_FUTURE_DATE", "signup_date")],
    "products": [("INVALID_VALUE", "category"), ("INVALID_NUMERIC_VALUE", "price"), ("INVALID_NUMERIC_VALUE", "stock_quantity")],
    "orders": [("INVALID_VALUE", "order_status"), ("INVALID_OR_FUTURE_DATE", "order_date"), ("INVALID_FOREIGN_KEY", "customer_id")],
    "order_items": [
        ("INVALID_FOREIGN_KEY", "order_id"),
        ("INVALID_FOREIGN_KEY", "product_id"),
        ("INVALID_NUMERIC_VALUE", "quantity"),
        ("INVALID_NUMERIC_VALUE", "unit_price"),
        ("OUT_OF_RANGE", "discount_percentage"),
    ],
    "payments": [
        ("INVALID_FOREIGN_KEY", "order_id"),
        ("INVALID_VALUE", "payment_method"),
        ("INVALID_VALUE", "payment_status"),
        ("INVALID_NUMERIC_VALUE", "payment_amount"),
        ("INVALID_OR_FUTURE_DATE", "payment_date"),
    ],
}
PARENTS = {"customer_id": "customers", "order_id": "orders", "product_id": "products"}


def _fails(rule: str, name: str, now: Column) -> Column:
    c = F.col(name)
    number = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    if rule == "INVALID_EMAIL":
        return c.isNotNull() & ~c.rlike(EMAIL)
    if rule == "INVALID_VALUE":
        return c.isNotNull() & ~c.isin(VALUES[name])
    if rule == "INVALID_NUMERIC_VALUE":
        return number.isNull() | (number < 0 if name == "stock_quantity" else number <= 0)
    if rule == "OUT_OF_RANGE":
        return number.isNull() | ~number.between(0, 100)
    if rule == "INVALID_OR_FUTURE_DATE":
        when = c.try_cast("timestamp")
        return when.isNull() | (when > now)
    return c.isNotNull() & F.col(f"_has_{name}").isNull()


def judged(name: str, rows: DataFrame, valid: dict[str, DataFrame], now: Column) -> DataFrame:
    """The rows with their reasons; ``valid`` holds the accepted rows of the parents, whose keys are unique."""
    if lost := [c for c in REQUIRED[name] if c not in rows.columns]:
        raise ValueError(f"{name} lacks {lost}")
    key, out = KEYS[name], rows
    for rule, c in RULES[name]:
        if rule == "INVALID_FOREIGN_KEY":
            parent = PARENTS[c]
            out = out.join(valid[parent].select(F.col(KEYS[parent]).alias(c), F.lit(True).alias(f"_has_{c}")), c, "left")
    tests = [(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"MISSING_REQUIRED_VALUE:{c}") for c in REQUIRED[name]]
    tests.append((F.col("_n_key") > 1, f"DUPLICATE_PRIMARY_KEY:{key}"))
    tests += [(_fails(rule, c, now), f"{rule}:{c}") for rule, c in RULES[name]]
    out = out.withColumn("_n_key", F.count("*").over(Window.partitionBy(key)))
    return out.select(*rows.columns, F.concat_ws(" | ", *(F.when(test, F.lit(code)) for test, code in tests)).alias("rejection_reason"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("rejection_reason = ''").drop("rejection_reason"), rows.where("rejection_reason <> ''")


def everything(tables: dict[str, DataFrame], now: Column | None = None) -> dict[str, DataFrame]:
    """All datasets, parents first; dates past ``now`` (the present) are in the future."""
    out, valid = {}, {}
    for name in KEYS:  # parents come first
        out[name] = judged(name, tables[name], valid, F.current_timestamp() if now is None else now)
        valid[name] = split(out[name])[0]
    return out


def audit(checked: dict[str, DataFrame]) -> DataFrame:
    """A row for each dataset: how many rows came, passed and failed, and the share that passed."""
    out = None
    for name, rows in checked.items():
        good = F.count_if(F.col("rejection_reason") == "")
        rate = F.coalesce(F.round(F.try_divide(good * 100.0, F.count("*")), 2), F.lit(0)).cast("double")
        one = rows.agg(
            F.lit(name).alias("dataset_name"),
            F.count("*").alias("input_record_count"),
            good.alias("valid_record_count"),
            (F.count("*") - good).alias("invalid_record_count"),
            rate.alias("validation_success_rate"),
        )
        out = one if out is None else out.unionByName(one)
    return out
