"""Rules as columns: every rule of a dataset in one projection, the errors in one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import instant, missing

# Fixed values.
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id"}
REQUIRED = {
    "customers": ["customer_id"],
    "products": ["product_id"],
    "orders": ["order_id", "customer_id"],
    "order_items": ["order_item_id", "order_id", "product_id"],
    "payments": ["payment_id", "order_id"],
}
TIMES = {
    "customers": ["validation_timestamp"],
    "products": ["validation_timestamp"],
    "orders": ["order_date", "validation_timestamp"],
    "order_items": ["validation_timestamp"],
    "payments": ["payment_date", "validation_timestamp"],
}
ALLOWED = {
    "order_status": ["Pending", "Confirmed", "Shipped", "Delivered", "Cancelled", "Returned"],
    "payment_status": ["Pending", "Success", "Completed", "Failed", "Refunded"],
    "payment_method": ["Credit Card", "Debit Card", "UPI", "Net Banking", "Cash on Delivery", "Wallet"],
}
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PARENTS = {
    "orders": [("customer_id", "customers", "CUSTOMER_NOT_FOUND")],
    "order_items": [("order_id", "orders", "ORDER_NOT_FOUND"), ("product_id", "products", "PRODUCT_NOT_FOUND")],
    "payments": [("order_id", "orders", "ORDER_NOT_FOUND")],
}


def _rules(name: str, df: DataFrame) -> list[tuple[Column, str]]:
    has, c = df.columns, F.col
    rules = [(missing(c(x)), f"MISSING_REQUIRED_FIELD:{x}") for x in REQUIRED[name] if x in has]
    rules += [(c("_n_key") > 1, "DUPLICATE_PRIMARY_KEY")]
    rules += [(~missing(c(x)) & instant(c(x)).isNull(), f"INVALID_TIMESTAMP:{x}") for x in TIMES[name] if x in has]
    rules += [(~missing(c(x)) & ~c(x).isin(v), f"INVALID_VALUE:{x}") for x, v in ALLOWED.items() if x in has]
    by_column = {
        "email": (~missing(c("email")) & ~c("email").rlike(EMAIL), "INVALID_EMAIL_FORMAT"),
        "price": (c("price") < 0, "NEGATIVE_PRICE"),
        "stock_quantity": (c("stock_quantity") < 0, "NEGATIVE_STOCK_QUANTITY"),
        "quantity": (c("quantity").isNull() | (c("quantity") <= 0), "INVALID_QUANTITY"),
        "unit_price": (c("unit_price").isNull() | (c("unit_price") < 0), "INVALID_UNIT_PRICE"),
        "discount_percentage": ((c("discount_percentage") < 0) | (c("discount_percentage") > 100), "INVALID_DISCOUNT_PERCENTAGE"),
        "payment_amount": (c("payment_amount").isNull() | (c("payment_amount") < 0), "INVALID_PAYMENT_AMOUNT"),
    }
    return rules + [rule for x, rule in by_column.items() if x in has]


def validated(name: str, tables: dict[str, DataFrame], rejected_orders: DataFrame | None = None) -> DataFrame:
    """The dataset with ``_validation_errors``, ``_validation_status`` and ``_validation_reason``.

    Parents are looked up before their own validation; with ``rejected_orders`` (their ids) items and payments
    of a rejected order are rejected too.
    """
    df, key = tables[name], KEYS[name]
    n = F.count(key).over(Window.partitionBy(key))  # a null key counts none
    rows = df.withColumn("_n_key", n)
    rules = _rules(name, df)
    lookups = [
        (x, tables[parent].select(F.col(KEYS[parent]).alias("_id")).where(~missing(F.col("_id"))), code)
        for x, parent, code in PARENTS.get(name, ()) if parent in tables
    ]
    for k, (column, ids, code) in enumerate(lookups):
        found = ids.distinct().select(F.col("_id").alias(f"_p{k}"), F.lit(True).alias(f"_f{k}"))
        rows = rows.join(found, F.col(column) == F.col(f"_p{k}"), "left")
        rules.append((~missing(F.col(column)) & F.col(f"_f{k}").isNull(), code))
    if rejected_orders is not None and name in ("order_items", "payments"):
        gone = rejected_orders.select(F.col("order_id").alias("_gone")).distinct()
        rows = rows.join(gone, F.col("order_id") == F.col("_gone"), "left")
        rules.append((F.col("_gone").isNotNull(), "PARENT_ORDER_QUARANTINED"))
    errors = F.array_compact(F.array(*(F.when(test, F.lit(code)) for test, code in rules)))
    rows = rows.withColumn("_validation_errors", errors)
    status = F.when(F.size("_validation_errors") == 0, "VALID").otherwise("INVALID")
    return rows.withColumns(
        {"_validation_status": status, "_validation_reason": F.concat_ws("; ", "_validation_errors")}
    ).select(*df.columns, "_validation_errors", "_validation_status", "_validation_reason")


def everything(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All datasets; orders come before what hangs on them."""
    out = {name: validated(name, tables) for name in ("customers", "products", "orders") if name in tables}
    gone = out["orders"].where("_validation_status = 'INVALID'").select("order_id")
    return out | {name: validated(name, tables, gone) for name in ("order_items", "payments") if name in tables}


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the validation's columns, and the quarantine."""
    own = [c for c in rows.columns if not c.startswith("_validation_")]
    return rows.where("_validation_status = 'VALID'").select(*own), rows.where("_validation_status = 'INVALID'")


def report(checked: dict[str, DataFrame]) -> DataFrame:
    """Rows that break each rule, and their share of the dataset."""
    out = None
    for name, rows in checked.items():
        total = rows.agg(F.count("*").alias("total"))
        each = rows.select(F.explode("_validation_errors").alias("rule")).groupBy("rule").agg(F.count("*").alias("failed"))
        each = each.crossJoin(total).select(
            F.lit(name).alias("dataset"),
            "rule",
            "failed",
            F.round(F.col("failed") * 100.0 / F.col("total"), 2).cast("double").alias("percent"),
        )
        out = each if out is None else out.unionByName(each)
    return out.orderBy("dataset", F.desc("failed"), "rule") if out is not None else None


def summary(checked: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in checked.items():
        bad = F.count_if(F.col("_validation_status") == "INVALID")
        each = rows.agg(
            F.lit(name).alias("dataset"),
            F.count("*").alias("total"),
            (F.count("*") - bad).alias("valid"),
            bad.alias("invalid"),
            F.when(bad == 0, "SUCCESS").otherwise("COMPLETED_WITH_INVALID_RECORDS").alias("status"),
        )
        out = each if out is None else out.unionByName(each)
    return out
