"""Typed snapshots: one projection a dataset. Columns that a dataset lacks are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MONEY, instant, money, title


def _with(df: DataFrame, **made) -> DataFrame:
    return df.withColumns({k: v for k, v in made.items()})


def _each(df: DataFrame, how, *names: str) -> DataFrame:
    return df.withColumns({n: how(F.col(n)) for n in names if n in df.columns})


def _trimmed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c, t in df.dtypes if t == "string"})


def _money(df: DataFrame, *names: str) -> DataFrame:
    return _each(df, lambda c: c.try_cast(MONEY), *names)


def customers(df: DataFrame) -> DataFrame:
    df = _each(_trimmed(df), title, "first_name", "last_name", "city", "state", "country")
    df = _each(_each(df, F.lower, "email"), F.upper, "status")
    df = _each(df, lambda c: c.try_cast("date"), "signup_date")
    return _with(df, customer_full_name=F.concat_ws(" ", "first_name", "last_name"))


def products(df: DataFrame) -> DataFrame:
    df = _each(_trimmed(df), title, "product_name", "category", "subcategory", "brand")
    return _each(_each(_money(df, "price", "cost_price"), lambda c: c.try_cast("int"), "stock_quantity"), F.upper, "status")


def orders(df: DataFrame) -> DataFrame:
    df = _each(_each(_trimmed(df), F.upper, "order_status"), lambda c: instant(c, loose=True), "order_date")
    day = F.to_date("order_date")
    return _with(df, order_day=day, order_year=F.year(day), order_month=F.month(day), order_quarter=F.quarter(day))


def order_items(df: DataFrame) -> DataFrame:
    df = _money(_trimmed(df), "unit_price", "discount_percentage", "discount_amount", "tax_amount")
    df = _with(df, quantity=F.col("quantity").try_cast("int"))
    df = _with(df, gross_amount=money(F.col("unit_price") * F.col("quantity")))
    off = F.coalesce("discount_amount", F.lit(0)) if "discount_amount" in df.columns else F.lit(0)
    return _with(df, net_amount=(F.col("gross_amount") - off).cast(MONEY))


def payments(df: DataFrame) -> DataFrame:
    df = _each(_trimmed(df), F.upper, "payment_status")
    df = _each(df, lambda c: F.initcap(F.regexp_replace(F.lower(c), "_", " ")), "payment_method")
    df = _each(_money(df, "payment_amount", "refund_amount"), lambda c: instant(c, loose=True), "payment_date")
    return _with(df, payment_day=F.to_date("payment_date"))


CLEAN = {"customers": customers, "products": products, "orders": orders, "order_items": order_items, "payments": payments}
