"""The queries by name. Dates are written as text and money as double, so that both engines compare alike."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_of
from ..operators import assertions, changes, cleaning, history, star, strict, validation
from ..sources.scratch import freed, stored
from . import marts
from .retail import SECOND, relation

DATASETS = ("customers", "products", "orders", "order_items", "payments")


def plain(df: DataFrame) -> DataFrame:
    kind = lambda t: "string" if t in ("date", "timestamp") else "double" if t.startswith("decimal") else None
    return df.select(*(F.col(c).cast(kind(t)).alias(c) if kind(t) else F.col(c) for c, t in df.dtypes))


def clean(name, spark, d):
    out = cleaning.CLEAN[name](relation(spark, d, name))
    parts = [c for c in ("order_year", "order_month", "order_quarter") if c in out.columns]  # may be null: as text
    return plain(out.withColumns({c: F.col(c).cast("string") for c in parts}) if parts else out)


def _raw(spark, d):
    return {n: relation(spark, d, n) for n in DATASETS}


def errors(name, spark, d):
    rows = validation.everything(_raw(spark, d))[name]
    return rows.select(validation.KEYS[name], F.col("_validation_status").alias("status"), F.col("_validation_reason").alias("reason"))


def rule_report(spark, d):
    return validation.report(validation.everything(_raw(spark, d)))


def rule_summary(spark, d):
    return validation.summary(validation.everything(_raw(spark, d)))


#: The present of the strict profile's queries.
NOW = "1998-01-01 00:00:00"


def _strict(spark, d):
    names = {n: f"strict_{n}" for n in ("customers", "products", "orders")}
    return strict.everything({n: relation(spark, d, names.get(n, n)) for n in DATASETS}, F.lit(NOW).cast("timestamp"))


def strict_errors(name, spark, d):
    return _strict(spark, d)[name].select(validation.KEYS[name], "rejection_reason")


def strict_audit(spark, d):
    return strict.audit(_strict(spark, d))


def anti_fk(spark, d):
    o, c = relation(spark, d, "orders"), relation(spark, d, "customers")
    return o.join(c, "customer_id", "left_anti").select("order_id", "customer_id")


def _customer_changes(spark, d):
    return changes.changes(relation(spark, d, "current_customers"), relation(spark, d, "previous_customers"), ["customer_id"])


def cdc(spark, d):
    return _customer_changes(spark, d).select("customer_id", "customer_segment", "change_type")


def cdc_pivot(spark, d):
    return changes.counts(_customer_changes(spark, d))


def merge(spark, d):
    previous = cleaning.customers(relation(spark, d, "previous_customers"))
    changed = _customer_changes(spark, d)
    kinds = changed.select("customer_id", "change_type")
    typed = cleaning.customers(changed.drop("change_type")).join(kinds, "customer_id")
    return plain(changes.merged(previous, typed, ["customer_id"]).select("customer_id", "customer_full_name", "customer_segment", "signup_date"))


def _changes(spark, d):
    """Of customers and products."""
    goods = changes.changes(relation(spark, d, "repriced_products"), relation(spark, d, "products"), ["product_id"])
    return marts.change_summary({"customers": _customer_changes(spark, d), "products": goods})


def change_summary(spark, d):
    return _changes(spark, d)


def change_pivot(spark, d):
    return marts.change_pivot(_changes(spark, d))


_VERSION = ["customer_id", "customer_segment", "effective_from", "effective_to", "is_current", "record_version"]


def scd2_init(spark, d):
    return plain(history.begun(cleaning.customers(relation(spark, d, "previous_customers")), SECOND).select(*_VERSION))


def _merged_history(spark, d):
    first = history.begun(relation(spark, d, "previous_customers"), "1995-01-01")
    return history.advanced(first, _customer_changes(spark, d), SECOND, ["customer_id"])


def scd2_merge(spark, d):
    return plain(_merged_history(spark, d).select(*_VERSION))


def scd2_sound(spark, d):
    return history.sound(_merged_history(spark, d), ["customer_id"])


def point_in_time(spark, d):
    """Orders against the history in which keys come and go: some find no version."""
    orders = cleaning.orders(relation(spark, d, "orders"))
    return history.as_of(
        orders,
        _merged_history(spark, d),
        "customer_id",
        "order_day",
        "customer_sk",
    ).select("order_id", "customer_id", "customer_sk")


def _histories(spark, d):
    out = []
    for name, later, key, typed in (
        ("customers", "changed_customers", "customer_id", cleaning.customers),
        ("products", "repriced_products", "product_id", cleaning.products),
    ):
        old, new = relation(spark, d, name), relation(spark, d, later)
        changed = changes.changes(new, old, [key])
        kinds = changed.select(key, "change_type")
        typed_changes = typed(changed.drop("change_type")).join(kinds, key)
        out.append(history.advanced(history.begun(typed(old), "1995-01-01"), typed_changes, SECOND, [key]))
    return out


def build(spark, d, keep: bool = False):
    """The star over the rows whose keys are known: orders of unknown customers and their items stay out, as the gate asks.

    With ``keep`` histories, enriched orders and items and the payment facts are stored, each computed once, for queries
    that read several. What is stored has no surrogate keys (of 64 characters, and hashes don't compress) but what they
    are made of, and only the columns that marts and checks read.
    """
    kept = stored if keep else lambda df, tag: df
    people, goods = (kept(df, "history") for df in _histories(spark, d))
    raw = _raw(spark, d)
    orders = cleaning.orders(raw["orders"].where("customer_id <> 'C-1' and order_date <> 'soon'"))
    known = orders.select("order_id")
    items = cleaning.order_items(raw["order_items"].where("product_id <> 'P-1'").join(known, "order_id", "left_semi"))
    payments = cleaning.payments(raw["payments"].join(known, "order_id", "left_semi"))
    days = star.dim_date(orders.select("order_day"), payments.select("payment_day"))
    if keep:
        # the join with orders leaves items of unknown ones out, so they need no shuffle of their own for that; raw keys are compared
        lines = cleaning.order_items(raw["order_items"].where("product_id <> 'P-1' and order_id = trim(order_id)"))
        eo, ei, ep, paid = _kept(orders, lines, payments, people, goods)
        days = stored(days, "dim_date")
    else:
        eo = star.enriched_orders(orders, people)
        ei = star.enriched_items(items, eo, goods)
        ep = star.enriched_payments(payments, eo)
        paid = star.fact_payment(ep, eo)
    t = {
        "dim_customer": star.dim_customer(people),
        "dim_product": star.dim_product(goods),
        "dim_date": days,
        "fact_sales": star.fact_sales(ei, eo),
        "fact_payment": paid,
    }
    return t | {"orders": eo, "order_items": ei, "payments": ep}


def _kept(orders, items, payments, people, goods):
    """Enriched orders, items and payments, and the payment facts, over stored tables without surrogate keys."""
    spark = orders.sparkSession
    order_sk = key_of(F.lit("ORDER"), F.col("order_id"))
    o = history.version_at(orders.select("order_id", "customer_id", "order_day", "order_status"), people, "customer_id", "order_day", "_customer")
    o = stored(o, "orders")
    eo = o.withColumns({"order_sk": order_sk, "customer_sk": history.key_at("customer_id", "_customer")}).drop("_customer")
    own = items.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_percentage")
    i = own.join(o, "order_id")
    i = stored(history.version_at(i, goods, "product_id", "order_day", "_product"), "order-items", "zstd")
    freed(spark)
    keys = {
        "order_sk": order_sk,
        "customer_sk": history.key_at("customer_id", "_customer"),
        "product_sk": history.key_at("product_id", "_product"),
    }
    ei = i.withColumns(keys).drop("_customer", "_product")
    ep = star.enriched_payments(payments, eo)
    made = ["order_sk", "customer_sk", "payment_sk"]
    p = star.fact_payment(ep, eo).withColumn("_known", F.col("order_sk").isNotNull()).drop(*made)
    p = stored(p, "payments").withColumn("order_sk", F.when(F.col("_known"), order_sk))
    paid = p.withColumn("payment_sk", key_of(F.col("payment_id"), F.col("order_sk"))).drop("_known")
    freed(spark)
    return eo, ei, ep, paid


_SHOWN = {
    "dim_customer": [
        "customer_sk",
        "customer_id",
        "customer_full_name",
        "customer_segment",
        "effective_from",
        "effective_to",
        "is_current",
        "record_version",
        "is_active",
    ],
    "dim_product": ["product_sk", "product_id", "category", "price", "effective_from", "effective_to", "is_current", "record_version"],
    "dim_date": None,
    "fact_sales": [
        "sales_sk",
        "order_item_id",
        "order_id",
        "order_sk",
        "customer_sk",
        "product_sk",
        "order_date_key",
        "quantity",
        "gross_amount",
        "discount_amount",
        "tax_amount",
        "net_amount",
        "order_status",
    ],
    "fact_payment": [
        "payment_sk",
        "payment_id",
        "order_sk",
        "customer_sk",
        "payment_date_key",
        "payment_amount",
        "refund_amount",
        "net_payment_amount",
        "is_successful",
    ],
    "orders": ["order_id", "order_sk", "customer_sk"],
    "order_items": ["order_item_id", "order_sk", "customer_sk", "product_sk"],
    "payments": ["payment_id", "order_sk"],
}


def table(name, spark, d):
    df = build(spark, d)[name]
    return plain(df.select(*_SHOWN[name]) if _SHOWN[name] else df)


def checks(spark, d):
    t = build(spark, d, keep=True)
    return assertions.suite(t, t)


def _versions(t):
    return marts.version_history({"dim_customer": (t["dim_customer"], "customer_id"), "dim_product": (t["dim_product"], "product_id")})


def _one(part):
    """A row of figures, computed at once: what it was made from leaves the disk before the next."""
    part = stored(part, "figures")
    freed(part.sparkSession)
    return part


def mart(name, spark, d):
    t = build(spark, d, keep=name in ("executive", "funnel", "layers"))
    sales, pays = t["fact_sales"], t["fact_payment"]
    if name == "daily":
        out = marts.daily_sales(sales)
    elif name == "product":
        out = marts.product_performance(sales, t["dim_product"])
    elif name == "customer":
        out = marts.customer_performance(sales, t["dim_customer"])
    elif name == "payment":
        out = marts.payment_summary(pays)
    elif name == "executive":
        out = marts.executive(sales, pays)
    elif name == "monthly":
        out = marts.monthly_breakdown(sales, t["dim_product"], t["dim_customer"])
    elif name == "top_products":
        out = marts.top(marts.product_performance(sales, t["dim_product"]), "product_id", "net_revenue")
    elif name == "top_customers":
        out = marts.top(marts.customer_performance(sales, t["dim_customer"]), "customer_id", "total_spent")
    elif name == "history":
        out = marts.with_history(t["dim_customer"], "customer_id").select(
            "customer_id",
            "customer_segment",
            "effective_from",
            "effective_to",
            "n_versions",
        )
    elif name == "product_rollup":
        out = marts.product_rollup(marts.product_performance(sales, t["dim_product"]), t["dim_product"])
    elif name == "customer_rollup":
        out = marts.customer_rollup(marts.customer_performance(sales, t["dim_customer"]), t["dim_customer"])
    elif name in ("month", "category", "customer_segment"):
        out = marts.revenue_by(marts.monthly_breakdown(sales, t["dim_product"], t["dim_customer"]), name)
    elif name == "methods":
        out = marts.paid_by_method(marts.payment_summary(pays))
    elif name == "statuses":
        out = marts.payments_by_status(marts.payment_summary(pays))
    elif name == "versions":
        out = _versions(t)
    elif name == "funnel":
        out = marts.funnel(rule_summary(spark, d), _changes(spark, d), _versions(t), sales, assertions.suite(t, t), _one)
    elif name == "repeat":
        out = marts.repeat_customers(sales)
    else:
        out = marts.layer_counts({k: t[k] for k in sorted(t)})
    return plain(out)


QUERIES = (
    {f"p_clean_{n}": partial(clean, n) for n in DATASETS}
    | {f"v_errors_{n}": partial(errors, n) for n in DATASETS}
    | {
        "v_rule_report": rule_report,
        "v_summary": rule_summary,
        "j_anti_fk": anti_fk,
        "j_point_in_time": point_in_time,
        "c_cdc_customers": cdc,
        "c_cdc_pivot": cdc_pivot,
    }
    | {"m_snapshot_merge": merge, "s_scd2_init": scd2_init, "s_scd2_merge": scd2_merge, "s_scd2_sound": scd2_sound}
    | {f"e_{n}": partial(table, n) for n in ("orders", "order_items", "payments")}
    | {f"g_{n}": partial(table, n) for n in ("dim_customer", "dim_product", "dim_date", "fact_sales", "fact_payment")}
    | {"q_checks": checks}
    | {f"k_{n}": partial(mart, n) for n in ("daily", "product", "customer", "payment", "executive")}
    | {
        f"x_{k}": partial(mart, n)
        for k, n in (
            ("monthly_breakdown", "monthly"),
            ("top_products", "top_products"),
            ("top_customers", "top_customers"),
            ("scd2_history", "history"),
            ("repeat_customers", "repeat"),
            ("layer_counts", "layers"),
        )
    }
    | {f"v_strict_{n}": partial(strict_errors, n) for n in DATASETS}
    | {"v_strict_audit": strict_audit, "x_cdc_summary": change_summary, "x_cdc_pivot": change_pivot}
    | {
        f"x_{k}": partial(mart, n)
        for k, n in (
            ("product_rollup", "product_rollup"),
            ("customer_rollup", "customer_rollup"),
            ("revenue_by_month", "month"),
            ("revenue_by_category", "category"),
            ("revenue_by_segment", "customer_segment"),
            ("paid_by_method", "methods"),
            ("payments_by_status", "statuses"),
            ("version_history", "versions"),
            ("funnel", "funnel"),
        )
    }
)
