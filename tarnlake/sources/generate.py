"""Made-up retail batches, the same for the same seed: a clean first day, a next day, and a day with known defects.

Every choice is a hash of the row's key and the seed, so tables of any size are made without state; rows that a
change picks are the n with the least hash. Ids are numbered without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import KEYS

#: Invented makers, and how many each category has; a category's makers are named after it.
MAKERS = ("Alder", "Birch", "Cedar", "Dune", "Ember", "Fjord")
CATEGORIES = {"Electronics": 6, "Fashion": 5, "Furniture": 5, "Books": 5, "Sports": 5, "Beauty": 5, "Home": 5, "Toys": 5}
BRANDS = {c: [f"{m} {c}" for m in MAKERS[:n]] for c, n in CATEGORIES.items()}
# Fixed values.
SEGMENTS = {"Regular": 60, "Silver": 22, "Gold": 13, "Platinum": 5}
STATUSES = {"Delivered": 68, "Cancelled": 8, "Pending": 7, "Returned": 7, "Shipped": 10}
NEW_STATUSES = {"Delivered": 10, "Shipped": 50, "Pending": 30, "Cancelled": 7, "Returned": 3}
PAID = {"Success": 82, "Failed": 8, "Refunded": 5, "Pending": 5}
DISCOUNTS = {0: 35, 5: 20, 10: 18, 15: 12, 20: 10, 25: 5}
METHODS = ["UPI", "Credit Card", "Debit Card", "Net Banking", "Wallet"]
FIRST = ["Asha", "Ravi", "Meera", "Kiran", "Nila", "Arun", "Tara", "Dev"]
LAST = ["Rao", "Iyer", "Das", "Gill", "Nair", "Sen", "Bose", "Khan"]
CITIES = {"Pune": "Maharashtra", "Kochi": "Kerala", "Jaipur": "Rajasthan", "Surat": "Gujarat", "Patna": "Bihar", "Mysuru": "Karnataka"}
#: The first and last id's text and width of each dataset's ids.
IDS = {"customers": ("CUST", 6), "products": ("PROD", 5), "orders": ("ORD", 8), "order_items": ("ITEM", 9), "payments": ("PAY", 8)}
#: Defects of a dirty day: rows, column, value (an SQL expression); and rows that come twice.
DIRT = {
    "customers": ([(10, "email", "null"), (10, "email", "'not-an-address'"), (5, "city", "null"), (5, "customer_segment", "'Diamond'")], 10),
    "products": ([(5, "price", "-999.99"), (5, "product_name", "null"), (5, "stock_quantity", "-100"), (5, "category", "'Unknown'")], 5),
    "orders": (
        [
            (10, "customer_id", "'CUST999999'"),
            (10, "shipping_city", "null"),
            (10, "order_status", "'Unknown'"),
            (5, "order_date", "'2099-01-01 00:00:00'"),
        ],
        10,
    ),
    "order_items": (
        [
            (10, "product_id", "'PROD99999'"),
            (10, "order_id", "'ORD99999999'"),
            (10, "quantity", "0"),
            (10, "unit_price", "-500"),
            (10, "discount_percentage", "150"),
        ],
        10,
    ),
    "payments": (
        [
            (10, "payment_amount", "null"),
            (10, "payment_amount", "-1000"),
            (10, "order_id", "'ORD99999999'"),
            (10, "payment_status", "'Unknown'"),
            (5, "payment_date", "'2099-01-01 00:00:00'"),
        ],
        10,
    ),
}


class Draw:
    """Numbers below n from a key, a seed and what they are for."""

    def __init__(self, seed: int, key: str = "n"):
        self.seed, self.key = seed, key

    def below(self, n, what: str) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key), F.lit(self.seed), F.lit(what)), F.lit(n) if isinstance(n, int) else n)

    def one(self, values: list, what: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(len(values), what) + 1).cast("int"))

    def weighed(self, weights: dict, what: str) -> Column:
        at, total, out = self.below(sum(weights.values()), what), 0, None
        for value, weight in weights.items():
            total += weight
            out = (F.when if out is None else out.when)(at < total, F.lit(value))
        return out


def _id(name: str, n: Column) -> Column:
    start, width = IDS[name]
    return F.concat(F.lit(start), F.lpad(n.cast("string"), width, "0"))


def _number(name: str) -> Column:
    return F.substring(F.col(KEYS[name]), len(IDS[name][0]) + 1, 20).cast("long")


def _state(city: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CITIES.items() for x in pair)), city)


def _when(start: str, seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + seconds), "yyyy-MM-dd HH:mm:ss")


def _people(n: DataFrame, seed: int, signup: Column, segment: Column) -> DataFrame:
    d = Draw(seed)
    rows = n.select(
        "n",
        _id("customers", F.col("n")).alias("customer_id"),
        d.one(FIRST, "first").alias("first_name"),
        d.one(LAST, "last").alias("last_name"),
        d.one(list(CITIES), "city").alias("city"),
        signup.alias("signup_date"),
        segment.alias("customer_segment"),
    )
    email = F.concat(F.lower("first_name"), F.lit("."), F.lower("last_name"), F.col("n").cast("string"), F.lit("@example.com"))
    phone = F.concat(F.lit("+91"), (7_000_000_000 + F.col("n")).cast("string"))
    return rows.select(
        "customer_id",
        "first_name",
        "last_name",
        email.alias("email"),
        phone.alias("phone"),
        "city",
        _state(F.col("city")).alias("state"),
        F.lit("India").alias("country"),
        "signup_date",
        "customer_segment",
    )


def _sales(
    n: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    seed: int,
    statuses: dict,
    day: str,
    seconds: int,
    most: int,
    first_item: Column | int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders numbered ``n``, their items and one payment each. Item ids follow the order's number, ``most`` of them kept for each."""
    d = Draw(seed)
    counts = customers.agg(F.count("*").alias("n_people")).crossJoin(products.agg(F.count("*").alias("n_goods")))  # of single rows
    base = n.crossJoin(F.broadcast(counts)).withColumns(
        {
            "order_id": _id("orders", F.col("n")),
            "customer_id": _id("customers", d.below(F.col("n_people"), "customer") + 1),
            "_at": d.below(seconds, "date"),
            "order_status": d.weighed(statuses, "status"),
        }
    )
    base = base.withColumn("order_date", _when(day, F.col("_at")))
    homes = customers.select("customer_id", F.col("city").alias("shipping_city"), F.col("state").alias("shipping_state"))
    orders = base.join(homes, "customer_id", "left").select(
        "order_id",
        "customer_id",
        "order_date",
        "order_status",
        "shipping_city",
        "shipping_state",
    )
    lines = base.withColumn("k", F.explode(F.sequence(F.lit(0), d.below(most, "items").cast("int"))))
    lines = lines.withColumn("n_line", F.col("n") * most + F.col("k"))
    x = Draw(seed, "n_line")
    lines = lines.select(
        "order_id",
        _id("order_items", F.col("n_line") + first_item).alias("order_item_id"),
        _id("products", x.below(F.col("n_goods"), "product") + 1).alias("product_id"),
        (x.below(4, "quantity") + 1).cast("int").alias("quantity"),
        x.weighed(DISCOUNTS, "discount").cast("double").alias("discount_percentage"),
    )
    items = lines.join(products.select("product_id", F.col("price").alias("unit_price")), "product_id").select(
        "order_item_id",
        "order_id",
        "product_id",
        "quantity",
        "unit_price",
        "discount_percentage",
    )
    totals = items.groupBy("order_id").agg(
        F.round(F.sum(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_percentage") / 100)), 2).alias("payment_amount")
    )
    status = F.when(
        F.col("order_status") == "Cancelled",
        d.one(["Failed", "Refunded"], "paid"),
    ).when(F.col("order_status") == "Returned", "Refunded").otherwise(d.weighed(PAID, "paid"))
    payments = base.join(totals, "order_id", "left").select(
        _id("payments", F.col("n")).alias("payment_id"),
        "order_id",
        d.one(METHODS, "method").alias("payment_method"),
        status.alias("payment_status"),
        "payment_amount",
        _when(day, F.col("_at") + 60 * (1 + d.below(120, "minutes"))).alias("payment_date"),
    )
    return orders, items, payments


def clean(spark: SparkSession, customers: int = 5000, products: int = 1000, orders: int = 50_000, seed: int = 42) -> dict[str, DataFrame]:
    """A first day. Every customer, product and order has an id from 1 on."""
    numbers = lambda n: spark.range(1, n + 1).select(F.col("id").alias("n"))
    d = Draw(seed)
    people = _people(
        numbers(customers),
        seed,
        F.date_add(F.lit("2022-01-01").cast("date"), d.below(1642, "signup").cast("int")).cast("string"),
        d.weighed(SEGMENTS, "segment"),
    )
    goods = numbers(products).withColumn("category", d.one(list(BRANDS), "category"))
    brand = F.coalesce(*(F.when(F.col("category") == c, d.one(b, "brand")) for c, b in BRANDS.items()))
    goods = goods.withColumn("brand", brand).select(
        _id("products", F.col("n")).alias("product_id"),
        F.concat_ws(" ", "brand", "category", F.lit("Item"), "n").alias("product_name"),
        "category",
        "brand",
        ((10_000 + d.below(7_490_001, "price")) / 100).alias("price"),
        d.below(1501, "stock").cast("int").alias("stock_quantity"),
    )
    o, i, p = _sales(numbers(orders), people, goods, seed, STATUSES, "2024-01-01", 930 * 86_400, 5, 0)
    return {"customers": people, "products": goods, "orders": o, "order_items": i, "payments": p}


def _marked(df: DataFrame, key: str, n: int, seed: int, mark: str) -> DataFrame:
    """With a column that is true for n rows' keys."""
    some = df.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(mark)), key).limit(n)
    return df.join(F.broadcast(some.withColumn(mark, F.lit(True))), key, "left")


def _changed(df: DataFrame, key: str, n: int, seed: int, column: str, value: Column) -> DataFrame:
    mark = f"_{column}_{seed}"
    return _marked(df, key, n, seed, mark).withColumn(column, F.when(F.col(mark), value).otherwise(F.col(column))).select(*df.columns)


def next_day(
    tables: dict[str, DataFrame],
    batch: str,
    seed: int = 7,
    upgrades: int = 150,
    moves: int = 60,
    sign_ups: int = 80,
    prices: int = 40,
    orders: int = 600,
) -> dict[str, DataFrame]:
    """The day after: upgraded, moved and new customers, new prices, new orders; 24 of the new rows are bad."""
    spark = tables["customers"].sparkSession
    people, goods, c = tables["customers"], tables["products"], Draw(seed, "customer_id")
    up = F.element_at(
        F.create_map(*(F.lit(x) for x in ("Regular", "Silver", "Silver", "Gold", "Gold", "Platinum", "Platinum", "Platinum"))),
        F.col("customer_segment"),
    )
    people = _changed(people, "customer_id", upgrades, seed, "customer_segment", up)
    people = _changed(people, "customer_id", moves, seed + 1, "city", c.one(list(CITIES), "move"))
    people = people.withColumn("state", F.coalesce(_state(F.col("city")), "state"))
    last = lambda name: tables[name].agg(F.max(_number(name)).alias("last"))
    after = lambda name, n: spark.range(1, n + 1).crossJoin(F.broadcast(last(name))).select((F.col("id") + F.coalesce("last",
        F.lit(0))).alias("n"))
    people = people.unionByName(_people(after("customers", sign_ups), seed, F.lit(batch), F.lit("Regular")))
    goods = _changed(
        goods,
        "product_id",
        prices,
        seed + 2,
        "price",
        F.round(F.col("price") * (85 + Draw(seed, "product_id").below(31, "price")) / 100, 2),
    )
    o, i, p = _sales(after("orders", orders), people, goods, seed, NEW_STATUSES, batch, 86_400, 4, 1_000_000)
    i = _changed(_changed(i, "order_item_id", 8, 1, "quantity", F.lit(-2)), "order_item_id", 5, 2, "product_id", F.lit("PROD99999"))
    o = _changed(o, "order_id", 6, 3, "customer_id", F.lit("CUST999999"))
    p = _changed(p, "payment_id", 5, 4, "payment_amount", F.lit(None))
    new = {"orders": o, "order_items": i, "payments": p}
    return {"customers": people, "products": goods} | {n: tables[n].unionByName(rows) for n, rows in new.items()}


def dirty(tables: dict[str, DataFrame], seed: int = 11) -> dict[str, DataFrame]:
    """The tables with the defects of ``DIRT``; each defect picks its rows by itself, and a damaged row may come twice."""
    out = {}
    for name, (defects, twice) in DIRT.items():
        rows, key = tables[name], KEYS[name]
        for k, (n, column, value) in enumerate(defects):
            rows = _changed(rows, key, n, seed + k, column, F.expr(value).cast(rows.schema[column].dataType))
        again = _marked(rows, key, twice, seed + 99, "_twice").where("_twice").select(*rows.columns)
        out[name] = rows.unionByName(again)
    return out


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """As ``<folder>/<dataset>.csv``, which the batch run reads."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
