"""The retail relations as views of the test tables, in SQL that both engines read alike, and two batches of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST, SECOND = "1995-01-01", "1996-01-01"

_VIEWS = {
    "customers": """SELECT 'C' || CAST(c_custkey AS STRING) AS customer_id, 'customer' AS first_name, CAST(c_custkey AS STRING) AS last_name,
      CASE WHEN c_custkey % 97 = 5 THEN 'not-an-address' WHEN c_custkey % 89 = 3 THEN NULL ELSE 'C' || CAST(c_custkey AS STRING)
          || '@Example.com' END AS email,
      lower(n_name) AS city, CASE WHEN c_custkey % 101 = 7 THEN NULL ELSE 'state ' || CAST(c_nationkey AS STRING) END AS state, n_name AS country,
      '2022-12-12' AS signup_date, c_mktsegment AS customer_segment FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "products": """SELECT 'P' || CAST(p_partkey AS STRING) AS product_id, lower(p_name) AS product_name, p_type AS category, p_brand AS brand,
      CASE WHEN p_partkey % 53 = 1 THEN -p_retailprice ELSE p_retailprice END AS price, CASE WHEN p_partkey % 59 = 2 THEN -p_size
          ELSE p_size END AS stock_quantity FROM {part}""",
    "orders": """SELECT 'O' || CAST(o_orderkey AS STRING) AS order_id, CASE WHEN o_orderkey % 211 = 3 THEN 'C-1' ELSE 'C' || CAST(o_custkey
        AS STRING) END AS customer_id,
      CASE WHEN o_orderkey % 223 = 5 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 08:15:00' END AS order_date,
      CASE WHEN o_orderkey % 199 = 7 THEN 'Unknown' WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'O' THEN 'Pending'
          ELSE 'Shipped' END AS order_status FROM {orders}""",
    "order_items": """SELECT 'I' || concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS
        STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) AS order_item_id,
      'O' || CAST(l_orderkey AS STRING) AS order_id, CASE WHEN l_partkey % 307 = 4 THEN 'P-1' ELSE 'P' || CAST(l_partkey AS STRING) END AS product_id,
      CASE WHEN l_partkey % 311 = 6 THEN 0 ELSE CAST(l_quantity AS INT) END AS quantity, l_extendedprice AS unit_price,
      CASE WHEN l_partkey % 313 = 8 THEN 150.0 ELSE round(l_discount * 100, 0) END AS discount_percentage FROM {lineitem}""",
    "payments": """SELECT 'Y' || CAST(o_orderkey AS STRING) AS payment_id, 'O' || CAST(o_orderkey AS STRING) AS order_id,
      CASE o_orderkey % 5 WHEN 0 THEN 'UPI' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Debit Card' WHEN 3 THEN 'Net Banking' ELSE
          'Wallet' END AS payment_method,
      CASE WHEN o_orderkey % 227 = 9 THEN 'Unknown' WHEN o_orderstatus = 'F' THEN 'Success' WHEN o_orderstatus = 'O' THEN 'Pending'
          ELSE 'Refunded' END AS payment_status,
      CASE WHEN o_orderkey % 229 = 1 THEN NULL WHEN o_orderkey % 233 = 1 THEN -o_totalprice ELSE o_totalprice END AS payment_amount,
      CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 09:30:00' AS payment_date FROM {orders}""",
}

_TABLES = {"customers": ("customer", "nation"), "products": ("part",), "orders": ("orders",), "order_items": ("lineitem",), "payments": ("orders",)}

#: Two batches of customers: the first lacks each 13th key, the second each 17th; each 7th changes its segment.
_NUMBER = "CAST(substr(customer_id, 2) AS BIGINT)"
_BATCHES = {
    "previous_customers": f"SELECT * FROM {{customers}} WHERE {_NUMBER} % 13 <> 0",
    "current_customers": f"SELECT customer_id, first_name, last_name, email, city, state, country, signup_date, CASE WHEN {_NUMBER} % 7 = 0 THEN 'Platinum' ELSE customer_segment END AS customer_segment FROM {{customers}} WHERE {_NUMBER} % 17 <> 0",
    "changed_customers": f"SELECT customer_id, first_name, last_name, email, city, state, country, signup_date, CASE WHEN {_NUMBER} % 7 = 0 THEN 'Platinum' ELSE customer_segment END AS customer_segment FROM {{customers}}",
    "repriced_products": "SELECT product_id, product_name, category, brand, CASE WHEN CAST(substr(product_id, 2) AS BIGINT) % 11 = 0 THEN price + 1 ELSE price END AS price, stock_quantity FROM {products}",
    "strict_customers": f"""SELECT customer_id, first_name, last_name, email, city, state, country, signup_date,
      CASE WHEN {_NUMBER} % 37 = 0 THEN 'Diamond' WHEN {_NUMBER} % 2 = 0 THEN 'Gold' ELSE 'Regular' END AS customer_segment FROM {{customers}}""",
    "strict_products": """SELECT product_id, product_name, CASE CAST(substr(product_id, 2) AS BIGINT) % 9 WHEN 0 THEN 'Garden'
        WHEN 1 THEN 'Books' WHEN 2 THEN 'Toys' ELSE 'Home' END AS category,
      brand, price, stock_quantity FROM {products}""",
    "strict_orders": """SELECT order_id, customer_id, order_date, order_status, 'town' AS shipping_city,
      CASE WHEN CAST(substr(order_id, 2) AS BIGINT) % 41 = 0 THEN '  ' ELSE 'state' END AS shipping_state FROM {orders}""",
}
_BASE = {n: n.split("_")[1] for n in _BATCHES} | {"repriced_products": "products"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if base := _BASE.get(name):
        return spark.sql(_BATCHES[name], **{base: relation(spark, sf_dir, base)})
    return spark.sql(_VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]})


def prelude(*names: str) -> str:
    """The relations as common table expressions r_<name>, for the SQL that checks a query."""
    out = []
    for name in dict.fromkeys(n for x in names for n in (_BASE.get(x), x) if n):
        tables = {t: t for ts in _TABLES.values() for t in ts}
        sql = (_BATCHES.get(name) or _VIEWS[name]).format(**tables | ({_BASE[name]: f"r_{_BASE[name]}"} if name in _BASE else {}))
        out.append(f"r_{name} AS ({sql})")
    return ",\n".join(out)
