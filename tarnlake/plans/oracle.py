"""For each query the SQL that DuckDB checks it with, written apart from the DataFrame code over the same relations."""

from __future__ import annotations

from .retail import prelude


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(trim({x})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _key(*parts: str) -> str:
    return "sha256(concat_ws('||', " + ", ".join(f"coalesce(({p})::VARCHAR, 'NULL')" for p in parts) + "))"


def _with(names: tuple[str, ...], body: str, more: str = "") -> str:
    return f"WITH {prelude(*names)}{more}\n{body}"


_DAY = "try_cast(left({}, 10) AS DATE)"
_OD = _DAY.format("order_date")

_CLEAN = {
    "customers": f"""SELECT customer_id, {_title("first_name")} AS first_name, {_title("last_name")} AS last_name, lower(email)
        AS email, {_title("city")} AS city, {_title("state")} AS state,
      {_title("country")} AS country, signup_date, customer_segment, concat_ws(' ', {_title("first_name")}, {_title("last_name")})
          AS customer_full_name FROM r_customers""",
    "products": f"""SELECT product_id, {_title("product_name")} AS product_name, {_title("category")} AS category, {_title("brand")}
        AS brand, price::DECIMAL(18,2)::DOUBLE AS price, stock_quantity FROM r_products""",
    "orders": f"""SELECT order_id, customer_id, CASE WHEN {_OD} IS NOT NULL THEN order_date END AS order_date, upper(order_status)
        AS order_status, {_OD}::VARCHAR AS order_day,
      year({_OD})::VARCHAR AS order_year, month({_OD})::VARCHAR AS order_month, quarter({_OD})::VARCHAR AS order_quarter FROM r_orders""",
    "order_items": """SELECT order_item_id, order_id, product_id, quantity, unit_price::DECIMAL(18,2)::DOUBLE AS unit_price, discount_percentage::DECIMAL(18,2)::DOUBLE
        AS discount_percentage,
      (unit_price::DECIMAL(18,2) * quantity)::DOUBLE AS gross_amount, (unit_price::DECIMAL(18,2) * quantity)::DOUBLE AS net_amount
          FROM r_order_items""",
    "payments": f"""SELECT payment_id, order_id, CASE payment_method WHEN 'UPI' THEN 'Upi' ELSE payment_method END AS payment_method,
        upper(payment_status) AS payment_status,
      payment_amount::DECIMAL(18,2)::DOUBLE AS payment_amount, payment_date, {_DAY.format("payment_date")}::VARCHAR AS payment_day FROM r_payments""",
}

# Errors: one list of CASEs for each dataset, nulls left out by concat_ws.
_EMAIL = "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"
_ERRORS = f""",
e_customers AS (SELECT customer_id, concat_ws('; ', CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '{_EMAIL}') THEN
    'INVALID_EMAIL_FORMAT' END) AS reason FROM r_customers),
e_products AS (SELECT product_id, concat_ws('; ', CASE WHEN price < 0 THEN 'NEGATIVE_PRICE' END, CASE WHEN stock_quantity < 0
    THEN 'NEGATIVE_STOCK_QUANTITY' END) AS reason FROM r_products),
e_orders AS (SELECT order_id, concat_ws('; ', CASE WHEN {_OD} IS NULL THEN 'INVALID_TIMESTAMP:order_date' END,
  CASE WHEN order_status NOT IN ('Pending', 'Confirmed', 'Shipped', 'Delivered', 'Cancelled', 'Returned') THEN 'INVALID_VALUE:order_status' END,
  CASE WHEN customer_id NOT IN (SELECT customer_id FROM r_customers) THEN 'CUSTOMER_NOT_FOUND' END) AS reason FROM r_orders),
gone AS (SELECT DISTINCT order_id FROM e_orders WHERE reason <> ''),
e_order_items AS (SELECT order_item_id, concat_ws('; ', CASE WHEN count(*) OVER (PARTITION BY order_item_id) > 1 THEN 'DUPLICATE_PRIMARY_KEY'
    END, CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'INVALID_QUANTITY' END,
  CASE WHEN unit_price IS NULL OR unit_price < 0 THEN 'INVALID_UNIT_PRICE' END, CASE WHEN discount_percentage < 0 OR discount_percentage
      > 100 THEN 'INVALID_DISCOUNT_PERCENTAGE' END,
  CASE WHEN order_id NOT IN (SELECT order_id FROM r_orders) THEN 'ORDER_NOT_FOUND' END, CASE WHEN product_id NOT IN (SELECT product_id
      FROM r_products) THEN 'PRODUCT_NOT_FOUND' END,
  CASE WHEN order_id IN (SELECT order_id FROM gone) THEN 'PARENT_ORDER_QUARANTINED' END) AS reason FROM r_order_items),
e_payments AS (SELECT payment_id, concat_ws('; ', CASE WHEN payment_status NOT IN ('Pending', 'Success', 'Completed', 'Failed',
    'Refunded') THEN 'INVALID_VALUE:payment_status' END,
  CASE WHEN payment_amount IS NULL OR payment_amount < 0 THEN 'INVALID_PAYMENT_AMOUNT' END, CASE WHEN order_id IN (SELECT order_id
      FROM gone) THEN 'PARENT_ORDER_QUARANTINED' END) AS reason FROM r_payments),
e_all AS (SELECT 'customers' AS dataset, reason FROM e_customers UNION ALL SELECT 'products', reason FROM e_products UNION ALL
    SELECT 'orders', reason FROM e_orders
  UNION ALL SELECT 'order_items', reason FROM e_order_items UNION ALL SELECT 'payments', reason FROM e_payments)"""  # fmt: skip

_ALL = ("customers", "products", "orders", "order_items", "payments")
_BY_KEY = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id"}

_CDC = """,
cdc AS (SELECT coalesce(c.customer_id, p.customer_id) AS customer_id, CASE WHEN c.customer_id IS NULL THEN p.customer_segment
    ELSE c.customer_segment END AS customer_segment,
  CASE WHEN p.customer_id IS NULL THEN 'INSERTED' WHEN c.customer_id IS NULL THEN 'DELETED' WHEN c.customer_segment = p.customer_segment
      THEN 'UNCHANGED' ELSE 'UPDATED' END AS change_type
  FROM r_current_customers c FULL JOIN r_previous_customers p ON c.customer_id = p.customer_id),
hist AS (SELECT p.customer_id, p.customer_segment, DATE '1900-01-01' AS effective_from, CASE WHEN c.change_type IN ('UPDATED',
    'DELETED') THEN DATE '1995-12-31' END AS effective_to,
    c.change_type NOT IN ('UPDATED', 'DELETED') AS is_current, 1 AS record_version FROM r_previous_customers p JOIN cdc c USING (customer_id)
  UNION ALL SELECT customer_id, customer_segment, DATE '1996-01-01', NULL, true, CASE change_type WHEN 'UPDATED' THEN 2 ELSE 1
      END FROM cdc WHERE change_type IN ('INSERTED', 'UPDATED'))"""
_BOTH = ("previous_customers", "current_customers")


def _versions(name: str, base: str, later: str, key: str, value: str, shown: str) -> str:
    """Two versions of what has changed, one of the rest."""
    changed = f"b.{value} IS DISTINCT FROM n.{value}"
    return f"""{name} AS (
  SELECT b.{key}, {shown.format("b")}, DATE '1900-01-01' AS effective_from, CASE WHEN {changed} THEN DATE '1995-12-31' END AS
      effective_to, NOT ({changed}) AS is_current, 1 AS record_version FROM {base} b JOIN {later} n USING ({key})
  UNION ALL SELECT b.{key}, {shown.format("n")}, DATE '1996-01-01', NULL, true, 2 FROM {base} b JOIN {later} n USING ({key}) WHERE {changed})"""


_SK = ("effective_from", "record_version")
_STAR = f""",
{
    _versions(
        "people",
        "r_customers",
        "r_changed_customers",
        "customer_id",
        "customer_segment",
        "{0}.customer_segment, concat_ws(' ', 'Customer', {0}.last_name) AS customer_full_name",
    )
},
{
    _versions(
        "goods",
        "r_products",
        "r_repriced_products",
        "product_id",
        "price",
        "{0}.price::DECIMAL(18,2) AS price, " + _title("{0}.category") + " AS category, " + _title("{0}.product_name") + " AS product_name",
    )
},
dim_customer AS (SELECT {_key("customer_id", *_SK)} AS customer_sk, *, is_current AS is_active FROM people),
dim_product AS (SELECT {_key("product_id", *_SK)} AS product_sk, * FROM goods),
o0 AS (SELECT order_id, customer_id, upper(order_status) AS order_status, {_OD} AS order_day FROM r_orders WHERE customer_id <>
    'C-1' AND order_date <> 'soon'),
orders_e AS (SELECT o.*, {_key("'ORDER'", "order_id")} AS order_sk, c.customer_sk FROM o0 o JOIN dim_customer c ON o.customer_id
    = c.customer_id AND order_day >= effective_from AND (effective_to IS NULL OR order_day <= effective_to)),
i0 AS (SELECT DISTINCT ON (order_item_id) * FROM r_order_items WHERE product_id <> 'P-1'),
items_e AS (SELECT i.order_item_id, i.order_id, i.product_id, i.quantity, o.order_sk, o.customer_sk, o.customer_id, o.order_day,
    o.order_status, p.product_sk,
  (i.unit_price::DECIMAL(18,2) * i.quantity)::DECIMAL(18,2) AS gross_amount, round((i.unit_price::DECIMAL(18,2) * i.quantity)::DECIMAL(18,2)
      * i.discount_percentage::DECIMAL(9,2) * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) AS discount_amount
  FROM i0 i JOIN orders_e o USING (order_id) JOIN dim_product p ON i.product_id = p.product_id AND order_day >= effective_from
      AND (effective_to IS NULL OR order_day <= effective_to)),
fact_sales AS (SELECT *, {_key("order_item_id", "order_sk", "product_sk")} AS sales_sk, strftime(order_day, '%Y%m%d')::INT AS
    order_date_key, 0::DECIMAL(18,2) AS tax_amount, (gross_amount - discount_amount)::DECIMAL(18,2) AS net_amount FROM items_e),
fact_payment AS (SELECT p.payment_id, o.order_sk, o.customer_sk, {_key("payment_id", "order_sk")} AS payment_sk, {_DAY.format("payment_date")}
    AS payment_day, strftime({_DAY.format("payment_date")}, '%Y%m%d')::INT AS payment_date_key,
  CASE payment_method WHEN 'UPI' THEN 'Upi' ELSE payment_method END AS payment_method, upper(payment_status) AS payment_status,
      payment_amount::DECIMAL(18,2) AS payment_amount,
  CASE WHEN upper(payment_status) = 'REFUNDED' THEN payment_amount::DECIMAL(18,2) ELSE 0 END::DECIMAL(18,2) AS refund_amount,
  (payment_amount::DECIMAL(18,2) - CASE WHEN upper(payment_status) = 'REFUNDED' THEN payment_amount::DECIMAL(18,2) ELSE 0 END)::DECIMAL(18,2)
      AS net_payment_amount, upper(payment_status) IN ('SUCCESS', 'SUCCESSFUL', 'COMPLETED', 'PAID', 'CAPTURED') AS is_successful
  FROM r_payments p JOIN orders_e o USING (order_id)),
span AS (SELECT min(d) AS a, max(d) AS b FROM (SELECT order_day AS d FROM o0 UNION ALL SELECT payment_day FROM fact_payment)),
days AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM span)"""  # fmt: skip
_STARS = (*_ALL, "changed_customers", "repriced_products")


def _star(body: str) -> str:
    return _with(_STARS, body, _STAR)


def _ratio(a: str, b: str) -> str:
    n, d = f"(2 * (({a}) * 100)::BIGINT + ({b})::BIGINT)", f"(2 * ({b})::BIGINT)"
    return f"coalesce(CASE WHEN {b} > 0 THEN (({n} - (({n} % {d}) + {d}) % {d}) / {d})::DOUBLE / 100 END, 0.0)::DOUBLE"


_MONEY = "sum({0})::DOUBLE AS {1}"
_TABLES = ("dim_customer", "dim_product", "fact_sales", "fact_payment")

_PRODUCT = f"""SELECT p.product_sk, p.product_id, p.category, coalesce(q, 0)::BIGINT AS total_quantity_sold, coalesce(n, 0) AS
    total_orders, coalesce(g, 0)::DOUBLE AS gross_revenue, coalesce(r, 0)::DOUBLE AS net_revenue, {_ratio("r", "q")} AS average_selling_price
  FROM dim_product p LEFT JOIN (SELECT product_sk, sum(quantity) AS q, count(DISTINCT order_sk) AS n, sum(gross_amount) AS g,
      sum(net_amount) AS r FROM fact_sales GROUP BY product_sk) USING (product_sk)"""
_CUSTOMER = f"""SELECT c.customer_sk, c.customer_id, c.customer_full_name AS customer_name, c.customer_segment, coalesce(n, 0)
    AS total_orders, coalesce(i, 0) AS total_items, coalesce(r, 0)::DOUBLE AS total_spent, a::VARCHAR AS first_order_date, b::VARCHAR
    AS latest_order_date, {_ratio("r", "n")} AS average_order_value
  FROM dim_customer c LEFT JOIN (SELECT customer_sk, count(DISTINCT order_sk) AS n, count(*) AS i, sum(net_amount) AS r, min(order_day)
      AS a, max(order_day) AS b FROM fact_sales GROUP BY customer_sk) USING (customer_sk)"""

SQL: dict[str, str] = (
    {f"p_clean_{n}": _with((n,), q) for n, q in _CLEAN.items()}
    | {
        f"v_errors_{n}": _with(
            _ALL,
            f"SELECT {_BY_KEY[n]}, CASE WHEN reason = '' THEN 'VALID' ELSE 'INVALID' END AS status, reason FROM e_{n}",
            _ERRORS,
        )
        for n in _ALL
    }
    | {
        "v_rule_report": _with(
            _ALL,
            "SELECT dataset, rule, count(*) AS failed, round(count(*) * 100.0::DOUBLE / any_value(total), 2) AS percent FROM (SELECT dataset, unnest(string_split(reason, "
            "'; ')) AS rule FROM e_all WHERE reason <> '') JOIN (SELECT dataset, count(*) AS total FROM e_all GROUP BY dataset) USING (dataset) "
            "GROUP BY dataset, rule",
            _ERRORS,
        ),
        "v_summary": _with(
            _ALL,
            "SELECT dataset, count(*) AS total, count(*) FILTER (reason = '') AS valid, count(*) FILTER (reason <> '') AS invalid, CASE WHEN count(*) "
            "FILTER (reason <> '') = 0 THEN 'SUCCESS' ELSE 'COMPLETED_WITH_INVALID_RECORDS' END AS status FROM e_all GROUP BY dataset",
            _ERRORS,
        ),
        "j_anti_fk": _with(
            ("orders", "customers"),
            "SELECT order_id, customer_id FROM r_orders WHERE NOT EXISTS (SELECT 1 FROM r_customers c WHERE c.customer_id = r_orders.customer_id)",
        ),
        "j_point_in_time": _with(
            (*_BOTH, "orders"),
            f"SELECT order_id, customer_id, customer_sk FROM (SELECT o.order_id, o.customer_id, CASE WHEN h.customer_id IS NOT NULL THEN {_key('h.customer_id', 'effective_from', 'record_version')} "
            f"END AS customer_sk, row_number() OVER (PARTITION BY o.order_id ORDER BY effective_from DESC NULLS LAST, record_version DESC NULLS "
            f"LAST) AS nth FROM r_orders o LEFT JOIN hist h ON o.customer_id = h.customer_id AND {_OD} >= effective_from AND (effective_to IS NULL "
            f"OR {_OD} <= effective_to)) WHERE nth = 1",
            _CDC,
        ),
        "c_cdc_customers": _with(_BOTH, "SELECT * FROM cdc", _CDC),
        "c_cdc_pivot": _with(
            _BOTH,
            "SELECT " + ", ".join(
                f"count(*) FILTER (change_type = '{k}') AS {k}" for k in ("INSERTED", "UPDATED", "UNCHANGED", "DELETED")
            ) + " FROM cdc",
            _CDC,
        ),
        "m_snapshot_merge": _with(
            _BOTH,
            "SELECT customer_id, concat_ws(' ', 'Customer', last_name) AS customer_full_name, customer_segment, signup_date FROM r_current_customers",
            _CDC,
        ),
        "s_scd2_init": _with(
            _BOTH,
            "SELECT customer_id, customer_segment, '1900-01-01' AS effective_from, NULL::VARCHAR AS effective_to, true AS is_current, 1 AS record_version "
            "FROM r_previous_customers",
        ),
        "s_scd2_merge": _with(
            _BOTH,
            "SELECT customer_id, customer_segment, effective_from::VARCHAR AS effective_from, effective_to::VARCHAR AS effective_to, is_current, "
            "record_version FROM hist",
            _CDC,
        ),
        "s_scd2_sound": _with(
            _BOTH,
            "SELECT count(*) FILTER (n > 1) AS several_current, coalesce(sum(back), 0)::BIGINT AS backwards, coalesce(sum(ended), 0)::BIGINT AS "
            "current_ended FROM (SELECT customer_id, count(*) FILTER (is_current) AS n, count(*) FILTER (effective_to < effective_from) AS back, "
            "count(*) FILTER (is_current AND effective_to IS NOT NULL) AS ended FROM hist GROUP BY customer_id)",
            _CDC,
        ),
        "e_orders": _star("SELECT order_id, order_sk, customer_sk FROM orders_e"),
        "e_order_items": _star("SELECT order_item_id, order_sk, customer_sk, product_sk FROM items_e"),
        "e_payments": _star("SELECT payment_id, order_sk FROM fact_payment"),
        "g_dim_customer": _star(
            "SELECT customer_sk, customer_id, customer_full_name, customer_segment, effective_from::VARCHAR AS effective_from, effective_to::VARCHAR "
            "AS effective_to, is_current, record_version, is_active FROM dim_customer"
        ),
        "g_dim_product": _star(
            "SELECT product_sk, product_id, category, price::DOUBLE AS price, effective_from::VARCHAR AS effective_from, effective_to::VARCHAR "
            "AS effective_to, is_current, record_version FROM dim_product"
        ),
        "g_dim_date": _star(
            "SELECT strftime(d, '%Y%m%d')::INT AS date_key, d::VARCHAR AS calendar_date, day(d)::INT AS day_number, dayname(d) AS day_name, (dayofweek(d) "
            "+ 1)::INT AS day_of_week, weekofyear(d)::INT AS week_of_year, month(d)::INT AS month_number, monthname(d) AS month_name, quarter(d)::INT "
            "AS quarter_number, 'Q' || quarter(d) AS quarter_name, year(d)::INT AS year_number, strftime(d, '%Y-%m') AS year_month, dayofweek(d) "
            "IN (0, 6) AS is_weekend FROM days"
        ),
        "g_fact_sales": _star(
            "SELECT sales_sk, order_item_id, order_id, order_sk, customer_sk, product_sk, order_date_key, quantity, gross_amount::DOUBLE AS gross_amount, "
            "discount_amount::DOUBLE AS discount_amount, tax_amount::DOUBLE AS tax_amount, net_amount::DOUBLE AS net_amount, order_status FROM "
            "fact_sales"
        ),
        "g_fact_payment": _star(
            "SELECT payment_sk, payment_id, order_sk, customer_sk, payment_date_key, payment_amount::DOUBLE AS payment_amount, refund_amount::DOUBLE "
            "AS refund_amount, net_payment_amount::DOUBLE AS net_payment_amount, is_successful FROM fact_payment"
        ),
        "k_daily": _star(
            f"SELECT order_day::VARCHAR AS order_date, count(DISTINCT order_sk) AS total_orders, count(*) AS total_items, {_MONEY.format('gross_amount', 'gross_revenue')}, "
            f"{_MONEY.format('discount_amount', 'total_discount')}, {_MONEY.format('tax_amount', 'total_tax')}, {_MONEY.format('net_amount', 'net_revenue')}, "
            f"count(DISTINCT customer_id) AS unique_customers, {_ratio('sum(net_amount)', 'count(DISTINCT order_sk)')} AS average_order_value FROM "
            f"fact_sales GROUP BY order_day"
        ),
        "k_product": _star(_PRODUCT),
        "k_customer": _star(_CUSTOMER),
        "k_payment": _star(
            f"SELECT payment_day::VARCHAR AS payment_date, payment_method, payment_status, count(*) AS payment_count, {', '.join(_MONEY.format(c, c) for c in ('payment_amount', 'refund_amount', 'net_payment_amount'))} "
            f"FROM fact_payment GROUP BY payment_day, payment_method, payment_status"
        ),
        "k_executive": _star(
            f"SELECT * FROM (SELECT count(DISTINCT order_sk) AS total_orders, count(*) AS total_items_sold, count(DISTINCT customer_id) AS total_customers, "
            f"count(DISTINCT product_id) AS total_products_sold, {_MONEY.format('gross_amount', 'gross_revenue')}, {_MONEY.format('discount_amount', 'total_discount')}, "
            f"{_MONEY.format('tax_amount', 'total_tax')}, {_MONEY.format('net_amount', 'net_revenue')}, {_ratio('sum(net_amount)', 'count(DISTINCT order_sk)')} "
            f"AS average_order_value FROM fact_sales), (SELECT count(*) FILTER (is_successful) AS successful_payments, {_MONEY.format('payment_amount', 'total_payment_amount')}, "
            f"{_MONEY.format('refund_amount', 'total_refund_amount')} FROM fact_payment)"
        ),
        "x_monthly_breakdown": _star(
            f"SELECT date_trunc('month', order_day)::DATE::VARCHAR AS month, category, customer_segment, order_status, {_MONEY.format('net_amount', 'net_revenue')}, "
            f"{_MONEY.format('discount_amount', 'discount')}, sum(quantity)::BIGINT AS items, count(DISTINCT order_sk) AS orders FROM fact_sales "
            f"JOIN dim_product USING (product_sk) JOIN (SELECT customer_sk, customer_segment FROM dim_customer) USING (customer_sk) GROUP BY 1, "
            f"2, 3, 4"
        ),
        "x_top_products": _star(
            "SELECT product_id, sum(net_amount)::DOUBLE AS net_revenue FROM fact_sales GROUP BY product_id ORDER BY sum(net_amount) DESC, product_id "
            "LIMIT 10"
        ),
        "x_top_customers": _star(
            "SELECT customer_id, sum(net_amount)::DOUBLE AS total_spent FROM fact_sales GROUP BY customer_id ORDER BY sum(net_amount) DESC, customer_id "
            "LIMIT 10"
        ),
        "x_scd2_history": _star(
            "SELECT customer_id, customer_segment, effective_from::VARCHAR AS effective_from, effective_to::VARCHAR AS effective_to, n_versions "
            "FROM (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n_versions FROM people) WHERE n_versions > 1"
        ),
        "x_repeat_customers": _star(
            "SELECT customer_id, count(DISTINCT order_sk) AS total_orders FROM fact_sales GROUP BY customer_id HAVING count(DISTINCT order_sk) >= 2"
        ),
        "x_layer_counts": _star(
            "SELECT 'dim_date' AS layer, count(*) AS n_rows FROM days UNION ALL SELECT 'orders', count(*) FROM orders_e UNION ALL SELECT 'order_items', count(*) FROM items_e UNION ALL SELECT 'payments', count(*) FROM fact_payment " + " ".join(
                f"UNION ALL SELECT '{t}', count(*) FROM {t}" for t in _TABLES
            )
        ),
    }
)


# The assertions: a count for each.

def _checks() -> str:
    rows: list[tuple[str, str, str]] = []

    def add(table: str, name: str, test: str) -> None:
        rows.append((table, name, f"SELECT count(*) FROM {table} WHERE {test}"))

    for t, k in (("dim_customer", "customer"), ("dim_product", "product")):
        for c in (f"{k}_sk", f"{k}_id", "effective_from", "is_current", "record_version"):
            add(t, f"not_null_{c}", f"{c} IS NULL")
        add(t, "valid_scd_date_range", "effective_from IS NULL OR (NOT is_current AND effective_to IS NULL) OR effective_to < effective_from")
        add(t, "current_scd_end_date", "is_current AND effective_to IS NOT NULL")
        rows.append((t, "unique_key", f"SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {k}_sk HAVING count(*) > 1)"))
        rows.append((t, "current_scd_uniqueness", f"SELECT count(*) FROM (SELECT 1 FROM {t} WHERE is_current GROUP BY {k}_id HAVING count(*) > 1)"))
    rows += [("dim_date", n, "SELECT count(*) FROM days WHERE d IS NULL") for n in ("not_null_date_key", "not_null_calendar_date")]
    rows.append(("dim_date", "unique_key", "SELECT count(*) FROM (SELECT 1 FROM days GROUP BY d HAVING count(*) > 1)"))
    for t, own, amounts in (
        (
            "fact_sales",
            ("sales_sk", "order_sk", "customer_sk", "product_sk", "order_date_key"),
            ("gross_amount", "discount_amount", "tax_amount", "net_amount"),
        ),
        ("fact_payment", ("payment_sk", "order_sk", "payment_id", "payment_date_key"), ("payment_amount", "refund_amount", "net_payment_amount")),
    ):
        for c in own:
            add(t, f"not_null_{c}", f"{c} IS NULL")
        for c in amounts:
            add(t, f"non_negative_{c}", f"{c} < 0")
        rows.append((t, "unique_key", f"SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {own[0]} HAVING count(*) > 1)"))
    add("fact_sales", "positive_quantity", "quantity IS NULL OR quantity <= 0")
    add("fact_sales", "sales_amount_equation", "gross_amount - discount_amount + tax_amount <> net_amount")
    add("fact_payment", "payment_amount_equation", "payment_amount - refund_amount <> net_payment_amount")
    for t, key, day in (("fact_sales", "order_date_key", "order_day"), ("fact_payment", "payment_date_key", "payment_day")):
        add(t, f"date_key_consistency_{key}", f"{key} IS NULL OR {day} IS NULL OR strftime({day}, '%Y%m%d')::INT <> {key}")
        rows.append(
            (t, f"foreign_key_{key}", f"SELECT count(DISTINCT {key}) FROM {t} WHERE {key} NOT IN (SELECT strftime(d, '%Y%m%d')::INT FROM days)")
        )
    for k in ("customer", "product"):
        rows.append(
            ("fact_sales", f"foreign_key_{k}_sk", f"SELECT count(DISTINCT {k}_sk) FROM fact_sales WHERE {k}_sk NOT IN (SELECT {k}_sk FROM dim_{k})")
        )
    rows.append(("fact_sales", "row_count_reconciliation", "SELECT abs((SELECT count(*) FROM items_e) - (SELECT count(*) FROM fact_sales))"))
    rows.append(
        (
            "fact_payment",
            "row_count_reconciliation",
            "SELECT abs((SELECT count(*) FROM r_payments WHERE order_id IN (SELECT order_id FROM o0)) - (SELECT count(*) FROM fact_payment))",
        )
    )
    each = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, '{n}' AS check_name, ({q})::BIGINT AS failed_count" for t, n, q in rows)
    return f"SELECT *, CASE WHEN failed_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({each})"


SQL["q_checks"] = _star(_checks())


# The strict profile: parents are those that passed.

_REQUIRED = {
    "customers": ("customer_id", "first_name", "last_name", "email", "city", "state", "country", "signup_date", "customer_segment"),
    "products": ("product_id", "product_name", "category", "brand", "price", "stock_quantity"),
    "orders": ("order_id", "customer_id", "order_date", "order_status", "shipping_city", "shipping_state"),
    "order_items": ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_percentage"),
    "payments": ("payment_id", "order_id", "payment_method", "payment_status", "payment_amount", "payment_date"),
}
_LATE = "coalesce(try_cast({0} AS TIMESTAMP) > TIMESTAMP '1998-01-01 00:00:00', true)"
_STRICT_RULES = {
    "customers": [
        ("INVALID_EMAIL:email", f"NOT regexp_matches(email, '{_EMAIL}')"),
        ("INVALID_VALUE:customer_segment", "customer_segment NOT IN ('Regular', 'Silver', 'Gold', 'Platinum')"),
        ("INVALID_OR_FUTURE_DATE:signup_date", _LATE.format("signup_date")),
    ],
    "products": [
        ("INVALID_VALUE:category", "category NOT IN ('Electronics', 'Fashion', 'Furniture', 'Books', 'Sports', 'Beauty', 'Home', 'Toys')"),
        ("INVALID_NUMERIC_VALUE:price", "coalesce(price <= 0, true)"),
        ("INVALID_NUMERIC_VALUE:stock_quantity", "coalesce(stock_quantity < 0, true)"),
    ],
    "orders": [
        ("INVALID_VALUE:order_status", "order_status NOT IN ('Delivered', 'Cancelled', 'Pending', 'Returned', 'Shipped')"),
        ("INVALID_OR_FUTURE_DATE:order_date", _LATE.format("order_date")),
        ("INVALID_FOREIGN_KEY:customer_id", "customer_id NOT IN (SELECT customer_id FROM t_customers WHERE rejection_reason = '')"),
    ],
    "order_items": [
        (f"INVALID_FOREIGN_KEY:{c}", f"{c} NOT IN (SELECT {c} FROM t_{t} WHERE rejection_reason = '')")
        for c, t in (("order_id", "orders"), ("product_id", "products"))
    ] + [
        ("INVALID_NUMERIC_VALUE:quantity", "coalesce(quantity <= 0, true)"),
        ("INVALID_NUMERIC_VALUE:unit_price", "coalesce(unit_price <= 0, true)"),
        ("OUT_OF_RANGE:discount_percentage", "coalesce(discount_percentage < 0 OR discount_percentage > 100, true)"),
    ],
    "payments": [
        ("INVALID_FOREIGN_KEY:order_id", "order_id NOT IN (SELECT order_id FROM t_orders WHERE rejection_reason = '')"),
        ("INVALID_VALUE:payment_method", "payment_method NOT IN ('UPI', 'Credit Card', 'Debit Card', 'Net Banking', 'Wallet')"),
        ("INVALID_VALUE:payment_status", "payment_status NOT IN ('Success', 'Failed', 'Refunded', 'Pending')"),
        ("INVALID_NUMERIC_VALUE:payment_amount", "coalesce(payment_amount <= 0, true)"),
        ("INVALID_OR_FUTURE_DATE:payment_date", _LATE.format("payment_date")),
    ],
}
_STRICT_NAMES = {n: f"strict_{n}" if n in ("customers", "products", "orders") else n for n in _ALL}


def _strict_tables() -> str:
    out = ""
    for n in _ALL:
        key = _BY_KEY[n]
        tests = [(f"MISSING_REQUIRED_VALUE:{c}", f"{c} IS NULL OR trim({c}::VARCHAR) = ''") for c in _REQUIRED[n]]
        tests += [(f"DUPLICATE_PRIMARY_KEY:{key}", f"count(*) OVER (PARTITION BY {key}) > 1"), *_STRICT_RULES[n]]
        out += f",\nt_{n} AS (SELECT {key}, concat_ws(' | ', " + ", ".join(
            f"CASE WHEN {test} THEN '{code}' END" for code, test in tests
        ) + f") AS rejection_reason FROM r_{_STRICT_NAMES[n]})"
    return out


_STRICT = _strict_tables()
SQL |= {f"v_strict_{n}": _with(tuple(_STRICT_NAMES.values()), f"SELECT {_BY_KEY[n]}, rejection_reason FROM t_{n}", _STRICT) for n in _ALL}
SQL["v_strict_audit"] = _with(
    tuple(_STRICT_NAMES.values()),
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset_name, count(*) AS input_record_count, count(*) FILTER (rejection_reason = '') AS valid_record_count, count(*) "
        f"FILTER (rejection_reason <> '') AS invalid_record_count, round(count(*) FILTER (rejection_reason = '') * 100.0::DOUBLE / count(*), "
        f"2) AS validation_success_rate FROM t_{n}"
        for n in _ALL
    ),
    _STRICT,
)

# Roll-ups of the marts.

_BOTH_CHANGES = """,
goods_cdc AS (SELECT CASE WHEN p.price = n.price THEN 'UNCHANGED' ELSE 'UPDATED' END AS change_type FROM r_products p JOIN r_repriced_products
    n USING (product_id)),
both_cdc AS (SELECT 'customers' AS dataset, change_type FROM cdc UNION ALL SELECT 'products', change_type FROM goods_cdc)"""
_CHANGED = (*_BOTH, "products", "repriced_products")
SQL["x_cdc_summary"] = _with(_CHANGED, "SELECT dataset, change_type, count(*) AS records FROM both_cdc GROUP BY ALL", _CDC + _BOTH_CHANGES)
SQL["x_cdc_pivot"] = _with(
    _CHANGED,
    "SELECT dataset, " + ", ".join(
        f"count(*) FILTER (change_type = '{k}') AS {k}" for k in ("INSERTED", "UPDATED", "UNCHANGED", "DELETED")
    ) + " FROM both_cdc GROUP BY dataset",
    _CDC + _BOTH_CHANGES,
)
SQL["x_product_rollup"] = _star(
    "SELECT d.product_id, d.category, d.product_name, coalesce(sum(s.q), 0)::BIGINT AS units, coalesce(sum(s.n), 0)::BIGINT AS orders, "
    "coalesce(sum(s.r), 0)::DOUBLE AS net_revenue FROM dim_product d LEFT JOIN (SELECT product_sk, sum(quantity) AS q, count(DISTINCT order_sk) "
    "AS n, sum(net_amount) AS r FROM fact_sales GROUP BY product_sk) s USING (product_sk) GROUP BY ALL"
)
SQL["x_customer_rollup"] = _star(
    "SELECT d.customer_id, d.customer_full_name AS customer_name, coalesce(sum(s.n), 0)::BIGINT AS orders, coalesce(sum(s.r), 0)::DOUBLE "
    "AS total_spent, max(s.b)::VARCHAR AS latest_order FROM dim_customer d LEFT JOIN (SELECT customer_sk, count(DISTINCT order_sk) AS n, "
    "sum(net_amount) AS r, max(order_day) AS b FROM fact_sales GROUP BY customer_sk) s USING (customer_sk) GROUP BY ALL"
)
_BREAKDOWN = """(SELECT date_trunc('month', order_day)::DATE::VARCHAR AS month, category, customer_segment, order_status, sum(net_amount)
    AS net_revenue, count(DISTINCT order_sk) AS orders
  FROM fact_sales JOIN dim_product USING (product_sk) JOIN (SELECT customer_sk, customer_segment FROM dim_customer) USING (customer_sk)
      GROUP BY 1, 2, 3, 4)"""
for _k, _c in (("month", "month"), ("category", "category"), ("segment", "customer_segment")):
    SQL[f"x_revenue_by_{_k}"] = _star(
        f"SELECT {_c}, sum(net_revenue)::DOUBLE AS net_revenue, sum(orders)::BIGINT AS orders FROM {_BREAKDOWN} GROUP BY {_c}"
    )
SQL["x_paid_by_method"] = _star(
    "SELECT payment_method, sum(payment_amount)::DOUBLE AS payment_amount FROM fact_payment WHERE payment_status = 'SUCCESS' GROUP BY payment_method"
)
SQL["x_payments_by_status"] = _star(
    "SELECT payment_status, sum(payment_amount)::DOUBLE AS amount, count(*) AS payments FROM fact_payment GROUP BY payment_status"
)
_VERSIONS = " UNION ALL ".join(
    f"SELECT 'dim_{k}' AS dimension, {k}_id AS business_key, effective_from::VARCHAR AS effective_from, effective_to::VARCHAR AS effective_to, "
    f"is_current, record_version FROM (SELECT *, count(*) OVER (PARTITION BY {k}_id) AS n FROM dim_{k}) WHERE n > 1"
    for k in ("customer", "product")
)
SQL["x_version_history"] = _star(_VERSIONS)
SQL["x_funnel"] = _with((*_STARS, *_BOTH), f"""SELECT * FROM (SELECT count(*) AS raw_rows, count(*) FILTER (reason <> '') AS quarantined_rows,
    count(*) FILTER (reason = '') AS valid_rows FROM e_all), (SELECT count(*) FILTER (change_type <> 'UNCHANGED') AS changes FROM
    both_cdc),
  (SELECT count(*) FILTER (is_current) AS new_versions FROM ({_VERSIONS})), (SELECT count(*) AS sales_rows FROM fact_sales), (SELECT
      count(*) FILTER (status = 'PASS') AS checks_passed, count(*) AS checks_run FROM ({_checks()}))""", _STAR + _ERRORS + _CDC
      + _BOTH_CHANGES)
