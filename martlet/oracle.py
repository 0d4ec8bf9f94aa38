"""The same results as plain SQL over the same tables, written independently of
the DataFrame code, for checking one against the other."""

from __future__ import annotations

from martlet.registry import CUT_DAYS, SMALL_SHARE
from martlet.sources.schemas import WHOLESALE, WHOLESALE_FOREIGN_KEYS

_NET = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,8))"
_LIST_NET = "CAST(p_retailprice * l_quantity * (1 - l_discount) AS DECIMAL(28,8))"

_ORDER_VALUES = f"""
order_values AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         SUM({_NET}) AS order_value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY ALL)"""

_MONTHLY = f"""{_ORDER_VALUES},
monthly AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, SUM(order_value) AS total
  FROM order_values GROUP BY ALL)"""

_GROWTH = f"""{_MONTHLY},
lagged AS (SELECT month, total, LAG(total) OVER (ORDER BY month) AS prev FROM monthly),
growth AS (
  SELECT month, CAST(total AS DOUBLE) AS total_sales,
         CASE WHEN prev > 0 THEN CAST(total - prev AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) * 100 END
           AS growth_rate
  FROM lagged)"""

_SELLERS = f"""
sellers AS (
  SELECT s_suppkey AS seller_id, s_name AS seller_name, SUM({_NET}) AS total
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY ALL),
ranked AS (
  SELECT seller_id, seller_name, total, CAST(total AS DOUBLE) AS total_sales,
         RANK() OVER (ORDER BY total DESC) AS sales_rank,
         DENSE_RANK() OVER (ORDER BY total DESC) AS dense_rank,
         CAST(total AS DOUBLE) / CAST(SUM(total) OVER () AS DOUBLE) * 100 AS pct_of_total
  FROM sellers)"""

_SEGMENTS = f"""{_ORDER_VALUES},
segments AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, COUNT(*) AS order_count,
         SUM(order_value) AS spent
  FROM order_values JOIN customer ON customer_id = c_custkey
  GROUP BY ALL),
labelled AS (
  SELECT customer_id, customer_name, order_count, spent, CAST(spent AS DOUBLE) AS total_spent,
         CAST(spent AS DOUBLE) / order_count AS avg_order_value,
         CASE WHEN CAST(spent AS DOUBLE) / order_count >
                   (SELECT CAST(SUM(order_value) AS DOUBLE) / COUNT(*)
                    FROM order_values JOIN customer ON customer_id = c_custkey)
              THEN 'Above Average' ELSE 'Below Average' END AS value_category
  FROM segments)"""

_FLAGGED = f"""{_ORDER_VALUES},
flagged AS (
  SELECT customer_id, order_id, order_value AS exact_value, CAST(order_value AS DOUBLE) AS order_value,
         CASE WHEN CAST(order_value AS DOUBLE) >
                   CAST(SUM(order_value) OVER () AS DOUBLE) / COUNT(*) OVER ()
              THEN 'Above Average' ELSE 'Below Average' END AS value_category
  FROM order_values)"""

_CATEGORIES = "categories AS (SELECT DISTINCT p_type AS category_id, p_type AS category_name FROM part)"


def _category_sales(net: str) -> str:
    return f"""{_CATEGORIES},
category_sales AS (
  SELECT category_id, category_name, SUM({net}) AS total
  FROM categories JOIN part ON category_id = p_type JOIN lineitem ON p_partkey = l_partkey
  GROUP BY ALL)"""


def _product_sales(net: str) -> str:
    return f"""
product_sales AS (
  SELECT p_type AS category_id, p_partkey AS product_id, p_name AS product_name, SUM({net}) AS total
  FROM part JOIN lineitem ON p_partkey = l_partkey
  GROUP BY ALL),
numbered AS (
  SELECT *, CAST(total AS DOUBLE) AS total_sales,
         ROW_NUMBER() OVER (PARTITION BY category_id ORDER BY total DESC, product_id) AS rn
  FROM product_sales)"""


def _category_share(net: str) -> str:
    return f"""WITH {_category_sales(net)}
SELECT category_id, category_name, CAST(total AS DOUBLE) AS total_sales,
       CAST(total AS DOUBLE) / CAST(SUM(total) OVER () AS DOUBLE) * 100 AS sales_pct
FROM category_sales"""


def _top_by_id(net: str) -> str:
    return f"""WITH {_product_sales(net)}
SELECT category_id, product_id, product_name, total_sales, rn FROM numbered WHERE rn <= 3"""


def _top_named(n: int) -> str:
    return f"""WITH {_CATEGORIES}, {_product_sales(_NET)}
SELECT category_id, category_name, product_id, product_name, total_sales, rn
FROM numbered JOIN categories USING (category_id) WHERE rn <= {n}"""


def _key_duplicates() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, '{", ".join(spec.primary_key)}' AS key_columns,
       COUNT(*) AS repeated_keys, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS surplus_rows
FROM (SELECT COUNT(*) AS n FROM {name} GROUP BY {", ".join(spec.primary_key)} HAVING COUNT(*) > 1)"""
        for name, spec in WHOLESALE.items()
    )


def _fk_orphans() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{child}' AS child_table, '{column}' AS child_column, '{parent}' AS parent_table,
       COUNT(DISTINCT {column}) AS orphan_keys, COUNT(*) AS orphan_rows
FROM {child} WHERE {column} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {parent_column} = {column})"""
        for child, column, parent, parent_column in WHOLESALE_FOREIGN_KEYS
    )


def _null_counts() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, "
        f"COUNT(*) FILTER (WHERE {column} IS NULL) AS null_count FROM {name}"
        for name, spec in WHOLESALE.items()
        for column in spec.not_null
    )


def _overlong() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, CAST({limit} AS BIGINT) AS max_length, "
        f"COUNT(*) FILTER (WHERE LENGTH({column}) > {limit}) AS overlong FROM {name}"
        for name, spec in WHOLESALE.items()
        for column, limit in spec.max_length.items()
    )


def _fanout(table: str, joined: str, net: str) -> str:
    facts, on = joined.split(" | ")
    return f"""SELECT '{table}' AS joined_table,
       (SELECT COUNT(*) FROM {facts} f WHERE EXISTS (SELECT 1 FROM {on})) AS rows_before,
       (SELECT COUNT(*) FROM {facts} f, {on}) AS rows_after,
       (SELECT CAST(SUM({net}) AS DOUBLE) FROM {facts} f WHERE EXISTS (SELECT 1 FROM {on})) AS net_before,
       (SELECT CAST(SUM({net}) AS DOUBLE) FROM {facts} f, {on}) AS net_after,
       (SELECT COUNT(*) FROM {facts} f, {on}) >
         (SELECT COUNT(*) FROM {facts} f WHERE EXISTS (SELECT 1 FROM {on})) AS multiplied"""


def _reconcile() -> str:
    return f"""WITH {_MONTHLY}, {_SELLERS.strip()}, {_category_sales(_NET)},
t AS (SELECT CAST(SUM(order_value) AS DOUBLE) AS total FROM order_values),
p AS (SELECT CAST(SUM({_NET}) AS DOUBLE) AS sold FROM lineitem JOIN part ON p_partkey = l_partkey),
running AS (SELECT month, SUM(total) OVER (ORDER BY month) AS r FROM monthly),
rules AS (
  SELECT 'running total ends at total revenue' AS rule, total AS expected,
         (SELECT CAST(r AS DOUBLE) FROM running ORDER BY month DESC LIMIT 1) AS actual FROM t
  UNION ALL SELECT 'months add up to total revenue', total,
         (SELECT CAST(SUM(m.total) AS DOUBLE) FROM monthly m) FROM t
  UNION ALL SELECT 'customers add up to total revenue', total,
         (SELECT CAST(SUM(order_value) AS DOUBLE) FROM order_values JOIN customer ON customer_id = c_custkey) FROM t
  UNION ALL SELECT 'sellers add up to total revenue', total,
         (SELECT CAST(SUM(s.total) AS DOUBLE) FROM sellers s) FROM t
  UNION ALL SELECT 'categories add up to product sales', sold,
         (SELECT CAST(SUM(c.total) AS DOUBLE) FROM category_sales c) FROM p
  UNION ALL SELECT 'seller shares add up to 100', 100.0, (SELECT SUM(pct_of_total) FROM ranked)
  UNION ALL SELECT 'category shares add up to 100', 100.0,
         (SELECT SUM(x) FROM (SELECT CAST(total AS DOUBLE) / CAST(SUM(total) OVER () AS DOUBLE) * 100 AS x
                              FROM category_sales)))
SELECT rule, ROUND(CAST(expected AS DOUBLE), 4) AS expected, ROUND(actual, 4) AS actual,
       ROUND(CAST(expected AS DOUBLE), 4) IS NOT DISTINCT FROM ROUND(actual, 4) AS holds
FROM rules"""


_ADDITIVE = f"""COUNT(*) AS line_count,
       CAST(SUM(CAST(l_quantity AS DECIMAL(28,8))) AS DOUBLE) AS quantity,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(28,8))) AS DOUBLE) AS gross_revenue,
       CAST(SUM({_NET}) AS DOUBLE) AS net_revenue"""


def _marts_figures() -> str:
    parts = [
        ("kpis", "'total_revenue'", "revenue", "k"),
        ("kpis", "'total_orders'", "n", "k"),
        ("kpis", "'avg_order_value'", "revenue / n", "k"),
        ("best_month", "month", "CAST(total AS DOUBLE)", "(SELECT * FROM monthly ORDER BY total DESC, month LIMIT 1)"),
        ("sellers", "seller_id", "total_sales", "ranked"),
        ("seller_ranks", "seller_id", "sales_rank", "ranked"),
        ("seller_shares", "seller_id", "pct_of_total", "ranked"),
        ("monthly", "month", "CAST(total AS DOUBLE)", "monthly"),
        ("running", "month", "r", "(SELECT month, CAST(SUM(total) OVER (ORDER BY month) AS DOUBLE) AS r FROM monthly)"),
        ("growth", "month", "growth_rate", "growth"),
        ("customers", "customer_id", "total_spent", "labelled"),
        ("customer_orders", "customer_id", "order_count", "labelled"),
        ("categories", "category_id", "total_sales", "shares"),
        ("category_shares", "category_id", "sales_pct", "shares"),
        ("top_products", "product_id", "total_sales", "(SELECT * FROM numbered WHERE rn <= 3)"),
    ]
    segments = _SEGMENTS.removeprefix(f"{_ORDER_VALUES},").strip()
    products = _product_sales(_NET).strip()
    rows = "\nUNION ALL ".join(
        f"SELECT '{mart}' AS mart, CAST({item} AS VARCHAR) AS item, CAST({figure} AS DOUBLE) AS figure FROM {source}"
        for mart, item, figure, source in parts
    )
    return f"""WITH {_GROWTH}, {segments}, {_SELLERS.strip()}, {products},
k AS (SELECT CAST(SUM(order_value) AS DOUBLE) AS revenue, COUNT(*) AS n FROM order_values),
shares AS ({_category_share(_NET)})
{rows}"""


def _distinct_orders() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{level}' AS level, CAST(date_trunc('{level}', o_orderdate) AS DATE) AS period, {category} AS category,
       COUNT(DISTINCT o_orderkey) AS order_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
        for level in ("month", "quarter", "year")
        for category in ("p_type", "CAST(NULL AS VARCHAR)")
    )


def _flag_changes() -> str:
    before, after = (f"DATE '{d}'" for d in CUT_DAYS)
    mean = "CAST(SUM(order_value) AS DOUBLE) / COUNT(*)"
    label = "CASE WHEN CAST(order_value AS DOUBLE) > {} THEN 'Above Average' ELSE 'Below Average' END"
    return f"""WITH {_ORDER_VALUES},
a AS (SELECT {mean} AS old FROM order_values WHERE order_date <= {before}),
b AS (SELECT {mean} AS new FROM order_values WHERE order_date <= {after}),
labelled AS (
  SELECT order_id, customer_id, CAST(order_value AS DOUBLE) AS order_value, {label.format("old")} AS label_before,
         {label.format("new")} AS label_after
  FROM order_values, a, b WHERE order_date <= {before})
SELECT * FROM labelled WHERE label_before <> label_after"""


def oracle_sql() -> dict[str, str]:
    return {
        "seller_rank": f"""WITH {_SELLERS}
SELECT seller_id, seller_name, total_sales, pct_of_total, sales_rank FROM ranked""",
        "seller_rank_laid_out": f"""WITH {_SELLERS}
SELECT seller_id, seller_name, total_sales, pct_of_total, sales_rank FROM ranked""",
        "kpi_summary": f"""
SELECT CAST(SUM({_NET}) AS DOUBLE) AS total_revenue, COUNT(DISTINCT o_orderkey) AS total_orders,
       CAST(SUM({_NET}) AS DOUBLE) / NULLIF(COUNT(DISTINCT o_orderkey), 0) AS avg_order_value
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
        "best_month": f"""WITH {_MONTHLY}
SELECT month, CAST(total AS DOUBLE) AS total_sales FROM monthly ORDER BY total DESC, month LIMIT 1""",
        "headline_cards": f"""WITH {_MONTHLY},
k AS (SELECT CAST(SUM(order_value) AS DOUBLE) AS revenue, COUNT(DISTINCT order_id) AS n FROM order_values),
b AS (SELECT month, CAST(total AS DOUBLE) AS total FROM monthly ORDER BY monthly.total DESC, month LIMIT 1)
SELECT format('${{:,}}', CAST(round_even(revenue, 0) AS BIGINT)) AS revenue_label,
       format('{{:,}}', n) AS orders_label,
       format('${{:,}}', CAST(round_even(revenue / n, 0) AS BIGINT)) AS avg_order_label,
       strftime(month, '%b %Y') AS best_month_label,
       format('${{:,}}', CAST(round_even(total, 0) AS BIGINT)) AS best_month_sales_label
FROM k, b""",
        "monthly_running_total": f"""WITH {_MONTHLY}
SELECT month, CAST(total AS DOUBLE) AS total_sales,
       CAST(SUM(total) OVER (ORDER BY month) AS DOUBLE) AS running_total
FROM monthly""",
        "mom_growth": f"WITH {_GROWTH}\nSELECT month, total_sales, growth_rate FROM growth",
        "mom_growth_calendar": f"""WITH {_MONTHLY}
SELECT m.month, CAST(m.total AS DOUBLE) AS total_sales,
       CASE WHEN p.total > 0
            THEN CAST(m.total - p.total AS DOUBLE) / CAST(p.total AS DOUBLE) * 100 END AS growth_rate
FROM monthly m LEFT JOIN monthly p ON p.month + INTERVAL 1 MONTH = m.month""",
        "mom_growth_complete": f"""WITH {_GROWTH}
SELECT month, total_sales, growth_rate FROM growth
WHERE last_day(month) <= (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders)""",
        "mom_growth_ym": f"""WITH {_ORDER_VALUES},
m AS (SELECT year(order_date) AS year, month(order_date) AS month, SUM(order_value) AS total
      FROM order_values GROUP BY ALL),
g AS (SELECT year, month, total, LAG(total) OVER (ORDER BY year, month) AS prev FROM m)
SELECT year, month,
       CAST(total - prev AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) * 100 AS growth_rate
FROM g""",
        "order_value_flag": f"""WITH {_FLAGGED}
SELECT customer_id, order_id, order_value, value_category FROM flagged""",
        "customer_segments": f"""WITH {_SEGMENTS}
SELECT customer_id, customer_name, order_count, total_spent, avg_order_value, value_category FROM labelled""",
        "category_share": _category_share(_NET),
        "category_share_list": _category_share(_LIST_NET),
        "top3_products": _top_named(3),
        "top3_by_id": _top_by_id(_NET),
        "top3_list": _top_by_id(_LIST_NET),
        "seller_tiers": f"""WITH {_SELLERS}
SELECT seller_id, seller_name, total_sales, pct_of_total, sales_rank,
       CASE WHEN sales_rank <= 3 THEN 'green' WHEN sales_rank <= 5 THEN 'amber' ELSE 'red' END AS tier,
       '#' || sales_rank AS rank_label,
       format('${{:,}}', CAST(round_even(total_sales, 0) AS BIGINT)) AS sales_label,
       printf('%.1f%%', pct_of_total) AS share_label
FROM ranked""",
        "seller_dense_rank": f"""WITH {_SELLERS}
SELECT seller_id, seller_name, total_sales, dense_rank AS sales_rank FROM ranked""",
        "growth_direction": f"""WITH {_GROWTH}
SELECT month, total_sales, growth_rate, CASE WHEN growth_rate >= 0 THEN 'up' ELSE 'down' END AS direction
FROM growth WHERE growth_rate IS NOT NULL""",
        "growth_extremes": f"""WITH {_GROWTH},
b AS (SELECT * FROM growth WHERE growth_rate IS NOT NULL ORDER BY growth_rate DESC, month LIMIT 1),
w AS (SELECT * FROM growth WHERE growth_rate IS NOT NULL ORDER BY growth_rate, month LIMIT 1)
SELECT b.month AS best_month, b.growth_rate AS best_growth, w.month AS worst_month,
       w.growth_rate AS worst_growth, strftime(b.month, '%b %Y') AS best_month_label,
       printf('%+.1f%%', b.growth_rate) AS best_growth_label,
       strftime(w.month, '%b %Y') AS worst_month_label,
       printf('%+.1f%%', w.growth_rate) AS worst_growth_label
FROM b, w""",
        "next_month_delta": f"""WITH {_MONTHLY},
n AS (SELECT month, total, LEAD(total) OVER (ORDER BY month) AS following FROM monthly)
SELECT month, CAST(total AS DOUBLE) AS total_sales, CAST(following AS DOUBLE) AS next_sales,
       CAST(following - total AS DOUBLE) AS delta
FROM n""",
        "top15_customers": f"""WITH {_SEGMENTS}
SELECT customer_id, customer_name, order_count, total_spent, avg_order_value, value_category,
       CASE WHEN value_category = 'Above Average' THEN 'green' ELSE 'amber' END AS badge
FROM labelled ORDER BY spent DESC, customer_id LIMIT 15""",
        "category_top3_total": f"""WITH {_CATEGORIES}, {_product_sales(_NET)}
SELECT category_id, category_name, CAST(SUM(total) AS DOUBLE) AS shown_total
FROM numbered JOIN categories USING (category_id) WHERE rn <= 3 GROUP BY ALL""",
        "product_share_in_category": f"""WITH {_product_sales(_NET)}
SELECT category_id, product_id, product_name, total_sales,
       CAST(total AS DOUBLE) / CAST(SUM(total) OVER (PARTITION BY category_id) AS DOUBLE) * 100
         AS pct_of_category
FROM numbered""",
        "order_seller_detail": """
SELECT seller_name, order_id, order_date
FROM (SELECT DISTINCT s_suppkey, s_name AS seller_name, o_orderkey AS order_id,
             CAST(o_orderdate AS DATE) AS order_date
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey)""",
        "order_customer_detail": """
SELECT o_orderkey AS order_id, c_name AS customer_name, CAST(o_orderdate AS DATE) AS order_date
FROM orders JOIN customer ON o_custkey = c_custkey""",
        "line_product_detail": """
SELECT o_orderkey AS order_id, p_name AS product_name, l_quantity AS quantity,
       CAST(o_orderdate AS DATE) AS order_date
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
        "topk_share": f"""WITH {_SELLERS}
SELECT CAST(SUM(total) FILTER (WHERE sales_rank <= 5) AS DOUBLE) AS top_sales,
       CAST(SUM(total) AS DOUBLE) AS total_sales,
       CAST(SUM(total) FILTER (WHERE sales_rank <= 5) AS DOUBLE) / CAST(SUM(total) AS DOUBLE) * 100
         AS top_share_pct
FROM ranked""",
        "leader_ratio": f"""WITH {_SELLERS}
SELECT CAST(MAX(total) AS DOUBLE) AS best_sales, CAST(MIN(total) AS DOUBLE) AS worst_sales,
       CAST(MAX(total) AS DOUBLE) / NULLIF(CAST(MIN(total) AS DOUBLE), 0) AS ratio
FROM sellers""",
        "category_pareto": f"""WITH {_category_sales(_NET)}
SELECT category_id, category_name, CAST(total AS DOUBLE) AS total_sales,
       CAST(SUM(total) OVER (ORDER BY total DESC) AS DOUBLE) / CAST(SUM(total) OVER () AS DOUBLE) * 100
         AS cumulative_pct
FROM category_sales""",
        "small_categories": f"SELECT * FROM ({_category_share(_NET)}) WHERE sales_pct < {SMALL_SHARE!r}",
        "max_order_ratio": f"""WITH {_ORDER_VALUES}
SELECT CAST(MAX(order_value) AS DOUBLE) AS max_order,
       CAST(SUM(order_value) AS DOUBLE) / COUNT(*) AS avg_order,
       CAST(MAX(order_value) AS DOUBLE) / (CAST(SUM(order_value) AS DOUBLE) / COUNT(*)) AS ratio
FROM order_values""",
        "repeat_high_value": f"""WITH {_FLAGGED}
SELECT customer_id, COUNT(*) AS high_value_orders, CAST(SUM(exact_value) AS DOUBLE) AS high_value_total
FROM flagged WHERE value_category = 'Above Average' GROUP BY customer_id HAVING COUNT(*) >= 2""",
        "product_beats_category": f"""WITH {_category_sales(_NET)}, {_product_sales(_NET)}
SELECT category_id, category_name, product_id, product_name, n.total_sales,
       (SELECT COUNT(*) FROM category_sales o
        WHERE o.category_id <> n.category_id AND o.total < n.total) AS categories_beaten
FROM numbered n JOIN categories USING (category_id) WHERE rn = 1""",
        "top_orders": f"""WITH {_FLAGGED}
SELECT customer_id, order_id, order_value, value_category
FROM flagged ORDER BY exact_value DESC, order_id LIMIT 5""",
        "top1_product": _top_named(1),
        "repeat_customers": f"""WITH {_SEGMENTS}
SELECT customer_id, customer_name, order_count FROM labelled WHERE order_count > 1""",
        "yoy_growth": f"""WITH {_MONTHLY}
SELECT m.month, CAST(m.total AS DOUBLE) AS total_sales, CAST(y.total AS DOUBLE) AS year_ago_sales,
       CASE WHEN y.total > 0
            THEN CAST(m.total - y.total AS DOUBLE) / CAST(y.total AS DOUBLE) * 100 END AS yoy_pct
FROM monthly m LEFT JOIN monthly y ON y.month + INTERVAL 12 MONTH = m.month""",
        "dim_date": """WITH span AS (
  SELECT MIN(CAST(o_orderdate AS DATE)) AS a, MAX(CAST(o_orderdate AS DATE)) AS b FROM orders),
days AS (SELECT CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS full_date FROM span)
SELECT full_date, month(full_date) AS month, quarter(full_date) AS quarter, year(full_date) AS year,
       dayofweek(full_date) AS day_of_week
FROM days""",
        "dim_product": f"""WITH {_CATEGORIES}
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_id, category_name,
       p_retailprice AS list_price, p_brand AS brand
FROM part LEFT JOIN categories ON category_id = p_type""",
        "dim_customer": """
SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS nation, r_name AS region,
       c_mktsegment AS segment
FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey""",
        "dim_seller": "SELECT s_suppkey AS seller_id, s_name AS seller_name FROM supplier",
        "dim_category": "SELECT DISTINCT p_type AS category_id, p_type AS category_name FROM part",
        "fact_sales": f"""
SELECT o_orderkey AS order_id, l_partkey AS product_id, o_custkey AS customer_id, l_suppkey AS seller_id,
       CAST(o_orderdate AS DATE) AS order_date, l_quantity AS quantity,
       l_extendedprice / l_quantity AS unit_price, l_discount AS discount,
       CAST(CAST(l_extendedprice AS DECIMAL(28,8)) AS DOUBLE) AS gross_revenue,
       CAST({_NET} AS DOUBLE) AS net_revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "revenue_by_nation": f"""
SELECT r_name AS region, n_name AS nation, {_ADDITIVE}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""",
        "revenue_by_year_category": f"""
SELECT year(o_orderdate) AS year, p_type AS category_name, {_ADDITIVE}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY ALL""",
        "revenue_by_weekday": f"""
SELECT dayofweek(o_orderdate) AS day_of_week, {_ADDITIVE}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
        "revenue_by_seller_nation": f"""
SELECT r_name AS sales_region, n_name AS territory, {_ADDITIVE}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""",
        "rollup_from_aggregate": f"""
SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, r_name AS region, {_ADDITIVE}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
     JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""",
        "distinct_orders_rollup": _distinct_orders(),
        "marts_figures": _marts_figures(),
        "monthly_after_append": f"""WITH {_MONTHLY}
SELECT month, CAST(total AS DOUBLE) AS total_sales, CAST(SUM(total) OVER (ORDER BY month) AS DOUBLE) AS running_total
FROM monthly""",
        "flag_changes": _flag_changes(),
        "avg_price_discount": """
SELECT p_type AS category_id, p_type AS category_name,
       CAST(SUM(CAST(l_extendedprice / l_quantity AS DECIMAL(20,8))) AS DOUBLE) / COUNT(*) AS avg_unit_price,
       CAST(SUM(CAST(l_discount AS DECIMAL(20,8))) AS DOUBLE) / COUNT(*) AS avg_discount
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY ALL""",
        "grain_check": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, COUNT(*) AS n
FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""",
        "fanout_check": "\nUNION ALL\n".join(
            [
                _fanout("orders", "lineitem | orders d WHERE d.o_orderkey = f.l_orderkey", _NET),
                _fanout("products", "lineitem | part d WHERE d.p_partkey = f.l_partkey", _NET),
                _fanout(
                    "customers",
                    "(SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
                    " | customer d WHERE d.c_custkey = f.o_custkey",
                    _NET,
                ),
                _fanout("sellers", "lineitem | supplier d WHERE d.s_suppkey = f.l_suppkey", _NET),
            ]
        ),
        "reconcile": _reconcile(),
        "orders_without_lines": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date
FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
        "table_counts": """
SELECT 'orders' AS tbl, COUNT(*) AS n FROM orders
UNION ALL SELECT 'customers', COUNT(*) FROM customer
UNION ALL SELECT 'products', COUNT(*) FROM part
UNION ALL SELECT 'sellers', COUNT(*) FROM supplier
UNION ALL SELECT 'categories', COUNT(DISTINCT p_type) FROM part
UNION ALL SELECT 'lines', COUNT(*) FROM lineitem""",
        "preview_customers": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
        "growth_table": f"""WITH {_GROWTH}
SELECT * FROM (
  SELECT 'up' AS direction, month, growth_rate, ROW_NUMBER() OVER (ORDER BY growth_rate DESC, month) AS place
  FROM growth WHERE growth_rate > 0 QUALIFY place <= 5)
UNION ALL SELECT * FROM (
  SELECT 'down', month, growth_rate, ROW_NUMBER() OVER (ORDER BY growth_rate, month) AS place
  FROM growth WHERE growth_rate < 0 QUALIFY place <= 3)""",
        "sql_text": """
SELECT o_orderpriority, COUNT(*) AS n_orders, MIN(CAST(o_orderdate AS DATE)) AS first_date
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""",
        "orders_by_status": """
SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
        "order_customer_sample": """
SELECT o_orderkey AS order_id, c_name AS customer_name, CAST(o_orderdate AS DATE) AS order_date
FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 10""",
        "preview_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
        "key_duplicates": _key_duplicates(),
        "fk_orphans": _fk_orphans(),
        "null_counts": _null_counts(),
        "overlong_names": _overlong(),
    }
