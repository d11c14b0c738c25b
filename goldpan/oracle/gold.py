"""The gold star schema as SQL over the lake tables."""

GOLD = """
dim_customer AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS full_name, n.n_name AS country,
         r.r_name AS continent, c.c_mktsegment AS segment,
         CAST(c.c_acctbal AS DECIMAL(18,2)) AS balance,
         CASE WHEN c.c_acctbal >= 7500 THEN '7500+'
              WHEN c.c_acctbal >= 5000 THEN '5000-7499'
              WHEN c.c_acctbal >= 2500 THEN '2500-4999'
              WHEN c.c_acctbal >= 0 THEN '0-2499' END AS balance_band,
         CASE WHEN c.c_acctbal < 0 THEN 'Debtor'
              WHEN c.c_acctbal >= 0 THEN 'Creditor' END AS account_status
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
dim_product AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS subcategory,
         CASE WHEN p_size <= 15 THEN 'S' WHEN p_size <= 35 THEN 'M'
              WHEN p_size > 35 THEN 'L' END AS product_line,
         CASE WHEN p_size > 25 THEN 'Yes' WHEN p_size <= 25 THEN 'No' END AS maintenance_required,
         CAST(p_retailprice AS DECIMAL(18,2)) AS cost
  FROM part
),
dim_store AS (
  SELECT s.s_suppkey AS store_id, s.s_name AS store_name,
         CASE WHEN s.s_acctbal < 0 THEN 'Tier D' WHEN s.s_acctbal < 3000 THEN 'Tier C'
              WHEN s.s_acctbal < 6500 THEN 'Tier B' WHEN s.s_acctbal >= 6500 THEN 'Tier A' END AS store_type,
         r.r_name AS region
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
distinct_lines AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(l_quantity AS DECIMAL(24,6)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(24,6)) AS extended,
         CAST(l_discount AS DECIMAL(24,6)) AS discounted, CAST(l_tax AS DECIMAL(24,6)) AS tax,
         l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS shipped
  FROM lineitem
),
distinct_orders AS (
  SELECT DISTINCT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS ordered, o_orderpriority
  FROM orders
),
order_lines AS (
  SELECT l.*, o.*,
         l_orderkey || '-' || l_linenumber || '-' || md5(
           coalesce(l_orderkey::VARCHAR, '') || '|' || coalesce(l_linenumber::VARCHAR, '') || '|' ||
           coalesce(l_partkey::VARCHAR, '') || '|' || coalesce(l_suppkey::VARCHAR, '') || '|' ||
           coalesce(quantity::VARCHAR, '') || '|' || coalesce(extended::VARCHAR, '') || '|' ||
           coalesce(discounted::VARCHAR, '') || '|' || coalesce(tax::VARCHAR, '') || '|' ||
           coalesce(l_returnflag, '') || '|' || coalesce(l_linestatus, '') || '|' ||
           coalesce(shipped::VARCHAR, '') || '|' || coalesce(o_orderkey::VARCHAR, '') || '|' ||
           coalesce(o_custkey::VARCHAR, '') || '|' || coalesce(ordered::VARCHAR, '') || '|' ||
           coalesce(o_orderpriority, '')) AS number,
         CAST(extended AS DECIMAL(18,2)) AS amount, CAST(quantity AS BIGINT) AS units,
         CAST(discounted AS DECIMAL(4,2)) AS reduction,
         ordered + CAST(15 * TRY_CAST(o_orderpriority[1] AS INTEGER) AS INTEGER) AS due
  FROM distinct_lines l LEFT JOIN distinct_orders o ON l.l_orderkey = o.o_orderkey
),
fact_sales AS (
  SELECT number AS order_number, l_partkey AS product_id,
         o_custkey AS customer_id, l_suppkey AS store_id, ordered AS order_date,
         shipped AS shipping_date, due AS due_date, units AS quantity,
         amount AS sales_amount, reduction AS discount,
         CAST(((2 * CAST(amount * 100 AS BIGINT) + units) // (2 * nullif(units, 0))) AS DECIMAL(18,2))
           / 100 AS price,
         year(ordered) AS order_year, month(ordered) AS order_month,
         monthname(ordered) AS order_month_name,
         CASE WHEN shipped >= ordered THEN shipped - ordered END AS days_to_ship,
         due - ordered AS days_to_due,
         CASE WHEN shipped < ordered OR shipped IS NULL OR ordered IS NULL THEN 'Unknown'
              WHEN shipped <= due THEN 'On Time' ELSE 'Late' END AS delivery_status
  FROM order_lines
),
fact_returns AS (
  SELECT 'R-' || number AS return_id, number AS order_number, shipped AS return_date,
         year(shipped) AS return_year, month(shipped) AS return_month,
         o_orderpriority AS return_reason,
         CAST(round(amount * (1 - reduction), 2) AS DECIMAL(18,2)) AS return_amount
  FROM order_lines WHERE l_returnflag = 'R'
)"""

# Bronze and silver objects with their column counts.
UPSTREAM = {
    "bronze": {
        "region": 2,
        "nation": 3,
        "customer": 5,
        "supplier": 4,
        "part": 6,
        "orders": 6,
        "lineitem": 11,
        "events": 6,
        "documents": 5,
        "labels": 3,
        "conversations": 4,
        "embeddings": 3,
        "pages": 3,
        "benchmark": 2,
    },
    "silver": {"order_lines": 20},
}

# Declared columns of the gold objects.
COLUMNS = {
    "dim_customer": {
        "customer_id": "bigint",
        "full_name": "string",
        "country": "string",
        "continent": "string",
        "segment": "string",
        "balance": "decimal(18,2)",
        "balance_band": "string",
        "account_status": "string",
    },
    "dim_product": {
        "product_id": "bigint",
        "product_name": "string",
        "category": "string",
        "subcategory": "string",
        "product_line": "string",
        "maintenance_required": "string",
        "cost": "decimal(18,2)",
    },
    "dim_store": {
        "store_id": "bigint",
        "store_name": "string",
        "store_type": "string",
        "region": "string",
    },
    "fact_sales": {
        "order_number": "string",
        "product_id": "bigint",
        "customer_id": "bigint",
        "store_id": "bigint",
        "order_date": "date",
        "shipping_date": "date",
        "due_date": "date",
        "quantity": "bigint",
        "sales_amount": "decimal(18,2)",
        "discount": "decimal(4,2)",
        "price": "decimal(18,2)",
        "order_year": "bigint",
        "order_month": "bigint",
        "order_month_name": "string",
        "days_to_ship": "bigint",
        "days_to_due": "bigint",
        "delivery_status": "string",
    },
    "fact_returns": {
        "return_id": "string",
        "order_number": "string",
        "return_date": "date",
        "return_year": "bigint",
        "return_month": "bigint",
        "return_reason": "string",
        "return_amount": "decimal(18,2)",
    },
}
