"""The statements as SQL over five tables named like the gold objects.

Averages, shares and rates are rounded half away from zero in whole numbers, as the
Spark side does, by its own formula here. Text of the statements depends on the column
roles, so the same SQL checks the lake's star and the tests' small retail star.
"""

from __future__ import annotations

from collections.abc import Sequence


def ratio(num: str, den: str, digits: int = 2) -> str:
    """num / den of whole numbers, den >= 0, rounded; NULL when den is 0."""
    n = f"CAST({num} AS HUGEINT)"
    d = f"nullif(CAST({den} AS HUGEINT), 0)"
    size = f"((2 * abs({n}) * {10**digits} + {d}) // (2 * {d}))"
    return f"(CAST(sign({n}) * {size} AS DOUBLE) / {10**digits})"


def share(part: str, whole: str) -> str:
    return ratio(f"({part}) * 10000", f"({whole}) * 100")


def average(column: str, digits: int = 2) -> str:
    return ratio(f"sum({column}) * 100", f"count({column}) * 100", digits)


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def whole(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def spread(column: str, digits: int = 2) -> str:
    return f"round(stddev_samp({dbl(column)}), {digits})"


def audit(table: str, columns: Sequence[str], measure: str, label: str, value: str) -> str:
    """One row per column; ``measure`` is a template over ``{c}``."""
    rows = [
        f"SELECT '{c}' AS {label}, {measure.format(c=c)} AS {value} FROM {table}" for c in columns
    ]
    return " UNION ALL ".join(rows) + f" ORDER BY {value} DESC, {label}"


def values(table: str, column: str, name: str) -> str:
    return f"SELECT {column} AS {name} FROM {table} GROUP BY 1 ORDER BY 1 NULLS FIRST"


def shares(table: str, column: str, name: str) -> str:
    return f"""
      WITH counted AS (SELECT {column}, count(*) AS {name} FROM {table} GROUP BY ALL)
      SELECT {column}, {name}, {share(name, f"(SELECT sum({name}) FROM counted)")} AS pct_of_total
      FROM counted ORDER BY {name} DESC, {column} NULLS FIRST"""


def lost(fact: str, dim: str, key: str, name: str, dim_key: str | None = None) -> str:
    on = f"d.{dim_key or key} = f.{key}"
    return f"SELECT count(*) AS {name} FROM {fact} f ANTI JOIN {dim} d ON {on}"


def repeated(table: str, keys: str, shown: str | None = None) -> str:
    return f"""
      SELECT {shown or keys}, count(*) AS occurrences FROM {table} GROUP BY {keys}
      HAVING count(*) >= 2 ORDER BY occurrences DESC, 1 NULLS FIRST"""


def inventory(upstream: dict[str, dict[str, int]], columns: dict[str, dict[str, str]]) -> str:
    rows = []
    for layer, objects in upstream.items():
        rows += [(layer, name, "BASE TABLE", n) for name, n in objects.items()]
    rows += [("gold", name, "VIEW", len(c)) for name, c in columns.items()]
    return " UNION ALL ".join(
        f"SELECT '{layer}' AS schema_name, '{name}' AS object_name, '{kind}' AS object_type, "
        f"CAST({n} AS BIGINT) AS column_count, count(*) AS row_count FROM {name}"
        for layer, name, kind, n in rows
    )


def dictionary(columns: dict[str, dict[str, str]]) -> str:
    rows = []
    for name, fields in columns.items():
        for position, (column, kind) in enumerate(fields.items(), 1):
            longest = f"max(length({column}))" if kind == "string" else "NULL"
            rows.append(
                f"SELECT 'gold' AS schema_name, '{name}' AS object_name, "
                f"CAST({position} AS BIGINT) AS col_position, '{column}' AS column_name, "
                f"'{kind}' AS data_type, CAST({longest} AS BIGINT) AS max_length, "
                f"'YES' AS is_nullable, count(*) - count({column}) AS null_count FROM {name}"
            )
    return " UNION ALL ".join(rows) + " ORDER BY object_name, col_position"


def by_attribute(column: str, average_too: bool = True, on: str = "") -> str:
    extra = f", {average('s.sales_amount')} AS avg_order_value" if average_too else ""
    return f"""
      SELECT c.{column}, count(DISTINCT c.customer_id) AS customer_count,
             count(DISTINCT s.order_number) AS total_orders,
             {dbl("sum(s.sales_amount)")} AS total_revenue{extra}
      FROM dim_customer c LEFT JOIN fact_sales s ON c.customer_id = s.customer_id {on}
      GROUP BY ALL ORDER BY total_revenue DESC NULLS LAST, 1 NULLS FIRST"""


def table_profile(table: str, numbers: Sequence[str], texts: Sequence[str]) -> str:
    rows = []
    for c in [*numbers, *texts]:
        value, text = (dbl(c), "NULL") if c in numbers else ("NULL", f"CAST({c} AS VARCHAR)")
        rows.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, "
            f"count(*) - count({c}) AS null_count, {dbl(f'min({value})')} AS lowest, "
            f"{dbl(f'max({value})')} AS highest, CAST(min({text}) AS VARCHAR) AS first_text, "
            f"CAST(max({text}) AS VARCHAR) AS last_text, "
            f"{whole(f'max(length(CAST({text} AS VARCHAR)))')} AS longest FROM {table}"
        )
    return " UNION ALL ".join(rows) + " ORDER BY null_count DESC, column_name"


def profile_by(dim: str, key: str, column: str) -> str:
    return f"""
      WITH placed AS (
        SELECT {column}, sales_amount AS x, percent_rank() OVER (
          PARTITION BY {column} ORDER BY sales_amount NULLS FIRST) AS place
        FROM fact_sales JOIN {dim} USING ({key}))
      SELECT {column}, count(*) AS total_orders, {dbl("sum(x)")} AS total_revenue,
             {dbl("min(x)")} AS min_order_value, {dbl("max(x)")} AS max_order_value,
             {average("x")} AS avg_order_value, {spread("x")} AS stddev_order_value,
             round(stddev_samp({dbl("x")}) / nullif(avg({dbl("x")}), 0) * 100, 2) AS cv_pct,
             {dbl("max(x) FILTER (place <= 0.25)")} AS p25,
             {dbl("max(x) FILTER (place <= 0.50)")} AS p50_median,
             {dbl("max(x) FILTER (place <= 0.75)")} AS p75
      FROM placed GROUP BY {column} ORDER BY 1 NULLS FIRST"""


def customer_groupings(roles) -> str:
    sets = {
        "continent": ["continent"],
        "country": ["country", "continent"],
        "age group": [roles.age_group],
        "gender": [roles.gender],
        "marital status": [roles.marital_status],
    }
    columns = list(dict.fromkeys(c for by in sets.values() for c in by))
    parts = []
    for name, by in sets.items():
        shown = ", ".join(f"c.{c}" if c in by else f"NULL AS {c}" for c in columns)
        parts.append(f"""
          SELECT '{name}' AS "grouping", {shown}, count(DISTINCT c.customer_id) AS customer_count,
                 count(DISTINCT s.customer_id) AS active_customers,
                 count(DISTINCT s.order_number) AS total_orders,
                 {dbl("sum(s.sales_amount)")} AS total_revenue,
                 {average("s.sales_amount")} AS avg_order_value
          FROM dim_customer c LEFT JOIN fact_sales s ON c.customer_id = s.customer_id
          GROUP BY {", ".join(f"c.{c}" for c in by)}""")
    return " UNION ALL ".join(parts)


def product_board(
    way: str, rank: str, by_key: bool = False, method: str = "dense_rank"
) -> str:
    nulls = "FIRST" if way == "ASC" else "LAST"
    by = f"{'product_id, ' if by_key else ''}product_name, category, subcategory"
    ties = ", ".join(f"{c} NULLS FIRST" for c in by.split(", "))
    within = f", {ties}" if method == "row_number" else ""
    return f"""
      WITH sold AS (
        SELECT {by}, sum(quantity) AS units, sum(sales_amount) AS revenue
        FROM fact_sales JOIN dim_product USING (product_id) GROUP BY ALL)
      SELECT {by}, {whole("units")} AS units_sold, {dbl("revenue")} AS total_revenue,
             {method}() OVER (ORDER BY revenue {way} NULLS {nulls}{within}) AS {rank}
      FROM sold ORDER BY {rank}, {ties} LIMIT 10"""


def rank_in_category(method: str, ties: str = "") -> str:
    order = f"revenue DESC NULLS LAST{ties}"
    return f"""
      WITH g AS (
        SELECT category, subcategory, product_name, sum(sales_amount) AS revenue,
               sum(quantity) AS units
        FROM fact_sales JOIN dim_product USING (product_id) GROUP BY ALL)
      SELECT category, subcategory, product_name, {dbl("revenue")} AS total_revenue,
             {whole("units")} AS units_sold,
             {method}() OVER (ORDER BY {order}) AS global_rank,
             {method}() OVER (PARTITION BY category ORDER BY {order}) AS rank_within_category
      FROM g ORDER BY category NULLS FIRST, rank_within_category"""


def best_in_category(method: str, k: int = 3) -> str:
    ties = "product_name NULLS FIRST, category NULLS FIRST, subcategory NULLS FIRST"
    within = f", {ties}" if method == "row_number" else ""
    return f"""
      WITH g AS (
        SELECT product_name, category, subcategory, sum(quantity) AS units,
               sum(sales_amount) AS revenue
        FROM fact_sales JOIN dim_product USING (product_id) GROUP BY ALL)
      SELECT product_name, category, subcategory, {whole("units")} AS units_sold,
             {dbl("revenue")} AS total_revenue,
             {method}() OVER (PARTITION BY category ORDER BY revenue DESC NULLS LAST{within})
               AS rank_within_category
      FROM g QUALIFY rank_within_category <= {k}
      ORDER BY category NULLS FIRST, rank_within_category, {ties}"""


def alike(column: str) -> str:
    return f"lower(strip_accents(rtrim({column}, ' ')))"


def sign_off(roles, keys: dict[str, str]) -> str:
    checks = []

    def add(name: str, sql: str) -> None:
        checks.append(f"SELECT '{name}' AS check_name, ({sql}) AS violations")

    for table, key in keys.items():
        for column, allowed in roles.domains.get(table, {}).items():
            listed = ", ".join(f"'{v}'" for v in allowed)
            strange = f"SELECT count(*) FROM {table} WHERE coalesce({column} NOT IN ({listed}), TRUE)"
            add(f"{table}.{column} domain", strange)
        for column, (low, high) in roles.ranges.get(table, {}).items():
            outside = f"{column} IS NULL OR {column} < '{low}' OR {column} > '{high}'"
            add(f"{table}.{column} range", f"SELECT count(*) FROM {table} WHERE {outside}")
        add(f"{table}.{key} unique", f"SELECT count({key}) - count(DISTINCT {key}) FROM {table}")
        add(f"{table}.{key} present", f"SELECT count(*) FROM {table} WHERE {key} IS NULL")
    for fact, dim, key, name in (
        ("fact_sales", "dim_customer", "customer_id", "orphan customers"),
        ("fact_sales", "dim_product", "product_id", "orphan products"),
        ("fact_sales", "dim_store", "store_id", "orphan stores"),
        ("fact_returns", "fact_sales", "order_number", "orphan returns"),
    ):
        add(name, lost(fact, dim, key, "n"))
    return f"""
      SELECT check_name, {whole("violations")} AS violations,
             CASE violations WHEN 0 THEN 'pass' ELSE 'fail' END AS verdict
      FROM ({" UNION ALL ".join(checks)}) ORDER BY violations DESC, check_name"""


def structure(
    upstream: dict[str, dict[str, int]],
    columns: dict[str, dict[str, str]],
) -> dict[str, str]:
    """Phase 1."""
    objects = inventory(upstream, columns)
    return {
        "p1_1_layer_inventory": f"""
          SELECT schema_name, count(*) AS object_count, {whole("sum(row_count)")} AS total_rows
          FROM ({objects}) GROUP BY ALL ORDER BY 1""",
        "p1_2_object_inventory": f"SELECT * FROM ({objects}) ORDER BY 1, 3, 2",
        "p1_3_column_dictionary": dictionary(columns),
        "p1_4_row_counts": f"""
          SELECT 'gold.' || object_name AS gold_object, row_count FROM ({objects})
          WHERE schema_name = 'gold' ORDER BY row_count DESC, 1""",
    }


def variants(roles) -> dict[str, str]:
    """The operators' other uses, on the lake."""
    in_1995 = "AND s.order_year = 1995"
    return {
        # Exact: sketches of so few values are.
        "p2_1b_cardinality_approximate": audit(
            "dim_customer",
            roles.customer_categories,
            "count(DISTINCT {c})",
            "dimension_column",
            "distinct_values",
        ),
        "p2_2f_domain_segment_collated": """
          SELECT min(segment) AS segment_value FROM dim_customer
          GROUP BY lower(rtrim(segment, ' ')) ORDER BY 1 NULLS FIRST""",
        "p3_4b_line_profile": table_profile(
            "lineitem",
            (
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax",
            ),
            ("l_returnflag", "l_linestatus", "l_shipdate"),
        ),
        "p3_6e_orders_without_lines": lost(
            "orders", "lineitem", "o_orderkey", "orders_without_lines", "l_orderkey"
        ),
        "p3_6f_documents_without_labels": lost(
            "documents", "labels", "doc_id", "documents_without_labels"
        ),
        "p3_6g_customers_without_events": lost(
            "customer", "events", "c_custkey", "customers_without_events", "user_id"
        ),
        "p3_6h_orphan_references": "SELECT "
        + ", ".join(
            f"({lost('fact_sales', f'dim_{name}', f'{name}_id', 'n')}) AS orphan_{name}s"
            for name in ("customer", "product", "store")
        ),
        "p3_6i_customers_beyond_stores": f"""
          SELECT count(*) AS customers_beyond_stores FROM dim_customer c
          ANTI JOIN dim_store s ON {alike("s.region")} = {alike("c.continent")}""",
        "p3_7e_dup_raw_lines": repeated(
            "lineitem",
            "l_orderkey, l_linenumber",
            f"l_orderkey, {whole('l_linenumber')} AS l_linenumber",
        ),
        "p3_7f_dup_document_texts": repeated("documents", "text", "sha256(text) AS text_sha256"),
        "p4_1b_profile_by_category": profile_by("dim_product", "product_id", "category"),
        "p4_1c_profile_by_store_type": profile_by("dim_store", "store_id", "store_type"),
        "p4_1d_sales_by_percent_rank": f"""
          SELECT order_number, {whole("order_year")} AS order_year,
                 {dbl("sales_amount")} AS sales_amount,
                 percent_rank() OVER (ORDER BY sales_amount NULLS FIRST) AS percent_rank,
                 percent_rank() OVER (PARTITION BY order_year ORDER BY sales_amount NULLS FIRST)
                   AS percent_rank_in_year
          FROM fact_sales""",
        "p5_6d_by_age_group_1995": by_attribute(roles.age_group, on=in_1995),
        "p5_6e_by_gender_1995": by_attribute(roles.gender, on=in_1995),
        "p5_6f_by_marital_1995": by_attribute(roles.marital_status, False, in_1995),
        "p5_8_customer_groupings": customer_groupings(roles),
        "p6_1b_top10_products_by_key": product_board("DESC", "revenue_rank", by_key=True),
        "p6_1c_top10_products_rank": product_board("DESC", "revenue_rank", method="rank"),
        "p6_1d_top10_products_row_number": product_board(
            "DESC", "revenue_rank", method="row_number"
        ),
        "p6_1e_top10_subcategories_alike": f"""
          WITH g AS (
            SELECT min(category) AS category, min(subcategory) AS subcategory,
                   sum(quantity) AS units, sum(sales_amount) AS revenue
            FROM fact_sales JOIN dim_product USING (product_id)
            GROUP BY {alike("category")}, {alike("subcategory")})
          SELECT category, subcategory, {whole("units")} AS units_sold,
                 {dbl("revenue")} AS total_revenue,
                 dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS revenue_rank
          FROM g ORDER BY revenue_rank, category NULLS FIRST, subcategory NULLS FIRST LIMIT 10""",
        "p6_4b_rank_in_category_rank": rank_in_category("rank"),
        "p6_4c_rank_in_category_row_number": rank_in_category(
            "row_number", ", product_name NULLS FIRST, category NULLS FIRST, subcategory NULLS FIRST"
        ),
        "p6_4d_best3_in_category": best_in_category("row_number"),
        "p6_4e_best3_ranks_in_category": best_in_category("dense_rank"),
        "p6_4f_best3_places_in_category": best_in_category("rank"),
    }


def statements(roles, keys: dict[str, str], sanity_type: str) -> dict[str, str]:
    """Phases 2 to 6. ``sanity_type`` is the type the checked attribute is shown in."""
    distinct = "count(DISTINCT {c})"
    nulls = "count(*) FILTER ({c} IS NULL)"
    checked = roles.sanity_column
    return {
        "p2_1_cardinality": audit(
            "dim_customer",
            roles.customer_categories,
            distinct,
            "dimension_column",
            "distinct_values",
        ),
        "p2_2a_domain_gender": values("dim_customer", roles.gender, f"{roles.gender}_value"),
        "p2_2b_domain_marital": values(
            "dim_customer", roles.marital_status, f"{roles.marital_status}_value"
        ),
        "p2_2c_domain_age_group": values("dim_customer", roles.age_group, f"{roles.age_group}_value"),
        "p2_2d_domain_continent": values("dim_customer", "continent", "continent_value"),
        "p2_2e_domain_country": values("dim_customer", "country", "country_value"),
        "p2_3_hierarchy": f"""
          SELECT category, subcategory, count(product_id) AS product_count,
                 {dbl("min(cost)")} AS min_cost, {dbl("max(cost)")} AS max_cost,
                 {average("cost")} AS avg_cost
          FROM dim_product GROUP BY ALL ORDER BY 1 NULLS FIRST, 2 NULLS FIRST""",
        "p2_4a_domain_product_line": values("dim_product", "product_line", "product_line_value"),
        "p2_4b_domain_maintenance": values(
            "dim_product", "maintenance_required", "maintenance_value"
        ),
        "p2_4c_crosstab": """
          SELECT category, maintenance_required, count(*) AS product_count FROM dim_product
          GROUP BY ALL ORDER BY 1 NULLS FIRST, 2 NULLS FIRST""",
        "p2_5a_domain_store_type": values("dim_store", "store_type", "store_type_value"),
        "p2_5b_domain_region": values("dim_store", "region", "region_value"),
        "p2_5c_store_matrix": """
          SELECT store_type, region, count(store_id) AS store_count FROM dim_store
          GROUP BY ALL ORDER BY 1 NULLS FIRST, 2 NULLS FIRST""",
        "p2_6_status_share": shares("fact_sales", "delivery_status", "order_count"),
        "p2_7_reason_share": shares("fact_returns", "return_reason", "return_count"),
        "p3_1a_sales_date_coverage": """
          SELECT min(order_date) AS earliest_order, max(order_date) AS latest_order,
                 date_diff('month', min(order_date), max(order_date)) AS span_months,
                 count(DISTINCT year(order_date)) AS years_covered,
                 count(DISTINCT strftime(order_date, '%Y-%m')) AS distinct_year_months
          FROM fact_sales""",
        "p3_1b_returns_date_coverage": """
          SELECT min(return_date) AS earliest_return, max(return_date) AS latest_return,
                 date_diff('month', min(return_date), max(return_date)) AS span_months
          FROM fact_returns""",
        "p3_2_nulls_customer": audit(
            "dim_customer", roles.customer_audit, nulls, "column_name", "null_count"
        ),
        "p3_3_nulls_product": audit(
            "dim_product", roles.product_audit, nulls, "column_name", "null_count"
        ),
        "p3_4_nulls_sales": audit(
            "fact_sales", roles.sales_audit, nulls, "column_name", "null_count"
        ),
        "p3_5_nulls_returns": audit(
            "fact_returns", roles.returns_audit, nulls, "column_name", "null_count"
        ),
        "p3_6a_orphan_customers": lost(
            "fact_sales", "dim_customer", "customer_id", "orphan_customers"
        ),
        "p3_6b_orphan_products": lost("fact_sales", "dim_product", "product_id", "orphan_products"),
        "p3_6c_orphan_stores": lost("fact_sales", "dim_store", "store_id", "orphan_stores"),
        "p3_6d_orphan_returns": lost(
            "fact_returns", "fact_sales", "order_number", "orphan_returns"
        ),
        "p3_7a_dup_customers": repeated("dim_customer", "customer_id"),
        "p3_7b_dup_products": repeated("dim_product", "product_id"),
        "p3_7c_dup_orders": repeated("fact_sales", "order_number"),
        "p3_7d_dup_returns": repeated("fact_returns", "return_id"),
        "p3_8_age_sanity": f"""
          SELECT CAST(min({checked}) AS {sanity_type}) AS {roles.sanity_lowest},
                 CAST(max({checked}) AS {sanity_type}) AS {roles.sanity_highest},
                 {average(checked, 1)} AS avg_{checked},
                 {whole(f"sum(CASE WHEN {checked} < {roles.sanity_low} THEN 1 ELSE 0 END)")}
                   AS {checked}_under_{roles.sanity_low},
                 {whole(f"sum(CASE WHEN {checked} > {roles.sanity_high} THEN 1 ELSE 0 END)")}
                   AS {checked}_over_{roles.sanity_high},
                 {whole(f"sum(CASE WHEN {checked} IS NULL THEN 1 ELSE 0 END)")} AS {checked}_null
          FROM dim_customer""",
        "p3_9_sign_off": sign_off(roles, keys),
        "p4_1_sales_profile": f"""
          WITH placed AS (
            SELECT sales_amount AS x,
                   percent_rank() OVER (ORDER BY sales_amount NULLS FIRST) AS place
            FROM fact_sales)
          SELECT count(*) AS total_orders, {dbl("sum(x)")} AS total_revenue,
                 {dbl("min(x)")} AS min_order_value, {dbl("max(x)")} AS max_order_value,
                 {average("x")} AS avg_order_value, {spread("x")} AS stddev_order_value,
                 round(stddev_samp({dbl("x")}) / nullif(avg({dbl("x")}), 0) * 100, 2) AS cv_pct,
                 {dbl("max(x) FILTER (place <= 0.25)")} AS p25,
                 {dbl("max(x) FILTER (place <= 0.50)")} AS p50_median,
                 {dbl("max(x) FILTER (place <= 0.75)")} AS p75
          FROM placed""",
        "p4_2_price_qty_profile": f"""
          SELECT {dbl("min(price)")} AS min_unit_price, {dbl("max(price)")} AS max_unit_price,
                 {average("price")} AS avg_unit_price, {spread("price")} AS stddev_price,
                 {whole("min(quantity)")} AS min_qty_per_order,
                 {whole("max(quantity)")} AS max_qty_per_order,
                 {average("quantity")} AS avg_qty_per_order,
                 {whole("sum(quantity)")} AS total_units_sold,
                 {ratio("sum(sales_amount) * 100", "sum(quantity) * 100")} AS effective_price_per_unit
          FROM fact_sales""",
        "p4_3a_return_profile": f"""
          SELECT count(*) AS total_return_transactions,
                 {dbl("sum(return_amount)")} AS total_returned_value,
                 {dbl("min(return_amount)")} AS min_return_amount,
                 {dbl("max(return_amount)")} AS max_return_amount,
                 {average("return_amount")} AS avg_return_amount,
                 {spread("return_amount")} AS stddev_return_amount
          FROM fact_returns""",
        "p4_3b_return_rate": f"""
          WITH sold AS (SELECT sum(sales_amount) AS v FROM fact_sales),
               returned AS (SELECT sum(return_amount) AS v FROM fact_returns)
          SELECT {share("(SELECT v FROM returned)", "(SELECT v FROM sold)")} AS return_rate_pct""",
        "p4_4_cost_by_category": f"""
          SELECT category, count(product_id) AS product_count, {dbl("min(cost)")} AS min_cost,
                 {dbl("max(cost)")} AS max_cost, {average("cost")} AS avg_cost,
                 {spread("cost")} AS stddev_cost, {dbl("max(cost) - min(cost)")} AS cost_range
          FROM dim_product GROUP BY ALL ORDER BY avg_cost DESC NULLS LAST, category NULLS FIRST""",
        "p4_5_lead_time": f"""
          SELECT {whole("min(days_to_ship)")} AS min_days_to_ship,
                 {whole("max(days_to_ship)")} AS max_days_to_ship,
                 {average("days_to_ship", 1)} AS avg_days_to_ship,
                 {spread("days_to_ship", 1)} AS stddev_days_to_ship,
                 {whole("min(days_to_due)")} AS min_days_to_due,
                 {whole("max(days_to_due)")} AS max_days_to_due,
                 {average("days_to_due", 1)} AS avg_days_to_due,
                 {spread("days_to_due", 1)} AS stddev_days_to_due
          FROM fact_sales WHERE days_to_ship IS NOT NULL AND days_to_due IS NOT NULL""",
        "p5_1_by_year": f"""
          SELECT {whole("order_year")} AS order_year, count(DISTINCT order_number) AS total_orders,
                 {whole("sum(quantity)")} AS total_units_sold,
                 {dbl("sum(sales_amount)")} AS total_revenue,
                 {average("sales_amount")} AS avg_order_value
          FROM fact_sales GROUP BY order_year ORDER BY 1 NULLS FIRST""",
        "p5_2_by_category": f"""
          WITH g AS (
            SELECT category, count(DISTINCT order_number) AS orders, sum(quantity) AS units,
                   sum(sales_amount) AS revenue
            FROM fact_sales JOIN dim_product USING (product_id) GROUP BY ALL)
          SELECT category, orders AS total_orders, {whole("units")} AS units_sold,
                 {dbl("revenue")} AS total_revenue,
                 {share("revenue", "(SELECT sum(revenue) FROM g)")} AS revenue_pct
          FROM g ORDER BY total_revenue DESC NULLS LAST, category NULLS FIRST""",
        "p5_3_by_store_type": f"""
          WITH g AS (
            SELECT store_type, count(DISTINCT order_number) AS orders, sum(quantity) AS units,
                   sum(sales_amount) AS revenue, {average("sales_amount")} AS mean_value
            FROM fact_sales JOIN dim_store USING (store_id) GROUP BY ALL)
          SELECT store_type, orders AS total_orders, {whole("units")} AS units_sold,
                 {dbl("revenue")} AS total_revenue, mean_value AS avg_order_value,
                 {share("revenue", "(SELECT sum(revenue) FROM g)")} AS revenue_pct
          FROM g ORDER BY total_revenue DESC NULLS LAST, store_type NULLS FIRST""",
        "p5_4a_by_continent": f"""
          WITH g AS (
            SELECT continent, count(DISTINCT customer_id) AS customers,
                   count(DISTINCT order_number) AS orders, sum(sales_amount) AS revenue
            FROM fact_sales JOIN dim_customer USING (customer_id) GROUP BY ALL)
          SELECT continent, customers AS unique_customers, orders AS total_orders,
                 {dbl("revenue")} AS total_revenue,
                 {share("revenue", "(SELECT sum(revenue) FROM g)")} AS revenue_pct
          FROM g ORDER BY total_revenue DESC NULLS LAST, continent NULLS FIRST""",
        "p5_4b_by_country": f"""
          SELECT country, continent, count(DISTINCT customer_id) AS unique_customers,
                 count(DISTINCT order_number) AS total_orders,
                 {dbl("sum(sales_amount)")} AS total_revenue,
                 {average("sales_amount")} AS avg_order_value
          FROM fact_sales JOIN dim_customer USING (customer_id) GROUP BY country, continent
          ORDER BY total_revenue DESC NULLS LAST, 1 NULLS FIRST, 2 NULLS FIRST""",
        "p5_5_returns_by_category": f"""
          WITH g AS (
            SELECT category, count(return_id) AS n, sum(return_amount) AS value,
                   {average("return_amount")} AS mean_value
            FROM fact_returns JOIN fact_sales USING (order_number)
            JOIN dim_product USING (product_id) GROUP BY ALL)
          SELECT category, n AS total_returns, {dbl("value")} AS total_returned_value,
                 mean_value AS avg_return_amount,
                 {share("value", "(SELECT sum(value) FROM g)")} AS return_value_pct
          FROM g ORDER BY n DESC, category NULLS FIRST""",
        "p5_6a_by_age_group": by_attribute(roles.age_group),
        "p5_6b_by_gender": by_attribute(roles.gender),
        "p5_6c_by_marital": by_attribute(roles.marital_status, average_too=False),
        "p5_7_monthly_trend": f"""
          SELECT {whole("order_year")} AS order_year, {whole("order_month")} AS order_month,
                 order_month_name, count(DISTINCT order_number) AS total_orders,
                 {whole("sum(quantity)")} AS units_sold,
                 {dbl("sum(sales_amount)")} AS monthly_revenue
          FROM fact_sales GROUP BY fact_sales.order_year, fact_sales.order_month, order_month_name
          ORDER BY 1 NULLS FIRST, 2 NULLS FIRST""",
        "p6_1_top10_products": product_board("DESC", "revenue_rank"),
        "p6_2_bottom10_products": product_board("ASC", "low_revenue_rank"),
        "p6_3_top10_customers": f"""
          WITH g AS (
            SELECT customer_id, full_name, country, {roles.age_group}, {roles.gender},
                   count(DISTINCT order_number) AS total_orders, sum(sales_amount) AS revenue,
                   {average("sales_amount")} AS avg_order_value
            FROM fact_sales JOIN dim_customer USING (customer_id) GROUP BY ALL)
          SELECT * EXCLUDE (revenue), {dbl("revenue")} AS lifetime_revenue,
                 dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS clv_rank
          FROM g ORDER BY clv_rank, customer_id NULLS FIRST, full_name NULLS FIRST,
            country NULLS FIRST, {roles.age_group} NULLS FIRST, {roles.gender} NULLS FIRST
          LIMIT 10""",
        "p6_4_rank_in_category": rank_in_category("dense_rank"),
        "p6_5_store_dual_rank": f"""
          WITH g AS (
            SELECT store_name, store_type, region, count(DISTINCT order_number) AS orders,
                   sum(sales_amount) AS revenue, count(*) AS n,
                   count(*) FILTER (delivery_status = 'On Time') AS punctual
            FROM fact_sales JOIN dim_store USING (store_id) GROUP BY ALL)
          SELECT store_name, store_type, region, orders AS total_orders,
                 {dbl("revenue")} AS total_revenue, {ratio("punctual * 100", "n")} AS on_time_pct,
                 dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS revenue_rank,
                 dense_rank() OVER (ORDER BY {dbl("punctual")} / {dbl("n")} DESC) AS delivery_rank
          FROM g ORDER BY revenue_rank, 1 NULLS FIRST""",
        "p6_6_month_rank": f"""
          WITH g AS (
            SELECT order_year AS y, order_month AS m, order_month_name,
                   count(DISTINCT order_number) AS orders, sum(sales_amount) AS revenue
            FROM fact_sales GROUP BY ALL)
          SELECT {whole("y")} AS order_year, {whole("m")} AS order_month, order_month_name,
                 orders AS total_orders, {dbl("revenue")} AS monthly_revenue,
                 dense_rank() OVER (ORDER BY revenue DESC NULLS LAST) AS overall_rank,
                 dense_rank() OVER (PARTITION BY y ORDER BY revenue DESC NULLS LAST)
                   AS rank_within_year
          FROM g ORDER BY 1 NULLS FIRST, 2 NULLS FIRST""",
        "p6_7_country_return_rate": f"""
          WITH g AS (
            SELECT country, continent, count(DISTINCT s.order_number) AS orders,
                   count(DISTINCT r.return_id) AS returned
            FROM fact_sales s JOIN dim_customer c ON s.customer_id = c.customer_id
            LEFT JOIN fact_returns r ON s.order_number = r.order_number
            GROUP BY ALL)
          SELECT country, continent, orders AS total_orders, returned AS total_returns,
                 {ratio("returned * 100", "orders")} AS return_rate_pct,
                 dense_rank() OVER (
                   ORDER BY {dbl("returned")} / nullif({dbl("orders")}, 0) DESC NULLS LAST)
                   AS return_rank
          FROM g ORDER BY return_rank, 1 NULLS FIRST, 2 NULLS FIRST""",
    }
