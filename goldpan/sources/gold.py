"""The gold star schema over the lake's order tables.

Silver ``order_lines`` is the one expensive step (join of the two largest tables, exact
copies collapsed, and the columns derived from them). It is written once per session and
source folder, bucketed by order number, so that what matches facts by that key later
reads co-located buckets instead of shuffling. No row of the lake is lost on the way: only
rows equal in every column count once, and what lacks a partner keeps NULLs. The facts are selections from it, the
dimensions are written as they are.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldpan.functions import half_up
from goldpan.operators import ranking
from goldpan.plans.star import Entry, Roles, Star
from goldpan.sources.lake import LAKE_SCHEMAS, read_table, table_bytes
from goldpan.sources.storage import new_folder, written

# The lake has no demographics; fixed stand-in columns take their roles.
LAKE_ROLES = Roles(
    gender="segment",
    marital_status="account_status",
    age_group="balance_band",
    customer_categories=("segment", "account_status", "balance_band", "country", "continent"),
    customer_audit=(
        "customer_id",
        "full_name",
        "segment",
        "account_status",
        "balance",
        "balance_band",
        "country",
        "continent",
    ),
    product_audit=(
        "product_id",
        "product_name",
        "cost",
        "category",
        "subcategory",
        "product_line",
        "maintenance_required",
    ),
    sales_audit=(
        "order_number",
        "product_id",
        "customer_id",
        "store_id",
        "order_date",
        "shipping_date",
        "due_date",
        "quantity",
        "price",
        "sales_amount",
        "discount",
        "order_year",
        "order_month",
        "order_month_name",
        "days_to_ship",
        "days_to_due",
        "delivery_status",
    ),
    returns_audit=(
        "return_id",
        "order_number",
        "return_date",
        "return_year",
        "return_month",
        "return_reason",
        "return_amount",
    ),
    sanity_column="balance",
    sanity_low=0,
    sanity_high=9000,
    sanity_lowest="lowest_balance",
    sanity_highest="highest_balance",
    domains={
        "dim_customer": {
            "balance_band": ("0-2499", "2500-4999", "5000-7499", "7500+"),
            "account_status": ("Debtor", "Creditor"),
        },
        "dim_product": {
            "product_line": ("S", "M", "L"),
            "maintenance_required": ("Yes", "No"),
        },
        "dim_store": {"store_type": ("Tier A", "Tier B", "Tier C", "Tier D")},
        "fact_sales": {"delivery_status": ("On Time", "Late", "Unknown")},
    },
    ranges={
        "dim_customer": {"balance": (0, 9000)},
        "fact_sales": {"order_date": (date(1995, 1, 1), date(2001, 12, 31))},
        "fact_returns": {"return_date": (date(1995, 1, 1), date(2001, 12, 31))},
    },
)

MONEY = "decimal(18,2)"
BUCKET_BYTES = 1 << 30
# Parts that the values of a key are counted in.
HASHES = 1 << 16


def geography(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "n_name", "r_name"
    )


def dim_customer(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = geography(nation, region)
    balance = F.col("c_acctbal")
    band = (
        F.when(balance.isNull() | (balance < 0), None)
        .when(balance < 2500, "0-2499")
        .when(balance < 5000, "2500-4999")
        .when(balance < 7500, "5000-7499")
        .otherwise("7500+")
    )
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("continent"),
        F.col("c_mktsegment").alias("segment"),
        balance.cast(MONEY).alias("balance"),
        band.alias("balance_band"),
        F.when(balance < 0, "Debtor").when(balance >= 0, "Creditor").alias("account_status"),
    )


def dim_product(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.when(size <= 15, "S").when(size <= 35, "M").when(size > 35, "L").alias("product_line"),
        F.when(size > 25, "Yes").when(size <= 25, "No").alias("maintenance_required"),
        F.col("p_retailprice").cast(MONEY).alias("cost"),
    )


def dim_store(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = geography(nation, region)
    balance = F.col("s_acctbal")
    tier = (
        F.when(balance < 0, "Tier D")
        .when(balance < 3000, "Tier C")
        .when(balance < 6500, "Tier B")
        .when(balance >= 6500, "Tier A")
    )
    return supplier.join(places, supplier.s_nationkey == places.n_nationkey, "left").select(
        F.col("s_suppkey").alias("store_id"),
        F.col("s_name").alias("store_name"),
        tier.alias("store_type"),
        F.col("r_name").alias("region"),
    )


# Measures of a line as exact decimals: what floating point columns hold up to a millionth.
EXACT = "decimal(24,6)"
LINE = {
    "l_orderkey": "bigint",
    "l_linenumber": "int",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_quantity": EXACT,
    "l_extendedprice": EXACT,
    "l_discount": EXACT,
    "l_tax": EXACT,
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "date",
}
ORDER = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderdate": "date",
    "o_orderpriority": "string",
}


def distinct_rows(
    df: DataFrame, columns: dict[str, str], dealt: tuple[int, str] | None = None
) -> DataFrame:
    """Rows equal in every given column once: a hash aggregate that starts before the shuffle.

    Exact decimals are moved as the doubles next to them, a third of the bytes, from which
    ``exact`` restores them: no two that floating point columns yield have one double.

    ``dealt`` names a number of partitions and a column: rows are first dealt out by it and then
    collapse in place, copies being neighbours. That is for columns that are ``evenly_keyed``.
    """
    kinds = ((F.col(name).cast(kind), kind) for name, kind in columns.items())
    rows = df.select(*(c.cast("double") if kind == EXACT else c for c, kind in kinds))
    return (rows.repartition(*dealt) if dealt else rows).distinct()


def evenly_keyed(df: DataFrame, key: str) -> bool:
    """Whether no value of a column, NULL included, has more rows than one task may hold.

    Proven from counts of the values' hashes, which are no smaller than those of the values.
    """
    hashes = df.select(F.pmod(F.hash(key), F.lit(HASHES)).alias("hash")).groupBy("hash").count()
    return (hashes.agg(F.max("count")).first()[0] or 0) <= ranking.SINGLE_TASK_ROWS


def exact(name: str) -> Column:
    """A column of ``distinct_rows`` as it was compared."""
    return F.col(name).cast(EXACT) if LINE.get(name) == EXACT else F.col(name)


def order_lines(
    lineitem: DataFrame, orders: DataFrame, partitions: int | None = None, even: bool = False
) -> DataFrame:
    """Every different order line, with what its order says; lines without an order too.

    Exact copies count once, however many there are. Lines that share order and line
    number but differ elsewhere are sales of their own, and so is a line under each of the
    different orders that claim one key. The order number ends in a digest of all columns,
    which makes it unique; it is NULL where the order or the line number is. A quantity
    that is not whole stops the build.

    With ``partitions`` rows are dealt out into so many by order number. They are shuffled
    as they come from the lake: the number, the widest column and one that does not compress,
    is computed before for its hash alone and once more after.

    ``even`` says that both tables are ``evenly_keyed`` by order: then one shuffle of each
    serves copies and join. Otherwise copies collapse before they are shuffled, so that each
    task sends one, and the join has exchanges of its own, where adaptive execution splits a
    hot order.
    """
    dealt = (partitions, "l_orderkey"), (partitions, "o_orderkey")
    lines = distinct_rows(lineitem, LINE, dealt[0] if partitions and even else None)
    once = distinct_rows(orders, ORDER, dealt[1] if partitions and even else None)
    joined = lines.join(once, lines.l_orderkey == once.o_orderkey, "left")
    # The key of the order is that of the line, or there is none: one bit of it is moved.
    ordered = F.col("o_orderkey").isNotNull().alias("ordered")
    joined = joined.select(*LINE, ordered, *[c for c in ORDER if c != "o_orderkey"])
    told = {"o_orderkey": F.when(F.col("ordered"), F.col("l_orderkey"))}
    texts = (F.coalesce(told.get(c, exact(c)).cast("string"), F.lit("")) for c in [*LINE, *ORDER])
    parts = [F.col("l_orderkey"), F.col("l_linenumber"), F.md5(F.concat_ws("|", *texts))]
    number = F.concat(*[x for part in parts for x in (part.cast("string"), F.lit("-"))][:-1])
    if partitions:
        joined = joined.repartition(partitions, number)
    quantity = exact("l_quantity")
    whole = quantity.cast("bigint")
    broken = F.raise_error(F.concat(F.lit("l_quantity is not whole: "), quantity))
    return joined.select(
        number.alias("order_number"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("shipping_date"),
        F.col("o_orderpriority").alias("order_priority"),
        F.col("l_returnflag").alias("return_flag"),
        F.when(quantity != whole, broken.cast("bigint")).otherwise(whole).alias("quantity"),
        exact("l_extendedprice").cast(MONEY).alias("sales_amount"),
        exact("l_discount").cast("decimal(4,2)").alias("discount"),
    )


def with_derived(lines: DataFrame) -> DataFrame:
    """Order lines with everything computed from a line's own columns."""
    allowed_days = F.substring("order_priority", 1, 1).try_cast("int") * 15
    lead = F.datediff("shipping_date", "order_date")
    price = half_up("cast(sales_amount * 100 as bigint)", "quantity * 100", 2, "bigint")
    refund = F.round(F.col("sales_amount") * (F.lit(1) - F.col("discount")), 2)
    dated = lines.withColumn("due_date", F.date_add("order_date", allowed_days)).withColumn(
        "days_to_ship", F.when(lead >= 0, lead).cast("bigint")
    )
    return dated.select(
        *dated.columns,
        price.cast(MONEY).alias("price"),
        F.year("order_date").cast("bigint").alias("order_year"),
        F.month("order_date").cast("bigint").alias("order_month"),
        F.date_format("order_date", "MMMM").alias("order_month_name"),
        F.datediff("due_date", "order_date").cast("bigint").alias("days_to_due"),
        F.when(F.col("days_to_ship").isNull(), "Unknown")
        .when(F.col("shipping_date") <= F.col("due_date"), "On Time")
        .otherwise("Late")
        .alias("delivery_status"),
        F.when(F.col("return_flag") == "R", refund).cast(MONEY).alias("return_amount"),
    )


def fact_sales(lines: DataFrame) -> DataFrame:
    return lines.select(
        "order_number",
        "product_id",
        "customer_id",
        "store_id",
        "order_date",
        "shipping_date",
        "due_date",
        "quantity",
        "sales_amount",
        "discount",
        "price",
        "order_year",
        "order_month",
        "order_month_name",
        "days_to_ship",
        "days_to_due",
        "delivery_status",
    )


def fact_returns(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("return_flag") == "R").select(
        F.concat(F.lit("R-"), F.col("order_number")).alias("return_id"),
        "order_number",
        F.col("shipping_date").alias("return_date"),
        F.year("shipping_date").cast("bigint").alias("return_year"),
        F.month("shipping_date").cast("bigint").alias("return_month"),
        F.col("order_priority").alias("return_reason"),
        "return_amount",
    )


def _partitions(spark: SparkSession) -> int:
    conf = spark.conf
    return int(
        conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        or conf.get("spark.sql.shuffle.partitions")
    )


def bucket_count(spark: SparkSession, source_bytes: int) -> int:
    """Buckets of about a gigabyte of source each, but at least one per core.

    The number divides the shuffle partitions or is a multiple of them, so that rows of
    one shuffle partition fall into whole buckets or into one: no task spreads its rows
    over all buckets.
    """
    conf = spark.conf
    partitions = _partitions(spark)
    wanted = max(math.ceil(source_bytes / BUCKET_BYTES), spark.sparkContext.defaultParallelism)
    if wanted <= partitions:
        return next(n for n in range(wanted, partitions + 1) if partitions % n == 0)
    most = int(conf.get("spark.sql.sources.bucketing.maxBuckets"))
    times = min(math.ceil(wanted / partitions), most // partitions)
    return partitions * max(1, times)


def write_order_lines(
    spark: SparkSession,
    lines: DataFrame,
    folder: str,
    schema: str,
    source_bytes: int,
    dealt: bool = False,
) -> DataFrame:
    """Write silver bucketed by order number, returned lines together in each bucket.

    Rows are dealt out by order number first unless ``dealt`` says they are, so that each
    task writes whole buckets or one. Sorted by return flag, a bucket's file statistics let a
    scan of the returns skip the rest. Half of a row is its number's digest, in hexadecimal:
    zstandard stores that in half the bytes.
    """
    if not dealt:
        lines = lines.repartition(_partitions(spark), "order_number")
    (
        lines.write.format("parquet")
        .option("compression", "zstd")
        .bucketBy(bucket_count(spark, source_bytes), "order_number")
        .sortBy("return_flag")
        .option("path", f"{folder}/order_lines")
        .saveAsTable(f"{schema}.order_lines")
    )
    return spark.table(f"{schema}.order_lines")


_stars: dict[tuple[str, str], Star] = {}


def lake_star(spark: SparkSession, folder: str, refresh: bool = False) -> Star:
    """The star over a lake folder, built on first use in a session and then reused.

    The star is a snapshot: pass ``refresh=True`` after the lake files change.
    """
    key = (spark.sparkContext.applicationId, folder)
    if refresh or key not in _stars:
        _stars[key] = build_star(spark, folder)
    return _stars[key]


def build_star(spark: SparkSession, folder: str) -> Star:
    lake = {name: read_table(spark, folder, name) for name in LAKE_SCHEMAS}
    target = new_folder(spark)
    schema = "silver_" + target.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{target}'")
    size = table_bytes(spark, folder, "lineitem")
    even = all(evenly_keyed(lake[t], c) for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")))
    dealt = order_lines(lake["lineitem"], lake["orders"], _partitions(spark), even)
    lines = with_derived(dealt)
    lines = write_order_lines(spark, lines, target, schema, size, dealt=True)
    places = lake["nation"], lake["region"]
    dimensions = {
        "dim_customer": dim_customer(lake["customer"], *places),
        "dim_product": dim_product(lake["part"]),
        "dim_store": dim_store(lake["supplier"], *places),
    }
    stored = {name: written(df, f"{target}/{name}") for name, df in dimensions.items()}
    upstream = [Entry("bronze", name, "BASE TABLE", df) for name, df in lake.items()]
    upstream.append(Entry("silver", "order_lines", "BASE TABLE", lines))
    return Star(
        **stored,
        fact_sales=fact_sales(lines),
        fact_returns=fact_returns(lines),
        roles=LAKE_ROLES,
        upstream=tuple(upstream),
        grouped_by_key=frozenset({"fact_sales", "fact_returns"}),
    )
