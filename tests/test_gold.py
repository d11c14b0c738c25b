"""Silver and gold: deduplication, derived columns, storage."""

from __future__ import annotations

import random
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from goldpan.plans.star import KEYS
from goldpan.sources import gold, read_csv
from goldpan.sources.lake import LAKE_SCHEMAS, table_bytes
from goldpan.sources.storage import cut_lineage, shared_folder
from tests.compare import assert_same
from tests.conftest import LAKE, settings


def line(order, number, shipped="2000-01-05", part=1, amount=10.0, quantity=3.0, flag="R", discount=0.1):
    day = None if shipped is None else datetime.fromisoformat(shipped)
    return (order, part, 7, number, quantity, amount, discount, 0.0, flag, "O", day)


def order(key, day="2000-01-01", priority="2-HIGH", customer=1):
    return (key, customer, "O", 0.0, datetime.fromisoformat(day), priority)


def lake(spark, lines, orders):
    return (
        spark.createDataFrame(lines, LAKE_SCHEMAS["lineitem"]),
        spark.createDataFrame(orders, LAKE_SCHEMAS["orders"]),
    )


def test_exact_copies_collapse_and_nothing_else(spark):
    rnd = random.Random(2)
    lines = [
        line(o, n, rnd.choice(["2000-01-05", "2000-01-04"]), rnd.randint(1, 2), rnd.choice([1.0, 2.0]))
        for o in range(1, 20)
        for n in (1, 2)
        for _ in range(rnd.randint(1, 6))
    ]
    # A third of all rows are copies of one line.
    lines += [line(1, 1, "2000-01-09")] * (len(lines) // 2)
    rnd.shuffle(lines)
    found = gold.order_lines(*lake(spark, lines, [order(k) for k in range(1, 20)])).collect()
    different = set(lines)
    assert len(found) == len(different) == len({r.order_number for r in found})
    assert sum(r.sales_amount for r in found) == Decimal(str(sum(x[5] for x in different)))
    prefixes = sorted(r.order_number.rsplit("-", 1)[0] for r in found)
    assert prefixes == sorted(f"{x[0]}-{x[3]}" for x in different)


def test_lines_without_number_or_order_stay(spark):
    lines = [line(1, None), line(1, None), line(2, None), line(2, 1), line(None, 1), line(9, 1)]
    rows = gold.order_lines(*lake(spark, lines, [order(1, customer=5), order(2, customer=6)])).collect()
    found = [((r.order_number or "").rsplit("-", 1)[0], r.customer_id or 0) for r in rows]
    assert sorted(found) == [("", 0), ("", 5), ("", 6), ("2-1", 6), ("9-1", 0)]


def test_copies_of_orders_collapse_and_different_ones_stay(spark):
    lines = [line(1, 1), line(1, 2), line(2, 1)]
    orders = [order(1, customer=5), order(1, customer=5), order(1, customer=4), order(2)]
    rows = gold.order_lines(*lake(spark, lines, orders)).collect()
    found = [(r.order_number.rsplit("-", 1)[0], r.customer_id) for r in rows]
    assert sorted(found) == [("1-1", 4), ("1-1", 5), ("1-2", 4), ("1-2", 5), ("2-1", 1)]
    assert len({r.order_number for r in rows}) == 5


def test_a_quantity_that_is_not_whole_stops_the_build(spark):
    lines = gold.order_lines(*lake(spark, [line(1, 1, quantity=1.5)], [order(1)]))
    with pytest.raises(Exception, match="not whole"):
        lines.collect()


def test_all_sales_of_the_lake_are_kept(spark):
    lineitem = gold.read_table(spark, LAKE, "lineitem")
    sales = gold.lake_star(spark, LAKE).fact_sales
    amount = gold.F.sum(gold.F.col("l_extendedprice").cast(gold.MONEY))
    assert sales.count() == lineitem.distinct().count()
    assert sales.agg({"sales_amount": "sum"}).first()[0] == lineitem.distinct().agg(amount).first()[0]


def test_the_build_aggregates_by_hash(spark):
    tables = [gold.read_table(spark, LAKE, name) for name in ("lineitem", "orders")]
    plan = gold.with_derived(gold.order_lines(*tables))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 4


def test_rows_are_dealt_out_before_anything_is_computed(spark):
    """What the last shuffle of the build moves are the lake's columns, measures as doubles."""
    tables = [gold.read_table(spark, LAKE, name) for name in ("lineitem", "orders")]
    dealt = gold.with_derived(gold.order_lines(*tables, 4))
    text = dealt._jdf.queryExecution().executedPlan().toString()
    moved = text[text.index("REPARTITION_BY_NUM") :]
    assert "order_number" not in moved and "days_to_due" not in moved
    assert "l_quantity" in moved and "md5" not in moved
    whole = gold.with_derived(gold.order_lines(*tables))
    assert sorted(dealt.collect(), key=str) == sorted(whole.collect(), key=str)


def test_evenly_keyed_lines_are_shuffled_twice(spark):
    """Once for copies and the join with their orders, once to be dealt out by number."""
    tables = [gold.read_table(spark, LAKE, name) for name in ("lineitem", "orders")]
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    ):
        dealt = gold.with_derived(gold.order_lines(*tables, 4, even=True))
        text = dealt._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 3  # lines, orders, lines
        assert text.count("REPARTITION_BY_NUM") == 3 and "SortAggregate" not in text
        found = sorted(dealt.collect(), key=str)
    whole = gold.with_derived(gold.order_lines(*tables))
    assert found == sorted(whole.collect(), key=str)


def test_the_build_shuffles_each_table_once_for_copies_and_join(spark, monkeypatch):
    found = []
    order_lines = gold.order_lines
    monkeypatch.setattr(gold, "order_lines", lambda *args: found.append(args) or order_lines(*args))
    rows = gold.build_star(spark, LAKE).rows("fact_sales")
    monkeypatch.setattr(gold.ranking, "SINGLE_TASK_ROWS", 1)
    assert gold.build_star(spark, LAKE).rows("fact_sales") == rows
    assert [args[3] for args in found] == [True, False]


@pytest.mark.parametrize("even", [True, False])
def test_copies_unknown_keys_and_repeated_orders_collapse_alike(spark, even):
    rnd = random.Random(6)
    lines = [
        line(rnd.choice([None, 1, 2, 3, 99]), rnd.choice([None, 1, 2]), rnd.choice([None, "2000-01-05"]),
             rnd.randint(1, 2), flag=rnd.choice([None, "", "R"]))
        for _ in range(600)
    ]
    orders = [order(k, customer=c) for k, c in [(1, 1), (1, 1), (1, 2), (2, 1), (None, 1), (3, None), (3, 7)]]
    tables = lake(spark, lines, orders)
    found = gold.order_lines(*tables, 4, even).collect()
    partners = {1: 2, 2: 1, 3: 2}
    assert len(found) == sum(partners.get(x[0], 1) for x in set(lines))
    assert sorted(found, key=str) == sorted(gold.order_lines(*tables).collect(), key=str)


def test_keys_are_even_only_where_no_value_is_hot(spark, monkeypatch):
    monkeypatch.setattr(gold.ranking, "SINGLE_TASK_ROWS", 50)
    assert gold.evenly_keyed(spark.range(1000), "id")
    assert gold.evenly_keyed(spark.range(0), "id")
    for hot in ("if(id < 60, 7, id)", "if(id < 60, null, id)"):
        assert not gold.evenly_keyed(spark.range(1000).selectExpr(f"{hot} as id"), "id")


def test_measures_moved_as_doubles_are_the_same_decimals(spark):
    rnd = random.Random(4)
    values = [0.0, -0.0, 0.1, -0.05, 1e-7, 5e-7, 2.5e-6, 4503599627.370497, 123456789012345.67, 9.9e17]
    for power in range(-24, 59):
        values += [rnd.choice([1, -1]) * rnd.uniform(2.0**power, 2.0 ** (power + 1)) for _ in range(300)]
        values += [round(rnd.uniform(2.0**power, 2.0 ** (power + 1)), 6) for _ in range(300)]
    lines = spark.createDataFrame([line(i, 1, amount=x) for i, x in enumerate(values)], LAKE_SCHEMAS["lineitem"])
    was = lines.select("l_orderkey", gold.F.col("l_extendedprice").cast(gold.EXACT).alias("was"))
    moved = gold.distinct_rows(lines, gold.LINE)
    assert dict(moved.dtypes)["l_extendedprice"] == "double"
    now = moved.select("l_orderkey", gold.exact("l_extendedprice").alias("now"))
    both = was.join(now, "l_orderkey")
    assert both.count() == len(values) and both.where("not was <=> now").count() == 0
    # Rows alike to a millionth are still one.
    twice = [line(1, 1, amount=0.1), line(1, 1, amount=0.1 + 1e-9), line(1, 1, amount=0.100001)]
    alike = spark.createDataFrame(twice, LAKE_SCHEMAS["lineitem"])
    assert gold.distinct_rows(alike, gold.LINE).count() == 2


def test_silver_is_stored_compactly(spark):
    files = gold.lake_star(spark, LAKE).source("order_lines").inputFiles()
    assert files and all(name.endswith(".zstd.parquet") for name in files)


def test_unknown_places_and_values_reach_the_audits(spark, tmp_path):
    """Members without a nation, lines without an order and NULL balances, against SQL."""
    tables = {name: gold.read_table(spark, LAKE, name) for name in LAKE_SCHEMAS}
    wrong = {
        "customer": [(999_001, "C1", None, None, "X"), (999_002, "C2", 999, -1.0, None)],
        "supplier": [(999_001, "S1", None, None), (999_002, "S2", 999, 1.0)],
        "part": [(999_001, "P1", "B", "T", None, None)],
        "lineitem": [line(999_001, 1, part=999_001), line(None, 1), line(999_002, None)],
        "orders": [],
    }
    con = duckdb.connect()
    for name, df in tables.items():
        more = spark.createDataFrame(wrong.get(name, []), LAKE_SCHEMAS[name])
        df.unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    folder = str(tmp_path)
    for key in ("p3_2_nulls_customer", "p3_3_nulls_product", "p3_4_nulls_sales", "p3_6a_orphan_customers",
                "p3_8_age_sanity", "p2_1_cardinality", "p2_5c_store_matrix", "p4_1_sales_profile",
                "p5_6a_by_age_group", "p6_7_country_return_rate"):
        assert_same(contract.queries()[key](spark, folder), con, contract.oracle_sql()[key])
    nulls = {r[0]: r[1] for r in contract.queries()["p3_2_nulls_customer"](spark, folder).collect()}
    assert nulls["country"] == 2 and nulls["balance"] == nulls["account_status"] == 1
    lost = contract.queries()["p3_6a_orphan_customers"](spark, folder).first()[0]
    assert lost == 3


def test_derived_sales_columns(spark):
    lines = [
        line(1, 1, "2000-01-31", amount=10.0, quantity=3.0),
        line(1, 2, "2000-02-01", amount=0.05, quantity=2.0),
        line(1, 3, "1999-12-31"),
        line(1, 4, None, quantity=0.0),
        line(2, 1),
    ]
    orders = [order(1), order(2, priority="odd")]
    silver = gold.with_derived(gold.order_lines(*lake(spark, lines, orders)))
    rows = {r.order_number.rsplit("-", 1)[0]: r for r in gold.fact_sales(silver).collect()}
    status = {n: (r.days_to_ship, r.days_to_due, r.delivery_status) for n, r in rows.items()}
    assert status == {
        "1-1": (30, 30, "On Time"),
        "1-2": (31, 30, "Late"),
        "1-3": (None, 30, "Unknown"),
        "1-4": (None, 30, "Unknown"),
        "2-1": (4, None, "Late"),
    }
    assert rows["1-1"].price == Decimal("3.33")
    assert rows["1-2"].price == Decimal("0.03")
    assert rows["1-4"].price is None
    assert (rows["1-1"].order_year, rows["1-1"].order_month, rows["1-1"].order_month_name) == (2000, 1, "January")


def test_returns(spark):
    lines = [line(1, 1, amount=0.05, discount=0.1), line(1, 2, flag="A"), line(1, 3, flag=None)]
    silver = gold.with_derived(gold.order_lines(*lake(spark, lines, [order(1)])))
    (row,) = gold.fact_returns(silver).collect()
    assert (row.return_id, row.return_reason) == (f"R-{row.order_number}", "2-HIGH")
    assert row.order_number.startswith("1-1-")
    # 0.045 lies on the half cent.
    assert row.return_amount == Decimal("0.05")
    assert (row.return_year, row.return_month) == (2000, 1)


def test_star_is_built_once_and_refreshed_on_request(spark):
    star = gold.lake_star(spark, LAKE)
    assert gold.lake_star(spark, LAKE) is star
    assert set(star.gold) == set(KEYS)
    again = gold.lake_star(spark, LAKE, refresh=True)
    assert again is not star
    assert again.rows("fact_sales") == star.rows("fact_sales")


def test_keys_grouped_by_are_unique(spark):
    star = gold.lake_star(spark, LAKE)
    for name in star.grouped_by_key:
        df = star.gold[name]
        assert df.select(KEYS[name]).distinct().count() == df.count() == star.rows(name)


@pytest.mark.parametrize("partitions", [4, 12, 200, 1000])
def test_buckets_fit_the_shuffle_partitions(spark, partitions):
    cores = spark.sparkContext.defaultParallelism
    gigabyte = gold.BUCKET_BYTES
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    with settings(spark, spark__sql__shuffle__partitions=str(partitions)):
        for size in (0, 10**6, 7 * gigabyte, partitions * gigabyte, 99 * partitions * gigabyte):
            buckets = gold.bucket_count(spark, size)
            assert partitions % buckets == 0 or buckets % partitions == 0
            assert buckets >= max(cores, size / gigabyte)
        assert most - partitions < gold.bucket_count(spark, 10**17) <= most


def test_more_buckets_than_partitions_make_one_file_each(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(gold, "bucket_count", lambda spark, size: 16)
    silver = gold.order_lines(*lake(spark, [line(o, 1) for o in range(200)], [order(o) for o in range(200)]))
    spark.sql(f"CREATE DATABASE wide LOCATION '{tmp_path}/wide'")
    gold.write_order_lines(spark, silver, f"{tmp_path}/wide", "wide", 0)
    files = spark.table("wide.order_lines").inputFiles()
    assert len(files) == 16 and spark.table("wide.order_lines").count() == 200


def test_table_bytes(spark):
    assert table_bytes(spark, LAKE, "lineitem") > 10_000


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named
    assert sorted(r.id for r in cut_lineage(spark.range(3)).collect()) == [0, 1, 2]


def test_a_local_session_without_the_setting_gets_one_folder():
    class Context:
        master, applicationId, folder = "local[2]", "local-test", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    folder = shared_folder(Session())
    assert shared_folder(Session()) == folder == Session.sparkContext.folder


def test_no_folder_on_a_cluster_is_refused():
    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_csv_extract(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text("id,name,since\n1,Ann,2023-01-05\n2,,\n")
    rows = read_csv(spark, str(path), "id int, name string, since date").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "Ann"), (2, None)]
    path.write_text("id,name,since\nx,Ann,2023-01-05\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_csv(spark, str(path), "id int, name string, since date").collect()
