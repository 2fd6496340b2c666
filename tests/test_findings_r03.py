"""What the review of round 3 found, each in small."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallymark import bench_queries as B
from tallymark.operators import events as E
from tallymark.operators import staging
from tallymark.plans import gold as G
from tallymark.streaming import orders as S

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_order_do_not_go_through_the_driver(spark):
    orders = spark.range(50).select(F.col("id").alias("raw_id"), F.col("id").cast("string").alias("order_id"), (F.col("id") % 2 == 0).alias("has_clean_error"), F.col("id").cast("string").alias("customer_id"), F.current_date().alias("order_date"))
    log = spark.range(50).select("id", F.col("id").alias("raw_id"), F.lit("promoted").alias("to_state"), F.current_timestamp().alias("event_at"))
    assert "Broadcast" not in plan(E.with_effective_state(orders, log))
    item = orders.withColumns({c: F.lit(1) for c in ("item_index", "quantity", "unit_price", "cost_price", "discount_pct", "shipping_fee")}).withColumn("product_id", F.lit("p"))
    amounts = G.with_amounts(item)
    assert "Broadcast" not in plan(G.with_rollup(orders, amounts))
    assert "Broadcast" not in plan(G.fct_order_items(amounts.drop("customer_id"), orders))
    record = spark.range(50).select("id", F.lit("f").alias("file"), F.col("id").alias("row"), F.current_timestamp().alias("received_at"), F.col("id").cast("string").alias("order_id"), F.lit("processed").alias("status"), F.lit("").alias("error_message"), (F.col("id") % 2 == 0).alias("new"))
    judged = S.judge(record)
    assert "Broadcast" not in plan(judged)
    assert judged.count() == 25


@needs_data
def test_a_list_is_opened_without_reading_its_documents_twice(spark):
    assert plan(B.payload_unmapped(spark, DATA)).count("ArrowEvalPython") == 1


@needs_data
def test_items_are_shuffled_once(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        assert plan(B.order_items_enriched(spark, DATA)).count("Exchange hashpartitioning") == 2  # items, orders
    finally:
        spark.conf.set(threshold, before)


def test_bytes_of_a_row_are_those_that_a_sort_holds(spark):
    row = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "view", dt.date(2024, 1, 1))], "event_id bigint, ts timestamp_ntz, event_type string, day date")
    assert row.select(staging.row_bytes(row)).first()[0] >= 8 + 4 * 8 + 8 + 32
