"""The operators applied to the driver's tables, each with the SQL that says the same.

Adapters shape the tables into the order domain; they are the same views in both engines. Money is decimal throughout
and leaves a query as double.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tallymark import contracts as C
from tallymark.functions import text as X
from tallymark.operators import distributions as D
from tallymark.operators import events as E
from tallymark.operators import ingest, retries, rules, staging
from tallymark.plans import checks as K
from tallymark.plans import gold as G
from tallymark.plans import reevaluation as V
from tallymark.plans import reports as R
from tallymark.sources import contract, generator
from tallymark.sources.days_source import DayTables
from tallymark.sources.manifest import Manifest
from tallymark.sources.store import one_a_key, shuffles_dropped, stage_root, stored
from tallymark.streaming import orders as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = dt.datetime(2024, 1, 28, 12, 0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            views, recursive = VIEWS.strip(), sql.startswith(", RECURSIVE")
            rest = sql.replace(", RECURSIVE", ",", 1)
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{views}{rest}" if rest.startswith(",") else f"WITH {views} {rest}"
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- adapters -------------------------------------------------------------------------------------------------------

VIEWS = """
items AS (
  SELECT l_orderkey AS raw_id, CAST(l_orderkey AS VARCHAR) AS order_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS item_index,
    CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS product_id, CAST(l_shipdate AS DATE) AS order_date,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
    CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS cost_price,
    CAST(l_discount AS DECIMAL(4,2)) * 100 AS discount_pct, CASE WHEN l_linenumber <> 7 THEN CAST(l_tax AS DECIMAL(4,2)) END AS shipping_fee,
    l_returnflag, l_shipdate
  FROM lineitem),
amounts AS (
  SELECT *, CAST(quantity AS DECIMAL(9,0)) * unit_price AS gross_amount,
    CAST(quantity AS DECIMAL(9,0)) * unit_price * (100 - CAST(discount_pct AS DECIMAL(7,4))) * CAST(0.01 AS DECIMAL(3,2)) AS net_amount,
    CAST(quantity AS DECIMAL(9,0)) * cost_price AS cost_amount
  FROM items),
ord AS (
  SELECT o_orderkey AS raw_id, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_orderdate AS received_at,
    CASE WHEN o_custkey % 40 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS returned, o_orderstatus, o_orderpriority, o_totalprice,
    o_orderpriority = '1-URGENT' AS has_clean_error
  FROM orders),
ev AS (
  SELECT event_id AS id, user_id AS raw_id, ts AS event_at,
    CASE event_type WHEN 'view' THEN 'initial_evaluation' WHEN 'signup' THEN 'initial_evaluation' WHEN 'purchase' THEN 're_evaluation' WHEN 'error' THEN 're_quarantination' ELSE 'manual_rejection' END AS event_type,
    CASE event_type WHEN 'view' THEN 'clean' WHEN 'signup' THEN 'quarantined' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 're_quarantined' ELSE 'permanently_rejected' END AS to_state,
    CASE WHEN event_id % 3 = 0 THEN 'v3' ELSE 'v4' END AS rule_version
  FROM events),
latest AS (SELECT raw_id, to_state, event_at FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY event_at DESC, id DESC) AS n FROM ev) WHERE n = 1),
states AS (
  SELECT o.*, l.event_at AS quality_state_at, coalesce(NOT has_clean_error OR l.to_state = 'promoted', FALSE) AS fine,
    CASE WHEN NOT has_clean_error THEN 'clean' WHEN l.to_state = 'promoted' THEN 'promoted' WHEN l.to_state = 'permanently_rejected' THEN 'permanently_rejected' ELSE 'quarantined' END AS effective_quality_state
  FROM ord o LEFT JOIN latest l ON o.raw_id = l.raw_id),
flagged AS (
  SELECT *, CASE WHEN quantity > 45 THEN 1 ELSE 0 END AS bad_quantity, CASE WHEN discount_pct >= 9 THEN 1 ELSE 0 END AS bad_discount, CASE WHEN shipping_fee >= 0.07 THEN 1 ELSE 0 END AS bad_fee
  FROM items)
"""


def items(spark, d):
    every = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    nth = (F.row_number().over(Window.partitionBy("raw_id").orderBy(*every)) - 1).cast("bigint")
    # numbered by raw_id before anything is derived: the one shuffle moves columns of the table, and serves what joins or groups by raw_id
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "raw_id").withColumn("item_index", nth).select(
        "raw_id",
        F.col("raw_id").cast("string").alias("order_id"),
        "item_index",
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey").cast("string")).alias("product_id"),
        F.to_date("l_shipdate").alias("order_date"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        price.alias("unit_price"),
        F.when(F.col("l_suppkey") % 10 != 0, price).alias("cost_price"),
        (F.col("l_discount").cast("decimal(4,2)") * 100).alias("discount_pct"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax").cast("decimal(4,2)")).alias("shipping_fee"),
        "l_returnflag",
        "l_shipdate",
    )


def amounts(spark, d):
    return G.with_amounts(items(spark, d))


def orders(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("raw_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderdate").alias("received_at"),
        F.when(F.col("o_custkey") % 40 != 0, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(status == "F", True).when(status == "O", False).alias("returned"),
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        (F.col("o_orderpriority") == "1-URGENT").alias("has_clean_error"),
    )


def quality_events(spark, d):
    t = F.col("event_type")
    kind = F.when(t.isin("view", "signup"), "initial_evaluation").when(t == "purchase", "re_evaluation").when(t == "error", "re_quarantination").otherwise("manual_rejection")
    to = F.when(t == "view", C.CLEAN).when(t == "signup", C.QUARANTINED).when(t == "purchase", C.PROMOTED).when(t == "error", C.RE_QUARANTINED).otherwise(C.REJECTED)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("raw_id"), F.col("ts").alias("event_at"), kind.alias("event_type"), to.alias("to_state"), F.when(F.col("event_id") % 3 == 0, "v3").otherwise("v4").alias("rule_version"))


def states(spark, d):
    return E.with_effective_state(orders(spark, d), quality_events(spark, d))


def flagged(spark, d):
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return items(spark, d).withColumns({"bad_quantity": flag(F.col("quantity") > 45), "bad_discount": flag(F.col("discount_pct") >= 9), "bad_fee": flag(F.col("shipping_fee") >= 0.07)})


def money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


MONEY = ("gross_amount", "net_amount", "cost_amount", "shipping_amount")
ROLLUP_SQL = """count(*) AS item_count, count(*) FILTER (net_amount IS NULL) AS items_missing_amount, count(*) FILTER (cost_amount IS NULL) AS items_missing_cost,
  count(*) FILTER (shipping_fee IS NULL) AS items_missing_shipping, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(gross_amount) AS DOUBLE) AS gross_amount,
  CAST(sum(net_amount) AS DOUBLE) AS net_amount, CAST(sum(cost_amount) AS DOUBLE) AS cost_amount, CAST(sum(shipping_fee) AS DOUBLE) AS shipping_amount"""


# --- aggregates and joins -------------------------------------------------------------------------------------------


@query("""SELECT a.order_date, coalesce(p.p_type, '__UNKNOWN__') AS category, o.returned AS is_returned, count(DISTINCT a.order_id) AS orders, count(DISTINCT coalesce(o.customer_id, '__UNKNOWN__')) AS customers,
  count(*) AS items, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(gross_amount) AS DOUBLE) AS gross_amount, CAST(sum(net_amount) AS DOUBLE) AS net_amount, CAST(sum(cost_amount) AS DOUBLE) AS cost_amount,
  CAST(sum(shipping_fee) AS DOUBLE) AS shipping_amount, count(*) FILTER (net_amount IS NULL) AS items_missing_amount, count(*) FILTER (cost_amount IS NULL) AS items_missing_cost, count(*) FILTER (shipping_fee IS NULL) AS items_missing_shipping
  FROM amounts a LEFT JOIN part p ON a.product_id = CAST(p.p_partkey AS VARCHAR) LEFT JOIN ord o ON a.raw_id = o.raw_id GROUP BY 1, 2, 3""")
def sales_daily_by_category(spark, d):
    o = orders(spark, d)
    df = amounts(spark, d).join(o.select("raw_id", G.known("customer_id").alias("customer_id")), "raw_id", "left")
    df = df.withColumn("customer_id", G.known("customer_id"))
    products = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_type").alias("category"))
    return money(R.sales_daily_by_category(df, products, o), *MONEY)


@query(f"""SELECT o.order_id, o.order_date, coalesce(o.customer_id, '__UNKNOWN__') AS customer_id, coalesce(item_count, 0) AS item_count, coalesce(items_missing_amount, 0) AS items_missing_amount,
  coalesce(items_missing_cost, 0) AS items_missing_cost, coalesce(items_missing_shipping, 0) AS items_missing_shipping, total_quantity, gross_amount, net_amount, cost_amount, shipping_amount
  FROM ord o LEFT JOIN (SELECT order_id, {ROLLUP_SQL} FROM amounts GROUP BY 1) r ON o.order_id = r.order_id""")
def order_rollup(spark, d):
    df = G.with_rollup(orders(spark, d), amounts(spark, d)).withColumn("customer_id", G.known("customer_id"))
    return money(df.select("order_id", "order_date", "customer_id", *G.COUNTERS, "total_quantity", *MONEY), *MONEY)


@query("""SELECT printf('%s-%03d', a.order_id, a.item_index) AS order_item_key, a.order_id, a.item_index, coalesce(a.product_id, '__UNKNOWN__') AS product_id, coalesce(o.customer_id, '__UNKNOWN__') AS customer_id,
  quantity, CAST(gross_amount AS DOUBLE) AS gross_amount, CAST(net_amount AS DOUBLE) AS net_amount, CAST(cost_amount AS DOUBLE) AS cost_amount, CAST(shipping_fee AS DOUBLE) AS shipping_fee
  FROM amounts a LEFT JOIN ord o ON a.raw_id = o.raw_id""")
def order_items_enriched(spark, d):
    df = G.fct_order_items(amounts(spark, d), orders(spark, d))
    keep = ["order_item_key", "order_id", "item_index", "product_id", "customer_id", "quantity", "gross_amount", "net_amount", "cost_amount", "shipping_fee"]
    return money(df.select(*keep), "gross_amount", "net_amount", "cost_amount", "shipping_fee")


@query("""SELECT customer_id, order_date, o_orderpriority, c_name, c_mktsegment FROM (SELECT o.*, c.c_name, c.c_mktsegment, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC NULLS LAST, received_at DESC, o.raw_id DESC) AS n
  FROM ord o LEFT JOIN customer c ON o.customer_id = CAST(c.c_custkey AS VARCHAR) WHERE customer_id IS NOT NULL) WHERE n = 1
  UNION ALL SELECT '__UNKNOWN__', NULL, NULL, NULL, NULL""")
def dim_customer_latest(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_name", "c_mktsegment")
    last = E.keep_latest(orders(spark, d).where("customer_id is not null"), "customer_id", F.desc_nulls_last("order_date"), F.desc("received_at"), F.desc("raw_id"))
    return G.with_unknown(last.join(names, "customer_id", "left").select("customer_id", "order_date", "o_orderpriority", "c_name", "c_mktsegment"), "customer_id")


@query("""SELECT product_id, order_date, item_index, raw_id, p_name, p_brand FROM (SELECT a.*, p.p_name, p.p_brand, row_number() OVER (PARTITION BY product_id ORDER BY order_date DESC NULLS LAST, item_index DESC, a.raw_id DESC) AS n
  FROM items a LEFT JOIN part p ON a.product_id = CAST(p.p_partkey AS VARCHAR) WHERE product_id IS NOT NULL) WHERE n = 1 UNION ALL SELECT '__UNKNOWN__', NULL, NULL, NULL, NULL, NULL""")
def dim_product_latest(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_name", "p_brand")
    last = E.keep_latest(items(spark, d).where("product_id is not null"), "product_id", F.desc_nulls_last("order_date"), F.desc("item_index"), F.desc("raw_id"))
    return G.with_unknown(last.join(names, "product_id", "left").select("product_id", "order_date", "item_index", "raw_id", "p_name", "p_brand"), "product_id")


@query("SELECT raw_id, to_state, event_at FROM latest")
def latest_event_per_order(spark, d):
    return E.latest_event(quality_events(spark, d)).select("raw_id", "to_state", "event_at")


@query("SELECT raw_id, order_id, effective_quality_state, quality_state_at FROM states WHERE fine")
def effective_state_clean(spark, d):
    return E.clean_side(states(spark, d)).select("raw_id", "order_id", "effective_quality_state", "quality_state_at")


@query("SELECT raw_id, order_id, effective_quality_state, coalesce(quality_state_at, received_at) AS quarantined_at FROM states WHERE NOT fine")
def effective_state_quarantine(spark, d):
    return E.quarantine_side(states(spark, d)).select("raw_id", "order_id", "effective_quality_state", "quarantined_at")


@query("""SELECT raw_id, CASE WHEN fine THEN 2 END AS appearances FROM states WHERE (fine AND raw_id % 10 = 0) OR (NOT fine AND raw_id % 9 = 0)""")
def split_is_partition(spark, d):
    """The test of the split on sides that were tampered with: a tenth of the clean orders twice, some quarantined ones lost."""
    s = states(spark, d)
    clean, other = E.clean_side(s).select("raw_id"), E.quarantine_side(s).select("raw_id")
    return K.split_is_partition(orders(spark, d), clean.unionAll(clean.where("raw_id % 10 = 0")), other.where("raw_id % 9 <> 0"))


@query("""SELECT CAST(event_at AS DATE) AS event_date, rule_version, count(*) AS events, count(*) FILTER (event_type = 'initial_evaluation') AS initial_evaluations,
  count(*) FILTER (event_type = 'initial_evaluation' AND to_state = 'clean') AS initial_clean, count(*) FILTER (event_type = 'initial_evaluation' AND to_state = 'quarantined') AS initial_quarantined,
  count(*) FILTER (to_state = 'promoted') AS promotions, count(*) FILTER (to_state = 're_quarantined') AS re_quarantinations, count(*) FILTER (to_state = 'permanently_rejected') AS rejections FROM ev GROUP BY 1, 2""")
def events_daily(spark, d):
    return R.quality_events_daily(quality_events(spark, d))


CODES_SQL = "list_concat(CASE WHEN bad_quantity = 1 THEN ['quantity'] ELSE [] END, list_concat(CASE WHEN bad_discount = 1 THEN ['discount', 'discount'] ELSE [] END, CASE WHEN bad_fee = 1 THEN ['fee'] ELSE [] END))"


def backlog_rows(spark, d):
    found = lambda flag, code, n=1: F.when(F.col(flag) == 1, F.array(*[F.named_struct(F.lit("code"), F.lit(code))] * n)).otherwise(F.array().cast("array<struct<code:string>>"))
    message = F.concat(found("bad_quantity", "quantity"), found("bad_discount", "discount", 2), found("bad_fee", "fee"))
    return flagged(spark, d).select(F.concat_ws("-", "order_id", "item_index").alias("raw_id"), F.col("l_shipdate").alias("quarantined_at"), F.lit("v4").alias("dq_rule_version"), F.lit(C.QUARANTINED).alias("effective_quality_state"), message.alias("clean_error_message"))


@query(f"""SELECT quarantined_date, 'v4' AS rule_version, 'quarantined' AS state, coalesce(code, '__UNKNOWN__') AS code, count(DISTINCT k) AS orders_with_code, count(DISTINCT CASE WHEN code IS NOT DISTINCT FROM least_code THEN k END) AS orders_primary_code
  FROM (SELECT k, quarantined_date, list_min(codes) AS least_code, unnest(CASE WHEN len(codes) = 0 THEN [NULL] ELSE codes END) AS code
    FROM (SELECT order_id || '-' || item_index AS k, order_date AS quarantined_date, list_distinct({CODES_SQL}) AS codes FROM flagged)) GROUP BY 1, 2, 3, 4""")
def backlog_by_code(spark, d):
    return R.quality_backlog(backlog_rows(spark, d))


@query(f"SELECT unnest({CODES_SQL}) AS code, count(*) AS findings FROM flagged GROUP BY 1")
def code_histogram(spark, d):
    return R.code_histogram(backlog_rows(spark, d))


@query("""SELECT count(*) AS rows, count(*) FILTER (bad_quantity = 1 OR bad_fee = 1) AS errors, count(*) FILTER (bad_quantity = 1 OR bad_fee = 1) / CAST(count(*) AS DOUBLE) AS rate
  FROM flagged WHERE order_date = (SELECT max(order_date) FROM flagged) HAVING count(*) FILTER (bad_quantity = 1 OR bad_fee = 1) / CAST(count(*) AS DOUBLE) >= 0.15""")
def hard_gate_latest_day(spark, d):
    return R.gate(flagged(spark, d).withColumn("bad", (F.col("bad_quantity") == 1) | (F.col("bad_fee") == 1)), "bad", C.GATE_THRESHOLD, "l_shipdate")


@query("SELECT count(*) AS rows, count(*) FILTER (bad_quantity = 1) AS errors, count(*) FILTER (bad_quantity = 1) / CAST(count(*) AS DOUBLE) AS rate FROM flagged")
def monitor_rate(spark, d):
    return R.error_rate(flagged(spark, d).withColumn("bad", F.col("bad_quantity") == 1), "bad")


# --- rules ----------------------------------------------------------------------------------------------------------


@query("""SELECT order_id, item_index, CASE WHEN q <= 0 THEN ['quantity_non_positive'] ELSE [] END || CASE WHEN p < 0 THEN ['unit_price_negative'] ELSE [] END || CASE WHEN NOT (dd BETWEEN 0 AND 100) THEN ['discount_pct_out_of_range'] ELSE [] END AS codes
  FROM (SELECT order_id, item_index, CAST(quantity - 3 AS DOUBLE) AS q, CAST(unit_price AS DOUBLE) - 2000 AS p, CAST(discount_pct AS DOUBLE) * 12 AS dd FROM items)""".replace("SELECT order_id, item_index, CASE", "SELECT order_id, item_index, list_aggregate(CASE", 1).replace("END AS codes", "END, 'string_agg', ',') AS codes"))
def rule_flags_items(spark, d):
    number = {"quantity": F.col("quantity").cast("double") - 3, "unit_price": F.col("unit_price").cast("double") - 2000, "discount_pct": F.col("discount_pct").cast("double") * 12}
    found = rules.item_findings(lambda f: number.get(f, F.lit(None).cast("double")), F.col("item_index"))
    return items(spark, d).select("order_id", "item_index", F.nullif(F.array_join(rules.codes(found), ","), F.lit("")).alias("codes"))


@query("""SELECT order_id, nullif(concat_ws(',', CASE WHEN NOT (tax BETWEEN 0 AND 100) THEN 'tax_pct_out_of_range' END, CASE WHEN delivered < order_date THEN 'delivery_before_order' END, CASE WHEN order_date > DATE '1997-06-01' + 1 THEN 'order_date_in_future' END,
  CASE WHEN NOT (rating BETWEEN 1 AND 5) THEN 'customer_rating_out_of_range' END, CASE WHEN NOT (age BETWEEN 0 AND 130) THEN 'age_out_of_range' END), '') AS codes
  FROM (SELECT order_id, order_date, o_totalprice / 2000 AS tax, order_date + CAST(raw_id % 9 AS INTEGER) - 4 AS delivered, CAST(raw_id % 7 AS DOUBLE) AS rating, CAST(customer_id AS BIGINT) % 140 AS age FROM ord)""")
def rule_flags_orders(spark, d):
    df = orders(spark, d).select(
        "order_id", "order_date", (F.col("o_totalprice") / 2000).alias("tax_pct"), F.date_add("order_date", (F.col("raw_id") % 9 - 4).cast("int")).alias("delivery_date"),
        (F.col("raw_id") % 7).cast("double").alias("customer_rating"), (F.col("customer_id").cast("bigint") % 140).alias("age"), F.lit("a").alias("customer_name"), F.lit("b").alias("city"),
    )
    found = F.array_compact(F.array(*rules.order_findings(F.lit(dt.date(1997, 6, 1)))))
    return df.select("order_id", F.nullif(F.array_join(rules.codes(found), ","), F.lit("")).alias("codes"))


@query("""SELECT doc_id, lower(trim(lang || '  ')) AS lang, CASE WHEN lower(source) IN ('src1', 'src2', '', 'n/a') THEN NULL ELSE source END AS source, length(text) > 150 AS long, length(replace(text, ' ', '')) AS n_solid
  FROM documents""")
def string_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", X.strip_lower(F.concat("lang", F.lit(" \t　"))).alias("lang"), X.null_sentinels(F.col("source"), ("src1", "src2", "", "n/a")).alias("source"), X.too_long(F.col("text"), 150).alias("long"), F.char_length(F.translate("text", " ", "")).cast("bigint").alias("n_solid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events")
def json_props(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), (ingest.kind(F.try_variant_get(v, "$.k", "variant")) == "integer").alias("has_k"))


# --- windows, incremental, reconciliation ---------------------------------------------------------------------------


def copies(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return e.unionByName(e.where("event_id % 4 = 0").withColumn("ts", F.expr("ts + interval 1 hour")))


COPIES_SQL = "copies AS (SELECT event_id, user_id, ts, event_type, value FROM events UNION ALL SELECT event_id, user_id, ts + INTERVAL 1 HOUR, event_type, value FROM events WHERE event_id % 4 = 0)"


@query(f", {COPIES_SQL} SELECT event_id, user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) AS n FROM copies) WHERE n = 1")
def dedup_latest_copy(spark, d):
    return E.keep_latest(copies(spark, d), "event_id", F.desc("ts")).select("event_id", "user_id", "ts", "event_type")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN n = 1 AND known IS NULL THEN 'processed' ELSE 'duplicate' END AS status
  FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) a LEFT JOIN (SELECT c_custkey AS known FROM customer WHERE c_nationkey = 3) k ON a.o_custkey = k.known""")
def first_write_wins(spark, d):
    known = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return E.first_write(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], known)


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def lookback_window(spark, d):
    return table(spark, d, "events").where(staging.lookback(F.col("ts"), F.lit(AS_OF.isoformat(" ")).cast("timestamp_ntz"))).select("event_id", "user_id", "ts")


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def backfill_range(spark, d):
    return table(spark, d, "events").where(staging.day_range(F.col("ts"), dt.date(2024, 1, 10), dt.date(2024, 1, 12))).select("event_id", "user_id", "ts")


@query(f""", {COPIES_SQL}, a AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS left_keys FROM copies GROUP BY 1),
  b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS right_rows FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) AS n FROM copies) WHERE n = 1 GROUP BY 1)
  SELECT coalesce(a.day, b.day) AS day, left_keys, right_rows FROM a FULL JOIN b ON a.day = b.day WHERE left_keys IS DISTINCT FROM right_rows""")
def recon_per_day(spark, d):
    c = copies(spark, d)
    return staging.reconcile(c, E.keep_latest(c, "event_id", F.desc("ts")), "ts", "event_id")


@query("SELECT order_id FROM ord EXCEPT SELECT order_id FROM items")
def complete_projection(spark, d):
    return K.complete_projection(orders(spark, d), items(spark, d))


@query("SELECT product_id, count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT discount_pct) AS discount_pct FROM items WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT discount_pct) > 1")
def attr_stability(spark, d):
    return K.attributes_stable(items(spark, d), "product_id", ("l_returnflag", "discount_pct"))


@query("""SELECT 'orders.customer' AS link, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'events.order', count(*) FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def fk_orphans(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "part", "events")}
    links = {"orders.customer": K.foreign_key(t["orders"], "o_custkey", t["customer"], "c_custkey"), "lineitem.part": K.foreign_key(t["lineitem"], "l_partkey", t["part"], "p_partkey"), "lineitem.order": K.foreign_key(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), "events.order": K.foreign_key(t["events"], "user_id", t["orders"].where("o_orderstatus = 'F'"), "o_orderkey")}
    out = [df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("link"), "orphans") for name, df in links.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query("""SELECT s.raw_id, s.order_id, CASE WHEN pass THEN 're_evaluation' ELSE 're_quarantination' END AS event_type, l.to_state AS from_state, CASE WHEN pass THEN 'promoted' ELSE 're_quarantined' END AS to_state
  FROM (SELECT *, raw_id % 3 <> 0 AS pass FROM states WHERE has_clean_error AND effective_quality_state <> 'permanently_rejected') s LEFT JOIN latest l ON s.raw_id = l.raw_id
  WHERE l.to_state IS DISTINCT FROM 'permanently_rejected' AND raw_id_ok(s.raw_id) AND ((pass AND s.raw_id % 11 <> 0 AND l.to_state IS DISTINCT FROM 'promoted') OR (NOT (pass AND s.raw_id % 11 <> 0) AND l.to_state = 'promoted'))""".replace("raw_id_ok(s.raw_id) AND ", "").replace("CASE WHEN pass THEN", "CASE WHEN pass AND s.raw_id % 11 <> 0 THEN"))
def reeval_plan(spark, d):
    s = states(spark, d)
    message = F.array(F.named_struct(F.lit("code"), F.when(F.col("raw_id") % 11 == 0, C.NON_FINITE_NUMBER).otherwise(C.AGE_OUT_OF_RANGE)))
    s = s.withColumn("clean_error_message", message).withColumn("new_codes", F.when(F.col("raw_id") % 3 == 0, F.array(F.lit(C.AGE_OUT_OF_RANGE))))
    return E.plan_events(E.candidates(s), F.lit(AS_OF.isoformat(" ")).cast("timestamp_ntz")).select("raw_id", "order_id", "event_type", "from_state", "to_state")


@query("SELECT raw_id, order_id, effective_quality_state FROM states WHERE has_clean_error AND effective_quality_state <> 'permanently_rejected' ORDER BY raw_id LIMIT 100")
def candidates_topn(spark, d):
    return E.candidates(states(spark, d), 100).select("raw_id", "order_id", "effective_quality_state")


@query("SELECT e.raw_id, e.event_at, date_diff('microsecond', o.received_at, e.event_at) AS off_microseconds FROM ord o JOIN ev e ON o.raw_id = e.raw_id AND e.event_type = 'initial_evaluation' WHERE o.received_at <> e.event_at")
def initial_event_drift(spark, d):
    o = orders(spark, d)
    return K.initial_event_time(o, quality_events(spark, d)).select("raw_id", "event_at", "off_microseconds")


@query("SELECT count(*) AS pending, count(*) FILTER (age > 900) AS stuck, max(age) AS oldest_seconds FROM (SELECT date_diff('second', ts, TIMESTAMP '2024-01-28 12:00:00') AS age FROM events WHERE event_type = 'view')")
def queue_health(spark, d):
    raw = table(spark, d, "events").select(F.col("ts").alias("received_at"), F.when(F.col("event_type") == "view", "pending").otherwise("processed").alias("status"))
    return staging.queue_health(raw, F.lit(AS_OF.isoformat(" ")).cast("timestamp_ntz").cast("timestamp"))


@query("SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS requests, count(*) - 1 AS refused FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit_windows(spark, d):
    return S.over_limit(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 1)


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY 1")
def latency_quantiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.percentile("value", F.lit(p)).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max("value").alias("most"))


@query("""SELECT last_at, age_hours, CASE WHEN age_hours IS NULL OR age_hours > 50 THEN 'error' WHEN age_hours > 26 THEN 'warn' ELSE 'pass' END AS state FROM (SELECT max(ts) AS last_at, date_diff('second', max(ts), TIMESTAMP '2024-02-01 12:00:00') / 3600.0 AS age_hours
  FROM events WHERE ts >= TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 30 DAY)""".replace("3600.0", "CAST(3600 AS DOUBLE)"))
def freshness(spark, d):
    return staging.freshness(table(spark, d, "events"), "ts", F.lit("2024-02-01 12:00:00").cast("timestamp_ntz").cast("timestamp"))


@query("SELECT event_type, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM events GROUP BY 1")
def landing_ratio(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"))


# --- documents as JSON ----------------------------------------------------------------------------------------------


_WRITTEN: dict[tuple[str, str], str] = {}


def write_payloads(spark, d):
    """Stores ``payloads`` in the shared folder; this session's queries read them from there."""
    path = _new(spark, "payloads")
    payloads(spark, d).write.parquet(path)
    _WRITTEN[spark.sparkContext.applicationId, d] = path


def payloads(spark, d):
    """Orders and their items as nested JSON, some with a field too many, a wrong kind or a group that is no object."""
    if (path := _WRITTEN.get((spark.sparkContext.applicationId, d))) is not None:
        return spark.read.parquet(path)
    each = items(spark, d).groupBy("raw_id").agg(F.sort_array(F.collect_list(F.struct("item_index", F.struct(F.struct("product_id").alias("product"), "quantity", F.col("unit_price").cast("double").alias("unit_price")).alias("i")))).alias("items"))
    o = orders(spark, d).join(one_a_key(each), "raw_id", "left")
    k = F.col("raw_id")
    return o.select(
        k.alias("id"),
        "received_at",
        F.to_json(
            F.struct(
                "order_id", F.col("order_date").cast("string").alias("order_date"), "returned",
                F.struct("customer_id", F.when(k % 13 == 0, F.lit("41")).alias("age"), F.when(k % 17 == 0, F.lit("x")).alias("nickname")).alias("customer"),
                F.when(k % 19 == 0, F.lit("none")).alias("payment"), F.transform("items", lambda x: x["i"]).alias("items"),
            )
        ).alias("raw_payload"),
    )


@query("SELECT raw_id AS id, order_id, order_date, returned, customer_id, CASE WHEN raw_id % 13 = 0 THEN CAST(41 AS BIGINT) END AS age, CAST(NULL AS DOUBLE) AS tax_pct, (SELECT count(*) FROM items i WHERE i.raw_id = o.raw_id) AS n_items, 'processed' AS status FROM ord o")
def payload_flatten(spark, d):
    flat = ingest.flatten(ingest.parse(payloads(spark, d)))
    return flat.select("id", "order_id", "order_date", "returned", "customer_id", "age", "tax_pct", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), "status")


@query("""SELECT raw_id AS id, nullif(concat_ws(',', CASE WHEN raw_id % 13 = 0 THEN 'type_drift:customer.age' END, CASE WHEN raw_id % 17 = 0 THEN 'unexpected_field:customer.nickname' END, CASE WHEN raw_id % 19 = 0 THEN 'non_object_group:payment' END), '') AS found FROM ord""")
def payload_drift(spark, d):
    df = ingest.drift(ingest.parse(payloads(spark, d)))
    found = F.array_join(F.transform("schema_drift_message", lambda e: F.concat_ws(":", e["code"], e["field"])), ",")
    return df.select("id", F.nullif(found, F.lit("")).alias("found"))


def order_documents(spark, d):
    """Every order of the table and its items as JSON, some of which the rules find fault with."""
    i = items(spark, d)
    each = F.struct("item_index", F.struct(F.struct("product_id").alias("product"), "quantity", *[F.col(c).cast("double").alias(c) for c in ("unit_price", "cost_price", "discount_pct", "shipping_fee")]).alias("i"))
    o = orders(spark, d).join(one_a_key(i.groupBy("raw_id").agg(F.sort_array(F.collect_list(each)).alias("items"))), "raw_id", "left")
    k = F.col("raw_id")
    tax = F.when(k % 7 == 0, 120.0).otherwise(F.when(k % 2 == 0, 5.0))
    return o.select(
        k.alias("id"),
        F.col("received_at").cast("timestamp").alias("received_at"),
        F.to_json(
            F.struct(
                "order_id", F.col("order_date").cast("string").alias("order_date"), "returned",
                F.struct("customer_id", F.when(k % 23 == 0, 200).alias("age")).alias("customer"), F.struct(tax.alias("tax_pct")).alias("payment"), F.transform("items", lambda x: x["i"]).alias("items"),
            )
        ).alias("raw_payload"),
    )


@query(f"""SELECT CASE WHEN o.raw_id % 7 = 0 OR o.raw_id % 23 = 0 THEN 'quarantined' ELSE 'clean' END AS effective_quality_state, count(*) AS orders, CAST(sum(coalesce(item_count, 0)) AS BIGINT) AS items,
  CAST(sum(gross_amount) AS DOUBLE) AS gross_amount, CAST(sum(net_amount) AS DOUBLE) AS net_amount FROM ord o LEFT JOIN (SELECT raw_id, count(*) AS item_count, sum(gross_amount) AS gross_amount, sum(net_amount) AS net_amount FROM amounts GROUP BY 1) r ON o.raw_id = r.raw_id GROUP BY 1""")
def gold_from_generated(spark, d):
    """All orders as documents through landing, states and facts: orders, items and sums by state."""
    ods, log = generator.land(order_documents(spark, d))
    staged = G.dedup_orders(ods)
    s = E.with_effective_state(staged.drop("items"), G.dedup_events(log))
    rolled = G.with_rollup(s, G.order_items(staged))  # items of every state: the join with the log is not needed for them
    return money(rolled.groupBy("effective_quality_state").agg(F.count(F.lit(1)).alias("orders"), F.sum("item_count").alias("items"), F.sum("gross_amount").alias("gross_amount"), F.sum("net_amount").alias("net_amount")), "gross_amount", "net_amount")


@query("""SELECT 'processed' AS status, count(*) AS records, count(*) FILTER (raw_id % 7 = 0 OR raw_id % 23 = 0) AS dirty FROM ord UNION ALL SELECT 'duplicate', count(*) FILTER (raw_id % 5 = 0) + count(*) FILTER (raw_id % 9 = 0), 0 FROM ord
  UNION ALL SELECT 'error', count(*) FILTER (raw_id % 11 = 0) + count(*) FILTER (raw_id % 33 = 0), 0 FROM ord""")
def stream_ingest(spark, d):
    """All orders as documents landed by a stream in several batches, a ninth of them as two equal lines of one file, a fifth
    of them again later, some broken, a third of these as two equal lines: statuses, all tables as of one version."""
    root = f"{stage_root(spark)}/stream-{dt.datetime.now().timestamp():.6f}"
    docs = order_documents(spark, d).select("id", "raw_payload")
    twice = lambda df, n: df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("id") % n == 0, 2).otherwise(1)))).drop("_n")
    again = docs.where("id % 5 = 0").withColumn("raw_payload", F.regexp_replace("raw_payload", "^.", '{"ship_mode":"again",'))
    broken = docs.where("id % 11 = 0").withColumn("raw_payload", F.concat(F.lit("{"), F.substring("raw_payload", 1, 40)))
    for part in (twice(docs, 9), again.unionByName(twice(broken, 33))):
        with shuffles_dropped(spark):
            part.select(F.col("raw_payload").alias("value")).write.mode("append").option("compression", "gzip").text(f"{root}/in")
        S.land_stream(S.documents_in(spark, f"{root}/in", maxFilesPerTrigger="100", cleanSource="delete"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    at = Manifest(spark, f"{root}/out").version()
    status, ods = S.landed(spark, f"{root}/out", "status", at), S.landed(spark, f"{root}/out", "orders", at).select("raw_id", "has_clean_error")
    return status.join(one_a_key(ods), "raw_id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.count_if("has_clean_error").alias("dirty"))


@query("""SELECT CAST(v AS BIGINT) AS version, (SELECT count(*) FROM events WHERE event_id % 4 <= v) AS events, (SELECT count(DISTINCT user_id) FROM events WHERE event_id % 4 = v) AS users, CASE WHEN v = 3 THEN 2 ELSE 1 END AS attempts FROM (SELECT unnest(range(0, 4)) AS v)""")
def joint_commits(spark, d):
    """All events in four commits of two tables, each with the users of its own events in place of those before; at the third
    another writer commits first, so that one is made anew. Both tables as of each version."""
    m, e = Manifest(spark, f"{stage_root(spark)}/joint-{dt.datetime.now().timestamp():.6f}"), table(spark, d, "events")

    def part(n: int, v) -> dict:
        some = e.where(F.col("event_id") % 4 == n)
        return {"add": {"events": m.write("events", some), "users": m.write("users", some.select("user_id").distinct())}, "remove": {"users": v.folders.get("users", [])}, "batch": n}

    raced = []

    def work(v) -> dict:
        n = v.number + 1
        if n == 2 and not raced:
            raced.append(m.transact(lambda v: part(n, v) | {"writer": "other"}))
        return part(n, v) | {"writer": "one"}

    while m.version().number < 3:
        m.transact(work, wait=0.05)
    seen = [(m.table("events", m.version(h["version"])), m.table("users", m.version(h["version"])), h) for h in m.history()]
    one = lambda ev, us, h: ev.agg(F.count(F.lit(1)).alias("events")).crossJoin(us.agg(F.count(F.lit(1)).alias("users"))).select(F.lit(h["version"]).cast("bigint").alias("version"), "events", "users", F.lit(h["attempts"]).alias("attempts"))  # noqa: E731  # one row each
    return reduce(DataFrame.unionByName, [one(*x) for x in seen])


@query("""SELECT CASE WHEN raw_id % 10 = 0 THEN 'dead' WHEN a <= fails THEN CASE WHEN a = 3 THEN 'dead' ELSE 'retry' END ELSE 'done' END AS outcome, CASE WHEN raw_id % 10 = 0 THEN 'DataError' WHEN a <= fails THEN 'OperationalError' END AS error_class, CAST(a AS INTEGER) AS attempt, count(*) AS records
  FROM (SELECT raw_id, unnest([1, 2, 3]) AS a, CASE WHEN raw_id % 10 = 0 THEN 0 WHEN raw_id % 4 = 1 THEN raw_id % 5 ELSE 0 END AS fails FROM ord) WHERE a = 1 OR a <= fails + 1 GROUP BY 1, 2, 3""")
def dead_letters(spark, d):
    """All orders worked on, some of which fail for good, some for so many attempts: how each attempt ended, by class."""
    m, k = Manifest(spark, f"{stage_root(spark)}/work-{dt.datetime.now().timestamp():.6f}"), F.col("raw_id")

    def work(df: DataFrame) -> DataFrame:
        passing = (k % 4 == 1) & (F.col("attempt") <= k % 5)
        return df.withColumn("failure", F.coalesce(retries.failed(k % 10 == 0, "DataError", "does not fit", False), retries.failed(passing, "OperationalError", "gone away", True)))

    now = dt.datetime(2024, 1, 28)
    retries.run_once(m, orders(spark, d).select("raw_id", "order_id"), work, F.lit(now), "raw_id", batch=0)
    while (due := retries.next_due(m)) is not None:
        retries.run_once(m, None, work, F.lit(due), "raw_id")
    return retries.attempts_by_class(m)


@query("""SELECT day, offered, landed, CASE WHEN offered IS NULL OR landed IS NULL THEN 'unknown' WHEN landed > offered THEN 'over' WHEN landed < offered * 0.8 THEN 'short' ELSE 'pass' END AS verdict FROM (SELECT CAST(ts AS DATE) AS day,
  CASE WHEN day(ts) <> 5 THEN count(*) END AS offered, CASE WHEN day(ts) <> 7 THEN CAST(count(*) FILTER (day(ts) % 3 <> 0 OR event_type <> 'error') + CASE WHEN day(ts) = 8 THEN count(*) ELSE 0 END AS BIGINT) END AS landed FROM events GROUP BY CAST(ts AS DATE), day(ts))""")
def landing_by_day(spark, d):
    """Offered and landed events of each day: on some days one type is lost, on one everything lands twice, of some a number is not known."""
    day = F.dayofmonth("ts")
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    count = lambda df: df.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    landed = e.where((day % 3 != 0) | (F.col("event_type") != "error"))
    landed = landed.unionByName(e.where(day == 8))
    return staging.landing_gate(count(e.where(day != 5)), count(landed.where(day != 7)), "day", 0.8)


@query("""SELECT event_type, le, total, n FROM (SELECT event_type, le, count(*) FILTER (value > coalesce(low, -1e300) AND value <= coalesce(le, 1e300)) AS n, count(value) AS total
  FROM events, (SELECT le, lag(le) OVER (ORDER BY le NULLS LAST) AS low FROM (SELECT CAST(unnest([1, 5, 10, 50, 100, 500, NULL]) AS DOUBLE) AS le)) GROUP BY event_type, le, low)""")
def value_histogram(spark, d):
    """Values by type in fixed buckets: histograms of days, added up."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = D.histogram(e, ["event_type", "day"], "value", (1, 5, 10, 50, 100, 500))
    return D.merged_histograms(days, ["event_type"])


@query("SELECT event_type, count(value) AS n, TRUE AS p50_holds, TRUE AS p95_holds, TRUE AS p99_holds FROM events GROUP BY 1")
def value_sketches(spark, d):
    """Quantiles by type from sketches of days, merged; each is within two hundredths of its rank among all values."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = D.quantiles(D.merged_sketches(D.sketches(e, ["event_type", "day"], "value"), ["event_type"]), **at)
    near = lambda n, p: ((F.count_if(F.col("value") < F.col(n)) / F.count("value") <= p + 0.02) & (F.count_if(F.col("value") <= F.col(n)) / F.count("value") >= p - 0.02)).alias(f"{n}_holds")
    return e.join(F.broadcast(found), "event_type").groupBy("event_type", "n").agg(*[near(n, p) for n, p in at.items()])  # a row a type


@query("""SELECT raw_id, order_id, CASE WHEN raw_id % 7 = 0 THEN 're_quarantination' ELSE 're_evaluation' END AS event_type, CASE WHEN raw_id % 3 = 0 THEN 'promoted' ELSE 'quarantined' END AS from_state,
  CASE WHEN raw_id % 7 = 0 THEN 're_quarantined' ELSE 'promoted' END AS to_state, CASE WHEN raw_id % 7 = 0 THEN 'tax_pct_out_of_range' END AS reason
  FROM ord WHERE (raw_id % 7 = 0 AND raw_id % 3 = 0) OR (raw_id % 7 <> 0 AND raw_id % 23 = 0 AND raw_id % 3 <> 0)""")
def reevaluate_orders(spark, d):
    """All orders judged, a third of the dirty ones promoted by hand, the rule on age relaxed, the rules run again; the log
    is written and read back, and a second run finds nothing to add."""
    ods, log = generator.land(order_documents(spark, d))
    by_hand = log.where("to_state = 'quarantined' and raw_id % 3 = 0").withColumns({"id": -F.col("id"), "to_state": F.lit(C.PROMOTED), "event_at": F.expr("event_at + interval 1 day")})
    path = f"{stage_root(spark)}/log-{dt.datetime.now().timestamp():.6f}"
    keep = ["id", "raw_id", "order_id", "event_type", "from_state", "to_state", "rule_version", "event_at", "reason"]
    log.select(*keep).unionByName(by_hand.select(*keep)).write.parquet(path)
    for day in (30, 31):
        V.reevaluate(ods, spark.read.parquet(path), path, F.lit(dt.datetime(2030, 1, day)), dry_run=False, expect_version=C.RULE_VERSION, age_high=250)
    done = spark.read.parquet(path).where("event_at >= '2030-01-01'")
    return done.select("raw_id", "order_id", "event_type", "from_state", "to_state", F.nullif(F.array_join(rules.codes(F.col("reason")), ","), F.lit("")).alias("reason"))


@query("""SELECT raw_id AS id, CASE WHEN raw_id % 17 = 0 THEN 'customer.nickname' END AS field, CASE WHEN raw_id % 17 = 0 THEN '"x"' END AS value FROM ord WHERE raw_id % 17 = 0""")
def payload_unmapped(spark, d):
    """Fields that the contract lacks, with their values."""
    df = ingest.drift(ingest.parse(payloads(spark, d)))
    # with ``inline`` Spark infers a filter on the list below it, for which every document is written, parsed and looked through twice
    return df.select("id", F.inline_outer("unmapped_fields")).where("field is not null")


BREAKER_SQL = """, RECURSIVE c AS (SELECT event_type AS service, ts, value > 20 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, value > 20) AS n FROM events),
  r AS (SELECT DISTINCT service, CAST(0 AS BIGINT) AS n, 0 AS bad, CAST(NULL AS TIMESTAMP) AS opened, '' AS state FROM c UNION ALL
    SELECT service, n, CASE WHEN state = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL WHEN opened IS NOT NULL OR bad >= 2 THEN ts END, state
    FROM (SELECT c.service, c.n, c.ts, c.ok, r.bad, r.opened, CASE WHEN r.opened IS NULL THEN 'closed' WHEN c.ts - r.opened < INTERVAL 30 MINUTE THEN 'open' ELSE 'half_open' END AS state FROM r JOIN c ON c.service = r.service AND c.n = r.n + 1))
  SELECT service, state, count(*) AS calls FROM r WHERE n > 0 GROUP BY 1, 2"""


@query(BREAKER_SQL)
def breaker_calls(spark, d):
    """Calls by service and the breaker's answer, with a wait of half an hour."""
    calls = table(spark, d, "events").select(F.col("event_type").alias("service"), "ts", (F.col("value") > 20).alias("ok"))
    return S.breaker_states(calls, seconds=1800.0, width=86_400.0).groupBy("service", "state").agg(F.count(F.lit(1)).alias("calls"))


@query("SELECT raw_id, order_id, order_date, customer_id FROM ord WHERE raw_id IN (7, 77, 777, 12345)")
def order_lookup(spark, d):
    return staging.lookup(orders(spark, d), "raw_id", 7, 77, 777, 12345).select("raw_id", "order_id", "order_date", "customer_id")


@query("SELECT e.event_id AS id, e.event_type FROM events e WHERE e.event_type = 'error' OR e.event_id % 50 = 0")
def replay_selected(spark, d):
    """Records to process again, by status and by id."""
    e = table(spark, d, "events")
    status = e.select(F.col("event_id").alias("raw_id"), F.col("event_type").alias("status"))
    return S.replay(e.select(F.col("event_id").alias("id"), "event_type"), status, e.where("event_id % 50 = 0").select(F.col("event_id").alias("id")), ["error"]).select("id", "event_type")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def incremental_days(spark, d):
    """Staged by day, the last four days written again: other days survive and nothing doubles."""
    path = f"{stage_root(spark)}/days-{dt.datetime.now().timestamp():.6f}"
    e = table(spark, d, "events")
    staging.overwrite_days(e, path, "ts", ["user_id"])
    staging.overwrite_days(e.where(staging.lookback(F.col("ts"), F.lit(AS_OF.isoformat(" ")).cast("timestamp_ntz"))), path, "ts", ["user_id"])
    return staging.read_days(spark, path, dt.date(2000, 1, 1), dt.date(2100, 1, 1)).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def _new(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2")
def fused_days(spark, d):
    """All events stored by day, a week of them read through the source that refuses to read without days."""
    path = _new(spark, "fused")
    staging.overwrite_days(table(spark, d, "events").select("event_id", "ts", "event_type"), path, "ts", ["event_id"])
    spark.dataSource.register(DayTables)
    push, before = "spark.sql.python.filterPushdown.enabled", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set(push, "true")
    try:
        week = spark.read.format(DayTables.name()).schema("event_id bigint, ts timestamp_ntz, event_type string, day date").load(path).where("day >= date'2024-01-05' and day < date'2024-01-12'")
        return stored(week.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n")), "fused-days")
    finally:
        spark.conf.set(push, before)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END) AS with_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def contract_days(spark, d):
    """Events stored by a declared schema; half-way a column is added: old and new days are one table."""
    path, e = _new(spark, "declared"), table(spark, d, "events")
    for columns, some in ((["event_id", "user_id", "ts"], e.where("ts < '2024-01-15'")), (["event_id", "user_id", "ts", "value"], e.where("ts >= '2024-01-15'"))):
        contract.declare(spark, path, e.select(*columns).schema)
        staging.append_days(contract.conform(some.select(*columns), contract.declared(spark, path)), path, "ts", ["user_id"])
    whole = StructType([*contract.declared(spark, path), StructField("day", DateType())])
    days = staging.read_days(spark, path, dt.date(2000, 1, 1), dt.date(2100, 1, 1), schema=whole)
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_orderkey AS id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey IN (7, 77, 777, 12345) OR o_custkey IN (11, 13)")
def stored_lookup(spark, d):
    """Orders stored by year, clustered by their id, with Bloom filters of their customers: looked up by either."""
    path = _new(spark, "lookup")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("at"), F.trunc("o_orderdate", "year").alias("year"))
    staging.overwrite_all(o, path, "year", ["id"], look_up={"customer": 10_000})
    t = spark.read.parquet(path)
    return staging.lookup(t, "id", 7, 77, 777, 12345).union(staging.lookup(t, "customer", 11, 13)).distinct().select("id", "customer", F.to_date("at").alias("day"))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, count(*) AS n FROM events GROUP BY 1")
def compact_days(spark, d):
    """Days written as eight digits, some of which name no day."""
    text = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("20240230"), F.lit("2024-1-1"), F.lit(""), F.lit("2024010"))[(F.col("event_id") % 4).cast("int")]).otherwise(F.date_format("ts", "yyyyMMdd"))
    return table(spark, d, "events").groupBy(X.compact_day(text).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '"nan"' WHEN 1 THEN '"inf"' WHEN 2 THEN '"-inf"' WHEN 3 THEN NULL ELSE CAST(user_id AS VARCHAR) || '.0' END AS rendered FROM events""")
def rendered_numbers(spark, d):
    """Numbers as JSON, with those that are not finite as texts."""
    k = F.col("event_id") % 5
    number = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 4, F.col("user_id").cast("double"))
    return table(spark, d, "events").select("event_id", X.number_json(number).alias("rendered"))
