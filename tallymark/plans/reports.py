"""Reports of fixed grain: additive numerators and denominators, never ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.operators.rules import codes
from tallymark.plans.gold import known


def sales_daily_by_category(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """By day, category and whether the order was returned (null: not known). Both joins keep all items; products is a
    dimension and Spark broadcasts it only while its size allows. An order has one customer, as its items say."""
    df = items.join(products.select("product_id", "category"), "product_id", "left").join(orders.select("order_id", F.col("returned").alias("is_returned")), "order_id", "left")
    missing = lambda c: F.count_if(F.col(c).isNull())
    day = ["order_date", known("category").alias("category"), "is_returned"]
    grain = ["order_date", "category", "is_returned"]
    sums = ("quantity", "gross_amount", "net_amount", "cost_amount", "shipping_fee")
    # orders and customers are counted by grouping, not by distinct sets; each aggregate is merged in tasks before its shuffle,
    # and the first one is dealt by order, so that a customer with very many orders (the unknown one) is no task's burden
    by_order = df.select(*day, "customer_id", "order_id", *sums).groupBy(*grain, "customer_id", "order_id").agg(
        F.count(F.lit(1)).alias("items"), *[F.sum(c).alias(c) for c in sums], missing("net_amount").alias("no_net"), missing("cost_amount").alias("no_cost"), missing("shipping_fee").alias("no_fee")
    )
    counted = ("items", *sums, "no_net", "no_cost", "no_fee")
    by_customer = by_order.groupBy(*grain, "customer_id").agg(F.count("order_id").alias("orders"), *[F.sum(c).alias(c) for c in counted])
    out = {"items": "items", "quantity": "total_quantity", "shipping_fee": "shipping_amount", "no_net": "items_missing_amount", "no_cost": "items_missing_cost", "no_fee": "items_missing_shipping"}
    return by_customer.groupBy(*grain).agg(F.sum("orders").alias("orders"), F.count("customer_id").alias("customers"), *[F.sum(c).alias(out.get(c, c)) for c in counted])


def quality_events_daily(events: DataFrame) -> DataFrame:
    """By day of the event and rule version; moves are counted by the state they lead to."""
    to, first = F.col("to_state"), F.col("event_type") == "initial_evaluation"
    return events.groupBy(F.to_date("event_at").alias("event_date"), "rule_version").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(first).alias("initial_evaluations"),
        F.count_if(first & (to == C.CLEAN)).alias("initial_clean"),
        F.count_if(first & (to == C.QUARANTINED)).alias("initial_quarantined"),
        F.count_if(to == C.PROMOTED).alias("promotions"),
        F.count_if(to == C.RE_QUARANTINED).alias("re_quarantinations"),
        F.count_if(to == C.REJECTED).alias("rejections"),
    )


def quality_backlog(quarantine: DataFrame) -> DataFrame:
    """By day, rule version, state and code: orders that have the code, and orders whose first code (alphabetically) it
    is. An order without codes counts under the unknown code; an order with a code twice counts once."""
    df = quarantine.withColumn("_codes", F.array_distinct(codes(F.col("clean_error_message"))))
    df = df.withColumn("_first", F.array_min("_codes")).withColumn("_code", F.explode_outer("_codes"))
    df = df.select(F.to_date("quarantined_at").alias("quarantined_date"), F.col("dq_rule_version").alias("rule_version"), F.col("effective_quality_state").alias("state"), known("_code").alias("code"), "raw_id", F.col("_code").eqNullSafe(F.col("_first")).alias("_primary"))
    grain = ["quarantined_date", "rule_version", "state", "code"]
    # an order once for each code, then a count: no distinct sets, and the groups of a frequent code are spread
    once = df.groupBy(*grain, "raw_id").agg(F.max("_primary").alias("_primary"))
    has_id = F.col("raw_id").isNotNull()
    return once.groupBy(*grain).agg(F.count_if(has_id).alias("orders_with_code"), F.count_if(F.col("_primary") & has_id).alias("orders_primary_code"))


def error_rate(df: DataFrame, flag: str, latest_by: str | None = None) -> DataFrame:
    """One row: rows, errors, rate (null for no rows); of the latest day by ``latest_by`` alone, if given."""
    if latest_by:
        df = df.join(df.agg(F.max(F.to_date(latest_by)).alias("_day")), F.to_date(latest_by) == F.col("_day"))  # one row
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(flag)).alias("errors")).withColumn("rate", F.try_divide(F.col("errors").cast("double"), F.col("rows").cast("double")))


def gate(df: DataFrame, flag: str, threshold: float = C.GATE_THRESHOLD, latest_by: str | None = None) -> DataFrame:
    """The row of ``error_rate`` if the rate is at or above the threshold, else none (so an empty table passes)."""
    return error_rate(df, flag, latest_by).where(F.col("rate") >= threshold)


def code_histogram(df: DataFrame, message: str = "clean_error_message") -> DataFrame:
    return df.select(F.explode(codes(F.col(message))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("findings"))
