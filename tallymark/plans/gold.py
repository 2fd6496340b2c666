"""From staged orders and events to dimensions and facts. Each model is a function of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.functions.text import amount, discounted
from tallymark.operators.events import keep_latest
from tallymark.sources.store import one_a_key


def known(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(C.UNKNOWN))


def dedup_orders(staged: DataFrame) -> DataFrame:
    """stg_orders: one row for each raw_id, the last landed."""
    return keep_latest(staged, "raw_id", F.desc("received_at"), F.desc("id"))


def dedup_events(staged: DataFrame) -> DataFrame:
    """stg_quality_events: one row for each event id."""
    return keep_latest(staged, "id", F.desc("event_at"))


def with_amounts(items: DataFrame) -> DataFrame:
    """gross, net and cost of each item; null wherever an input is null."""
    gross = amount(F.col("quantity"), F.col("unit_price"))
    return items.withColumns({"gross_amount": gross, "net_amount": discounted(gross, F.col("discount_pct")), "cost_amount": amount(F.col("quantity"), F.col("cost_price"))})


def order_items(orders: DataFrame) -> DataFrame:
    """int_order_items: orders' ``items`` (array of VARIANT), one row each; what cannot be read as a number is null."""
    df = orders.select("raw_id", "order_id", "order_date", F.posexplode("items").alias("item_index", "_i"))
    texts = lambda fields: ",".join(f"{f}:string" for f in fields)
    df = df.withColumn("_t", F.try_variant_get("_i", "$", f"struct<{texts(C.ITEM_FIELDS)},product:struct<{texts(C.PRODUCT_FIELDS)}>>"))  # an item is read once

    def scalar(f: str) -> Column:
        """The text of a field; of an object or a list none. Their texts open with a bracket, so only such are looked at again."""
        text, nested = F.col(f"_t.product.{f}"), F.schema_of_variant(F.try_variant_get("_i", f"$.product.{f}", "variant")).rlike("^(OBJECT|ARRAY)")
        return F.when(text.startswith("{") | text.startswith("["), F.when(~nested, text)).otherwise(text).alias(f)

    product = [scalar(f) for f in C.PRODUCT_FIELDS]
    number = [F.col(f"_t.{f}").try_cast("bigint" if f == "quantity" else "decimal(38,9)").alias(f) for f in C.ITEM_FIELDS]
    df = df.select("raw_id", "order_id", "order_date", "item_index", F.format_string("%d-%d", "raw_id", "item_index").alias("int_order_item_key"), *product, *number)
    return with_amounts(df)


def fct_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    own = orders.select("raw_id", "customer_id")
    df = items.join(one_a_key(own), "raw_id", "left")
    return df.select(
        F.format_string("%s-%03d", "order_id", "item_index").alias("order_item_key"), "order_id", "item_index", "order_date",
        known("product_id").alias("product_id"), known("customer_id").alias("customer_id"),
        "quantity", "unit_price", "cost_price", "discount_pct", "shipping_fee", "gross_amount", "net_amount", "cost_amount", "raw_id",
    )


def item_rollup(items: DataFrame, key: str = "order_id") -> DataFrame:
    """Counts, one canary for each chain of nulls, and sums that are never filled in."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("item_count"),
        missing("net_amount").alias("items_missing_amount"),
        missing("cost_amount").alias("items_missing_cost"),
        missing("shipping_fee").alias("items_missing_shipping"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("gross_amount").alias("gross_amount"),
        F.sum("net_amount").alias("net_amount"),
        F.sum("cost_amount").alias("cost_amount"),
        F.sum("shipping_fee").alias("shipping_amount"),
    )


COUNTERS = ("item_count", "items_missing_amount", "items_missing_cost", "items_missing_shipping")


def with_rollup(orders: DataFrame, items: DataFrame, key: str = "order_id") -> DataFrame:
    """orders with their items' rollup; an order without items stays, with counts of zero and null sums."""
    df = orders.join(one_a_key(item_rollup(items, key)), key, "left")
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in COUNTERS})


def fct_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    df = with_rollup(orders.drop("items"), items)
    return df.withColumn("customer_id", known("customer_id")).withColumnRenamed("membership_tier", "membership_tier_at_order")


def dim_customer(orders: DataFrame) -> DataFrame:
    fields = ["customer_id", "customer_name", "age", "gender", "membership_tier", "registration_date", "acquisition_channel", "newsletter_subscribed", "preferred_payment_method", "preferred_device"]
    df = orders.where("customer_id is not null")
    return with_unknown(keep_latest(df, "customer_id", F.desc_nulls_last("order_date"), F.desc("received_at"), F.desc("raw_id")).select(*fields), "customer_id")


def dim_product(items: DataFrame, orders: DataFrame) -> DataFrame:
    """The last attributes of each product; the order is total (receipt and raw_id break ties of a day)."""
    df = items.where("product_id is not null").join(orders.select("raw_id", "received_at"), "raw_id", "left")
    last = keep_latest(df, "product_id", F.desc_nulls_last("order_date"), F.desc("item_index"), F.desc("received_at"), F.desc("raw_id"))
    return with_unknown(last.select(*C.PRODUCT_FIELDS), "product_id")


def with_unknown(dim: DataFrame, key: str) -> DataFrame:
    """dim and its unknown member, whose attributes are all null."""
    one = dim.sparkSession.range(1).select(*[(F.lit(C.UNKNOWN) if c == key else F.lit(None)).cast(t).alias(c) for c, t in dim.dtypes])
    return dim.unionByName(one)
