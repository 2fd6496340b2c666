"""Seeded synthetic orders, all by hashing an id: the same rows on any cluster, at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.sources.store import stored


def draw(seed: int, name: str, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the seed, a name and the ids."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *ids), F.lit(1 << 30)) / F.lit(float(1 << 30))


def pick(u: Column, weighted: dict[str, float]) -> Column:
    total, at, out = sum(weighted.values()), 0.0, None
    for value, w in weighted.items():
        at += w / total
        out = F.when(u < at, value) if out is None else out.when(u < at, value)
    return out.otherwise(list(weighted)[-1])


CATEGORIES = {"Electronics": 5, "Home": 4, "Fashion": 4, "Books": 2, "Toys": 1}


def orders(spark: SparkSession, n: int, seed: int = 1, dirty: float = 0.1, missing_cost: float = 0.05, start: str = "2024-01-01", days: int = 30, customers: int = 400, products: int = 300) -> DataFrame:
    """(id, received_at, raw_payload): n orders as JSON. A share ``dirty`` breaks one rule, a quarter of these two."""
    i = F.col("id")
    u = lambda name, *more: draw(seed, name, i, *more)
    df = spark.range(n)
    for k in (1, 2):
        code = pick(u(f"code{k}"), {C.QUANTITY_NON_POSITIVE: 5, C.UNIT_PRICE_NEGATIVE: 4, C.DISCOUNT_PCT_OUT_OF_RANGE: 4, C.TAX_PCT_OUT_OF_RANGE: 3, C.DELIVERY_BEFORE_ORDER: 3, C.CUSTOMER_RATING_OUT_OF_RANGE: 2, C.AGE_OUT_OF_RANGE: 2, C.FIELD_TOO_LONG: 1, C.ORDER_DATE_IN_FUTURE: 1, C.NON_FINITE_NUMBER: 1})
        df = df.withColumn(f"bad{k}", F.when(u("dirty") < dirty * (1 if k == 1 else 0.25), code))
    bad = lambda c: F.coalesce((F.col("bad1") == c) | (F.col("bad2") == c), F.lit(False))
    day = F.date_add(F.lit(start).cast("date"), F.floor(u("day") * days).cast("int"))
    cust = F.floor(u("customer") * customers).cast("string")

    def item(k: Column) -> Column:
        p = F.floor(u("product", k) * products).cast("bigint")
        of = lambda name: draw(seed, name, p)  # noqa: E731  a product's attributes depend on it alone
        price = F.round(of("price") * 400 + 5, 2)
        first = k == 0
        keep = lambda name, x: F.when(u(name, k) >= missing_cost, x)
        return F.struct(
            F.struct(F.concat(F.lit("P"), p.cast("string")).alias("product_id"), F.concat(F.lit("Product "), p.cast("string")).alias("product_name"), pick(of("category"), CATEGORIES).alias("category"), pick(of("sub"), {"A": 1, "B": 1}).alias("sub_category"), pick(of("brand"), {"North": 1, "South": 1}).alias("brand"), pick(of("condition"), {"new": 9, "used": 1}).alias("condition")).alias("product"),
            F.when(first & bad(C.QUANTITY_NON_POSITIVE), 0).otherwise(1 + F.floor(u("quantity", k) * 5)).cast("bigint").alias("quantity"),
            F.when(first & bad(C.UNIT_PRICE_NEGATIVE), -price).otherwise(price).alias("unit_price"),
            keep("cost", F.round(price * 0.6, 2)).alias("cost_price"),
            F.when(first & bad(C.DISCOUNT_PCT_OUT_OF_RANGE), 150.0).otherwise(F.floor(u("discount", k) * 30).cast("double")).alias("discount_pct"),
            keep("shipping", F.when(first & bad(C.NON_FINITE_NUMBER), -987654321.0).otherwise(F.round(u("fee", k) * 20, 2))).alias("shipping_fee"),
        )

    some = lambda name, x: F.when(u(f"has_{name}") >= missing_cost, x)  # noqa: E731  optional fields are left out at times
    payload = F.struct(
        F.format_string("O%d", i).alias("order_id"),
        F.when(bad(C.ORDER_DATE_IN_FUTURE), F.date_add(day, 400)).otherwise(day).cast("string").alias("order_date"),
        some("ship_mode", pick(u("ship"), {"Standard": 3, " EXPRESS ": 1})).alias("ship_mode"),
        some("order_status", pick(u("status"), {"Delivered": 8, "N/A": 1})).alias("order_status"),
        F.date_add(day, F.when(bad(C.DELIVERY_BEFORE_ORDER), -2).otherwise(F.floor(u("delivery") * 7)).cast("int")).cast("string").alias("delivery_date"),
        F.when(u("known") < 0.95, u("returned") < 0.12).alias("returned"),
        F.struct(F.when(u("anonymous") >= 0.03, F.concat(F.lit("C"), cust)).alias("customer_id"), F.when(bad(C.FIELD_TOO_LONG), F.repeat(F.lit("x"), 200)).otherwise(F.concat(F.lit("Customer "), cust)).alias("customer_name"), F.when(bad(C.AGE_OUT_OF_RANGE), 200).otherwise(18 + F.floor(u("age") * 60)).cast("bigint").alias("age")).alias("customer"),
        F.struct(F.lit("Earth").alias("country"), some("city", pick(u("city"), {"Aville": 2, "Btown": 1})).alias("city")).alias("address"),
        F.transform(F.sequence(F.lit(0), F.floor(u("items") * 4).cast("int")), item).alias("items"),
        F.struct(some("payment_method", pick(u("pay"), {"Card": 3, "cash": 1})).alias("payment_method"), F.when(bad(C.TAX_PCT_OUT_OF_RANGE), 120.0).otherwise(F.floor(u("tax") * 20).cast("double")).alias("tax_pct")).alias("payment"),
        F.struct(F.when(bad(C.CUSTOMER_RATING_OUT_OF_RANGE), 9.0).otherwise(1 + F.floor(u("rating") * 5)).cast("double").alias("customer_rating")).alias("behavior"),
    )
    text = F.regexp_replace(F.to_json(payload), r"-9\.87654321E8|-987654321\.0", "NaN")
    received = day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(u("second") * 86_400))
    return df.select(i, received.alias("received_at"), text.alias("raw_payload"))


def resent(raw: DataFrame, share: float = 0.1, seed: int = 1) -> DataFrame:
    """raw and, after it, a share of its records once more: half of them word for word, half altered under the same order
    id. What lands twice must count once, and the first must win."""
    again = raw.where(draw(seed, "resent", F.col("id")) < share)
    altered = F.regexp_replace("raw_payload", r"^\{", '{"ship_mode":"again",')
    later = F.col("received_at") + F.make_dt_interval(F.lit(0), F.lit(1))
    again = again.select((-1 - F.col("id")).alias("id"), later.alias("received_at"), F.when(draw(seed, "altered", F.col("id")) < 0.5, altered).otherwise(F.col("raw_payload")).alias("raw_payload"))
    return raw.unionByName(again)


def land(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (id, received_at, raw_payload) to landed orders and their initial events: the batch form of the worker."""
    from tallymark.operators import events, ingest, rules

    read = ingest.drift(ingest.flatten(ingest.parse(raw), keep_schema=True)).withColumnRenamed("id", "raw_id")
    judged = rules.evaluate(rules.normalise(read), F.col("received_at")).drop("raw_payload", "v")
    # Spark moves no filter below the number of the task: one on what was read from the JSON would read all of it once more
    good = judged.withColumn("_task", F.spark_partition_id()).where("status = 'processed' and _task >= 0").drop("_task")
    ods = events.first_write(good, "order_id", ["received_at", "raw_id"]).where("status = 'processed'")
    ods = ods.withColumn("id", F.col("raw_id")).drop("status", "error_message")
    ods = stored(ods, "landed-orders")
    return ods, events.initial_events(ods)
