"""Normalisation and the quality rules, as column expressions: one narrow projection over all orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.functions.text import non_finite, null_sentinels, outside, strip, strip_lower, too_long
from tallymark.operators.ingest import at, kind_named, let, odd_number


def normalise(df: DataFrame) -> DataFrame:
    """Stripped and lowered texts, sentinels to null, delivery_days from the dates where both are known."""
    out = {c: null_sentinels(strip_lower(F.col(c))) for c in C.LOWERED} | {c: null_sentinels(strip(F.col(c))) for c in C.STRIPPED}
    out["delivery_days"] = F.coalesce(F.datediff("delivery_date", "order_date").cast("bigint"), F.col("delivery_days"))
    return df.withColumns({c: x for c, x in out.items() if c in df.columns})


def finding(code: str, field: str, value: Column, index: Column | None = None, order_date: Column | None = None, length: Column | None = None, most: int | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(field).alias("field"),
        value.cast("string").alias("value"),
        (none if index is None else index).cast("int").alias("index"),
        (none if order_date is None else order_date).cast("string").alias("order_date"),
        (none if length is None else length).cast("int").alias("length"),
        F.lit(most).cast("int").alias("max"),
    )


def _number(item: Column, index: Column, field: str) -> Column:
    """A JSON number (or a non-finite one, from ``odd``) as double; a number written as text is not looked at."""
    plain = let(at(item, f"$.{field}"), lambda x: F.when(kind_named(F.schema_of_variant(x)).isin("integer", "number"), F.try_variant_get(x, "$", "double")))
    return F.coalesce(odd_number(F.col("odd"), F.concat(F.lit("items["), index.cast("string"), F.lit(f"].{field}"))), plain)


def item_findings(number, index: Column | None) -> Column:
    """Findings of one item; ``number(field)`` gives its numbers as doubles."""
    out = [F.when(non_finite(number(f)), finding(C.NON_FINITE_NUMBER, f, number(f), index)) for f in C.ITEM_FIELDS]
    q, p, d = number("quantity"), number("unit_price"), number("discount_pct")
    sound = lambda x: ~non_finite(x)
    out.append(F.when(sound(q) & (q <= 0), finding(C.QUANTITY_NON_POSITIVE, "quantity", q, index)))
    out.append(F.when(sound(p) & (p < 0), finding(C.UNIT_PRICE_NEGATIVE, "unit_price", p, index)))
    out.append(F.when(sound(d) & outside(d, *C.PCT_RANGE), finding(C.DISCOUNT_PCT_OUT_OF_RANGE, "discount_pct", d, index)))
    return F.array_compact(F.array(*out))


def items_suspect() -> Column:
    """False where no item can have a finding: by the least and greatest of its numbers, which here include numbers written as text."""
    n = F.col("items").try_cast(f"array<struct<{','.join(f'{f}:double' for f in C.ITEM_FIELDS)}>>")
    least, most = (lambda f: F.array_min(n[f])), (lambda f: F.array_max(n[f]))  # NaN is the greatest
    bad = [F.col("odd").isNotNull(), least("quantity") <= 0, least("unit_price") < 0, least("discount_pct") < C.PCT_RANGE[0], most("discount_pct") > C.PCT_RANGE[1]]
    bad += [x for f in C.ITEM_FIELDS for x in (most(f) >= float("inf"), least(f) <= float("-inf"))]
    return F.coalesce(reduce(Column.__or__, bad), F.lit(False))


def order_findings(reference: Column, age_high: int = C.AGE_RANGE[1], name_most: int = C.SOFT_LENGTHS["customer_name"]) -> list[Column]:
    """Findings of the order's own fields, each null where the rule holds. ``reference``: the day it is judged on."""
    tax, rating, age, day, delivered = (F.col(c) for c in ("tax_pct", "customer_rating", "age", "order_date", "delivery_date"))
    out = [
        F.when(non_finite(tax), finding(C.NON_FINITE_NUMBER, "tax_pct", tax)).when(outside(tax, *C.PCT_RANGE), finding(C.TAX_PCT_OUT_OF_RANGE, "tax_pct", tax)),
        F.when(delivered < day, finding(C.DELIVERY_BEFORE_ORDER, "delivery_date", delivered, order_date=day)),
        F.when(day > F.date_add(reference, C.FUTURE_DAYS), finding(C.ORDER_DATE_IN_FUTURE, "order_date", day)),
        F.when(non_finite(rating), finding(C.NON_FINITE_NUMBER, "customer_rating", rating)).when(outside(rating, *C.RATING_RANGE), finding(C.CUSTOMER_RATING_OUT_OF_RANGE, "customer_rating", rating)),
        F.when(outside(age, C.AGE_RANGE[0], age_high), finding(C.AGE_OUT_OF_RANGE, "age", age)),
    ]
    for field, most in (C.SOFT_LENGTHS | {"customer_name": name_most}).items():
        out.append(F.when(too_long(F.col(field), most), finding(C.FIELD_TOO_LONG, field, F.lit(None), length=F.char_length(field), most=most)))
    return out


def evaluate(df: DataFrame, as_of: Column, **limits: int) -> DataFrame:
    """df with ``has_clean_error`` and ``clean_error_message`` (null if clean); non-finite numbers become null.
    ``as_of`` is the record's own receipt time, so that a later run comes to the same verdict. Non-finite numbers of items
    are null in ``items`` and found in ``odd``, which is dropped: what is stored holds none, and a later run, which cannot
    find them again, must not overturn the verdict on them."""
    if "odd" not in df.columns:
        df = df.withColumn("odd", F.lit(None).cast("map<string,string>"))
    numbers = lambda x, i: F.struct(*[_number(x, i, f).alias(f) for f in C.ITEM_FIELDS])  # noqa: E731  each read once
    each = F.when(items_suspect(), F.flatten(F.transform(F.transform("items", numbers), lambda n, i: item_findings(lambda f: n[f], i))))
    none = F.array().cast(f"array<{C.FINDING}>")
    all_of = F.concat(F.coalesce(each.cast(f"array<{C.FINDING}>"), none), F.array_compact(F.array(*order_findings(F.to_date(as_of), **limits))).cast(f"array<{C.FINDING}>"))
    df = df.withColumn("_found", all_of)
    keep = {c: F.when(~non_finite(F.col(c)), F.col(c)) for c in ("tax_pct", "customer_rating")}
    df = df.withColumns({"has_clean_error": F.size("_found") > 0, "clean_error_message": F.when(F.size("_found") > 0, F.col("_found")), **keep})
    return df.withColumn("dq_rule_version", F.lit(C.RULE_VERSION)).drop("_found", "odd")


def codes(message: Column) -> Column:
    """The codes of a message, in order; empty for null."""
    return F.coalesce(F.transform(message, lambda e: e["code"]), F.array().cast("array<string>"))
