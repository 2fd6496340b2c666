"""Text and number helpers: Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.contracts import SENTINELS

_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, _SPACE, "")


def strip_lower(c: Column) -> Column:
    return F.lower(strip(c))


def null_sentinels(c: Column, sentinels: Iterable[str] = SENTINELS) -> Column:
    """Null where the text only says that there is no value."""
    return F.when(strip_lower(c).isin(*sentinels), F.lit(None)).otherwise(c)


def drop_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\x00"), F.lit(""))  # by bytes: ``translate`` looks at each character


def too_long(c: Column, most: int) -> Column:
    return F.coalesce(F.char_length(c) > most, F.lit(False))


def outside(c: Column, low: float, high: float) -> Column:
    """False for null."""
    return F.coalesce(~c.between(low, high), F.lit(False))


def non_finite(c: Column) -> Column:
    """NaN or an infinity; false for null."""
    return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))


def compact_day(c: Column) -> Column:
    """The date that eight digits name (year, month, day); null for any other text."""
    return F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date"))


def number_json(c: Column) -> Column:
    """A number as JSON, which has no words for what is not finite: these become texts. Null stays null."""
    name = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.when(name.isNotNull(), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(c.cast("string"))


def key_pairs(c: Column) -> Column:
    """'k1:c1,k2:c2' -> map; malformed parts are left out, the last of equal keys counts."""
    parts = F.transform(F.split(c, ","), lambda p: F.split(p, ":", 2))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "") & (F.trim(F.get(p, F.lit(1))) != ""))
    entries = F.transform(good, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


# Money: quantity x price is exact at nine decimals, the discount at four; results have nine.
def amount(quantity: Column, price: Column) -> Column:
    """Null if either is, or on overflow."""
    return (quantity.try_cast("decimal(9,0)") * price.try_cast("decimal(20,9)")).try_cast("decimal(38,9)")


def discounted(gross: Column, pct: Column) -> Column:
    left = (F.lit(100).cast("decimal(3,0)") - pct.try_cast("decimal(7,4)")).cast("decimal(8,4)")
    whole = (gross.try_cast("decimal(29,9)") * left).try_cast("decimal(34,13)")
    return (whole * F.lit("0.01").cast("decimal(3,2)")).try_cast("decimal(38,9)")
