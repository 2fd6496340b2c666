"""Raw order documents -> flat orders: parse, coerce, flatten, note contract drift.

A text is parsed once, to VARIANT. Its schema, one string, is held against the contract as one pattern: a document that
fits is read as one typed struct and has no drift by construction; only the others are read value by value, leniently.
Texts that strict JSON refuses (NaN, Infinity, repeated keys) but Python's reader accepts go through one vectorised
repair that only sees those rows; non-finite numbers become null there and are kept by path in ``odd``, a column of its
own, so nothing that a payload holds can pass for one. Nothing is rejected for its values: a record is an ``error`` only
if it is no object, has no order_id, or holds a value that cannot be read as its type.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallymark import contracts as C
from tallymark.functions.text import drop_nul

_NAMES = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


class _NonFinite:
    def __init__(self, name: str) -> None:
        self.name = name


def repair(text: str | None) -> tuple[str | None, str | None]:
    """(strict JSON, {path: number} of the numbers that strict JSON lacks) of a text; nulls if it is no JSON at all."""
    odd: dict[str, str] = {}

    def walk(x, path: str):
        if isinstance(x, _NonFinite):
            odd[path] = x.name
            return None
        if isinstance(x, float) and not math.isfinite(x):
            odd[path] = "Infinity" if x > 0 else "-Infinity"
            return None
        if isinstance(x, dict):
            return {k: walk(v, f"{path}.{k}" if path else k) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, f"{path}[{i}]") for i, v in enumerate(x)]
        return x

    if text is None:
        return None, None
    try:
        return json.dumps(walk(json.loads(text, parse_constant=_NonFinite), "")), json.dumps(odd) if odd else None
    except (ValueError, RecursionError):
        return None, None


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("odd", StringType())]))
def _repair(texts: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame(None, index=texts.index, columns=["text", "odd"], dtype=object)
    for i in texts.index[texts.notna()]:  # nearly always none
        found.loc[i] = repair(texts[i])
    return found


def parse(raw: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """raw with ``v``, the payload as VARIANT (null if it is no JSON at all), and ``odd``, its non-finite numbers by path
    (nearly always null)."""
    text = drop_nul(F.col(payload))
    df = raw.withColumn("_v", F.try_parse_json(text)).withColumn("_r", _repair(F.when(F.col("_v").isNull(), text)))
    return df.withColumns({"v": F.coalesce("_v", F.try_parse_json("_r.text")), "odd": F.from_json("_r.odd", "map<string,string>")}).drop("_v", "_r")


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def kind_named(s: Column) -> Column:
    """JSON kind by the schema of a VARIANT: boolean, integer, number, string, array, object or null."""
    return (
        F.when(s.isNull() | (s == "VOID"), "null")
        .when(s == "STRING", "string")
        .when(s == "BIGINT", "integer")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("DECIMAL") | s.startswith("DOUBLE") | s.startswith("FLOAT"), "number")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def kind(v: Column) -> Column:
    return let(F.schema_of_variant(v), kind_named)


def odd_number(odd: Column, path: str | Column) -> Column:
    """The non-finite number at the path, or null."""
    name = F.when(odd.isNotNull(), odd[path])
    return F.when(name == "NaN", _NAMES["NaN"]).when(name == "Infinity", _NAMES["Infinity"]).when(name == "-Infinity", _NAMES["-Infinity"])


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


_SHAPES = {"string": "STRING", "date": "STRING", "bigint": "BIGINT", "double": r"BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE", "boolean": "BOOLEAN"}


def _shape(fields: dict[str, str], **inner: str) -> str:
    """Pattern of the schema of an object whose fields, where present, are null or of their kind, and that has no other."""
    kinds = {n: _SHAPES[t] for n, t in fields.items()} | inner
    return "OBJECT<" + "".join(rf"(?:{n}: (?:VOID|{kinds[n]})(?:, |(?=>)))?" for n in sorted(kinds)) + ">"


def contract_shape() -> str:
    item = _shape(C.ITEM_FIELDS, product=_shape(C.PRODUCT_FIELDS))
    return "^" + _shape(C.ORDER_FIELDS, items=f"ARRAY<{item}>", **{g: _shape(f) for g, f in C.GROUPS.items()}) + "$"


def contract_struct() -> str:
    """The type that a fitting document is read as; dates stay texts."""
    ddl = lambda fields: ",".join(f"{n}:{'string' if t == 'date' else t}" for n, t in fields.items())
    return f"struct<{ddl(C.ORDER_FIELDS)},{','.join(f'{g}:struct<{ddl(f)}>' for g, f in C.GROUPS.items())},items:array<variant>>"


_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _read(x: Column, s: Column, to: str) -> Column:
    """A scalar (its schema is s) read leniently as its type, or null."""
    k, text = kind_named(s), F.try_variant_get(x, "$", "string")
    if to == "string":
        return F.when(k == "string", text)
    if to == "bigint":
        d = F.when(k.isin("integer", "number", "string"), text.try_cast("decimal(38,9)")).when(k == "boolean", text.try_cast("boolean").cast("int"))
        return F.when(d == F.floor(d), d.try_cast("bigint"))
    if to == "double":
        return F.when(k.isin("integer", "number", "string"), text.try_cast("double"))
    if to == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1", "yes", "on", "t", "y"), True).when(low.isin("false", "0", "no", "off", "f", "n"), False)
    return F.when((k == "string") & text.rlike(_DAY), text.try_cast("date"))


def flatten(parsed: DataFrame, keep_schema: bool = False) -> DataFrame:
    """parsed (with ``v`` and ``odd``) to flat columns, ``items`` (array of VARIANT), ``status`` and ``error_message``; if asked also
    ``_schema`` and ``_plain``, which spare ``drift`` a second look through every document."""
    v, fits, odd = F.col("v"), F.col("_fits"), F.col("odd")
    key = {name: path.removeprefix("$.") for name, (path, _) in C.FLAT.items()}
    # in steps, so that each value is taken from the document once and read once; what only a document that does not fit
    # needs is one array, so a row has few columns to copy from step to step
    place = {name: i for i, name in enumerate(("items", *C.FLAT))}
    parts = F.array(at(v, "$.items"), *[at(v, path) for path, _ in C.FLAT.values()])
    df = parsed.withColumn("_s", F.schema_of_variant(v)).withColumn("_fits", F.coalesce(F.col("_s").rlike(contract_shape()), F.lit(False)))
    df = df.select("*", F.when(fits, F.try_variant_get(v, "$", contract_struct())).alias("_f"), F.when(~fits, parts).alias("_x"))
    df = df.withColumn("_k", F.transform("_x", F.schema_of_variant))
    part, schema = lambda name: F.get("_x", F.lit(place[name])), lambda name: F.get("_k", F.lit(place[name]))

    def value(name: str, to: str) -> Column:
        strict, lenient = F.col(f"_f.{key[name]}"), _read(part(name), schema(name), to)
        if to == "date":
            strict = F.when(strict.rlike(_DAY), strict.try_cast("date"))
        read = F.when(fits, strict).otherwise(lenient)
        return (F.coalesce(odd_number(odd, key[name]), read) if to == "double" else read).alias(name)

    def unread(name: str, to: str) -> Column:
        there = ~fits & schema(name).isNotNull() & (schema(name) != "VOID")
        if to == "date":
            there = there | fits & F.col(f"_f.{key[name]}").isNotNull()
        if to != "double":
            there = there | odd_number(odd, key[name]).isNotNull()
        return F.when(F.col(name).isNull() & there, F.lit(name))

    def all_unread() -> Column:
        """Of a document that fits and has no odd number only dates can be beyond reading."""
        of = lambda dates: F.array_compact(F.array(*[unread(name, to) for name, (_, to) in C.FLAT.items() if to == "date" or not dates]))
        return F.when(fits & odd.isNull(), of(True)).otherwise(of(False))

    items = F.when(fits, F.col("_f.items")).otherwise(F.try_variant_get(part("items"), "$", "array<variant>"))
    df = df.select("*", *[value(name, to) for name, (_, to) in C.FLAT.items()], items.alias("items"))
    df = df.withColumn("_unread", all_unread()).withColumn("_null_item", F.when(fits, F.exists("items", F.is_variant_null)))
    listed = kind_named(schema("items")).isin("array", "null")
    odd_items = F.when(fits, F.col("_null_item")).otherwise(~listed | F.coalesce(F.exists("items", lambda i: ~F.schema_of_variant(i).startswith("OBJECT")), F.lit(False)))
    message = (
        F.when(v.isNull(), "malformed JSON")
        .when(~F.col("_s").startswith("OBJECT"), "the payload is no object")
        .when(F.size("_unread") > 0, F.concat(F.lit("cannot read "), F.array_join("_unread", ", ")))
        .when(F.col("order_id").isNull(), "no order_id")
        .when(odd_items, "items that are no objects")
    )
    kept = [F.col("_s").alias("_schema"), (fits & ~F.coalesce("_null_item", F.lit(False))).alias("_plain")] if keep_schema else []
    df = df.select(*parsed.columns, *C.FLAT, "items", message.alias("error_message"), *kept)
    return df.withColumn("status", F.when(F.col("error_message").isNull(), "processed").otherwise("error"))


_KIND = {"string": "string", "date": "string", "bigint": "integer", "double": "number", "boolean": "boolean"}


def _drift_of(x: Column, odd: Column, fields: dict[str, str], inner: tuple[str, ...], prefix: Column) -> Column:
    """Findings for one object, from its own entries: unknown keys with their values, and known scalars of another kind."""
    wanted = F.create_map(*[F.lit(y) for n, t in fields.items() for y in (n, _KIND[t])])
    text = lambda y: (F.lit(None) if y is None else y).cast("string")
    finding = lambda code, field, expected, actual, value: F.struct(F.lit(code).alias("code"), field.alias("field"), text(expected).alias("expected"), text(actual).alias("actual"), text(value).alias("value"))

    def one(e: Column) -> Column:
        path, want = F.concat(prefix, e["key"]), F.element_at(wanted, e["key"])
        actual = F.when(odd.isNotNull() & odd[path].isNotNull(), "number").otherwise(kind_named(F.schema_of_variant(e["value"])))
        judged = lambda k: F.when(want.isNull(), finding(C.UNEXPECTED_FIELD, path, None, None, F.to_json(e["value"]))).when(~(k.isin("null") | (k == want) | ((want == "number") & (k == "integer"))), finding(C.TYPE_DRIFT, path, want, k, None))
        return F.when(~e["key"].isin(*inner) if inner else F.lit(True), let(actual, judged))

    entries = F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    return F.array_compact(F.transform(entries, one))


_FOUND = "array<struct<code:string,field:string,expected:string,actual:string,value:string>>"


def drift(df: DataFrame) -> DataFrame:
    """df (with ``v`` and ``odd``) plus ``has_schema_drift``, ``schema_drift_message`` (by field) and ``unmapped_fields``
    (path and value, as JSON, of each field that the contract lacks)."""
    v, o, none = F.col("v"), F.col("odd"), F.array().cast(_FOUND)
    other = lambda x, field: F.array(F.struct(F.lit(C.NON_OBJECT_GROUP).alias("code"), field.alias("field"), F.lit(None).cast("string").alias("expected"), kind(x).alias("actual"), F.lit(None).cast("string").alias("value")))
    parts = [_drift_of(v, o, C.ORDER_FIELDS, (*C.GROUPS, "items"), F.lit(""))]

    def group(x: Column, fields: dict[str, str], inner: tuple[str, ...], path: Column, also=None) -> Column:
        of = lambda k: F.when(k == "object", F.concat(_drift_of(x, o, fields, inner, F.concat(path, F.lit("."))), *([also] if also is not None else []))).when(k != "null", other(x, path)).otherwise(none)
        return let(kind(x), of)

    def item(x: Column, i: Column) -> Column:
        path = F.concat(F.lit("items["), i.cast("string"), F.lit("]"))
        product = let(at(x, "$.product"), lambda p: group(p, C.PRODUCT_FIELDS, (), F.concat(path, F.lit(".product"))))
        return F.when(kind(x) == "null", other(x, path)).otherwise(group(x, C.ITEM_FIELDS, ("product",), path, product))

    named = lambda name, fields: let(at(v, f"$.{name}"), lambda x: group(x, fields, (), F.lit(name)))
    parts += [named(name, fields) for name, fields in C.GROUPS.items()]
    each = lambda x: F.coalesce(F.flatten(F.transform(F.try_variant_get(x, "$", "array<variant>"), item)), none)
    parts.append(let(at(v, "$.items"), lambda x: F.when(kind(x) == "array", each(x)).when(kind(x) != "null", other(x, F.lit("items"))).otherwise(none)))
    by_field = lambda a, b: F.when(a["field"] < b["field"], -1).when(a["field"] > b["field"], 1).otherwise(0)
    if "_plain" not in df.columns:
        df = df.withColumn("_schema", F.schema_of_variant(v))
        shape = F.col("_schema").rlike(contract_shape())
        df = df.withColumn("_plain", shape & ~F.coalesce(F.exists(F.try_variant_get(v, "$.items", "array<variant>"), F.is_variant_null), F.lit(False)))
    look = F.col("_schema").startswith("OBJECT") & (~F.col("_plain") | o.isNotNull())
    found = F.when(look, F.array_sort(F.concat(*[p.cast(_FOUND) for p in parts]), by_field)).otherwise(none)
    df = df.withColumn("_found", found)
    extra = F.filter("_found", lambda e: e["code"] == C.UNEXPECTED_FIELD)
    return df.select(
        *[c for c in df.columns if c not in ("_found", "_schema", "_plain")],
        (F.size("_found") > 0).alias("has_schema_drift"),
        F.when(F.size("_found") > 0, F.transform("_found", lambda e: F.struct(*[e[c].alias(c) for c in ("code", "field", "expected", "actual")]))).alias("schema_drift_message"),
        F.when(F.size(extra) > 0, F.transform(extra, lambda e: F.struct(e["field"].alias("field"), e["value"].alias("value")))).alias("unmapped_fields"),
    )
