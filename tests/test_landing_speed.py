"""Landing reads each document once; the short ways to its parts say what the long ones said."""

import json

from pyspark.sql import functions as F

from tallymark.operators import ingest, rules
from tallymark.plans import gold as G
from tallymark.sources import generator


def test_landing_reads_the_json_in_one_pass(spark, monkeypatch):
    stores = []
    monkeypatch.setattr(generator, "stored", lambda df, name: stores.append((name, df._jdf.queryExecution().executedPlan().toString())) or df)
    generator.land(generator.orders(spark, 20))
    assert [name for name, _ in stores] == ["landed-orders"]
    assert stores[0][1].count("ArrowEvalPython") == 1
    assert "raw_payload" not in stores[0][1].split("Exchange")[0]


def test_drift_is_the_same_with_the_schema_kept(spark):
    docs = [{"order_id": "a", "items": [{"quantity": 1}]}, {"order_id": "b", "items": [None]}, {"order_id": "c", "age": 1, "items": [1]}, {"order_id": "d", "customer": "x"}, [1], {"order_id": "e", "payment": {"tax_pct": float("nan")}}]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] + [(90, "{"), (91, None)], "id int, raw_payload string")
    parsed = ingest.parse(raw)
    columns = ["id", "status", "error_message", "has_schema_drift", "schema_drift_message", "unmapped_fields"]
    kept = ingest.drift(ingest.flatten(parsed, keep_schema=True)).select(columns).orderBy("id").collect()
    assert kept == ingest.drift(ingest.flatten(parsed)).select(columns).orderBy("id").collect()
    assert len(kept) == 8


def items(spark, *docs):
    return spark.createDataFrame([(json.dumps(docs),)], "j string").select(F.lit(1).alias("raw_id"), F.lit("o").alias("order_id"), F.current_date().alias("order_date"), F.from_json("j", "array<variant>").alias("items"))


def test_fields_of_items_are_read_as_before(spark):
    df = items(spark, {"product": {"product_id": {"a": 1}, "product_name": "{x", "category": "[", "brand": [1], "sub_category": 5}, "quantity": "3", "unit_price": 2.5}, {"product": 7, "quantity": True}, None, 5)
    out = G.order_items(df).orderBy("item_index").collect()
    assert [(r.product_id, r.product_name, r.category, r.brand, r.sub_category) for r in out] == [(None, "{x", "[", None, "5"), *[(None,) * 5] * 3]
    assert [(r.quantity, None if r.unit_price is None else float(r.unit_price)) for r in out] == [(3, 2.5), *[(None, None)] * 3]


def test_only_suspect_items_are_looked_at_one_by_one(spark):
    odd = F.lit(None).cast("map<string,string>").alias("odd")
    suspect = lambda *docs: items(spark, *docs).select("items", odd).select(rules.items_suspect()).first()[0]
    assert not suspect({"quantity": 1, "unit_price": 0, "discount_pct": 100.0}, {"quantity": None}, {"quantity": "x"}, None, 3)
    assert not suspect()
    for bad in ({"quantity": 0}, {"unit_price": -0.01}, {"discount_pct": 100.5}, {"discount_pct": -1}, {"shipping_fee": "NaN"}, {"cost_price": "-Infinity"}):
        assert suspect({"quantity": 1}, bad)


def test_an_item_is_read_from_its_document_once(spark):
    plan = G.order_items(items(spark, {"quantity": 1}))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get(_i") == 1 + 6  # the whole, and each text once more if it opens with a bracket
