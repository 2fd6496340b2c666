"""Reading, normalising and judging orders; drift; states."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.functions import text as X
from tallymark.operators import events as E
from tallymark.operators import ingest, rules

BASE = {"order_id": "A", "order_date": "2024-05-10", "items": [{"product": {"product_id": "P1"}, "quantity": 1, "unit_price": 10.0}], "customer": {"customer_id": "C1"}}


def flat(spark, payloads):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    raw = spark.createDataFrame([(i, t, dt.datetime(2024, 5, 10, 12)) for i, t in enumerate(texts)], "id long, raw_payload string, received_at timestamp")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/flat-{hash(tuple(texts))}"
    ingest.flatten(ingest.parse(raw)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def judged(spark, payloads):
    df = rules.evaluate(rules.normalise(flat(spark, payloads)), F.col("received_at"))
    return [[(e["code"], e["field"]) for e in r["clean_error_message"] or []] for r in df.orderBy("id").collect()]


def having(**more):
    out = json.loads(json.dumps(BASE))
    for k, v in more.items():
        *path, last = k.split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {}) if not isinstance(at, list) else at[int(p)]
        at[last] = v
    return out


def item(**fields):
    return having(items=[{"product": {"product_id": "P1"}, **fields}])


def test_boundaries(spark):
    cases = [
        (item(quantity=0), C.QUANTITY_NON_POSITIVE), (item(quantity=1), None), (item(quantity=-3), C.QUANTITY_NON_POSITIVE), (item(quantity="0"), None), (item(quantity=None), None),
        (item(unit_price=-0.01), C.UNIT_PRICE_NEGATIVE), (item(unit_price=0), None),
        (item(discount_pct=-1), C.DISCOUNT_PCT_OUT_OF_RANGE), (item(discount_pct=0), None), (item(discount_pct=100), None), (item(discount_pct=100.5), C.DISCOUNT_PCT_OUT_OF_RANGE),
        (having(payment__tax_pct=101), C.TAX_PCT_OUT_OF_RANGE), (having(payment__tax_pct=100), None),
        (having(delivery_date="2024-05-09"), C.DELIVERY_BEFORE_ORDER), (having(delivery_date="2024-05-10"), None),
        (having(order_date="2024-05-12"), C.ORDER_DATE_IN_FUTURE), (having(order_date="2024-05-11"), None),
        (having(behavior__customer_rating=5.5), C.CUSTOMER_RATING_OUT_OF_RANGE), (having(behavior__customer_rating=1), None),
        (having(customer__age=131), C.AGE_OUT_OF_RANGE), (having(customer__age=130), None), (having(customer__age=-1), C.AGE_OUT_OF_RANGE),
        (having(customer__customer_name="é" * 151), C.FIELD_TOO_LONG), (having(customer__customer_name="é" * 150), None), (having(address__city="x" * 81), C.FIELD_TOO_LONG),
        (json.dumps(item(shipping_fee=float("nan"))), C.NON_FINITE_NUMBER), (json.dumps(having(payment__tax_pct=float("inf"))), C.NON_FINITE_NUMBER),
    ]
    found = judged(spark, [p for p, _ in cases])
    assert [[c for c, _ in f] for f in found] == [[w] if w else [] for _, w in cases]


def test_findings_come_in_order_and_values_are_cleared(spark):
    bad = having(items=[{"quantity": 0, "unit_price": -1}, {"quantity": 2, "discount_pct": 300}], customer__age=999, behavior__customer_rating=9)
    assert [c for c, _ in judged(spark, [bad])[0]] == [C.QUANTITY_NON_POSITIVE, C.UNIT_PRICE_NEGATIVE, C.DISCOUNT_PCT_OUT_OF_RANGE, C.CUSTOMER_RATING_OUT_OF_RANGE, C.AGE_OUT_OF_RANGE]
    df = rules.evaluate(rules.normalise(flat(spark, [json.dumps(having(payment__tax_pct=float("nan")))])), F.col("received_at"))
    assert df.first()["tax_pct"] is None


def test_reading(spark):
    cases = [
        (BASE, "processed"), ({"order_id": "only"}, "processed"), ({"order_date": "2024-01-01"}, "error"), ("{broken", "error"), ("[1]", "error"), ('"x"', "error"),
        (having(customer__age="41"), "processed"), (having(customer__age="12.0"), "processed"), (having(customer__age="12.5"), "error"), (having(customer__age="abc"), "error"),
        (having(ship_mode=5), "error"), (having(returned="yes"), "processed"), (having(order_date="2024-1-5"), "error"), (having(order_date="2024"), "error"),
        (having(customer="none"), "processed"), (having(items=[1]), "error"), (having(items={"a": 1}), "error"), (having(items=None), "processed"),
        ('{"order_id": "A", "order_id": "B"}', "processed"),
    ]
    out = flat(spark, [p for p, _ in cases]).orderBy("id").collect()
    assert [r["status"] for r in out] == [s for _, s in cases]
    assert out[6]["age"] == 41 and out[7]["age"] == 12 and out[11]["returned"] is True and out[14]["customer_id"] is None
    assert out[18]["order_id"] == "B"


def test_drift(spark):
    cases = [
        (BASE, None), (having(loyalty=3), [("unexpected_field", "loyalty")]), (having(customer__sex="f"), [("unexpected_field", "customer.sex")]),
        (having(items=[{"gift": True}]), [("unexpected_field", "items[0].gift")]), (having(customer__age="41"), [("type_drift", "customer.age")]), (having(returned=1), [("type_drift", "returned")]),
        (having(payment__tax_pct=5), None), (having(ship_mode=None), None), (having(customer=[1]), [("non_object_group", "customer")]), (having(items=[None]), [("non_object_group", "items[0]")]),
        (having(items="x"), [("non_object_group", "items")]), (having(order_status=[1]), [("type_drift", "order_status")]), (having(items=[{"product": {"colour": "red"}}]), [("unexpected_field", "items[0].product.colour")]),
        (json.dumps(item(shipping_fee=float("nan"))), None), ("[1]", None),
    ]
    out = ingest.drift(flat(spark, [p for p, _ in cases])).orderBy("id").collect()
    assert [[(e["code"], e["field"]) for e in r["schema_drift_message"]] if r["schema_drift_message"] else None for r in out] == [w for _, w in cases]
    assert [tuple(x) for x in out[1]["unmapped_fields"]] == [("loyalty", "3")] and not out[0]["has_schema_drift"]
    assert [tuple(x) for x in out[12]["unmapped_fields"]] == [("items[0].product.colour", '"red"')] and out[4]["unmapped_fields"] is None
    assert out[4]["schema_drift_message"][0]["expected"] == "integer" and out[4]["schema_drift_message"][0]["actual"] == "string"


def test_non_finite_numbers(spark):
    """They are judged, cleared and never mistaken for what a payload holds."""
    marked = having(items=[{"quantity": 1, "unit_price": {"__not_finite__": "NaN"}}], payment__tax_pct={"__not_finite__": "NaN"})
    odd = having(items=[{"quantity": 1, "unit_price": float("inf")}, {"quantity": float("nan"), "cost_price": 2}], behavior__customer_rating=float("-inf"))
    out = flat(spark, [json.dumps(marked), json.dumps(odd), json.dumps(having(ship_mode=float("nan")))]).orderBy("id").collect()
    assert [(r["status"], r["error_message"]) for r in out] == [("error", "cannot read tax_pct"), ("processed", None), ("error", "cannot read ship_mode")]
    assert out[1]["odd"] == {"items[0].unit_price": "Infinity", "items[1].quantity": "NaN", "behavior.customer_rating": "-Infinity"}
    df = rules.evaluate(rules.normalise(flat(spark, [json.dumps(odd)])), F.col("received_at"))
    r = df.select("*", F.to_json(F.transform("items", lambda x: F.to_json(x))).alias("text")).first()
    assert [(e["code"], e["field"], e["index"]) for e in r["clean_error_message"]] == [(C.NON_FINITE_NUMBER, "unit_price", 0), (C.NON_FINITE_NUMBER, "quantity", 1), (C.NON_FINITE_NUMBER, "customer_rating", None)]
    assert r["customer_rating"] is None and "odd" not in df.columns and json.loads(json.loads(r["text"])[0])["unit_price"] is None
    drifted = ingest.drift(flat(spark, [json.dumps(having(ship_mode=float("nan")))])).first()["schema_drift_message"]
    assert [(e["code"], e["field"], e["actual"]) for e in drifted] == [("type_drift", "ship_mode", "number")]


def test_normalise(spark):
    row = flat(spark, [having(ship_mode="  EXPRESS\t", order_status="　Delivered ", payment__payment_method=" N/A", address__region="na", address__state="-", delivery_date="2024-05-15", delivery_days=99)])
    r = rules.normalise(row).first()
    assert (r["ship_mode"], r["order_status"], r["payment_method"], r["region"], r["state"], r["delivery_days"]) == ("express", "Delivered", None, "na", "-", 5)


@pytest.mark.parametrize(
    ("current", "codes", "passes", "target"),
    [
        (C.REJECTED, [], True, None), (C.QUARANTINED, [], True, C.PROMOTED), (C.RE_QUARANTINED, [], True, C.PROMOTED), (C.QUARANTINED, [], False, None),
        (C.PROMOTED, [], False, C.RE_QUARANTINED), (C.PROMOTED, [], True, None), (None, [], True, C.PROMOTED), (None, [], False, None), (C.QUARANTINED, [C.NON_FINITE_NUMBER], True, None),
    ],
)
def test_target_state(spark, current, codes, passes, target):
    df = spark.createDataFrame([(current, codes, passes)], "c string, k array<string>, p boolean")
    assert df.select(E.target_state(F.col("c"), F.col("k"), F.col("p"))).first()[0] == target


def test_first_write_wins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id long, k string")
    known = spark.createDataFrame([("b",)], "k string")
    assert [r["status"] for r in E.first_write(df, "k", ["id"], known).orderBy("id").collect()] == ["processed", "duplicate", "duplicate", "processed"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("k1:c1, k2 : c2,bad,:x,k1:c3", "a\x00b")], "s string, n string")
    r = df.select(X.key_pairs(F.col("s")).alias("m"), X.drop_nul(F.col("n")).alias("n")).first()
    assert r["m"] == {"k1": "c3", "k2": "c2"} and r["n"] == "ab"
    q = spark.sql("SELECT 3L AS q, 199.123456789BD AS p, 12.5BD AS d")
    g = X.amount(F.col("q"), F.col("p"))
    out = q.select(g.alias("g"), X.discounted(g, F.col("d")).alias("n")).first()
    assert str(out["g"]) == "597.370370367" and str(out["n"]) == "522.699074071"
