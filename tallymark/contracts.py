"""The order contract, quality codes and states. Everything else is derived from these."""

from __future__ import annotations

# The contract of an order, group by group.
ORDER_FIELDS = {
    "order_id": "string",
    "order_date": "date",
    "ship_mode": "string",
    "order_status": "string",
    "delivery_date": "date",
    "delivery_days": "bigint",
    "returned": "boolean",
}
GROUPS = {
    "customer": {
        "customer_id": "string",
        "customer_name": "string",
        "age": "bigint",
        "gender": "string",
        "membership_tier": "string",
        "registration_date": "date",
        "acquisition_channel": "string",
        "newsletter_subscribed": "boolean",
        "preferred_payment_method": "string",
        "preferred_device": "string",
    },
    "address": {"country": "string", "region": "string", "state": "string", "city": "string", "postal_code": "string"},
    "payment": {"payment_method": "string", "tax_pct": "double"},
    "behavior": {"device_used": "string", "is_repeat_customer": "boolean", "customer_rating": "double"},
}
PRODUCT_FIELDS = {"product_id": "string", "product_name": "string", "category": "string", "sub_category": "string", "brand": "string", "condition": "string"}
ITEM_FIELDS = {"quantity": "bigint", "unit_price": "double", "cost_price": "double", "discount_pct": "double", "shipping_fee": "double"}

#: Field of the flat order -> (path in the payload, type).
FLAT = {n: (f"$.{n}", t) for n, t in ORDER_FIELDS.items()} | {n: (f"$.{g}.{n}", t) for g, fields in GROUPS.items() for n, t in fields.items()}

# Codes of the quality rules, in the order in which a record's findings are listed.
QUANTITY_NON_POSITIVE = "quantity_non_positive"
UNIT_PRICE_NEGATIVE = "unit_price_negative"
DISCOUNT_PCT_OUT_OF_RANGE = "discount_pct_out_of_range"
TAX_PCT_OUT_OF_RANGE = "tax_pct_out_of_range"
DELIVERY_BEFORE_ORDER = "delivery_before_order"
ORDER_DATE_IN_FUTURE = "order_date_in_future"
CUSTOMER_RATING_OUT_OF_RANGE = "customer_rating_out_of_range"
AGE_OUT_OF_RANGE = "age_out_of_range"
FIELD_TOO_LONG = "field_too_long"
NON_FINITE_NUMBER = "non_finite_number"
#: A rule that clears the value it finds cannot find it again: its verdict must not be overturned by a re-run.
NON_REPRODUCIBLE = (NON_FINITE_NUMBER,)
RULE_VERSION = "v4"
AGE_RANGE, RATING_RANGE, PCT_RANGE = (0, 130), (1, 5), (0, 100)
SOFT_LENGTHS = {"customer_name": 150, "city": 80}
FUTURE_DAYS = 1

# Texts that mean "no value", and the fields they are looked for in.
SENTINELS = ("", "null", "none", "n/a")
LOWERED = ("gender", "ship_mode", "membership_tier", "payment_method", "preferred_payment_method", "preferred_device")
STRIPPED = ("order_status", "country", "region", "state", "city", "postal_code", "customer_name")

# Drift codes, quality states, event types.
UNEXPECTED_FIELD, TYPE_DRIFT, NON_OBJECT_GROUP = "unexpected_field", "type_drift", "non_object_group"
CLEAN, QUARANTINED, PROMOTED, RE_QUARANTINED, REJECTED = "clean", "quarantined", "promoted", "re_quarantined", "permanently_rejected"
EVENT_TYPES = ("initial_evaluation", "re_evaluation", "re_quarantination", "manual_rejection")
UNKNOWN = "__UNKNOWN__"
GATE_THRESHOLD, MONITOR_THRESHOLD = 0.15, 0.10
LOOKBACK_DAYS = 3

FINDING = "struct<code:string,field:string,value:string,index:int,order_date:string,length:int,max:int>"
DRIFT = "struct<code:string,field:string,expected:string,actual:string>"
QUALITY_EVENT = f"id bigint, raw_id bigint, order_id string, event_type string, from_state string, to_state string, rule_version string, event_at timestamp, reason array<{FINDING}>"

#: Bytes of rows, as held in memory, that make a file of a stored table.
FILE_BYTES = 256_000_000
