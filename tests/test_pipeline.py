"""Landing, models, data tests, staging, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark import contracts as C
from tallymark.operators import events as E
from tallymark.operators import staging
from tallymark.plans import checks as K
from tallymark.plans import gold as G
from tallymark.plans import reevaluation as V
from tallymark.plans import reports as R
from tallymark.plans import runner
from tallymark.sources import generator
from tallymark.streaming import orders as S


@pytest.fixture(scope="module")
def landed(spark):
    return generator.land(generator.orders(spark, 400, seed=3))


def test_generator_is_seeded(spark):
    a, b = (sorted(r["raw_payload"] for r in generator.orders(spark, 50, seed=s).repartition(p).collect()) for s, p in ((4, 2), (4, 5)))
    assert a == b and a != sorted(r["raw_payload"] for r in generator.orders(spark, 50, seed=5).collect())


def test_what_is_sent_again_counts_once(spark):
    raw = generator.orders(spark, 60, seed=4)
    both = generator.resent(raw, 0.5, seed=2)
    assert both.count() > 70 and both.where("raw_payload like '%again%'").count() > 3
    ods, log = generator.land(both)
    assert ods.count() == log.count() == 60 and ods.where("raw_id < 0").count() == 0


def test_run_builds_and_tests_all_models(spark, landed, tmp_path):
    ods, log = landed
    copies = ods.unionByName(ods.where("raw_id % 7 = 0").withColumn("id", F.col("id") + 10_000))
    tables, outcome = runner.run(spark, {"orders": copies, "quality_events": log.unionByName(log.where("id % 5 = 0"))}, str(tmp_path))
    assert set(outcome.values()) == {"pass"} and len(outcome) > 90
    assert tables["stg_orders"].count() == ods.count() == tables["int_orders"].count() + tables["int_orders_quarantine"].count()
    assert tables["dim_customer"].where(F.col("customer_id") == C.UNKNOWN).count() == 1
    loose = tables["fct_orders"].where("item_count > 0 and items_missing_cost = item_count")
    assert loose.where("cost_amount is not null").count() == 0


def test_gate_stops_the_run(spark, landed, tmp_path):
    ods, log = landed
    dirty = ods.withColumn("has_clean_error", F.lit(True))
    with pytest.raises(runner.CheckFailed, match="error rate"):
        runner.run(spark, {"orders": dirty, "quality_events": log}, str(tmp_path))


def test_gate_on_edges(spark):
    day = lambda n, bad, d: [(dt.datetime(2024, 1, d, 1), i < bad) for i in range(n)]
    of = lambda rows: spark.createDataFrame(rows, "at timestamp, bad boolean")
    fails = lambda rows: R.gate(of(rows), "bad", 0.15, "at").count() == 1
    assert not fails(day(1000, 149, 2)) and fails(day(1000, 150, 2)) and fails(day(10, 10, 2))
    assert not fails(day(100, 100, 1) + day(100, 0, 2)) and not fails([])


def test_re_evaluation_is_idempotent(spark, landed):
    ods, log = landed
    states = E.with_effective_state(ods, log)
    again = lambda s: E.candidates(s).withColumn("new_codes", F.when(F.col("raw_id") % 2 == 0, F.array(F.lit("x"))))
    found = again(states)
    plan = E.plan_events(found, F.lit(dt.datetime(2025, 1, 1)))
    moved = plan.count()
    assert 0 < moved < found.count() and plan.where(F.col("to_state") != C.PROMOTED).count() == 0
    counts = E.plan_counts(found, plan).first()
    assert counts["promoted"] == moved and counts["unchanged"] == found.count() - moved
    after = log.select("id", "raw_id", "to_state", "event_at").unionByName(plan.select((F.col("raw_id") + 10**6).alias("id"), "raw_id", "to_state", "event_at"))
    assert E.plan_events(again(E.with_effective_state(ods, after)), F.lit(dt.datetime(2025, 1, 2))).count() == 0


def test_re_evaluation_end_to_end(spark, landed, tmp_path):
    ods, log = landed
    path = f"{tmp_path}/log"
    log.write.parquet(path)
    read, at = lambda: spark.read.parquet(path), F.lit(dt.datetime(2025, 1, 1))
    with pytest.raises(V.WrongVersion):
        V.reevaluate(ods, read(), path, at, expect_version="v0")
    dry = V.reevaluate(ods, read(), path, at, age_high=250)
    assert dry.events.count() > 0 and read().count() == log.count()
    only_age = ods.where("has_clean_error and size(clean_error_message) = 1 and clean_error_message[0].code = 'age_out_of_range'").count()
    done = V.reevaluate(ods, read(), path, at, dry_run=False, age_high=250, expect_version=C.RULE_VERSION)
    assert done.counts.first()["promoted"] == only_age == read().where("event_type = 're_evaluation'").count() > 0
    # a verdict that rests on a cleared value stands, and a second run adds nothing
    blocked = ods.where("exists(clean_error_message, e -> e.code = 'non_finite_number')").count()
    assert done.counts.first()["blocked_non_reproducible"] == blocked > 0
    assert V.reevaluate(ods, read(), path, at, dry_run=False, age_high=250).events.count() == 0
    assert V.plan(ods, read(), at, limit=3).counts.first()["candidates"] == 3


def test_incremental_run_equals_a_full_one(spark, landed, tmp_path):
    ods, log = landed
    as_of = F.lit(dt.datetime(2024, 1, 30, 12))
    days = runner.Days(as_of, lookback=3)
    early = lambda df, at: df.where(F.col(at) < dt.datetime(2024, 1, 28, 9))
    plan = [runner.Layer(x.name, x.models, [c for c in x.checks if "error rate" not in c.name]) for x in runner.layers(as_of)]
    go = lambda o, e, root, days: runner.run(spark, {"orders": o, "quality_events": e}, f"{tmp_path}/{root}", plan, days)[0]
    go(early(ods, "received_at"), early(log, "event_at"), "steps", days)
    steps, whole = go(ods, log, "steps", days), go(ods, log, "whole", None)
    for name in ("stg_orders", "stg_quality_events", "rpt_quality_events_daily", "fct_orders"):
        drop = [c for c, t in whole[name].dtypes if "variant" in t]
        a, b = steps[name].drop(*drop), whole[name].drop(*drop)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0
    # old days go when all tests have passed, from the tables stored by day alone
    old = dt.date(2024, 1, 15)
    kept, _ = runner.run(spark, {"orders": ods, "quality_events": log}, f"{tmp_path}/expired", plan, keep_from=old)
    for name, day in (("fct_orders", "order_date"), ("rpt_quality_events_daily", "event_date")):
        assert kept[name].columns == whole[name].columns and kept[name].count() == whole[name].where(F.col(day).isNull() | (F.col(day) >= old)).count() < whole[name].count()
    assert kept["int_orders"].count() == whole["int_orders"].count()
    # a day that was lost is seen and can be filled in again
    short = staging.days_of(spark, f"{tmp_path}/steps/stg_orders")[-2]
    staging.overwrite_days(ods.where(F.to_date("received_at") == short).limit(1), f"{tmp_path}/steps/stg_orders", "received_at", ["raw_id"])
    with pytest.raises(runner.CheckFailed, match="stg_orders matches"):
        runner.run(spark, {"orders": ods, "quality_events": log}, f"{tmp_path}/steps", plan, runner.Days(as_of, start=dt.date(2024, 1, 2)))
    healed = go(ods, log, "steps", runner.Days(as_of, start=short))
    assert healed["stg_orders"].count() == ods.count()


def test_states_of_odd_orders(spark):
    orders = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None), (5, True)], "raw_id long, has_clean_error boolean").withColumn("received_at", F.lit(dt.datetime(2024, 1, 1)))
    at = dt.datetime(2024, 1, 2)
    log = spark.createDataFrame([(1, 3, C.PROMOTED, at), (2, 3, C.RE_QUARANTINED, at), (3, 5, C.REJECTED, at)], "id long, raw_id long, to_state string, event_at timestamp")
    s = E.with_effective_state(orders, log)
    clean, other = E.clean_side(s), E.quarantine_side(s)
    assert K.split_is_partition(orders, clean, other).count() == 0
    assert [r["raw_id"] for r in clean.collect()] == [2]
    assert {r["raw_id"]: r["effective_quality_state"] for r in other.collect()} == {1: C.QUARANTINED, 3: C.QUARANTINED, 4: C.QUARANTINED, 5: C.REJECTED}


def test_backlog_counts_codes_once(spark):
    rows = [(1, ["b", "a", "a"]), (2, ["b"]), (3, None)]
    df = spark.createDataFrame(rows, "raw_id long, k array<string>").select("raw_id", F.transform("k", lambda c: F.struct(c.alias("code"))).alias("clean_error_message"), F.lit(dt.datetime(2024, 1, 1)).alias("quarantined_at"), F.lit("v4").alias("dq_rule_version"), F.lit(C.QUARANTINED).alias("effective_quality_state"))
    out = {r["code"]: (r["orders_with_code"], r["orders_primary_code"]) for r in R.quality_backlog(df).collect()}
    assert out == {"a": (1, 1), "b": (2, 1), C.UNKNOWN: (1, 1)}
    assert K.backlog_balances(R.quality_backlog(df), df).count() == 0


def test_staging_by_days(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, dt.datetime(2024, 1, 1 + i % 10, i % 24)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, at timestamp")
    assert staging.watermark(spark, path) is None
    staging.overwrite_days(df, path, "at", ["id"])
    assert staging.watermark(spark, path) == dt.date(2024, 1, 10)
    with pytest.raises(staging.MissingDayPredicate):
        staging.read_days(spark, path)
    late = df.where(staging.lookback(F.col("at"), F.lit(dt.datetime(2024, 1, 10, 13))))
    assert late.agg(F.min("at")).first()[0] == dt.datetime(2024, 1, 7, 6) or late.agg(F.min(F.to_date("at"))).first()[0] == dt.date(2024, 1, 7)
    staging.overwrite_days(late, path, "at", ["id"])
    whole = staging.read_days(spark, path, dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert whole.count() == 800 and staging.reconcile(df, whole, "at", "id").count() == 0
    assert staging.reconcile(df, whole.where("id <> 5"), "at", "id").count() == 1
    one = staging.read_days(spark, path, dt.date(2024, 1, 3))
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString() and one.count() == 80
    assert staging.expire_days(spark, path, dt.date(2024, 1, 3)) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert staging.read_days(spark, path, dt.date(2024, 1, 1), dt.date(2024, 2, 1)).count() == 640
    assert staging.since(df, "at", dt.date(2024, 1, 10)).count() == 80


def test_recovery_page_and_thresholds(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [(1, "pending", ago(30), None), (2, "pending", ago(90), None), (3, "processing", ago(5000), ago(700)), (4, "processing", ago(5000), ago(100)), (5, "processed", ago(9999), None)]
    raw = spark.createDataFrame(rows, "id long, status string, received_at timestamp, processing_started_at timestamp")
    assert [r["id"] for r in staging.recoverable(raw, F.lit(now)).collect()] == [2, 3]
    assert [r["id"] for r in staging.recoverable(raw, F.lit(now), after_id=2).collect()] == [3]
    assert staging.stuck_after() == 900
    assert [[r["id"] for r in page.collect()] for page in S.recovery_pages(raw, F.lit(now), page=1)] == [[2], [3]]


def test_recovery_pages_read_the_table_once(spark, tmp_path):
    now = dt.datetime(2024, 1, 1, 12)
    path = f"{tmp_path}/raw"
    spark.range(1000).selectExpr("id * 7 % 1000 AS id", "if(id % 3 = 0, 'processed', 'pending') AS status", "timestamp '2024-01-01 10:00:00' AS received_at", "CAST(NULL AS timestamp) AS processing_started_at").repartition(5).write.parquet(path)
    raw = spark.read.parquet(path)
    want = sorted(r["id"] for r in raw.where("status = 'pending'").collect())
    pages = S.recovery_pages(raw, F.lit(now), page=70)
    first = [r["id"] for r in next(pages).collect()]
    for f in (tmp_path / "raw").glob("*.parquet"):
        f.unlink()  # it is not needed any more
    got = [first, *[[r["id"] for r in p.collect()] for p in pages]]
    assert [x for p in got for x in p] == want and {len(p) for p in got[:-1]} == {70}
    assert list(S.recovery_pages(raw.sparkSession.createDataFrame([], raw.schema), F.lit(now))) == []


def test_data_tests_in_one_pass(spark):
    """The outcomes are those of each test alone, with a query a table."""
    a = spark.createDataFrame([(1, "x", 5), (2, None, -1), (2, "q", 7)], "id int, kind string, n int")
    b = spark.createDataFrame([(1, 1), (1, 2)], "id int, part int")
    checks = [*runner._keys("a", "id", "kind"), runner._one_of("a", "kind", "x", "y", severity="warn"), runner._rule("a", "n > 0"), runner._grain("b", "id", "part"), runner._unique("b.id unique", "b", "id"), *runner._filled("b", "part"), runner._grain("b", "part", "id"), runner._link("a", "id", "b")]
    tables = {"a": a, "b": b}
    spark.sparkContext.setJobGroup("fused", "")
    got = runner.broken(tables, checks)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fused"))
    spark.sparkContext.setJobGroup("alone", "")
    assert got == {c.name for c in checks if not c.rows(tables).isEmpty()} == {"a.id unique", "a.kind not null", "a.kind accepted", "a: n > 0", "b.id unique", "a.id in b"}
    assert jobs < len(spark.sparkContext.statusTracker().getJobIdsForGroup("alone"))
    spark.sparkContext.setJobGroup("", "")


def test_try_all_reports_every_failure():
    ran = []
    with pytest.raises(ExceptionGroup):
        runner.try_all({"a": lambda: 1 / 0, "b": lambda: ran.append(1)})
    assert ran == [1] and runner.try_all({"b": lambda: 2}) == {"b": 2}


def test_circuit_breaker(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [(0, False), (1, False), (2, False), (3, True), (20, True), (40, False), (41, True), (80, True), (81, False)]
    df = spark.createDataFrame([("s", at(t), ok) for t, ok in calls], "service string, ts timestamp, ok boolean")
    out = [r["state"] for r in S.breaker_states(df).orderBy("ts").collect()]
    assert out == ["closed", "closed", "closed", "open", "open", "half_open", "open", "half_open", "closed"]


@pytest.mark.parametrize("width", [7.0, 40.0, 1000.0])
def test_circuit_breaker_by_spans(spark, width):
    """Spans are folded apart and come to the same as one fold over all."""
    import random

    r, rows, want = random.Random(5), [], []
    for k in range(4):
        t = sorted(r.uniform(0, 600) for _ in range(150))
        calls = [(round(x * 1e6), r.random() < (0.2, 0.5, 0.8, 0.0)[k]) for x in t]
        want += [(f"s{k}", x, s) for (x, _), s in zip(calls, S.Breaker(3, 30_000_000).fold([x for x, _ in calls], [ok for _, ok in calls], 0, None), strict=True)]
        rows += [(f"s{k}", dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=x), ok) for x, ok in calls]
    out = S.breaker_states(spark.createDataFrame(rows, "service string, ts timestamp, ok boolean").repartition(3), width=width).collect()
    assert sorted((x["service"], round((x["ts"] - dt.datetime(2024, 1, 1)).total_seconds() * 1e6), x["state"]) for x in out) == want


def test_dim_product_order_is_total(spark):
    items = spark.createDataFrame([(1, 0, "P", "red"), (2, 0, "P", "blue")], "raw_id long, item_index int, product_id string, brand string").withColumns({"order_date": F.lit(dt.date(2024, 1, 1)), **{c: F.lit("x") for c in ("product_name", "category", "sub_category", "condition")}})
    orders = spark.createDataFrame([(1,), (2,)], "raw_id long").withColumn("received_at", F.lit(dt.datetime(2024, 1, 1)))
    out = {r["product_id"]: r["brand"] for r in G.dim_product(items, orders).collect()}
    assert out == {"P": "blue", C.UNKNOWN: None}
