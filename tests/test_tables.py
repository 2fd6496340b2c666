"""Stored tables: declared schemas, refused scans, files by size, look-ups, distributions, the landing gate."""

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators import distributions as D
from tallymark.operators import staging
from tallymark.plans import checks as K
from tallymark.plans import runner
from tallymark.sources import contract
from tallymark.sources.days_source import DayTables


def of(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


BASE = of(("id", T.LongType(), False), ("name", T.StringType(), True))


def test_declared_schema(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(contract.ContractBroken, match="declares no schema"):
        contract.declared(spark, path)
    assert contract.declare(spark, path, BASE) == 1 and contract.declare(spark, path, BASE) == 1
    wider = of(("id", T.LongType(), False), ("city", T.StringType(), True), ("name", T.StringType(), True))
    for schema, why in {
        "gone": (of(("id", T.LongType(), False), ("title", T.StringType(), True)), "name is gone"),
        "type": (of(("id", T.IntegerType(), False), ("name", T.StringType(), True)), "id was bigint, is int"),
        "null": (of(("id", T.LongType(), False), ("name", T.StringType(), False)), "name might be null"),
        "new": (of(*[(f.name, f.dataType, f.nullable) for f in BASE], ("x", T.LongType(), False)), "x is new and may not be null"),
    }.values():
        with pytest.raises(contract.ContractBroken, match=why):
            contract.declare(spark, path, schema)
    assert contract.declare(spark, path, wider) == 2 and contract.declared(spark, path) == wider and contract.declared(spark, path, 1) == BASE
    # the widened table still takes rows of the old columns, and no others
    old = spark.createDataFrame([("a", 1)], "name string, id bigint")
    assert [tuple(r) for r in contract.conform(old, wider).collect()] == [(1, None, "a")]
    for df, why in ((old.withColumn("x", F.lit(1)), "x is not declared"), (old.drop("id"), "id is absent"), (old.withColumn("id", F.lit(1)), "id is int, not bigint")):
        with pytest.raises(contract.ContractBroken, match=why):
            contract.conform(df, wider)
    with pytest.raises(Exception, match="id is null"):
        contract.conform(old.withColumn("id", F.lit(None).cast("bigint")), wider).collect()


def test_old_and_new_days_read_as_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    at = lambda d: dt.datetime(2024, 1, d, 5)
    contract.declare(spark, path, of(("id", T.LongType(), True), ("at", T.TimestampType(), True)))
    staging.append_days(contract.conform(spark.createDataFrame([(1, at(1))], "id long, at timestamp"), contract.declared(spark, path)), path, "at", ["id"])
    contract.declare(spark, path, of(("id", T.LongType(), True), ("at", T.TimestampType(), True), ("city", T.StringType(), True)))
    staging.append_days(contract.conform(spark.createDataFrame([(2, at(2), "x")], "id long, at timestamp, city string"), contract.declared(spark, path)), path, "at", ["id"])
    days = T.StructType([*contract.declared(spark, path), T.StructField("day", T.DateType())])
    both = staging.read_days(spark, path, dt.date(2024, 1, 1), dt.date(2024, 1, 9), schema=days)
    assert sorted((r["id"], r["city"]) for r in both.collect()) == [(1, None), (2, "x")]
    assert staging.days_of(spark, path) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]


def test_scans_without_days_are_refused_when_planned(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, dt.datetime(2024, 1, 1 + i % 9, 5), "ä" * (i % 4)) for i in range(90)]
    staging.overwrite_days(spark.createDataFrame(rows, "id long, at timestamp, name string"), path, "at", ["id"])
    spark.dataSource.register(DayTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("tallymark_days").schema("id long, at timestamp, name string, late string, day date").load(path)
        with pytest.raises(Exception, match="say which days to read"):
            df.where("id = 3")._jdf.queryExecution().executedPlan()
        spark.sparkContext.setJobGroup("refused", "")
        with pytest.raises(Exception, match="say which days to read"):
            df.collect()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("refused")
        spark.sparkContext.setJobGroup("", "")
        three = df.where("day >= date'2024-01-03' and day < date'2024-01-06' and id > 20")
        assert sorted((r["id"], r["name"], r["late"], r["day"]) for r in three.collect()) == sorted((i, n, None, a.date()) for i, a, n in rows if 3 <= a.day < 6 and i > 20)
        folders = {p.parent.name for p in Path(path).rglob("*.parquet")}
        assert len(folders) == 9 and three.select(F.spark_partition_id()).distinct().count() == 3  # a task a file
        assert {r["day"] for r in df.where("day in (date'2024-01-02', date'2024-01-08')").collect()} == {dt.date(2024, 1, 2), dt.date(2024, 1, 8)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_files_by_size(spark, tmp_path, kind):
    """One day holds nine tenths of all rows, and one key a third of these: files of a day are within a factor of two."""
    r, path = random.Random(1), f"{tmp_path}/t"
    rows = [(7 if r.random() < 1 / 3 else r.randrange(10_000), dt.datetime(2024, 1, 1 if i % 10 else 2 + i % 4)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k bigint, at timestamp").withColumn("k", F.lpad(F.col("k").cast("string"), 5, "0") if kind == "string" else F.col("k"))
    dated = df.withColumn("day", F.to_date("at"))
    each = dated.agg(F.avg(staging.row_bytes(dated))).first()[0]
    staging.overwrite_days(df, path, "at", ["k"], file_bytes=int(each * 1000))
    counts = [(x["d"], x["count"]) for x in spark.read.parquet(path).groupBy(F.col("day").alias("d"), F.input_file_name().alias("f")).count().collect()]
    files = Counter(d for d, _ in counts)
    assert files[dt.date(2024, 1, 1)] == 18 and all(n <= 2 for d, n in files.items() if d.day > 1)
    large = [n for d, n in counts if d.day == 1]
    assert max(large) <= 2 * min(large)
    back = spark.read.parquet(path)
    assert back.count() == 20_000 and back.groupBy("k").count().exceptAll(df.groupBy("k").count()).isEmpty()
    # files hold ranges: a key that is not the frequent one lies in a file of its day or two
    assert max(x["n"] for x in back.where("day = date'2024-01-01'").where(F.col("k") != (7 if kind == "bigint" else "00007")).withColumn("f", F.input_file_name()).groupBy("k").agg(F.countDistinct("f").alias("n")).collect()) <= 1


def rows_scanned(df):
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        if "FileSourceScanExec" in node.getClass().getSimpleName():
            out += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return out


def test_lookup_reads_few_row_groups(spark, tmp_path):
    df = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("code"), F.lit(dt.datetime(2024, 1, 1)).alias("at"))
    small = lambda w: w.option("parquet.block.size", "65536").option("parquet.page.size", "4096").option("parquet.block.size.row.check.min", "100")
    plain, bloom = f"{tmp_path}/plain", f"{tmp_path}/bloom"
    small(staging._writer(df, "at", ["id"], "day")).parquet(plain)
    small(staging._writer(df, "at", ["id"], "day", look_up={"code": 40_000})).parquet(bloom)
    code = df.where("id = 12345").first()["code"]
    found = {p: rows_scanned(staging.lookup(spark.read.parquet(p), "code", code)) for p in (plain, bloom)}
    assert found[bloom] < 40_000 / 4 < found[plain]
    assert staging.lookup(spark.read.parquet(bloom), "code", code).first()["id"] == 12345
    assert rows_scanned(staging.lookup(spark.read.parquet(bloom), "id", 777)) < 40_000 / 4  # the cluster key, by bounds


def test_histograms_of_days_add_up(spark):
    r = random.Random(2)
    rows = [(i % 5, r.choice("ab"), r.choice([None, 0.0, 1.0, 2.5, 9.0, 100.0, -4.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "day int, kind string, v double")
    once = D.histogram(df, ["kind"], "v", (1, 5, 50))
    days = D.merged_histograms(D.histogram(df, ["kind", "day"], "v", (1, 5, 50)), ["kind"])
    key = lambda x: {(a["kind"], a["le"], a["n"], a["total"]) for a in x.collect()}
    assert key(once) == key(days)
    want = Counter((k, next((e for e in (1, 5, 50) if v <= e), None)) for _, k, v in rows if v is not None)
    assert {(k, le): n for k, le, n, _ in key(once) if n} == want


def test_sketches_of_days(spark):
    """Merged days hold their rank error as one pass does."""
    r = random.Random(3)
    values = [r.lognormvariate(0, 2) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "day int, v double").withColumn("all", F.lit(1))
    at = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    for s in (D.sketches(df, ["all"], "v"), D.merged_sketches(D.sketches(df, ["all", "day"], "v"), ["all"])):
        got = D.quantiles(s, **at).first()
        assert got["n"] == 20_000
        for name, p in at.items():
            assert abs(sum(v <= got[name] for v in values) / 20_000 - p) < 0.017


def test_landing_gate(spark, tmp_path):
    of = lambda rows: spark.createDataFrame(rows, "batch int, n bigint")
    offered, landed = of([(1, 10), (2, 10), (2, 5), (3, 8), (4, 7)]), of([(1, 10), (2, 14), (3, 9), (5, 1), (None, 2)])
    got = {r["batch"]: (r["offered"], r["landed"], r["verdict"]) for r in staging.landing_gate(offered, landed).collect()}
    assert got == {1: (10, 10, "pass"), 2: (15, 14, "short"), 3: (8, 9, "over"), 4: (7, None, "unknown"), 5: (None, 1, "unknown"), None: (None, 2, "unknown")}
    runner.require_landed(of([(1, 10)]), of([(1, 9)]), least=0.9)
    built = []
    plan = [runner.Layer("one", {"m": lambda t: built.append(1) or t["x"]})]
    with pytest.raises(runner.CheckFailed, match="2: short, 14 of 15"):
        runner.run(spark, {"x": offered}, f"{tmp_path}/r", plan, gate=lambda: runner.require_landed(offered, landed))
    assert not built
    runner.run(spark, {"x": offered}, f"{tmp_path}/r", plan, gate=lambda: runner.require_landed(offered, offered))
    assert built


def test_attribute_conflicts_without_copies_of_the_rows(spark):
    rows = [("a", 1, "x"), ("a", 1, None), ("b", 1, "x"), ("b", 2, "x"), ("b", 3, None), ("c", None, "p"), ("c", None, "q"), (None, 1, "x"), (None, 2, "y"), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, m int, s string")
    out = K.attributes_stable(df, "k", ("m", "s"))
    assert sorted(tuple(r) for r in out.collect()) == [("b", 3, 1), ("c", 0, 2)]
    assert "Expand" not in out._jdf.queryExecution().toString()
