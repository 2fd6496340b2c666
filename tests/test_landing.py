"""Landing: joint commits, a status for every record, attempts and dead letters."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tallymark.operators import retries
from tallymark.plans import reevaluation as V
from tallymark.sources.manifest import Conflict, Manifest
from tallymark.streaming import orders as S


def statuses(df):
    return {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}


def test_of_two_commits_from_one_version_one_must_retry(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}")
    start = m.version()
    m.commit(start, {"a": m.write("a", spark.range(3)), "b": m.write("b", spark.range(2))}, writer="w", batch=0, counts={"records": 3})
    with pytest.raises(Conflict):
        m.commit(start, {"a": m.write("a", spark.range(9))})
    assert (m.version().number, m.table("a").count(), m.table("b").count()) == (0, 3, 2)
    seen = []

    def work(v):
        seen.append(v.number)
        if len(seen) == 1:  # another writer is faster
            m.commit(v, {"a": m.write("a", spark.range(1))}, writer="other")
        return {"add": {"a": m.write("a", spark.range(10))}, "writer": "w", "batch": 1}

    assert m.transact(work, wait=0.01).number == 2 and seen == [0, 1]
    assert m.table("a").count() == 14 and m.table("a", m.version(0)).count() == 3
    assert [(h["writer"], h["batch"], h["attempts"]) for h in m.history()] == [("w", 0, 1), ("other", None, 1), ("w", 1, 2)]
    with pytest.raises(ValueError, match="no version"):
        m.version(9)
    with pytest.raises(ValueError, match="no table"):
        m.table("c")


def test_log_of_many_versions(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}")
    for i in range(23):
        m.transact(lambda v, i=i: {"add": {"a": m.write("a", spark.range(1))}, "writer": "w", "batch": i})
    v = m.version()
    assert (v.number, v.writers, m.table("a", v).count(), m.table("a", m.version(5)).count()) == (22, {"w": 22}, 23, 6)
    m.compact("a")
    assert len(m.version().folders["a"]) == 1 and m.table("a").count() == 23 and m.table("a", v).count() == 23
    assert len(m.vacuum(0)) == 23 + 1 - 1 and m.table("a").count() == 23


@pytest.mark.parametrize("step", ["orders", "quality_events", "status", "commit"])
def test_readers_see_a_batch_whole_or_not(spark, tmp_path, step, monkeypatch):
    """The writer fails at each of its steps; no table shows the batch, and the next run lands it once."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"order_id": "A"}\n')
    go = lambda: S.land_stream(S.documents_in(spark, str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    go()
    (tmp_path / "in/2.json").write_text('{"order_id": "B"}\n{"order_id": "A"}\n')
    write, commit = Manifest.write, Manifest.commit

    def broken(self, name, *args, **named):
        if name == step or step == "commit" and not isinstance(name, str):
            raise OSError("the writer stops here")
        return (write if isinstance(name, str) else commit)(self, name, *args, **named)

    monkeypatch.setattr(Manifest, "commit" if step == "commit" else "write", broken)
    with pytest.raises(Exception, match="the writer stops here"):
        go()
    monkeypatch.undo()
    m = Manifest(spark, f"{tmp_path}/out")
    count = lambda: [m.table(t, m.version()).count() for t in ("orders", "quality_events", "status")]
    assert count() == [1, 1, 1]
    go()
    assert count() == [2, 2, 3]
    assert m.version().number == 1


def test_every_line_keeps_a_status(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"order_id": "A"}\n' * 3 + '{"order_id": "A", "ship_mode": "x"}\n' + "{bad\n" * 2)
    seen = S.LandingMetrics()
    spark.streams.addListener(seen)
    go = lambda: S.land_stream(S.documents_in(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    go()
    read = lambda n: S.landed(spark, f"{tmp_path}/out", n)
    assert statuses(read("status")) == {"processed": 1, "duplicate": 3, "error": 2}
    assert read("status").select("raw_id").distinct().count() == 6
    (folder / "2.json").write_text('{"order_id": "A"}\n{"order_id": "B"}\n')
    go()
    go()
    assert statuses(read("status")) == {"processed": 2, "duplicate": 4, "error": 2}
    assert sorted(r["order_id"] for r in read("orders").collect()) == ["A", "B"] and read("quality_events").count() == 2
    assert {r["error_message"] for r in read("status").where("status = 'duplicate'").collect()} == {"already landed: A"}
    raw = S.raw_records(spark, f"{tmp_path}/out")
    assert raw.count() == 8
    assert [r["raw_payload"] for r in S.replay(raw, read("status"), statuses=["error"]).collect()] == ["{bad", "{bad"]
    assert S.replay(raw, read("status"), read("status").where("order_id = 'B'").select(F.col("raw_id").alias("id"))).count() == 1
    counts = [h["counts"] for h in Manifest(spark, f"{tmp_path}/out").history()]
    metrics = S.commit_metrics(spark, f"{tmp_path}/out").collect()
    assert {(m["writer"], m["total"], m["records"], m["duplicates"], m["errors"], m["retries"]) for m in metrics} == {("landing", 2, 8, 4, 2, 0)} and sum(m["n"] for m in metrics) == 2
    assert counts == [{"records": 6, "processed": 1, "duplicate": 3, "error": 2}, {"records": 2, "processed": 1, "duplicate": 1}]
    until = time.time() + 20
    while len(seen.batches) < 2 and time.time() < until:
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert [b["state_rows"] for b in seen.batches][-1] == 2 and all(b["state_bytes"] > 0 for b in seen.batches)


def flaky(df):
    """Order B succeeds at its third attempt, C never, D can't."""
    some = F.when(F.col("order_id") == "D", retries.failed(F.lit(True), "DataError", "too long", False))
    return df.withColumn("failure", F.coalesce(some, retries.failed((F.col("order_id") == "B") & (F.col("attempt") < 3) | (F.col("order_id") == "C"), "OperationalError", "gone", True)))


def test_attempts_and_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("".join(f'{{"order_id": "{c}"}}\n' for c in "ABCD"))
    S.land_stream(S.documents_in(spark, str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint", work=flaky).awaitTermination()
    m = Manifest(spark, f"{tmp_path}/out")
    assert [r["order_id"] for r in m.table("orders").collect()] == ["A"] and m.table("retries").count() == 2
    early = retries.next_due(m) - dt.timedelta(seconds=1)
    S.work_again(spark, f"{tmp_path}/out", flaky, F.lit(early))  # nothing is due yet
    assert m.table("retries").count() == 2 and m.table("attempts").count() == 4
    first = retries.next_due(m)
    S.work_again(spark, f"{tmp_path}/out", flaky, F.lit(first))
    assert retries.next_due(m) - first == dt.timedelta(seconds=1)  # half a second before, a second now
    S.work_again(spark, f"{tmp_path}/out", flaky, F.lit(retries.next_due(m)))
    assert retries.next_due(m) is None
    assert sorted(r["order_id"] for r in m.table("orders").collect()) == ["A", "B"] and m.table("quality_events").count() == 2
    assert sorted((r["error_class"], r["attempt"]) for r in m.table("dead_letters").collect()) == [("DataError", 1), ("OperationalError", 3)]
    got = {(r["outcome"], r["error_class"], r["attempt"]): r["records"] for r in retries.attempts_by_class(m).collect()}
    assert got == {("done", None, 1): 1, ("dead", "DataError", 1): 1, ("retry", "OperationalError", 1): 2, ("retry", "OperationalError", 2): 2, ("done", None, 3): 1, ("dead", "OperationalError", 3): 1}


def test_re_evaluation_of_what_landed(spark, tmp_path, monkeypatch):
    """Events planned against a log that another writer has moved on are planned anew, and a second run adds none."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"order_id": "A", "customer": {"age": 200}}\n{"order_id": "B", "customer": {"age": 300}}\n{"order_id": "C"}\n')
    root = f"{tmp_path}/out"
    S.land_stream(S.documents_in(spark, str(tmp_path / "in")), root, f"{tmp_path}/checkpoint").awaitTermination()
    m, write, raced = Manifest(spark, root), Manifest.write, []
    log = m.table("quality_events")
    rejected = log.where("order_id = 'B'").withColumns({"id": F.lit(99).cast("bigint"), "event_type": F.lit("manual_rejection"), "from_state": F.col("to_state"), "to_state": F.lit("permanently_rejected"), "event_at": F.expr("event_at + interval 1 hour")})

    def late(self, name, df):
        if not raced:
            raced.append(self.commit(self.version(), {name: write(self, name, rejected)}, writer="human"))
        return write(self, name, df)

    monkeypatch.setattr(Manifest, "write", late)
    at = F.lit(dt.datetime(2030, 1, 1))
    v = V.reevaluate_landed(spark, root, at, age_high=400)
    monkeypatch.undo()
    added = m.table("quality_events", v).where("event_at >= '2030-01-01'").collect()
    assert [(r["order_id"], r["from_state"], r["to_state"]) for r in added] == [("A", "quarantined", "promoted")]  # B: a human was faster
    assert m.history()[-1]["attempts"] == 2 and m.history()[-1]["counts"]["promoted"] == 1
    assert V.reevaluate_landed(spark, root, at, age_high=400).number == v.number
