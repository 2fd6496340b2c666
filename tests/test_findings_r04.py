"""What the review of round 4 found in the orders, each in small."""

import gzip

from pyspark.sql import functions as F

from tallymark.sources import files
from tallymark.sources.store import stage_root
from tallymark.streaming import orders as S


def test_new_orders_are_found_without_a_shuffle_of_the_records(spark, monkeypatch):
    rows, ids = spark.range(1 << 41, (1 << 41) + 1000), spark.range(1 << 41, (1 << 41) + 1000, 3)
    for words, shuffled in ((S.WORDS, False), (1, True)):
        monkeypatch.setattr(S, "WORDS", words)
        out = S.only_of(rows, ids, 1000)
        assert out.columns == ["id"] and sorted(r[0] for r in out.collect()) == [r[0] for r in ids.collect()]
        assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == shuffled


def test_landing_leaves_no_work_behind(spark, tmp_path):
    """Tables of a batch go with it, compressed documents are read, and go when they have been read if asked for."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt.gz").write_bytes(gzip.compress(b'{"order_id": "A%d"}\n{"order_id": "A0"}\n' % k))
    S.land_stream(S.documents_in(spark, str(tmp_path / "in"), maxFilesPerTrigger="1", cleanSource="delete"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    status = {r["status"]: r["count"] for r in S.landed(spark, f"{tmp_path}/out", "status").groupBy("status").count().collect()}
    assert status == {"processed": 3, "duplicate": 3} and S.landed(spark, f"{tmp_path}/out", "orders").count() == 3
    assert len(list((tmp_path / "in").glob("*.gz"))) <= 1 and S.raw_records(spark, f"{tmp_path}/out").agg(F.count("raw_payload")).first()[0] == 6
    assert not [f for f in files.names(spark, stage_root(spark)) if f.startswith(("landing-batch", "judged-batch"))]
