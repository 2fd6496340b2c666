"""A third of all rows is one row: no task gets more than twice what the median one gets."""

import statistics

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallymark.llm import fingerprints, lm, mixing, packing, sstable
from tallymark.llm.common import placed


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    rows = [(7, "a row that very many repeat", "en", "s", 0) if i % 3 == 0 else (i, f"text {i % 40} of {'w ' * (i % 9)}", "en", "s", 0) for i in range(3000)]
    path = f"{tmp_path_factory.mktemp('hot')}/t"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def even(counts):
    counts = sorted(counts)
    return len(counts) > 5 and counts[-1] <= 2 * statistics.median(counts)


def of(df, column):
    return [r["count"] for r in df.groupBy(column).count().collect()]


def test_packing(hot):
    pieces = packing.pieces(hot, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024).withColumn("place", F.monotonically_increasing_id())
    items = pieces.select(F.array(F.struct("doc_id", "piece")).alias("members"), F.col("length").alias("fill"), "place")
    assert even(of(packing.dealt(items, 12, 0), F.spark_partition_id()))


def test_mix(hot, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 200)
    assert even(of(mixing.dealt(hot, 17, "source", "text", "doc_id"), "bucket"))
    out = mixing.mix(hot, (1,))
    assert out.count() == 3000 and out.agg(F.sum("copies")).first()[0] == 3000
    again = {tuple(r) for r in mixing.mix(hot, (5, 2, 1)).groupBy("doc_id", "text", "copies").count().collect()}
    assert again == {tuple(r) for r in mixing.mix(hot, (5, 2, 1)).groupBy("doc_id", "text", "copies").count().collect()}


def test_fingerprints(hot, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCS", 200)
    rows = fingerprints.with_next(hot).where("not extra")
    assert even(of(rows, "bucket")) and rows.count() == 3000
    assert rows.where("next_text is null").count() == 0
    # in order of ids, each row's next text is the text of the row after it
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in rows.orderBy("bucket", "place").collect()]
    assert [g[0] for g in got] == sorted(g[0] for g in got)
    assert [g[2] for g in got] == [g[1] for g in got[1:] + got[:1]]


@pytest.mark.parametrize("empty", [False, True])
def test_shards(hot, monkeypatch, tmp_path, empty):
    """Also of a table of empty texts, which have no characters to go by."""
    monkeypatch.setattr(sstable, "SHARD_ROWS", 250)
    df = hot.withColumn("text", F.lit("")) if empty else hot
    manifest = sstable.write(df, public_tokenizers.path("word_bpe_49k.json"), 1, f"file://{tmp_path}")
    assert even([r["n_docs"] for r in manifest.collect()])
    back = sstable.read(manifest)
    assert back.count() == 3000 and back.where("doc_id = 7").count() == 1000 + (0 if 7 % 3 == 0 else 1)
    found = sstable.lookup(manifest, hot.where("doc_id in (7, 8)").select("doc_id"))
    assert found.where("doc_id = 7").count() == 1001 and found.where("doc_id = 8").count() == 1


def test_language_model_chunks(hot):
    assert even(of(placed(hot).withColumn("chunk", lm.file_chunk(placed(hot), 1000)), "chunk"))
