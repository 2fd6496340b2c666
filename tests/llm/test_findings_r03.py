"""What the review of round 3 found in the corpus operators, each in small."""

from pyspark.sql import functions as F

from tallymark.llm import lm


def test_common_words_are_those_of_all_training_texts(spark, monkeypatch):
    """10,000 texts, of which a sample would miss some: a word that one text alone holds, more often than any other."""
    monkeypatch.setattr(lm, "COMMON", 3)
    started, start = [], lm.start
    monkeypatch.setattr(lm, "start", lambda *a: started.append(start(*a)) or started[-1])
    monkeypatch.setattr(lm, "train", lambda texts, begin, chars, rounds: [lm.np.zeros((64, 32), "float32")] * 2)
    text = lambda rare: F.when(F.col("id") == rare, F.repeat(F.lit("once "), 50_000)).otherwise(F.concat(F.lit("a b "), F.col("id").cast("string")))
    for rare in (0, 1):
        lm.score(spark.range(10_000).select(F.col("id").alias("doc_id"), text(rare).alias("text")), F.lit(True), F.lit(0)).count()
        assert started[-1].common == ("once", "a", "b")
        assert started[-1].leaves[:4].tolist() == [[10_000, 1], [50_000, 1], [9_999, 1], [9_999, 1]]


def test_hashes_of_words_are_those_of_spark(spark):
    ws = ["a", "", "gr\u00fc\u00df", "\u65e5\u672c\u8a9e", "x" * 100]
    df = spark.createDataFrame([(w,) for w in ws], "w string").select("w", F.xxhash64("w").alias("h"))
    assert {r["w"]: r["h"] % 2**64 for r in df.collect()} == {w: lm.hash_of(w) for w in ws}


def test_a_full_memory_of_pieces_keeps_the_common_ones():
    import public_tokenizers

    from tallymark.llm.tokens import Encoder

    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), keep=40, special=True)
    plain = Encoder(public_tokenizers.path("word_bpe_49k.json"), special=True)
    common = "the cat and the dog"
    encoder.encode([common])
    for i in range(8):
        texts = [f"{common} w{chr(97 + i)}{chr(97 + k)}x" for k in range(26)] + ["", "<|endoftext|>"]
        assert encoder.encode(texts) == plain.encode(texts)
        assert {"the", "cat", "and", "dog"} <= encoder.ids.keys()
    encoder.encode(["the"])
    assert {"the", "cat", "and", "dog"} <= encoder.ids.keys() and len(encoder.ids) <= 40


def test_probabilities_by_parts_are_those_of_the_whole():
    np = lm.np
    draw = np.random.default_rng(1)
    w = draw.normal(size=(64, 32)).astype("float32")
    for n in (1, lm.PART, lm.PART + 1):
        rows = [draw.integers(0, 64, n).astype("int32") for _ in range(3)]
        z = w[rows[0]] + w[rows[1]] + w[rows[2]]
        total = np.exp(z).sum(axis=1, dtype=float)
        found = [(part, scores.copy(), sums) for part, scores, _, sums in lm.probabilities(w, rows)]
        assert [part.stop - part.start for part, _, _ in found] == [lm.PART] * (n // lm.PART) + [n % lm.PART] * (n % lm.PART > 0)
        assert (np.concatenate([s for _, s, _ in found]) == z).all() and (np.concatenate([t for _, _, t in found]) == total).all()
        assert (lm.in_units(w, rows) == np.rint(np.exp(z).T * (lm.UNIT / total))).all()
