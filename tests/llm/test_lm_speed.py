"""The steps of op1_maxent_lm that work on whole slices instead of single words, each against its definition."""

import numpy as np
import pyarrow as pa

from tallymark.llm import lm
from tallymark.llm.common import lower_ascii, words

TEXTS = ["", None, "  One\ttwo\x0b\x0cONE ", "É\x1cA\xa0B　c\x85 D\r\nd", " \n", "x", "a b " * 300, "the end."]


def test_slices_of_texts_hold_their_words_and_ends(monkeypatch):
    """With long texts, which are cut between words, and without; no text without a long one beside it is split by Python."""
    for texts, size in ((TEXTS, 1 << 15), (TEXTS * 40, 1 << 10), (TEXTS * 3, 20), ([], 9)):
        monkeypatch.setattr(lm, "SLICE", size)
        monkeypatch.setattr(lm, "words", words if size == 20 else None)
        tokens, owners = [], []
        for ws, of, word in lm.streams(pa.array(texts, pa.string())):
            mine = iter(ws.to_pylist())
            tokens += [next(mine) if w else lm.END for w in word]
            owners += of.tolist()
            assert not list(mine) and len(of) == len(word)
        want = [(i, w) for i, t in enumerate(texts) for w in [*words(lower_ascii(t or "")), lm.END]]
        assert [*zip(owners, tokens, strict=True)] == want


def test_leaves_and_hashes_of_a_slice():
    ws = ["running,", "...", ".", "a", "日本語!", "b?", "running,", "the", lm.END, "ab", "xab;"]
    known = lm.Words(("the", "a"))
    n = known.numbers(ws)
    assert known.hashes[n].tolist() == [lm.hash_of(w) for w in ws]
    shared = {w: 32 * lm._class_of((w.rstrip(".,;:!?") or w)[-2:]) + (lm.hash_of(w) >> 40) % 32 for w in ws}
    assert known.leaves[n].tolist() == [{lm.END: 0, "the": 1, "a": 2}.get(w, shared[w]) for w in ws]
    assert (known.hashes[-1], known.leaves[-1]) == (1, 0)


def test_tally_of_more_tokens_than_a_pair_holds(monkeypatch):
    """All on one row, nearly sure of one class: its units would run into the next number."""
    monkeypatch.setattr(lm, "TOKENS", 5000)
    draw = np.random.default_rng(4)
    w = draw.normal(size=(64, 32)).astype("float32")
    w[7, [0, 16]] = 30, 29
    n = 12_000
    rows = [np.zeros(n, "int32"), np.where(np.arange(n) < 9000, 7, draw.integers(1, 64, n)).astype("int32")]
    want = draw.integers(0, 32, n)
    tally = lm.Tally(w)
    for i in range(0, n, 4100):
        tally.add([r[i : i + 4100] for r in rows], want[i : i + 4100])
    seen, expected = (x.reshape(64, 32) for x in tally.counts())
    seen2, expected2, units = np.zeros((64, 32), int), np.zeros((64, 32), int), lm.in_units(w, rows).T.astype(int)
    for r in rows:
        np.add.at(seen2, (r, want), 1)
        np.add.at(expected2, r, units)
    assert (seen == seen2).all() and (expected == expected2).all()


def test_counts_of_words_by_chunk(spark, monkeypatch):
    """Words of held-out texts count 0, of which a chunk may hold learnt ones too; no count is lost when rows are let go early."""
    monkeypatch.setattr(lm, "SLICE", 40)
    table = [(t, i % 3, i % 4 > 0) for i, t in enumerate(TEXTS * 30)]
    want: dict = {}
    for t, chunk, learn in table:
        for w in [*words(lower_ascii(t or "")), *[lm.END] * learn]:
            want[w, chunk] = want.get((w, chunk), 0) + learn
    got: dict = {}
    for r in lm.word_rows(spark.createDataFrame(table, "text string, chunk bigint, learn boolean").repartition(3)).collect():
        got[r["word"], r["chunk"]] = got.get((r["word"], r["chunk"]), 0) + r["n"]
    assert got == want
