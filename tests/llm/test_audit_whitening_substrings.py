"""Filter audit, whitening and removal of passages against brute force, with every awkward case."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import filter_audit, whitening
from tallymark.llm import substring_dedup as sd
from tallymark.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["part", "mask", "rows", "good", "toxic", "doc", "key", "anchor", "start", "marks", "piece", "x", "n", "component"]


def with_clashes(df):
    return df.selectExpr("*", *[f"'clash' AS {c}" for c in CLASHING])


def passages():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("alpha Beta gámma delta, epsilon. ζeta eta theta iota kappa".split()) for _ in range(n))
    shared, other = [f"p{i}" for i in range(30)], " ".join(f"q{i}" for i in range(13))
    rows = [(i, say(r.choice([1, 5, 13, 40])), "en", f"src{i % 3}", 0) for i in range(30)]
    rows += [(100 + i, f"{say(5)} {' '.join(shared[i % 4 : 20 + i % 9])} {say(6)}", "en", "hot", 0) for i in range(60)]  # a passage of many documents
    rows += [(200, other, "en", None, 0), (199, f"x {other} y", "en", "", 0), (201, other.replace("q5", "Q5"), "en", "s", 0), (202, other.replace(" ", "\n\t "), "en", "s", 0)]
    rows += [(203, "a " * 400, "en", "s", 0), (204, "a " * 13, "en", "s", 0), (205, say(3000), "en", "s", 0), (206, None, "en", "s", 0), (207, "", None, None, 0), (208, " \t\n", "en", "s", 0)]
    rows += [(None, other, "en", "s", 0), (209, rows[40][1], "en", "s", 0), (209, rows[40][1], "en", "s", 0), (209, other, "en", "s", 0), (-7, "z " + other, "en", "s", 0), (210, rows[-1][1], "en", "s", 0)]
    return rows


def cut(rows, window=13):
    """Brute force: (id, words, removed, kept)."""
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("shard", "places"), [(sd.SHARD, sd.PLACES), (40, 2)])
def test_passages(spark, shard, places):
    """Also where nearly every anchor exceeds its shard and its places travel apart."""
    df = with_clashes(spark.createDataFrame(passages(), SCHEMA).repartition(3))
    got = [tuple(r) for r in sd.dedup(df, shard=shard, places=places).collect()]
    assert sorted(got, key=repr) == sorted(cut(passages()), key=repr)


def test_no_passages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sd.dedup(none).count() == 0
    short = spark.createDataFrame([(1, "a b", "", "", 0)], SCHEMA)
    assert [tuple(r) for r in sd.dedup(short).collect()] == [(1, 2, 0, "a b")]
    with pytest.raises(ValueError, match="60"):
        sd.dedup(none, window=61)


def test_matching_statistics():
    """Streams that the index holds and others, against a search of the text."""
    r = np.random.default_rng(1)
    for _ in range(60):
        depth, kinds = int(r.integers(1, 7)), int(r.integers(1, 5))
        held = [r.integers(1, kinds + 1, r.integers(0, 20)) for _ in range(r.integers(1, 6))]
        text = np.concatenate([np.r_[s, 0] for s in held]).astype(np.int64)
        streams = [r.integers(1, kinds + 2, r.integers(0, 15)) for _ in range(5)] + held
        width = max(1, *map(len, streams))
        rows = np.zeros((len(streams), width), dtype=np.int64)
        for i, s in enumerate(streams):
            rows[i, width - len(s) :] = s
        index = FMIndex(text, depth)
        found, ranks = index.matching_statistics(rows, np.array([len(s) for s in streams]))
        inside = lambda p: any((text[j : j + len(p)] == p).all() for j in range(len(text) - len(p) + 1))
        for i, s in enumerate(streams):
            for j in range(len(s)):
                best = max([0] + [n for n in range(1, min(depth, len(s) - j) + 1) if inside(s[j : j + n])])
                assert found[i, width - len(s) + j] == best
                at = index.order[ranks[i, width - len(s) + j]]
                assert (text[at : at + best] == s[j : j + best]).all()


# --- filters --------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    """Brute force: each order applied to the rows, one filter after the other."""
    words = [WORD.findall(r[1] or "") for r in rows]
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    fails = []
    for r, w in zip(rows, words, strict=True):
        t = r[1] or ""
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        fails.append({x for x, bad in tests.items() if bad})
    marks = lambda i, k: any(x[k] == 1 for x in labels if x[0] == i and i is not None)
    out = []
    for part in {r[3] or "" for r in rows}:
        own = [(f, marks(r[0], 1), marks(r[0], 2)) for r, f in zip(rows, fails, strict=True) if (r[3] or "") == part]
        lines, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left, before = list(own), set()
            for step, x in enumerate(order, 1):
                gone = [o for o in left if x in o[0]]
                left = [o for o in left if x not in o[0]]
                total[x] += len(gone)
                lines.append((x, ("".join(order), step, len(left), len(gone), sum(x in o[0] and bool(before & o[0]) for o in own), sum(o[0] == {x} for o in own), sum(o[1] for o in gone), sum(o[2] for o in gone))))
                before.add(x)
        out += [(part, *line, total[x]) for x, line in lines]
    return sorted(out)


def documents():
    long = " ".join(f"w{i}" for i in range(220))
    rows = [(i, long if i % 3 else f"{long} Q", "en", f"s{i % 2}", 0) for i in range(12)]
    rows += [(20, "A B C", "en", None, 0), (21, "a $ b", "en", "", 0), (22, None, "en", "s0", 0), (23, "", "en", "s0", 0), (24, "é " * 300, "en", "s1", 0), (25, "SHOUT " * 250, "en", "s1", 0)]
    rows += [(None, long, "en", "s0", 0), (None, "lone", "en", None, 0), (5, long, "en", "s0", 0), (5, long, "en", "s1", 0), (1, long, "en", "s0", 0), (-3, f"{long} Q", "en", "s0", 0), (30, long + " | " + long * 20, "en", "s0", 0)]
    return rows, [(1, 1, 0), (1, 0, 1), (5, 1, 1), (20, None, 1), (21, 1, None), (None, 1, 1), (999, 1, 1), (24, 1, 0)]


@pytest.mark.parametrize("held", [filter_audit.HELD, 300])
def test_filters_in_all_orders(spark, held, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", held)
    rows, labels = documents()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, labels)


def test_colliding_fingerprints():
    """Texts of one fingerprint are told apart by their full text."""
    pairs = [(7, (5, 1, Counter("a"), "one")), (7, (3, 2, Counter("a"), "two")), (7, (4, 1, Counter("b"), "one")), (7, (4, 1, Counter("b"), "one")), (7, (9, "x", 16, 2))]
    assert sorted(filter_audit._chains(16)(pairs)) == [(3, "a", 2, 1), (4, "b", 1, 2), (5, "a", 17, 1), (9, "x", 16, 2)]


def test_filters_of_no_rows_and_of_ones_own(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    df = spark.createDataFrame([(1, "ab", "", "s", 0), (2, "b", "", "s", 0)], SCHEMA)
    got = filter_audit.audit(df, labels, {"Z": lambda t: "a" in t}).select("filter_order", "step", "kept", "removed").collect()
    assert sorted(map(tuple, got)) == [("EZ", 1, 2, 0), ("EZ", 2, 1, 1), ("ZE", 1, 1, 1), ("ZE", 2, 1, 0)]
    with pytest.raises(ValueError, match="too many"):
        filter_audit.audit(df, labels, dict.fromkeys("PQRSTU", bool))


def test_a_text_of_a_third_of_all_rows(spark):
    """Copies are merged before they are routed: no task gets many rows of one text."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}", "en", "s", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    judged = df.select("doc_id", "text", F.col("source").alias("part")).rdd.mapPartitions(filter_audit._judge(filter_audit.FILTERS))
    texts = Counter(v[3] for _, v in judged.collect() if isinstance(v[3], str))
    assert texts["the same text"] == 6 and max(texts.values()) == 6
    decided = judged.filter(lambda kv: not isinstance(kv[1][3], str)).map(lambda kv: kv[0] % 6).countByValue()
    assert max(decided.values()) < 2 * min(decided.values())


# --- whitening ------------------------------------------------------------------------------------------------------


def embeddings(n=120, width=5):
    r = np.random.default_rng(3)
    v = r.normal(size=(n, width)) @ np.diag(np.arange(1, width + 1)) * 0.1
    rows = [(i, [float(np.float32(c)) for c in x], 0) for i, x in enumerate(v)]
    rows += [(500, None, 0), (501, [0.1, None, 0.2, 0.3, 0.4], 0), (502, [0.1, float("nan"), 0.2, 0.3, 0.4], 0), (503, [float("inf")] * 5, 0), (504, [0.5, 0.5], 0), (505, [], 0)]
    return rows + [(None, rows[0][1], 0), (3, rows[3][1], 0)] + [(600 + i, rows[7][1], 0) for i in range(60)] + [(700, [-0.0, 0.0, -0.001, 1 / 256, -1.0], 0)]


def test_whitening(spark):
    rows = embeddings()
    df = with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5))
    got = whitening.whiten(df).collect()
    valid = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, _ in rows if v is not None and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in valid]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    e, w = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, w = e[::-1], w[:, ::-1]
    sign = {}
    assert len(got) == 4 * len(valid) and {r["n"] for r in got} == {n}
    want = Counter((i, int(((n * x - total) ** 2).sum())) for i, x in valid)
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    by_id = {i: (x - total / n) @ w[:, :4] / np.sqrt(e[:4]) for i, x in valid}
    for r in got:
        y, k = by_id[r["vec_id"]], r["component"] - 1
        sign.setdefault(k, np.sign(r["whitened"]) * np.sign(y[k]))
        assert r["whitened"] == pytest.approx(sign[k] * y[k], abs=1e-9)
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    of = lambda rows: [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, schema)).orderBy("vec_id", "component").collect()]
    assert of([]) == [] and of([(1, None), (2, [])]) == []
    assert of([(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    flat = of([(1, [0.5, 0.0]), (2, [0.25, 0.0])])
    assert [(r[0], r[1], abs(r[4]) if r[4] is not None else None, r[5]) for r in flat] == [(1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]
    assert all(r[6] < 1e-12 for r in flat)


def test_whitening_of_huge_entries(spark):
    """Deviations are exact as far as 64-bit integers go, and null beyond."""
    rows = [(1, [1e6]), (2, [3e6]), (3, [1e16]), (4, [-1e300])]
    of = lambda rows: {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert of(rows[:2]) == {1: (256 * 2 * 10**6) ** 2, 2: (256 * 2 * 10**6) ** 2}
    assert set(of(rows).values()) == {None}


def test_chan_merge():
    r = np.random.default_rng(5)
    x = r.integers(-300, 300, (1000, 6)) + 10**9
    whole, parts = whitening.moments(x), [whitening.moments(p) for p in np.array_split(x, [1, 2, 50, 600])]
    for order in (parts, parts[::-1]):
        m = order[0]
        for p in order[1:]:
            m = whitening.merge(m, p)
        assert m.n == 1000 and m.sums == [int(s) for s in x.sum(axis=0)] == whole.sums
        assert np.allclose(m.scatter, 1000 * np.cov(x.T.astype(float), bias=True), rtol=1e-12)
