"""Repeated passages, hard negatives and importance resampling against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from odd_documents import odd_rows
from pyspark.sql import functions as F

from seepline.llm import importance, negatives, passages, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_passages", "op12_negatives", "op13_importance"])
def test_queries_equal_their_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        base.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), base.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(got.select(*want.columns).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)) == Counter(want.fetchall())


# repeated passages


def brute_passages(rows, least):
    """rows: (doc_id, key, text). Result of each row, in order."""
    documents = {(i is None, i or 0, k): WORD.findall(t or "") for i, k, t in rows}
    seen, gone = set(), defaultdict(set)
    for name in sorted(documents):
        w = documents[name]
        for s in range(len(w) - least + 1):
            window = tuple(w[s : s + least])
            if window in seen:
                gone[name].update(range(s, s + least))
            seen.add(window)
    out = []
    for i, k, _ in rows:
        name = (i is None, i or 0, k)
        w = documents[name]
        out.append((i, len(w), len(gone[name]), " ".join(x for j, x in enumerate(w) if j not in gone[name])))
    return out


def given(docs):
    return [(r.doc_id, r.key, r.text) for r in docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text").collect()]


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def check_passages(docs, least):
    assert order(passages.without_repeats(docs, least).collect()) == order(brute_passages(given(docs), least))


@pytest.mark.parametrize("least", [1, 4, 5, 20, 33])
def test_passages_against_brute_force(spark, least):
    r = random.Random(least)
    shared = [[f"s{k}_{j}" for j in range(r.randint(1, 70))] for k in range(6)]
    rows = []
    for i in range(60):
        w = []
        while len(w) < 100:
            w += r.choice(shared) if r.random() < 0.5 else [r.choice("abcd") for _ in range(r.randint(1, 9))]
        rows.append((i if i % 9 else None, r.choice([" ", "  ", "\n"]).join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_passages(docs, least)


def test_periodic_text(spark):
    rows = [(1, " ".join(["a"] * 200)), (2, " ".join(["a", "b"] * 60)), (3, " ".join(["b", "a"] * 60 + ["c"])), (4, "a " * 19), (5, "a " * 20)]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string"), 20)


def test_many_contexts_of_one_anchor(spark):
    rows = [(i, " ".join([f"l{i}", *(f"x{j}" for j in range(19 + i % 3)), f"r{i % 40}"])) for i in range(400)]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 20)


def test_odd_passages(spark, odd, empty):
    check_passages(odd, 20)
    check_passages(odd, 3)
    assert passages.without_repeats(empty).count() == 0


def test_covers_hold_every_difference():
    for period, cover in passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# hard negatives


def brute_negatives(rows, is_anchor, k=5, window=(80, 100, 100), scale=256.0):
    """rows: (id, label, vector)."""
    sound = [(i, lab, [math.floor(x * scale) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v)]
    out = []
    for i, lab, v in sorted({(i, lab, tuple(v)) for i, lab, v in sound if is_anchor(i)}):
        score = [(min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), j, own == lab) for j, own, w in sound if j != i]
        ranked = sorted(score, key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in ranked if x[2]][:k]:
            fits = [x for x in ranked if not x[2] and window[0] * p <= window[2] * x[0] <= window[1] * p][:k]
            out += [(i, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(fits)]
    return order(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)


def run_negatives(spark, rows, anchor=10, **more):
    found = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % anchor == 0, F.col("label"), **more)
    return order(found.collect())


@pytest.mark.parametrize("kind", ["dense", "ties", "few", "sparse"])
def test_negatives_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "BYTES", 4096)
    r = np.random.default_rng(len(kind))
    values = {"dense": lambda: r.normal(size=12) / 3, "ties": lambda: r.integers(-1, 2, 6).astype(float), "few": lambda: np.abs(r.normal(size=3)), "sparse": lambda: r.normal(size=40) * (r.random(40) < 0.1)}[kind]
    rows = [(i, int(r.integers(0, 1 if i > 250 else 4)), [float(x) for x in values()]) for i in range(300)]
    assert run_negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 1, [0.7]), (3, 2, [1.0, 0.4, 9.0]), (4, 2, [1.0, 0.5]), (4, 2, [1.0, 0.5])]
    rows += [(5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, None, [1.0, 1.0]), (8, 2, None), (9, 2, [None, 1.0]), (None, 2, [1.0, 0.5]), (10, 3, []), (11, 3, []), (12, 4, [0.0, 0.0]), (13, 4, [-0.001, 1e307])]
    assert run_negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("size", [1e7, 1e17, 1e300])
def test_large_components(spark, size):
    r = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in np.round(r.normal(size=4), 1) * size]) for i in range(60)]
    assert run_negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_no_vectors(spark):
    assert run_negatives(spark, []) == []
    assert run_negatives(spark, [(0, None, [1.0]), (1, 1, None)]) == []


def test_index_omits_and_loses_nothing():
    r = np.random.default_rng(5)
    values = r.normal(size=(500, 24)) * np.linspace(0.2, 2, 24)
    heads = negatives.head_norms(values)
    for threshold in (2.0, 8.0, 20.0):
        w = r.normal(size=24)
        norms = negatives.head_norms(w[None, :])[0]
        index = negatives.Index(values, heads, threshold / norms[-1])
        assert index.counts.sum() < values.size
        assert set(np.flatnonzero(values @ w >= threshold)) <= set(index.reach(w, norms, threshold).tolist())


# importance resampling


def brute_importance(rows, target, percent=10, runs=1):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def read(text):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(read(text)[1])
    for text in target:
        t.update(read(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    scored = []
    for i, text in rows:
        w, b = read(text)
        gain = [math.floor(1000 * math.log((t[x] + 1) * (n_s + 10000) / ((s[x] + 1) * (n_t + 10000)))) for x in b]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(w), len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = len(enough) * percent // 100
    return order([(*x, k + 1 if k < drawn else None) for k, x in enumerate(enough)] + [(*x, None) for x in scored if x[1] < 20])


@pytest.mark.parametrize("percent, runs", [(10, 1), (60, 2), (100, 3)])
def test_importance_against_brute_force(spark, odd, percent, runs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([(rows[0][1],), ("mail an the or",), (None,), ("",)], "text string")
    want = brute_importance(rows, [r.text for r in target.collect()], percent, runs)
    assert order(importance.resample(odd, target, percent, runs=runs).collect()) == want


def test_importance_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    assert importance.resample(odd, none).count() == len(odd_rows())
    assert order(importance.resample(odd, none).collect()) == brute_importance([(r.doc_id, r.text) for r in odd.collect()], [])


def test_matrices_give_the_crc():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 3, 7, 64, 65, 900]))) for _ in range(500)]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    assert importance.crc32s(data, ends - [len(p) for p in parts], ends).tolist() == [zlib.crc32(p) for p in parts]
