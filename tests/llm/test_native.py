"""Mixing, chat formatting and top-k search."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from seepline.llm import chat, mixing, topk
from seepline.llm.queries import ORACLES, QUERIES
from workload.compare import compare, connect

from odd_documents import odd_rows, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, text = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, text


def targets(sizes, weights=(5, 2, 1)):
    """The contract's own words: deal by weight, stop at twice the size, deal the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return got | share
        for s in over:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def test_mix_meets_targets(spark, odd):
    rows = mixing.mix(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    sizes = {}
    for _, t, _, s, _ in odd_rows():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) == math.floor(1.5 * sum(sizes.values()))


def test_mix_is_near_its_targets_and_agrees_on_reruns(spark):
    docs = spark.createDataFrame([(k, prose(k, 5 + k % 40), f"s{k % 7 if k % 3 else 0}") for k in range(600)], "doc_id long, text string, source string")
    a = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert a == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    rows = mixing.mix(docs).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 45


def test_stream_is_in_order_of_virtual_time(spark):
    docs = spark.createDataFrame([(k, prose(k, 1 + k % 9), f"s{k % 3}") for k in range(90)], "doc_id long, text string, source string")
    rows = sorted((r for r in mixing.queue(docs).collect() if r.size), key=lambda r: r.begin)
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    at = 0
    for r in rows:
        assert r.begin == at
        at += r.size


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(none).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


ODD_TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "\\s\\l\\n <turn>user\n</turn>\n"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "assistant", "again"),
    (3, None, None, None), (3, 5, "us\ner<\\", "x"), (3, 5, "us\ner<\\", "x"),
    (None, 0, "user", "no id"), (4, 0, "system", "s"), (4, 1, "user", "u" * 100_000), (4, 2, "assistant", "日本😀"),
]


def test_chat_round_trip(spark):
    given = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("place", F.lit(2)).repartition(4)
    out = chat.conversations(chat.turns(given)).withColumn("whole", chat.formatted(F.col("segments")))
    rows = out.select("conv_id", "n_turns", "valid", "first_fault", "whole", "segments", chat.read_back(F.col("whole")).alias("back"), chat.under_loss(F.col("segments")).alias("loss")).collect()
    by = {r.conv_id: r for r in rows}
    for c in {t[0] for t in ODD_TURNS}:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in ODD_TURNS if t[0] == c))
        assert [(b.role, b.text) for b in by[c].back] == [t[1:] for t in own] and by[c].n_turns == len(own)
        assert by[c].loss == "".join(t[2] for t in own if t[1] == "assistant")
    assert by[1].valid and by[4].valid and not by[2].valid and by[2].first_fault == 1 and not by[None].valid and not by[3].valid
    assert by[1].whole.count("</turn>") == 4


def test_chat_machine_and_own_template(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "bot", "a"), (2, 0, "bot", "a"), (2, 1, "bot", "b")], "conv_id long, turn long, role string, text string")
    own = chat.Template(
        segments={"bot": (chat.Segment("<{role}>"), chat.Segment("{text}$", loss=True))}, unknown=(chat.Segment("[{text}]"),), steps=(("start", "user"), ("user", "bot"), ("start", "bot")), last=("bot",)
    )
    rows = {r.conv_id: r for r in chat.conversations(chat.turns(turns, own)).collect()}
    assert [(s.text, s.loss) for s in rows[1].segments] == [("[q]", False), ("<bot>", False), ("a$", True)]
    assert rows[1].valid and rows[2].first_fault == 2
    assert chat.conversations(chat.turns(turns.where("false"))).count() == 0


def test_chat_added_conversation(spark):
    r = QUERIES["op3_chat"](spark, SF).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_top_k_against_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    r = __import__("random").Random(4)
    rows = [(k, [r.uniform(-1, 1) if r.random() < 0.7 else 0.0 for _ in range(8)]) for k in range(300)]
    rows += [(k, [0.5] * 8) for k in range(300, 320)]  # ties
    rows += [(320, None), (321, [None] + [0.1] * 7), (322, [nan] * 8), (323, [inf] * 8), (None, [0.9] * 8), (350, [0.3] * 5), (400, []), (301, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1)).repartition(5)
    sound = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            import numpy as np

            sound.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    want = set()
    for q, a in sound:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert len(topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()) == 2


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e150, 2.0]), (1, [1e150, 3.0]), (2, [-1e150, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    most = 2**63 - 1
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, most), (0, 2, 3, most), (0, 3, 2, -most - 1)]


def test_top_k_of_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 2)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), *((k, [k / 8, 1 - k / 8]) for k in range(1, 9)), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect())
    first = [(0, 1, 8, 65536), (0, 2, 9, 65536), (0, 3, 9, 65536), (0, 4, 7, 57344), (0, 5, 6, 49152)]
    second = [(0, 1, 1, 57344), (0, 2, 2, 49152), (0, 3, 3, 40960), (0, 4, 4, 32768), (0, 5, 5, 24576)]
    assert got == sorted(first + second)


def test_top_k_sql_with_repeated_queries(spark, tmp_path):
    rows = [(50, [0.5, 0.25]), (50, [0.5, 0.25]), (0, [0.1, 0.9]), *((k, [k / 40, 0.3]) for k in range(1, 12)), (3, [3 / 40, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings")
    base = __import__("duckdb").connect()
    base.sql(f"create view embeddings as select * from '{tmp_path}/embeddings/*.parquet'")
    assert sorted(base.sql(topk.SQL).fetchall()) == sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
