"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chat, importance, jaccard, mixing, negatives, packing, parsing, passages, pii, store, topk, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_folder(spark, "wavelet")
    wavelet.write_shards(table(spark, sf_dir, "documents"), folder)
    read = wavelet.read_documents(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    out = chat.conversations(chat.turns(given.unionByName(added))).withColumn("whole", chat.formatted(F.col("segments")))
    loss = chat.under_loss(F.col("segments"))
    told = F.array_join(F.transform(chat.read_back(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size(chat.read_back(F.col("whole"))).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("whole").cast("long").alias("formatted_chars"),
    )


ORACLES["op3_chat"] = chat.SQL


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_mixing"] = mixing.SQL


@query
def op4_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op10_topk"] = topk.SQL


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.cut(pii.spans(table(spark, sf_dir, "documents")), "pii")
    out = pii.decided(found, pii.learn(found)).withColumn("all", F.concat("base", "added"))

    def listed(column: str):
        order = F.array_sort(F.transform(column, lambda s: F.struct(F.array_position(F.lit(list(pii.KINDS)), s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


@query
def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.edited_neighbours(table(spark, sf_dir, "documents"))


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.without_repeats(table(spark, sf_dir, "documents"), least=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_passages"] = passages.SQL


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op12_negatives"] = negatives.SQL


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance"] = importance.SQL
