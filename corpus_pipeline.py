"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of their input, other columns included. Null
texts and ids, repeated rows and empty tables pass through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepline.llm import jaccard, mixing, packing, pii, toxicity
from seepline.llm.rows import free_name
from seepline.llm.store import Written, cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents whose toxicity score is 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, model)


def _with_row_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the hash of the text and of the row's names, under free names."""
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    row = free_name(keyed, "row_key")
    return keyed.withColumn(row, F.xxhash64("doc_id", key)), key, row


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five-word shingles (80 of 100 or more), the one with the smallest id stays; documents without words all stay."""
    found = cut(jaccard.near_duplicates(docs, size=5, num=80, den=100), "duplicates")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    kept = found.where("component is not null").groupBy("component").agg(best).select("best.doc_id", "best.key", F.lit(True).alias("one"))
    blank = found.where("component is null").select("doc_id", "key", F.lit(False).alias("one")).distinct()
    chosen = kept.unionByName(blank).select(F.xxhash64("doc_id", "key").alias("chosen_row"), F.col("key").alias("chosen_key"), F.col("doc_id").alias("chosen_id"), "one")
    keyed, key, row = _with_row_key(docs)
    same = (keyed[row] == chosen["chosen_row"]) & (keyed[key] == chosen["chosen_key"]) & keyed["doc_id"].eqNullSafe(chosen["chosen_id"])
    place = free_name(keyed, "place")
    joined = keyed.join(chosen.select("chosen_row", "chosen_key", "chosen_id", F.col("one").alias(f"{place}_one")), same)
    numbered = joined.withColumn(place, F.row_number().over(Window.partitionBy(row, key, "doc_id").orderBy(F.lit(0))))
    return numbered.where(~F.col(f"{place}_one") | (F.col(place) == 1)).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind, and counts the characters anew."""
    found = Written(pii.spans(docs), "spans")
    model = pii.learn(found.df)
    found.drop()
    done = pii.redact(docs, model)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reaches it (one cut by the budget is kept whole). Documents without words are no part of a mix."""
    keyed, key, row = _with_row_key(docs)
    mixed = mixing.mix(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    counts = mixed.groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    given = counts.select(
        F.xxhash64("doc_id", "key").alias("mixed_row"), F.col("key").alias("mixed_key"), F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), "copies", "rows"
    )
    place = free_name(keyed, "place")
    given = given.withColumnRenamed("copies", f"{place}_copies").withColumnRenamed("rows", f"{place}_rows")
    same = (
        (keyed[row] == given["mixed_row"])
        & (keyed[key] == given["mixed_key"])
        & keyed["doc_id"].eqNullSafe(given["mixed_id"])
        & keyed["source"].cast("string").eqNullSafe(given["mixed_source"])
    )
    joined = keyed.join(given, same)
    # equal rows share their copies as evenly as whole numbers allow
    own = Window.partitionBy(row, key, "doc_id", "source").orderBy(F.lit(0))
    numbered = joined.withColumn(place, F.row_number().over(own))
    each = F.expr(f"`{place}_copies` div `{place}_rows`") + (F.col(place) <= F.col(f"{place}_copies") % F.col(f"{place}_rows")).cast("int")
    return numbered.withColumn(place, F.explode(F.array_repeat(F.lit(0), each.cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with where they come from."""
    return packing.pack(docs).select("sequence_id", "length", "ids", "doc_id", "start", "ids_crc32", "doc_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression lengths, personal data, hash joins and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        written = Written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
