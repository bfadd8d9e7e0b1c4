"""The pipeline's stages against brute force over what each was given."""

import re
from collections import Counter

import numpy as np
import pytest
from odd_documents import odd_rows
from pyspark.sql import functions as F
from test_texts import base_spans, brute_components

import corpus_pipeline
from seepline.llm import packing, pii, toxicity, vocabulary
from seepline.llm.store import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, SF), name)
        out.append((docs, made))
        docs = made
    return out


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = stages[0]
    model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    want = Counter(r.doc_id for r in toxicity.score(before, model, "s").collect() if r.s < 0.5)
    assert Counter(r.doc_id for r in after.collect()) == want


def test_one_document_of_each_component_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = sorted(i for i, _, low in brute_components(rows, 5, 80) if i == low)
    assert sorted(str(r.doc_id) for r in after.collect()) == want


def test_base_spans_are_gone(stages):
    before, after = stages[2]
    given = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        text = given[r.doc_id].text
        if base_spans(text):
            assert not [s for s in base_spans(r.text) if s[0] in ("email", "phone")] and re.search("<(email|ip|card|phone)>", r.text)
        elif not pii.candidates(text)[1]:
            assert r.text == text
        assert r.n_chars == len(r.text)
    assert after.count() == before.count()


def test_mixing_repeats_whole_documents(stages):
    before, after = stages[3]
    given = {r.doc_id: r for r in before.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 2 and all(r == given[r.doc_id] for r in after.collect())
    words = {i: len((r.text or "").split()) for i, r in given.items()}
    assert abs(sum(words[i] * n for i, n in times.items()) - 1.5 * sum(words.values())) <= max(words.values())


def test_sequences_hold_all_ids(stages):
    before, after = stages[4]
    encoder = vocabulary.encoder(vocabulary.word_file())
    want = Counter()
    for r in before.collect():
        ids, at = np.append(encoder.encode([r.text])[0], 2).astype("<u4"), 0
        for n in packing.binary_parts(len(ids), 4096):
            want[ids[at : at + n].tobytes()] += 1
            at += n
    rows = after.collect()
    assert Counter(bytes(r.ids) for r in rows) == want and len({r.sequence_id for r in rows}) == len(rows)


def test_run_gives_what_the_stages_give(spark, stages):
    key = lambda r: (r.sequence_id, r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1][1].collect()))


def test_odd_documents(spark, odd):
    docs = odd
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, SF), "odd")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert made.columns == odd.columns
        counts.append(made.count())
        docs = made
    assert counts[0] == len(odd_rows()) and counts[2] == counts[1] and counts[4] > 0


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b c", "s", 5)] * 3 + [(2, "d e", "s", 3), (3, "f", "t", 1), (4, None, "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).groupBy("doc_id").count().where("count > 1").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.where("doc_id = 1").count() <= 6 and mixed.where("doc_id = 4").count() == 0


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "none")
        assert docs.count() == 0
