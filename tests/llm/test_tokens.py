"""Encoder, packing, wavelet shards and attribution against the libraries and brute force."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seepline.llm import attribution, packing, store, vocabulary, wavelet

from odd_documents import odd_rows, prose


def whole(text):
    return np.array(vocabulary.encoder(vocabulary.word_file()).tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)


def parted(texts):
    ids, bounds = vocabulary.encoder(vocabulary.word_file()).encode(texts)
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbzÉßà'sdmt 1.9,<|>\t\n\x0b\x1c\x85\xa0²ªΣİ日😀̈")), max_size=40), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for own, text in zip(parted(texts), texts, strict=True):
        assert np.array_equal(own, whole(text)), text


def test_long_texts_and_special_strings():
    texts = [prose(5, 400_000), "a<|endoftext|>b <|ENDOFTEXT|>", None, "don't I'LL"]
    for own, text in zip(parted(texts), texts, strict=True):
        assert np.array_equal(own, whole(text))


def test_memory_starts_anew():
    small = vocabulary.WordEncoder(vocabulary.word_file(), most=10)
    for k in range(5):
        text = prose(k, 50)
        assert np.array_equal(small.encode([text])[0], whole(text))


@given(st.integers(0, 100_000))
def test_binary_parts(n):
    parts = packing.binary_parts(n, 4096)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 4096 for p in parts)
    assert len(set(p for p in parts if p < 4096)) == sum(p < 4096 for p in parts)


def test_packing_covers_each_id_once(odd):
    rows = packing.pack(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.offset == 0 and r.length == 1 << r.bucket and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.doc_tokens, r.start, r.length, bytes(r.ids)))
    want = {}
    for doc_id, text, *_ in odd_rows():
        ids, at = np.append(whole(text), 2).astype("<u4"), 0
        for n in packing.binary_parts(len(ids), 4096):
            want.setdefault(doc_id, []).append((len(ids), at, n, ids[at : at + n].tobytes()))
            at += n
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_buckets_are_written_by_length(spark, odd):
    folder = store.new_folder(spark, "test")
    packing.write_buckets(packing.pack(odd), folder)
    assert spark.read.parquet(folder).count() == packing.pack(odd).count()


def test_empty_tables(spark, empty):
    assert packing.pack(empty).count() == 0 and attribution.attribute(empty).count() == 0
    folder = store.new_folder(spark, "test")
    assert wavelet.write_shards(empty, folder).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_wavelet_matrix(ids):
    held = np.array(ids, np.uint32)
    shard = wavelet.Shard(wavelet.build(held, np.ma.masked_array([7], [False]), np.array([len(ids)])))
    assert np.array_equal(shard.ids(), held)
    for i in range(0, len(ids), 7):
        assert shard.access(i) == ids[i]
    for token in {*ids[:5], 3, 99_999_999}:
        places = [i for i, t in enumerate(ids) if t == token]
        assert shard.count(token) == len(places) and shard.count(token, 2, 9) == sum(2 <= p < 9 for p in places)
        assert [shard.select(token, k) for k in range(len(places))] == places and shard.select(token, len(places)) is None


def test_wavelet_matrix_of_several_blocks():
    ids = np.random.default_rng(1).integers(0, 300, 200_000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.build(ids, np.ma.masked_array([1], [False]), np.array([len(ids)])))
    places = np.flatnonzero(ids == 17)
    assert shard.count(17, 60_000, 150_000) == ((places >= 60_000) & (places < 150_000)).sum()
    assert [shard.select(17, k) for k in (0, 100, len(places) - 1)] == [places[0], places[100], places[-1]]
    assert [shard.access(i) for i in (0, 65_535, 65_536, 199_999)] == ids[[0, 65_535, 65_536, 199_999]].tolist()


def test_shards_hold_all_documents_in_order(spark, odd, monkeypatch):
    folder = store.new_folder(spark, "test")
    manifest = wavelet.write_shards(odd, folder)
    rows = sorted(wavelet.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert manifest.agg({"docs": "sum"}).first()[0] == len(rows) == len(odd_rows())
    want = sorted((-1 if i is None else i, np.append(whole(t), 2).astype("<u4").tobytes()) for i, t, *_ in odd_rows())
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in rows) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    token = int(whole("mail")[0])
    found = wavelet.occurrences(spark, folder, token).collect()
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4")
    assert sorted(r.place for r in found) == np.flatnonzero(stream == token).tolist()


def test_query_8_equals_whole_encoding(spark):
    from seepline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got, at = {r.doc_id: r for r in QUERIES["op8_wavelet"](spark, sf).collect()}, 0
    pieces = {}
    for r in QUERIES["op1_packing"](spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = np.append(whole(text), 2).astype("<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        for p in pieces[doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in pieces[doc_id]) == len(ids)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_against_single_tokens(rule):
    encoding, lengths = attribution.vocabulary(attribution.byte_file())
    text = "Ein Absatz\nnoch einer, länger 日本\n\n\nEnde"
    data = text.encode()
    ids = encoding.encode_ordinary(text)
    bounds = [0] + [i + 1 for i, c in enumerate(data) if c == 10] + [len(data)]
    want, at = [0.0] * (len(bounds) - 1), 0
    for k in ids:
        own = [max(0, min(at + lengths[k], bounds[s + 1]) - max(at, bounds[s])) for s in range(len(want))]
        held = [s for s, n in enumerate(own) if n]
        if rule == "share":
            for s in held:
                want[s] += own[s] / lengths[k]
        else:
            want[held[0] if rule == "start" else held[-1] if rule == "end" else own.index(max(own))] += 1
        at += lengths[k]
    got = attribution.allocate(np.cumsum(lengths[ids]), np.array(bounds), rule)
    assert np.allclose(got, want) and abs(got.sum() - len(ids)) < 1e-9


def test_attribution_of_documents(odd):
    encoding, _ = attribution.vocabulary(attribution.byte_file())
    rows = attribution.attribute(odd).collect()
    total = sum(len(encoding.encode_ordinary("\n".join(x or "" for x in (s, lang, t)) + "\n")) for _, t, lang, s, _ in odd_rows())
    assert sum(r.n_tokens for r in rows) == total
    assert {r.field for r in rows} == {"source", "lang", "text"}
    nine = sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.start)
    assert [r.n_chars for r in nine] == [2, 3, len(odd_rows()[-1][1]) + 1] and [r.start for r in nine] == [0, 2, 5]
