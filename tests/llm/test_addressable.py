"""Directly addressable codes: exact round trips, random access, and the store against the tokenizer."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmart.llm import addressable as A
from evalmart.llm import spans
from tests.llm.conftest import DOCUMENTS, frame

TEXTS = ["Don't STOP  it's\t\n a\x0bb\x1cc", "a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "é e ́x ΣΣ Σς", "　 x y\x85z", "\U0001f600中文 123 4.5", "'S 'LL", "İẞ ﬁ", "a​b"]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_round_trip_and_random_access(values):
    ids = np.array(values, np.uint32)
    codes = A.Codes(A.encode(ids))
    assert np.array_equal(codes.all(), ids)
    places = np.random.default_rng(1).permutation(len(ids))[:200]
    assert np.array_equal(codes.at(places), ids[places])


def test_many_blocks():
    ids = np.random.default_rng(2).zipf(1.3, 30_000).clip(0, 49_407).astype(np.uint32)
    raw = A.encode(ids)
    assert len(A.Codes(raw).levels) > 1 and len(raw) < 2 * len(ids)
    assert np.array_equal(A.Codes(raw).all(), ids) and np.array_equal(A.Codes(raw).at(np.arange(len(ids))), ids)
    with pytest.raises(IndexError):
        A.Codes(raw).at(np.array([len(ids)]))


def test_widths_are_the_cheapest():
    ids = np.array([1] * 900 + [200] * 60 + [40_000] * 40, np.uint32)

    def cost(widths):
        total, low = 0.0, 0
        for k, w in enumerate(widths):
            reach = len(ids) if low == 0 else int((A.bit_lengths(ids) > low).sum())
            total += reach * (w + ((1 + 32 / A.BLOCK_BITS) if k + 1 < len(widths) else 0))
            low += w
        return total

    def splits(n):
        return [[n], *([k, *rest] for k in range(1, n) for rest in splits(n - k))]

    assert cost(A.cheapest_widths(ids)) == pytest.approx(min(cost(w) for w in splits(16)))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=50))
def test_any_text_falls_apart_into_words(text):
    tokenizer = spans.tokenizer(spans.vocabulary_path(A.VOCABULARY))
    parts = [i for w in text.translate({c: " " for c in range(9, 14)}).split(" ") for i in tokenizer.encode(w, add_special_tokens=False).ids]
    assert parts == tokenizer.encode(text, add_special_tokens=False).ids


WORDS = st.text(st.sampled_from("aAbzÄßñÿ×÷.,!?'s1<|"), max_size=8)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(WORDS, st.sampled_from(["The", "the.", "THE?!", "<|endoftext|>", "<|ENDOFTEXT|>", "don't"])), max_size=30))
def test_words_have_the_ids_of_the_tokenizer(words):
    words = [w for w in words if w]
    path = spans.vocabulary_path(A.VOCABULARY)
    store, tokenizer = A.WordIds(path), spans.tokenizer(path)
    for _ in range(2):
        starts, sizes = store.lookup(words)
        for w, a, n in zip(words, starts, sizes, strict=True):
            assert store.flat[a : a + n].tolist() == tokenizer.encode(w, add_special_tokens=False).ids


def test_store_remembers_pieces_not_words():
    words = ["The", "the.", "THE?!", "the", "other.", "a" + "." * 30, "İ.", "É!"]
    path = spans.vocabulary_path(A.VOCABULARY)
    store, tokenizer = A.WordIds(path), spans.tokenizer(path)
    for _ in range(2):
        starts, sizes = store.lookup(words)
        assert [store.flat[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert sorted(store.at) == sorted(["the", "other", "é", ".", "?!", "!", "a" + "." * 30, "İ."])


def brute(rows):
    tokenizer = spans.tokenizer(spans.vocabulary_path(A.VOCABULARY))
    return [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, A.CLOSING_ID], "<u4")) for d, t, *_ in rows]


@pytest.mark.parametrize("segment", [50, 1 << 18])
def test_store(spark, tmp_path, rows, segment):
    rows = rows + [(1000 + i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "another one without an id", "en", "s")] * 2
    A.write_ids(frame(spark, rows), str(tmp_path / "s"), segment_ids=segment)
    got = A.read_documents(spark, str(tmp_path / "s")).orderBy("start").collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), zlib.crc32(i)) for d, i in want)
    at, last = 0, -1
    for r in got:  # one run of ids in ascending order of documents, null first
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    stream = {}
    for r in got:
        own = next(i for d, i in want if d == r.doc_id and len(i) == r.n_tokens and zlib.crc32(i) == r.ids_crc32)
        stream.update(enumerate(own.tolist(), r.start))
    asked = spark.range(0, at + 5, 7).withColumnRenamed("id", "position")
    found = {r.position: r.id for r in A.tokens_at(spark, str(tmp_path / "s"), asked.union(asked), cell=64).collect()}
    assert found == {p: stream[p] for p in range(0, at, 7)}


def test_empty_store(spark, tmp_path):
    A.write_ids(spark.createDataFrame([], DOCUMENTS), str(tmp_path / "s"))
    assert A.read_documents(spark, str(tmp_path / "s")).collect() == []
