"""Token counts, packing and sharding against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmart.llm import packing, sharding, spans, token_counts
from tests.llm.conftest import corpus, frame


@pytest.fixture(scope="module")
def tokenizer():
    return spans.tokenizer(spans.vocabulary_path("byte_bpe_50k.json"))


TEXTS = ["", " ", "a", " a", "a ", "a b", "a  b", "a\n b", "a \nb", "a  b", "<|endoftext|>", "x <|endoftext|> y", "x<|endoftext|>y <|endoftext|>", "it's we'll 12 345 67,8 --- !!", "　 中文 字", "é 😀 tab\tb", "᠎ x", "\x85 x", "a" * 5000, "q " * 3000,
         "hello  big wide world", "def add(x, y):\n    return x + y\n", "one.  two.  one.", "\tif  x:\n\t\ty  = 1\n", "the wide house", " \n a  \n  b"]


def test_spans_join_to_the_text_and_encode_alike(tokenizer):
    ids = spans.shared_ids(spans.vocabulary_path("byte_bpe_50k.json"), spans.vocabulary_path("byte_bpe_50k.tiktoken"))
    distinct, codes, offsets = spans.spans(pa.array(TEXTS))
    starts, sizes = ids.lookup(distinct)
    for i, text in enumerate(TEXTS):
        own = codes[offsets[i] : offsets[i + 1]]
        assert "".join(distinct[c] for c in own) == text
        assert [int(x) for c in own for x in ids.flat[starts[c] : starts[c] + sizes[c]]] == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(text):
    tokenizer = spans.tokenizer(spans.vocabulary_path("byte_bpe_50k.json"))
    ids = spans.shared_ids(spans.vocabulary_path("byte_bpe_50k.json"), spans.vocabulary_path("byte_bpe_50k.tiktoken"))
    distinct, codes, _ = spans.spans(pa.array([text]))
    starts, sizes = ids.lookup(distinct)
    assert [int(x) for c in codes for x in ids.flat[starts[c] : starts[c] + sizes[c]]] == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_whole_table_encodes_alike(spark, tokenizer):
    ids = spans.shared_ids(spans.vocabulary_path("byte_bpe_50k.json"), spans.vocabulary_path("byte_bpe_50k.tiktoken"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [t.replace(". ", ".  ").replace(", ", ",\n    ") for t in texts if t]  # the same with indentation and double spaces
    distinct, codes, offsets = spans.spans(pa.array(texts))
    assert len(set(distinct)) == len(distinct)
    starts, sizes = ids.lookup(distinct)
    for i, text in enumerate(texts):
        own = codes[offsets[i] : offsets[i + 1]]
        assert [int(x) for c in own for x in ids.flat[starts[c] : starts[c] + sizes[c]]] == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, rows, tokenizer, no_docs):
    odd = [(1000 + i, t, "en", "s") for i, t in enumerate(TEXTS)]
    got = Counter(tuple(r) for r in token_counts.token_counts(frame(spark, rows + odd), limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = Counter()
    for doc_id, text, *_ in rows + odd:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want[(doc_id, len((text or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts.token_counts(no_docs).count() == 0


def check_packing(pieces: list, rows: list[tuple], tokenizer, size: int) -> None:
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(texts) == set(by_doc)
    for doc_id, many in texts.items():
        ids, copies = many[0], len(many)
        found = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc_id])
        at = 0
        for start, length, crc, total in sorted(found):
            assert found[(start, length, crc, total)] == copies and start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_packing(spark, docs, rows, tokenizer, no_docs):
    for size in (64, 2048):
        odd = [(1000 + i, t, "en", "s") for i, t in enumerate(TEXTS)]
        pieces = packing.pack_documents(frame(spark, rows + odd), size).collect()
        check_packing(pieces, rows + odd, tokenizer, size)
    assert packing.pack_documents(no_docs).count() == 0


def test_frugal_packing_gives_the_same_pieces_and_keeps_no_ids(monkeypatch):
    texts = [f"alpha beta gamma delta number {i} of many" for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(packing, "FRUGAL_SLICE", 2000)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    paths = [spans.vocabulary_path(f"{spans.VOCABULARY}.{kind}") for kind in ("json", "tiktoken")]
    whole, cut = ([b.to_pylist() for b in packing._pieces(*paths, 16, frugal)(iter([batch]))] for frugal in (False, True))
    assert len(cut) > len(whole) == 1 and [row for b in cut for row in b] == whole[0]
    assert not spans.shared_ids(*paths).at


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    rng, size = random.Random(seed), 50
    lengths = [min(size, int(rng.expovariate(1 / 15)) + 1) for _ in range(400)]
    open_, bins = [], 0
    for n in sorted(lengths, reverse=True):  # one at a time
        fits = [r for r in open_ if r >= n]
        if fits:
            open_.remove(min(fits))
            open_.append(min(fits) - n)
        else:
            bins += 1
            open_.append(size - n)
    plan = packing.best_fit_plan(dict(Counter(lengths)), size)
    used = defaultdict(int)
    for length, _, count, first, _ in plan:
        for k in range(count):
            used[first + k] += length
    assert len(used) == bins and sorted(size - u for u in used.values()) == sorted(open_)


def test_sharding(spark, docs, rows, no_docs):
    limit = 4000
    got = sharding.extendible_shards(docs, limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((d, len((t or "").encode())) for d, t, *_ in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, own in shards.items():
        size = sum(r.n_bytes for r in own)
        assert all((r.shard_bytes, r.shard_docs, r.depth) == (size, len(own), len(name)) for r in own)
        assert size <= limit or len(own) == 1
        if name:  # only what was too large was split
            assert sum(r.n_bytes for r in got if r.shard.startswith(name[:-1])) > limit
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert sharding.extendible_shards(no_docs).count() == 0


def test_sharding_splits_one_hot_key(spark):
    rows = [(7, "same text " * 20, "en", "s")] * 60 + corpus(20)
    got = sharding.extendible_shards(frame(spark, rows), 1000).collect()
    assert max(r.shard_bytes for r in got if r.shard_docs > 1) <= 1000 and len(got) == len(rows)
