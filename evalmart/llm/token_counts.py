"""Token counts: pieces are counted once per distinct pre-token and multiplied with per-document frequencies; ids never exist.

Each task turns a slice of texts into (pre-token, document, frequency) triples, deals them by the hash of the pre-token and
ships one packed row per (slice, shard). The task of a shard counts the pieces of each distinct pre-token once and returns
per-document partial sums, which meet again by slice. A slice is bounded in bytes and rows, so no group is unbounded, and
copies or hot words weigh no more than once per slice.

Defined results: null and empty text 0 bytes and 0 tokens; a null doc_id stays a row; repeated rows are counted each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmart.llm import spans
from evalmart.llm.common import chunk_id, pack, slices, text_of, unpack

TOKEN_LIMIT = 512
MAX_SHARDS = 256
MEMO_COUNTS = 400_000
_EXCHANGED = "shard int, chunk long, base boolean, blob binary"
_COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _slice_rows(batch: pa.RecordBatch, chunk: int, shards: int) -> Iterator[tuple[int, bool, bytes]]:
    n = batch.num_rows
    ids = batch.column("doc_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    yield chunk % shards, True, pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), known.astype(np.uint8), sizes)
    distinct, codes, offsets = spans.spans(batch.column("text"))
    keys, freqs = np.unique(codes * n + np.repeat(np.arange(n), np.diff(offsets)), return_counts=True)
    codes, docs = keys // n, keys % n
    raw = [s.encode() for s in distinct]
    shard = np.fromiter((xxhash.xxh32_intdigest(s) % shards for s in raw), np.int64, len(raw))
    per_code = np.bincount(codes, minlength=len(raw))
    starts = np.concatenate([[0], np.cumsum(per_code)])
    order = sorted(np.flatnonzero(per_code).tolist(), key=lambda i: (shard[i], raw[i]))
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        own = order[bounds[s] : bounds[s + 1]]
        if not own:
            continue
        rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
        yield s, False, pack(
            np.array([n], np.uint32), np.array([len(raw[i]) for i in own], np.uint32), b"".join(raw[i] for i in own),
            per_code[own].astype(np.uint32), docs[rows].astype(np.uint16), freqs[rows].astype(np.uint32),
        )


def _deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches)):
            chunk = chunk_id(partition, k)
            rows = list(_slice_rows(batch, chunk, shards))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())],
                ["shard", "chunk", "base", "blob"],
            )

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, memo = spans.tokenizer(path), {}
        for batch in batches:
            out = []
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if base:
                    out.append(blob)
                    continue
                n, sizes, text, per_code, docs, freqs = unpack(blob)
                ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
                found = [bytes(text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                if len(memo) > MEMO_COUNTS:
                    memo.clear()
                fresh = [s for s in found if s not in memo]
                memo.update(zip(fresh, map(len, counter.encode_batch_fast([s.decode() for s in fresh], add_special_tokens=False)), strict=True))
                pieces = np.repeat(np.array([memo[s] for s in found], np.int64), np.frombuffer(per_code, np.uint32))
                sums = np.bincount(np.frombuffer(docs, np.uint16), pieces * np.frombuffer(freqs, np.uint32), int(np.frombuffer(n, np.uint32)[0]))
                out.append(pack(sums.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("base"), pa.array(out, pa.binary())], ["chunk", "base", "blob"])

    return run


def _gather(chunk: pa.Table) -> pa.Table:
    total, base = 0, None
    for is_base, blob in zip(chunk.column("base").to_pylist(), chunk.column("blob").to_pylist(), strict=True):
        parts = unpack(blob)
        if is_base:
            base = parts
        else:
            total = total + np.frombuffer(parts[0], np.int64)
    ids, known, sizes = (np.frombuffer(p, t) for p, t in zip(base, (np.int64, np.uint8, np.int64), strict=True))
    return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_bytes": sizes, "n_tokens": np.zeros(len(ids), np.int64) + total})


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT, shards: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``vocabulary``: path of a byte-level tokenizers file."""
    path = vocabulary or spans.vocabulary_path(f"{spans.VOCABULARY}.json")
    shards = shards or min(MAX_SHARDS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_deal(shards), _EXCHANGED)
    sums = dealt.repartition(shards, "shard").mapInArrow(_count(path), "chunk long, base boolean, blob binary")
    counted = sums.groupBy("chunk").applyInArrow(_gather, _COUNTED)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
