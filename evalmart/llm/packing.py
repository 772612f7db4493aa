"""Packing: best-fit decreasing into sequences of fixed length.

Overlong documents are first cut into full windows; what is left of each document is placed longest first into the tightest
open sequence. The placement depends on lengths only, so it is worked out on the histogram of lengths (at most ``size``
counts whatever the corpus): sequences with the same remaining capacity are handled as runs, and a segment tree over the
capacities finds the tightest one. Each piece then finds its run by length and rank. Ranks are numbered inside tasks and
shifted by the counts of earlier tasks, so a hot length is no hot group.

Defined results: null and empty text are the closing id alone; repeated rows are packed each; a null doc_id stays null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmart.llm import spans
from evalmart.llm.common import SLICE_BYTES, give_back, kept_in_light_batches, slices, text_of

SEQUENCE = 2048
CLOSING_ID = 1
FRUGAL_SLICE = 1 << 20  # bytes of text whose spans are numbered at once; their arrays take some thirty times as many
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _part int, _local long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size; finds the smallest capacity of at least n that has open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, n: int) -> int | None:
        at = n + self.leaves
        if self.open[at]:
            return n
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): the pieces of a length by rank go to consecutive sequences."""
    tree, runs = CapacityTree(size), {}
    plan, sequences = [], 0

    def keep(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            runs.setdefault(capacity, []).append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is not None:
                first, count = runs[capacity].pop()
                take = min(left, count)
                if take < count:
                    runs[capacity].append((first + take, count - take))
                elif not runs[capacity]:
                    tree.set(capacity, False)
                plan.append((length, rank, take, first, size - capacity))
                keep(capacity - length, first, take)
                rank, left = rank + take, left - take
                continue
            each = size // length  # a fresh sequence stays the tightest one for its own length until it is full
            for slots, count in ((each, left // each), (left % each, 1 if left % each else 0)):
                if slots and count:
                    for slot in range(slots):
                        plan.append((length, rank, count, sequences, slot * length))
                        rank += count
                    keep(size - slots * length, sequences, count)
                    sequences += count
            left = 0
    return np.array(plan, np.int64).reshape(-1, 5)


def _pieces(path: str, ranks_path: str, size: int, frugal: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, ids = TaskContext.get().partitionId(), spans.shared_ids(path, ranks_path)
        seen = np.zeros(size + 1, np.int64)
        for batch in slices(batches, limit=FRUGAL_SLICE if frugal else SLICE_BYTES):
            distinct, codes, offsets = spans.spans(batch.column("text"))
            starts, sizes = ids.lookup(distinct)
            counts = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(counts)])
            flat = ids.flat[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])]
            bounds, names = ends[offsets], batch.column("doc_id")
            rows, start, length, crc, total = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(CLOSING_ID)).astype("<u4")
                for at in range(0, len(own), size):
                    piece = own[at : at + size]
                    rows.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(own))
            length = np.array(length, np.int64)
            order = np.argsort(length, kind="stable")
            values, first, many = np.unique(length[order], return_index=True, return_counts=True)
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat(seen[values], many)
            seen[values] += many
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([partition] * len(rows), pa.int32()), pa.array(local)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_local"],
            )
        if frugal:
            ids.clear()
            give_back()

    return run


def _place(plan: np.ndarray, shift: int):
    order = np.argsort((plan[:, 0] << shift) | plan[:, 1], kind="stable")
    plan = plan[order]
    keys = (plan[:, 0] << shift) | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = plan[np.searchsorted(keys, (length << shift) | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, size: int = SEQUENCE, frugal: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every document with their place among the equally long pieces of their task."""
    path = vocabulary or spans.vocabulary_path(f"{spans.VOCABULARY}.json")
    ranks_path = ranks or spans.vocabulary_path(f"{spans.VOCABULARY}.tiktoken")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_pieces(path, ranks_path, size, frugal), _PIECES)


def pack_documents(docs: DataFrame, size: int = SEQUENCE, frugal: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.

    ``frugal``: smaller slices, and no ids stay in a worker after a task, which costs time; for jobs whose workers serve other stages too.
    The pieces are written to a table, because their ranks must not change between the histogram and the placement.
    """
    pieces = kept_in_light_batches(token_pieces(docs, size=size, frugal=frugal))
    per_task = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(shifts, ["length", "_part"]).withColumn("_rank", F.col("_local") + F.col("_before"))
    plan = best_fit_plan(histogram, size)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(_place(plan, 48), _PLACED)
