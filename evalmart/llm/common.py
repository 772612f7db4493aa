"""Helpers that the operators of this package share: column access, text slices, word codes, packed blobs, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmart.session import checkpoint_dir

SLICE_BYTES = 4 << 20
SLICE_ROWS = 20_000
BROADCAST_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LONG_WORD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def checked_broadcast(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after the rows have been counted and fit ``limit``; else the join shuffles."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: computed once, the same for every later pass, short lineage.

    checkpoint() would compute the last stage twice. The tables are named evalmart-*; clear them when the job is done.
    Shuffle files go as soon as the table stands; else they wait until the driver collects garbage. The session's setting is put back.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/evalmart-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SETTING, None)
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SETTING) if before is None else spark.conf.set(CLEAN_SETTING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``kept`` from which nothing is read any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def kept_in_light_batches(df: DataFrame) -> DataFrame:
    """As ``kept``; rows with texts go to the Python workers in batches of ``BATCH_BYTES``.

    Batches are else cut by 10,000 rows; one stands in its task's JVM and, with the next one, in the worker. The session's setting is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        return kept(df)
    finally:
        conf.set(BATCH_SETTING, before)


def give_back() -> None:
    """Workers live on from stage to stage: what a task no longer needs goes back to the system, or it adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``limit`` bytes in each; a longer text is alone in its slice."""
    give_back()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(int(np.searchsorted(ends, base + limit, "right")), start + SLICE_ROWS))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts with A-Z in lower case, flat, and the word offsets of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string, eight bytes at a time over all strings at once; long ones singly."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8)[: ends[-1]], np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    starts, sizes = ends[:-1], np.diff(ends)
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(n)
    for k in range(0, LONG_WORD, 8):
        at = at[sizes[at] > k]
        if len(at) == 0:
            break
        left = np.minimum(sizes[at] - k, 8).astype(np.uint64)
        part = eights[starts[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[at] = mixed(out[at] * np.uint64(0xD6E8FEB86659FD93) + part)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i + 1]].tobytes())
    return out


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` neighbouring codes; shorter input as one hash of the whole, empty input none."""
    if len(codes) == 0:
        return codes
    size = min(size, len(codes))
    n = len(codes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
        out ^= out >> np.uint64(29)
    return mixed(out)


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes in one compressed value."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    body = struct.pack(f"<{len(raw) + 1}I", len(raw), *map(len, raw)) + b"".join(raw)
    return struct.pack("<Q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[memoryview]:
    body = memoryview(pa.decompress(blob[8:], struct.unpack_from("<Q", blob)[0], codec="zstd"))
    count = struct.unpack_from("<I", body)[0]
    sizes, at, out = struct.unpack_from(f"<{count}I", body, 4), 4 + 4 * count, []
    for size in sizes:
        out.append(body[at : at + size])
        at += size
    return out


def chunk_id(partition: int, sequence: int) -> int:
    """Names a slice by its task and place, the same again when the task is repeated."""
    return partition << 32 | sequence
