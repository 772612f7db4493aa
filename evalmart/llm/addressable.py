"""Token ids in directly addressable codes.

An id is cut into chunks of bits, lowest first. Level k holds the k-th chunk of every id that has one, packed at one width, a
bitmap that says whether the id goes on in level k + 1, and a rank directory with the ones before every 512th bit. The place
of an id in the next level is the rank of its bit, so any id is read from at most one chunk per level and no block is ever
decoded. The widths of a segment are the cheapest ones for its own ids, found by dynamic programming over bit lengths.

A store is a folder of two Parquet tables. ``segments`` has a row per run of documents in id order: ``part`` and ``seq`` (the
writing task and the place in it), ``start`` (ids of the part before it), the documents' ids and sizes, and ``codes``, the
bytes of the format above. ``directory`` has a row per part with the ids of all parts before it. Texts are sorted by range
partitions once; copies of one id are ordered by text hash and place, so a hot id spreads over tasks.

Defined results: null and empty text are the closing id alone; null ids come first; documents of one id follow each other by
text hash; repeated rows are stored each; a text longer than a segment is a segment of its own; an empty table gives an empty
store and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmart.llm import spans
from evalmart.llm.common import slices, text_of

VOCABULARY = "word_bpe_49k.json"
CLOSING_ID = 2
SEGMENT_IDS = 1 << 18
SLICE_BYTES = 8 << 20  # words are looked up once a slice
BLOCK_BITS = 512
MAGIC = b"DAC1"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = ".,;:!?"
MOST_MARKS = 8  # a word with more behind it is encoded whole
_SEGMENT = "part int, seq long, start long, n_ids long, doc_ids array<bigint>, doc_sizes array<bigint>, codes binary"
_DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1]


def cheapest_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, lowest level first, with the fewest bits for these ids, directories included."""
    longer = np.bincount(bit_lengths(ids), minlength=33)[::-1].cumsum()[::-1]  # ids of at least b bits
    most = max(1, int(np.flatnonzero(longer)[-1])) if len(ids) else 1
    extra = 1 + 32 / BLOCK_BITS
    best = {most: (0.0, [])}
    for low in range(most - 1, -1, -1):
        reach = len(ids) if low == 0 else int(longer[low + 1])
        best[low] = min((reach * (high - low + (extra if high < most else 0)) + best[high][0], [high - low, *best[high][1]]) for high in range(low + 1, most + 1))
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def encode(ids: np.ndarray) -> bytes:
    """Header (magic, count, levels, then width and count per level), then chunks, bitmap and directory of each level."""
    ids = ids.astype(np.uint32)
    widths, head, body, left, shift = cheapest_widths(ids), [], [], ids, 0
    for k, width in enumerate(widths):
        head.append(struct.pack("<BQ", width, len(left)))
        body.append(_packed(left & np.uint32((1 << width) - 1), width))
        if k + 1 < len(widths):
            rest = left >> np.uint32(width)
            more = rest > 0
            blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS)) if len(more) else np.zeros(0, np.int64)
            body.append(np.packbits(more, bitorder="little").tobytes())
            body.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
            left = rest[more]
        shift += width
    return MAGIC + struct.pack("<QB", len(ids), len(widths)) + b"".join(head) + b"".join(body)


class Codes:
    """Reads a segment's bytes in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n, levels = struct.unpack_from("<QB", raw, 4)
        at = 13 + 9 * levels
        data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)])  # words may be read past the end
        self.levels = []
        for k in range(levels):
            width, count = struct.unpack_from("<BQ", raw, 13 + 9 * k)
            chunks, at = data[at:], at + (count * width + 7) // 8
            bitmap = directory = None
            if k + 1 < levels:
                bitmap, at = data[at : at + (count + 7) // 8], at + (count + 7) // 8
                blocks = (count + BLOCK_BITS - 1) // BLOCK_BITS
                directory, at = np.frombuffer(raw, "<u4", blocks, at), at + 4 * blocks
                bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % 64, np.uint8)]).view("<u8")
            self.levels.append((width, count, chunks, bitmap, directory))

    @staticmethod
    def _chunks(chunks: np.ndarray, width: int, positions: np.ndarray) -> np.ndarray:
        eights = np.ndarray(len(chunks) - 7, "<u8", chunks, strides=(1,))
        bit = positions * width
        return (eights[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Ones before each position: directory, whole words of the block, part of one word."""
        word, block = positions >> 6, positions // BLOCK_BITS
        below = (np.uint64(1) << (positions & 63).astype(np.uint64)) - np.uint64(1)
        ones = directory[block].astype(np.int64) + np.bitwise_count(bitmap[word] & below)
        for k in range(BLOCK_BITS // 64 - 1):
            at = block * (BLOCK_BITS // 64) + k
            ones += np.where(at < word, np.bitwise_count(bitmap[np.minimum(at, len(bitmap) - 1)]), 0)
        return ones

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, without reading the others."""
        positions = np.asarray(positions, np.int64)
        if len(positions) and not 0 <= positions.min() <= positions.max() < self.n:
            raise IndexError("position outside the segment")
        out, rows, shift = np.zeros(len(positions), np.uint64), np.arange(len(positions)), 0
        for width, _, chunks, bitmap, directory in self.levels:
            if len(positions) == 0:
                break
            out[rows] |= self._chunks(chunks, width, positions) << np.uint64(shift)
            shift += width
            if bitmap is not None:
                goes_on = (bitmap[positions >> 6] >> (positions & 63).astype(np.uint64)) & np.uint64(1) > 0
                rows, positions = rows[goes_on], positions[goes_on]
                positions = self._rank(bitmap, directory, positions) if len(positions) else positions
        return out.astype(np.uint32)

    def all(self) -> np.ndarray:
        """All ids in order; level by level, the set bits of a bitmap are the next level's rows."""
        out, rows, shift = np.zeros(self.n, np.uint64), np.arange(self.n), 0
        for width, count, chunks, bitmap, _ in self.levels:
            if count:
                out[rows] |= self._chunks(chunks, width, np.arange(count)) << np.uint64(shift)
            shift += width
            if bitmap is not None:
                rows = rows[np.unpackbits(bitmap.view(np.uint8), count=count, bitorder="little").astype(bool)]
        return out.astype(np.uint32)


class WordIds(spans.Ids):
    """Ids of words of a vocabulary that lowers case and marks the ends of words.

    A word of letters is one piece, and so are marks behind it: words that differ in case or such marks share the letters'
    ids, and letters are encoded in one text, where the closing tokens tell the words apart. Only letters, marks and other
    words are remembered, so the store lasts longer than one of whole words.
    """

    def __init__(self, path: str):
        self.path = path
        known = spans.tokenizer(path).get_vocab()
        self.closes = np.zeros(max(known.values()) + 1, bool)
        self.closes[[k for spelling, k in known.items() if spelling.endswith("</w>")]] = True
        self.clear()

    def encode_letters(self, fresh: list[str]) -> None:
        for own in spans.batches(fresh):
            ids = np.array(spans.tokenizer(self.path).encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(own):
                raise ValueError("words and closing tokens differ")
            self.add(own, ids, np.diff(stops, prepend=0))

    def places(self, pieces: pa.Array, encode) -> np.ndarray:
        """Place of each piece in the store; distinct fresh ones are encoded first."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        encode([s for s in distinct if s not in self.at])
        return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def lookup(self, distinct: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each word in ``flat``, where they stand behind the store until the next call."""
        if len(self.at) > spans.MEMO_SPANS:
            self.clear()
        distinct = distinct if isinstance(distinct, pa.Array) else pa.array(distinct, pa.string())
        core = pc.utf8_rtrim(distinct, characters=MARKS)
        marks = pc.subtract(pc.binary_length(distinct), pc.binary_length(core)).to_numpy()
        plain = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False) & (marks <= MOST_MARKS)
        head, tail = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1)
        head[plain] = self.places(pc.utf8_lower(core.filter(pa.array(plain))), self.encode_letters)
        head[~plain] = self.places(distinct.filter(pa.array(~plain)), self.encode_each)
        for k in range(1, MOST_MARKS + 1):
            own = plain & (marks == k)
            if own.any():
                tail[own] = self.places(pc.utf8_slice_codeunits(distinct.filter(pa.array(own)), -k), self.encode_each)
        n_head, n_tail = self.sizes[head], np.where(tail >= 0, self.sizes[tail], 0)
        sizes = n_head + n_tail
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - starts[row]
        ids = self.flat[np.where(place < n_head[row], self.starts[head][row] + place, self.starts[tail][row] + place - n_head[row])]
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        return self.used + starts, sizes


@lru_cache(maxsize=1)
def shared_words(path: str) -> WordIds:
    return WordIds(path)


def _segments(path: str, closing_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, store = TaskContext.get().partitionId(), shared_words(path)
        seq = start = 0
        names, runs, size = [], [], 0

        def closed() -> pa.RecordBatch:
            columns = [[part], [seq], [start], [size], [names], [[len(r) for r in runs]], [encode(np.concatenate(runs))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

        for batch in slices(batches, limit=SLICE_BYTES):
            # The vocabulary drops white space and no piece crosses it, so a text falls apart into words.
            words = pc.ascii_split_whitespace(batch.column("text"))
            flat, offsets = words.flatten().dictionary_encode(), words.offsets.to_numpy().astype(np.int64)
            starts, sizes = store.lookup(flat.dictionary)
            codes = flat.indices.to_numpy()
            counts = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids = store.flat[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])]
            bounds = ends[offsets - offsets[0]]
            for i, name in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(closing_id))
                if runs and size + len(own) > segment_ids:
                    yield closed()
                    seq, start = seq + 1, start + size
                    names, runs, size = [], [], 0
                names.append(name)
                runs.append(own)
                size += len(own)
        if runs:
            yield closed()

    return run


_NAMES = ["part", "seq", "start", "n_ids", "doc_ids", "doc_sizes", "codes"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, closing_id: int = CLOSING_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the store of a table of documents to ``path``."""
    spark, vocabulary = docs.sparkSession, vocabulary or spans.vocabulary_path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = ordered.mapInArrow(_segments(vocabulary, closing_id, segment_ids), _SEGMENT)
    made.write.option("compression", "none").parquet(f"{path}/segments")  # read in place: nothing to unpack first
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in parts:  # one row per writing task
        starts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(starts, "part int, before long").coalesce(1).write.parquet(f"{path}/directory")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``first``, the ids of all documents before them."""
    directory = spark.read.schema("part int, before long").parquet(f"{path}/directory")
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    return segments.join(F.broadcast(directory), "part").withColumn("first", F.col("before") + F.col("start"))  # one row per writing task


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, doc_ids, sizes, codes in zip(*(batch.column(c) for c in ("first", "doc_ids", "doc_sizes", "codes")), strict=True):
            ids, sizes = Codes(codes.as_py()).all().astype("<u4"), sizes.values.to_numpy()
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first.as_py() + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the store alone."""
    return read_segments(spark, path).select("first", "doc_ids", "doc_sizes", "codes").mapInArrow(_documents, _DOCUMENT)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, places, codes in zip(*(batch.column(c) for c in ("first", "places", "codes")), strict=True):
            places = places.values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(Codes(codes.as_py()).at(places - first.as_py()).astype(np.int64))], ["position", "id"])


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, cell: int = SEGMENT_IDS) -> DataFrame:
    """position, id of every distinct ``position`` that the store has, each read by random access.

    A segment and a position meet in the cells of ``cell`` ids that the segment touches; a segment has at most as many
    distinct positions as ids.
    """
    segments = read_segments(spark, path)
    reach = F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("n_ids") - 1) / cell))
    extents = segments.select("part", "seq", "first", "n_ids", F.explode(reach).alias("_cell"))
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("_cell", F.floor(F.col("position") / cell))
    inside = (F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids"))
    placed = asked.join(extents, "_cell").filter(inside).groupBy("part", "seq").agg(F.collect_list("position").alias("places"))
    return segments.select("part", "seq", "first", "codes").join(placed, ["part", "seq"]).select("first", "places", "codes").mapInArrow(_tokens, "position long, id long")
