"""Exact Jaccard join of word shingles in the metric space of Jaccard distance.

1. Equal sets are one node. A first pass names each document's set by a hash (a second hash guards against collisions) and
   counts shingles in a fixed number of buckets.
2. Two sets within the radius share one of their rarest shingles (prefix filter under the order of bucket counts). These
   rare shingles are the outer regions: inside one, distances to pivots tell something, while across the corpus nearly all
   distances are 1.
3. A small region joins directly. In a larger one a few pivots are drawn, exact distances to them are taken up to twice the
   radius (what the bounds below put farther is not sent), and each document that links with a pivot falls to the nearest
   one: its Voronoi cell. All others are one more cell. A few further documents are probed for links only. Links found so
   far are contracted, which leaves few documents outside the largest component.
4. By the triangle inequality a document can link into a cell only if its distance to the cell's pivot is at most the
   cell's radius plus the join radius, so at most twice the radius; documents within that window are replicated there. In a cell only pairs of
   different components are left to compare: every document outside the cell's largest component with all of the cell, in
   blocks. A document outside first meets a few of its candidates that pass the bounds, and more in further rounds while
   their components stay apart, until none is left: alike texts cost a few pairs a document, not pairs of all. There is one
   level of cells only, they are not divided again: in a large region of many different texts the last cell grows with the
   region and its comparisons with the square; they are made on bucketed counts.
5. Components over all links name each document's group.

Candidate pairs pass two exact bounds before any set is shipped: sizes, as soon as the documents of a region meet, and the L1
distance of bucketed shingle counts, which never exceeds the symmetric difference; long sets have more buckets. Texts are shipped compressed and cut into
shingles again where they meet. No pair is left out but those whose documents other links of their block already connect, so
the components equal brute force and links grow with documents, not with pairs.

Defined results: null and empty text has no shingles and links with nothing; texts shorter than a shingle are one shingle;
a null doc_id joins as the largest id and names its component only if alone; repeated rows are rows of one node, and
different texts of one doc_id share its name without being linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import checked_broadcast, forget, hashed, kept, kept_in_light_batches, pack, slices, text_of, unpack, windows, words
from evalmart.llm.components import components
from evalmart.llm.quality import row_key

SHINGLE = 4
PERCENT = 85
ORDER_BITS = 18
VECTOR = 256  # buckets of the counts of a short text; a longer one has one for four shingles at least
PER_BUCKET = 4
LEAF = 16
PIVOTS = 3
PROBES = 4
CANDIDATES = 4  # that a document outside the largest component meets in a block in the first round
WIDER = 16  # times as many in each further round
BLOCK = 2048
SHIP = 64  # documents of a block of measured pairs, besides those that all of them meet
TEXTS = 8  # unpacked at once
SLICE = 1 << 19  # bytes of text cut into shingles at once; their arrays take some fifteen times as many
SEEN = 1 << 16  # sets of a task that are sent once
BITMAP_BITS = 24
REST = 0  # cell of the documents that link with no pivot
NULL_ID = (1 << 63) - 1
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, offsets = words(texts)
    codes = hashed(flat)
    every, out = windows(codes, size), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = every[a : b - size + 1].copy() if b - a >= size else windows(codes[a:b], size)
        own.sort()
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
    return out


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    raw = shingles.tobytes()
    return xxhash.xxh64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw, 1) - (1 << 63)


def sketch(shingles: np.ndarray) -> bytes:
    """Shingles counted in a power of two of buckets, one byte each.

    The number grows with the set, or the bound would say nothing of long texts: with ``PER_BUCKET`` in a bucket two unrelated sets of one
    size can have little over half of their union in common. Counts are only cut at 255 where they are never summed up.
    """
    buckets = max(VECTOR, 1 << (max(1, len(shingles) // PER_BUCKET) - 1).bit_length())
    counts = np.bincount((shingles & _U(buckets - 1)).astype(np.int64), minlength=buckets)
    if buckets > VECTOR and counts.max() > 255:
        counts = counts.reshape(-1, VECTOR).sum(axis=0)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


class Sketches:
    """L1 distances of sketches, over as many buckets as the smaller of two has; never above the symmetric difference."""

    def __init__(self, blobs: list[bytes]):
        self.raw, self.sizes, self.folded = blobs, np.array([len(b) for b in blobs], np.int64), {}

    def rows(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of at least so many buckets, folded to them, and the place of each."""
        if buckets not in self.folded:
            own = np.flatnonzero(self.sizes >= buckets)
            place, out = np.full(len(self.raw), -1), np.empty((len(own), buckets), np.uint8)
            place[own] = np.arange(len(own))
            for at, i in enumerate(own.tolist()):
                own_counts = np.frombuffer(self.raw[i], np.uint8)
                out[at] = own_counts if len(own_counts) == buckets else np.minimum(own_counts.reshape(-1, buckets).sum(axis=0), 255)
            self.folded[buckets] = place, out
        return self.folded[buckets]

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least, out = np.minimum(self.sizes[x], self.sizes[y]), np.empty(len(x), np.int64)
        for buckets in np.unique(least).tolist():
            place, counts = self.rows(buckets)
            every, step = np.flatnonzero(least == buckets), max(1, BLOCK * VECTOR // buckets)
            for low in range(0, len(every), step):
                own = every[low : low + step]
                a, b = counts[place[x[own]]], counts[place[y[own]]]
                out[own] = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
        return out


def _nodes(size: int):
    """A row per document, and one row per task with its bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "sid", "guard", "n", "vector", "counts"]
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in slices(batches, limit=SLICE):
            sets = shingle_sets(batch.column("text"), size)
            ids = [set_id(s) for s in sets]
            counts += np.bincount((np.concatenate(sets) >> _U(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
            vectors = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([i for i, _ in ids], pa.int64()), pa.array([g for _, g in ids], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(vectors, pa.binary()), pa.nulls(len(sets), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.binary()), pa.array([pack(counts)], pa.binary())], names)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("counts").to_pylist():
            counts = np.frombuffer(unpack(blob)[0], np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "c"])


def prefix_size(n: int, percent: int) -> int:
    """Rarest shingles of which two linked sets of any size share at least one."""
    return n - (-(-percent * n // 100)) + 1


def _prefixes(size: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = order.value, set()
        for batch in slices(batches, limit=SLICE):
            tokens, sids, sizes = [], [], []
            if len(seen) > SEEN:  # only saves rows, which are summed up later
                seen.clear()
            for s in shingle_sets(batch.column("text"), size):
                if len(s) == 0:
                    continue
                sid = set_id(s)[0]
                if sid in seen:
                    continue
                seen.add(sid)
                k = prefix_size(len(s), percent)
                rare = np.lexsort((s, counts[(s >> _U(64 - ORDER_BITS)).astype(np.int64)]))[:k]
                tokens.append(s[rare])
                sids.append(np.full(k, sid, np.int64))
                sizes.append(np.full(k, len(s), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes))], ["region", "sid", "n"])

    return run


def _packed_texts(bitmap):
    """Texts of the rows whose key is in the bitmap, compressed: a few bytes a word, where its shingle's hash has eight that do not compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in slices(batches, limit=SLICE):
            spot = ((batch.column("key").to_numpy().view(np.uint64) ^ _U(1 << 63)) >> _U(64 - BITMAP_BITS)).astype(np.int64)
            own = batch.filter(pa.array((bits[spot >> 3] >> (spot & 7) & 1).astype(bool)))
            blobs = [pack(text.as_buffer().to_pybytes()) for text in own.column("text")]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("key"), pa.array(blobs, pa.binary())], ["rep", "key", "packed"])

    return run


def near_percent(percent: int) -> int:
    """Share of common shingles of two sets within twice the radius, up to which distances to pivots are taken."""
    return max(0, 2 * percent - 100)


def _bounded(percent: int):
    """Keeps a block's pairs whose bucketed counts allow enough overlap; for exact ones enough to lie within twice the radius."""

    def run(block: pa.Table) -> pa.Table:
        is_pair = pc.is_valid(block.column("a"))
        pairs, known = block.filter(is_pair), block.filter(pc.invert(is_pair))
        sid, n = known.column("sid").to_numpy(), known.column("n").to_numpy()
        sketches = Sketches(known.column("vector").to_pylist())
        order = np.argsort(sid)
        a, b = (order[np.searchsorted(sid, pairs.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
        least = np.where(pairs.column("exact").to_numpy(zero_copy_only=False).astype(bool), near_percent(percent), percent)
        ok = np.zeros(len(a), bool)
        for at in range(0, len(a), BLOCK):
            x, y = a[at : at + BLOCK], b[at : at + BLOCK]
            most = (n[x] + n[y] - sketches.distances(x, y)) // 2
            ok[at : at + BLOCK] = 100 * most >= least[at : at + BLOCK] * (n[x] + n[y] - most)
        return pairs.select(["a", "b", "exact", "m", "region", "own"]).filter(pa.array(ok))

    return run


def _block_pairs(percent: int, limit: int):
    """``x``: the document outside; ``more``: it has candidates beyond ``limit``, which wait for a further round."""

    def run(group: pa.Table) -> pa.Table:
        outer = group.column("outer").to_numpy()
        sid, label, main, n = (group.column(c).to_numpy() for c in ("sid", "label", "main", "n"))
        native = group.column("native").to_numpy()
        sketches = Sketches(group.column("vector").to_pylist())
        inner, xs, ys, more = np.flatnonzero(~outer), [], [], []
        for x in np.flatnonzero(outer):
            y = inner[(label[inner] != label[x]) & (native[x] | native[inner]) & ((label[inner] == main[x]) | (sid[x] < sid[inner]))]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            most = (n[y] + n[x] - sketches.distances(np.full(len(y), x), y)) // 2
            y = y[100 * most >= percent * (n[y] + n[x] - most)]
            few = y[:limit]
            xs.append(np.full(len(few), x))
            ys.append(few)
            more.append(np.full(len(few), len(few) < len(y)))
        none = np.zeros(0, np.int64)
        x, y = np.concatenate([none, *xs]), np.concatenate([none, *ys])
        return pa.table({"x": sid[x], "y": sid[y], "lx": label[x], "ly": label[y], "more": np.concatenate([none.astype(bool), *more])})

    return run


def _overlaps(size: int, percent: int):
    """Overlaps of a block's pairs, from the texts that came with it.

    ``joins``: a link whose ends' components ``la`` and ``lb`` no earlier link of the block connects. Only pairs that are exact or join are returned, so a
    block of k documents has fewer than k links, however many of its pairs are alike; pairs that could not join are not counted.
    """

    def run(block: pa.Table) -> pa.Table:
        is_pair = pc.is_valid(block.column("a"))
        pairs, known = block.filter(is_pair), block.filter(pc.invert(is_pair))
        sids, sets = known.column("sid").to_pylist(), {}
        for low in range(0, len(sids), TEXTS):
            texts = [unpack(blob)[0] for blob in known.column("packed")[low : low + TEXTS].to_pylist()]
            sets.update(zip(sids[low : low + TEXTS], shingle_sets(pa.array(texts, pa.binary()).view(pa.string()), size), strict=True))
        parent = {label: label for c in ("la", "lb") for label in pairs.column(c).to_pylist()}

        def root(label: int) -> int:
            while parent[label] != label:
                parent[label] = label = parent[parent[label]]
            return label

        out = []
        for a, b, exact, la, lb in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "exact", "la", "lb")), strict=True):
            x, y = root(la), root(lb)
            if x == y and not exact:
                continue
            both = np.concatenate([sets[a], sets[b]])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            joins = x != y and 100 * common >= percent * (len(both) - common)
            if joins:
                parent[x] = y
            if joins or exact:
                out.append((a, b, common, len(both) - common, joins))
        types = {"a": pa.int64(), "b": pa.int64(), "common": pa.int64(), "either": pa.int64(), "joins": pa.bool_()}
        return pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(types.items())})

    return run


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.radius = 1 - percent / 100
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of().alias("text"))
        keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of().alias("text"), row_key().alias("key"))
        self.keyed = keyed
        first = kept_in_light_batches(keyed.mapInArrow(_nodes(size), "doc_id long, key long, sid long, guard long, n long, vector binary, counts binary"))
        self.nodes = first.filter("counts IS NULL").select("doc_id", "key", "sid", "guard", "n", "vector")
        self.counts = first.filter("counts IS NOT NULL").select("counts")
        same = self.nodes.groupBy("sid").agg(F.min("guard").alias("g"), F.max("guard").alias("h"), F.min(F.struct("doc_id", "key")).alias("_r"), F.max("n").alias("n"))
        self.reps = kept(same.select("sid", "g", "h", F.col("_r.doc_id").alias("rep"), F.col("_r.key").alias("key"), "n"))
        if self.reps.filter("g <> h").limit(1).count():
            raise ValueError("two different shingle sets share a hash")

    def members(self) -> DataFrame:
        """region, sid, n, m, large: documents by rare shingle, where at least two different sets meet; equal regions once."""
        order = np.zeros(1 << ORDER_BITS, np.int64)
        sums = kept(self.counts.mapInArrow(_spread, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")))
        known = sums.toArrow()  # at most 2^ORDER_BITS rows
        order[known.column("bucket").to_numpy()] = known.column("c").to_numpy()
        shared = self.spark.sparkContext.broadcast(order)
        # Dealt by region once: the signs of a region and its rows come from one shuffle, which they share as both read all columns, none of them null.
        # Of its rows only those of one region among equals are written: alike texts share nearly all of their rare shingles.
        rows = self.rows.mapInArrow(_prefixes(self.size, self.percent, shared), "region long, sid long, n long").filter("region IS NOT NULL").repartition("region")
        met = rows.groupBy("region", "sid").agg(F.max("n").alias("n"))
        mark = F.xxhash64("sid")
        signs = met.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("s"), F.min_by("sid", F.xxhash64("sid", F.lit(7))).alias("_first"), F.max("n").alias("_n"))
        once = signs.filter("m > 1 AND _n > 0").groupBy("m", "x", "s").agg(F.min("region").alias("region"), F.min("_first").alias("_first")).select("region", "m", "_first")
        marked = kept_in_light_batches(rows.join(once, "region").groupBy("region", "sid", "m", "_first").agg(F.max("n").alias("n")))
        # Large regions overlap; those with the same first pivot become one, so that no pair is met once per shingle.
        merged = marked.filter(F.col("m") > LEAF).select(F.xxhash64("_first").alias("region"), "sid", "n").distinct()
        sizes = merged.groupBy("region").agg(F.count(F.lit(1)).alias("m"))
        out = kept(marked.filter(F.col("m") <= LEAF).select("region", "sid", "n", "m", F.lit(False).alias("large")).unionByName(merged.join(sizes, "region").withColumn("large", F.lit(True))))
        forget(sums, marked)
        return out

    def placed(self, pairs: DataFrame) -> DataFrame:
        """Adds ``block`` to distinct pairs (a < b, region, own).

        About ``SHIP`` documents of a region stand in a block with all that they meet: the few pivots and probes, the members
        of a small region, or one document. Whatever pairs need is thus sent once per block, not once per pair.
        """
        spans = kept(pairs.select("region", "own").distinct().groupBy("region").agg(F.ceil(F.count(F.lit(1)) / SHIP).alias("_n")))
        out = kept(pairs.join(spans, "region").withColumn("block", F.xxhash64("region", F.pmod(F.xxhash64("own", F.lit(11)), "_n"))).drop("_n"))
        forget(spans)
        return out

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Overlaps of pairs (a < b, exact, m, region, own) that pass the bound of bucketed counts, for exact ones that of twice the radius.

        A pair that meets in several regions counts in the one of most documents ``m``, where most of its neighbours meet too.
        """
        best = pairs.groupBy("a", "b").agg(F.max("exact").alias("exact"), F.max(F.struct("m", "region", "own")).alias("_r"))
        once = kept(best.select("a", "b", "exact", "_r.m", "_r.region", "_r.own"))
        placed = self.placed(once)
        wanted = kept(placed.select("block", F.explode(F.array("a", "b")).alias("sid")).distinct())
        ends = wanted.select("sid").distinct()
        about = self.about(ends)
        none = F.lit(None).cast("long")
        sent = about.join(wanted, "sid").select("block", *(none.alias(c) for c in ("a", "b", "m", "region", "own")), F.lit(None).cast("boolean").alias("exact"), "sid", "n", "vector")
        full = sent.unionByName(placed.withColumns({"sid": none, "n": none, "vector": F.lit(None).cast("binary")}))
        out = self.overlaps(full.groupBy("block").applyInArrow(_bounded(self.percent), "a long, b long, exact boolean, m long, region long, own long"))
        forget(once, placed, wanted)
        return out

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """a, b, common, either, joins of distinct pairs (a < b, exact, region, own), counted in blocks.

        ``la`` and ``lb``, where given, are the components that a and b are known to belong to.
        """
        labels = ["la", "lb"] if "la" in pairs.columns else [F.col("a").alias("la"), F.col("b").alias("lb")]
        left = kept(pairs.select("a", "b", "exact", "region", "own", *labels))
        ends = left.select(F.col("a").alias("sid")).union(left.select(F.col("b").alias("sid"))).distinct()
        needed = kept(self.reps.join(ends, "sid").select("sid", "rep", "key"))
        texts = self.keyed.mapInArrow(_packed_texts(self.spark.sparkContext.broadcast(self.bitmap(needed, "key"))), "rep long, key long, packed binary")
        dealt = self.placed(left)
        placed = dealt.select("block", "a", "b", "exact", "la", "lb")
        none = F.lit(None).cast("long")
        # A set is read from its first row; repeated rows are dropped where they are, a text is shuffled once before its blocks.
        wanted = placed.select("block", F.explode(F.array("a", "b")).alias("sid")).distinct().join(needed, "sid")
        sent = texts.dropDuplicates(["rep", "key"]).join(wanted, ["rep", "key"]).select("block", *(none.alias(c) for c in ("a", "b", "la", "lb")), F.lit(None).cast("boolean").alias("exact"), "sid", "packed")
        full = sent.unionByName(placed.withColumn("sid", none).withColumn("packed", F.lit(None).cast("binary")))
        out = kept(full.groupBy("block").applyInArrow(_overlaps(self.size, self.percent), "a long, b long, common long, either long, joins boolean"))
        forget(left, needed, dealt)
        return out

    def bitmap(self, rows: DataFrame, column: str) -> bytes:
        """2^BITMAP_BITS bits in pieces of 4 KB, whatever the number of values."""
        spot = F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-(1 << 63))), 64 - BITMAP_BITS) + 1
        out = bytearray(1 << (BITMAP_BITS - 3))
        for r in rows.select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
            out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
        return bytes(out)

    @staticmethod
    def linked(measured: DataFrame) -> DataFrame:
        """Links with the same components as all links of the measured pairs."""
        return measured.filter("joins").select("a", "b")

    def links(self) -> DataFrame:
        """Links (a, b as sid) with the same components as all links."""
        met = self.members()
        first = met.filter("large").groupBy("region").agg(F.min_by("sid", F.xxhash64("sid", F.lit(7))).alias("_first"))
        drawn = met.join(first, "region", "left").withColumn("pivot", F.col("large") & ((F.col("sid") == F.col("_first")) | (self.chance(7) < PIVOTS)))
        drawn = drawn.withColumn("probe", ~F.col("large") | F.col("pivot") | (self.chance(8) < PROBES))
        to = drawn.filter("probe").select("region", F.col("sid").alias("p"), F.col("pivot").alias("exact"), F.col("n").alias("pn"))
        fits = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * F.when(F.col("exact"), near_percent(self.percent)).otherwise(self.percent)
        stars = drawn.select("region", "sid", "n", "m", "pivot", "probe").join(to, "region").filter("sid <> p AND (sid < p OR NOT probe OR (exact AND NOT pivot))").filter(fits)
        stars = kept(stars.select("region", "sid", "p", "m", "exact", F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")))
        near = self.measured(stars.select("a", "b", "exact", "m", "region", F.col("sid").alias("own")))
        large = drawn.filter("large")
        if not large.limit(1).count():
            forget(met, stars)
            return self.linked(near)
        found = self.cells(large, stars.filter("exact"), near)
        cells, limit, links, source = self.described(found), CANDIDATES, self.linked(near), near
        forget(met, stars, found)
        while True:
            found, known = self.across(cells, components(links), limit)
            more = self.overlaps(found.drop("more"))
            every = kept(links.union(self.linked(more)))
            forget(source, known, more)
            links = source = every
            left = found.filter("more").limit(1).count()
            forget(found)
            if not left:
                forget(cells)
                return links
            limit *= WIDER

    @staticmethod
    def chance(seed: int) -> Column:
        """A document's own number between 0 and the size of its region."""
        return (F.xxhash64("sid", F.lit(seed)).cast("double") / float(1 << 64) + 0.5) * F.col("m")

    @staticmethod
    def labelled(rows: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
        """Adds each document's component and the largest one of its region, where there is more than one."""
        known = rows.join(labels.withColumnRenamed("id", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        tally = known.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("c"))
        main = tally.groupBy(*key).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        return known.join(main, key)

    def cells(self, drawn: DataFrame, stars: DataFrame, near: DataFrame) -> DataFrame:
        """region, cell (pivot, or ``REST``), sid, native: each document in its own cell and in those whose window it reaches.

        A document's own cell is that of the nearest pivot it links with, so a cell reaches one radius at most, its window two: distances beyond
        were not taken. Documents that link with no pivot are the cell ``REST``, which all but pivots can link into.
        """
        joins = F.col("common") * 100 >= F.col("either") * self.percent
        distance = 1 - F.col("common") / F.col("either")
        far = stars.join(near, ["a", "b"]).select("region", "a", "b", "sid", "p", distance.alias("d"), joins.alias("joins"))
        pivots = drawn.filter("pivot").select("region", "sid")
        both = pivots.select("region", F.col("sid").alias("_other"))
        swapped = far.join(both, (far["region"] == both["region"]) & (far["sid"] == both["_other"]), "left_semi").select("region", F.col("p").alias("sid"), F.col("sid").alias("p"), "d", "joins")
        own = pivots.select("region", "sid", F.col("sid").alias("p"), F.lit(0.0).alias("d"), F.lit(True).alias("joins"))
        table = kept(far.select("region", "sid", "p", "d", "joins").unionByName(swapped).unionByName(own))
        home = kept(table.filter("joins").groupBy("region", "sid").agg(F.min(F.struct("d", "p")).alias("h")).select("region", "sid", F.col("h.p").alias("home"), F.col("h.d").alias("_d")))
        reach = home.groupBy("region", "home").agg(F.max("_d").alias("reach")).withColumnRenamed("home", "p")
        inside = table.join(home.select("region", "sid", "home"), ["region", "sid"], "left").join(reach, ["region", "p"])
        slack = 1e-9  # a window may be too wide, never too narrow
        native = F.col("p").eqNullSafe(F.col("home"))
        windows = inside.filter(native | (F.col("d") <= F.col("reach") + self.radius + slack)).select("region", F.col("p").alias("cell"), "sid", native.alias("native"))
        rest = drawn.filter("NOT pivot").select("region", "sid").join(home.select("region", "sid", "home"), ["region", "sid"], "left")
        out = kept(windows.unionByName(rest.select("region", F.lit(REST).cast("long").alias("cell"), "sid", F.col("home").isNull().alias("native"))))
        forget(table, home)
        return out

    def about(self, ends: DataFrame) -> DataFrame:
        """sid, n, vector of distinct sids; no other document is shuffled twice."""
        return self.nodes.join(self.reps.join(ends, "sid").select("sid", F.col("rep").alias("doc_id")), ["sid", "doc_id"]).select("sid", "n", "vector").dropDuplicates(["sid"])

    def described(self, cells: DataFrame) -> DataFrame:
        """Adds n and vector."""
        return kept(cells.join(self.about(cells.select("sid").distinct()), "sid"))

    def across(self, cells: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of different components in a cell that pass both bounds: every one with a document outside its largest component; and the table of members.

        A document outside has at most ``limit`` pairs in a block; ``more`` is set where some are left out, so that the caller
        goes on. Documents of one component need no comparison. Both sides of a cell are cut into blocks of about
        ``BLOCK`` documents, and each pair of blocks is one small group, so neither a hot cell nor its pairs ever stand in one place.
        """
        key = ["region", "cell"]
        known = kept(self.labelled(cells, labels, key))
        outer = F.sum((F.col("label") != F.col("main")).cast("long"))
        blocks = known.groupBy(*key).agg(F.ceil(outer / BLOCK).alias("bo"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("bm"))
        rows = known.join(blocks, key)
        own, cols = F.xxhash64("sid", F.lit(9)), ["sid", "label", "main", "native", "n", "vector"]
        outside = rows.filter("label <> main").select(*key, F.pmod(own, "bo").alias("o"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bm") - 1)).alias("i"), F.lit(True).alias("outer"), *cols)
        inside = rows.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("bo") - 1)).alias("o"), F.pmod(own, "bm").alias("i"), F.lit(False).alias("outer"), *cols)
        found = outside.unionByName(inside).groupBy(*key, "o", "i").applyInArrow(_block_pairs(self.percent, limit), "x long, y long, lx long, ly long, more boolean")
        once = found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("more").alias("more"), F.min(F.struct("x", "y", "lx", "ly")).alias("_r"))
        la, lb = (F.when(F.col("_r.x") == F.col(end), F.col("_r.lx")).otherwise(F.col("_r.ly")) for end in ("a", "b"))
        return kept(once.select("a", "b", F.lit(False).alias("exact"), F.col("_r.x").alias("region"), F.col("_r.y").alias("own"), la.alias("la"), lb.alias("lb"), "more")), known


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. ``percent``: least share of common shingles of two linked documents."""
    join = _Join(docs, size, percent)
    labels = components(join.links())
    ids = join.reps.select("sid", "rep")
    smallest = labels.join(ids.withColumnRenamed("sid", "id"), "id").groupBy("label").agg(F.min("rep").alias("component"))
    of_set = labels.join(smallest, "label").select(F.col("id").alias("sid"), "component")
    named = ids.join(of_set, "sid", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    out = join.nodes.select("doc_id", "sid", "n").join(named, "sid")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(NULL_ID)).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the row of the smallest (doc_id, row_key), with all its columns; empty texts all stay.

    Rows count by id and text, so null and repeated ids lose nothing but copies. Rows equal in both stay once. Groups are
    reduced set by set before they meet, so neither a hot id nor a hot text stands in one task.
    """
    join = _Join(docs, size, percent)
    labels = components(join.links())
    sets = join.reps.filter("n > 0").join(labels.withColumnRenamed("id", "sid"), "sid", "left")
    first = sets.groupBy(F.coalesce("label", "sid").alias("label")).agg(F.min(F.struct("rep", "key")).alias("_r")).select(F.col("_r.key").alias("_key"))
    own = kept(join.nodes.groupBy(F.col("key").alias("_key")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_c")))
    gone = kept(own.filter("n > 0").select("_key").join(first, "_key", "left_anti"))
    out = docs.withColumn("_key", row_key()).join(checked_broadcast(gone, 16), "_key", "left_anti")
    twice = kept(own.filter("_c > 1").select("_key").join(gone, "_key", "left_anti"))
    if twice.limit(1).count():  # only rows that are repeated are shuffled
        few = checked_broadcast(twice, 16)
        out = out.join(few, "_key", "left_anti").unionByName(out.join(few, "_key", "left_semi").dropDuplicates(["_key"]))
    return out.select(*docs.columns)
