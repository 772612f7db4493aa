"""Benchmark decontamination by templates.

Words become template tokens: numbers, units after numbers and capitalised names inside sentences give way to typed
placeholders, everything else is its lower-cased core. Windows of template tokens with enough literal words are hash-joined
with those of the benchmark; a benchmark window that is too dense in numbers, units or names for that is sought in its exact
form (all cores), so every item with any word has windows at all its places and a verbatim copy meets all of them. Windows on one diagonal (document place minus item place) belong to one occurrence; there,
equal values of the item must meet equal values of the document, so a question with other numbers or names is caught and an
accidental frame is not. A document is a leak of an item if consistent windows cover enough of all its windows, or enough of
those with literals (dense windows of another parameterisation cannot meet), or as many as a passage of ``PASSAGE`` words has. ``coverage`` is the share of all windows.

Before the join each task drops windows that no benchmark window can equal, by a bitmap of fixed size over window hashes.
A capitalised word that opens a sentence has two readings, its core and a name; so has a unit that opens an item, since a number
may stand before the copy. Items emit windows in every mixture of readings, documents in two: all openers as cores and all as
names. So neither what stands before a copy nor another name at the head of a sentence hides it.

An item shorter than a window is one window of its own length, sought at that length.

Defined results: null or empty texts, documents and items alike, match nothing; repeated documents are reported each,
repeated items by each item_id; a null id stays null; ties do not arise, every (document, item) is one row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import checked_broadcast, kept, kept_in_light_batches, mixed, slices, text_of
from evalmart.llm.quality import row_key

WINDOW = 8
LITERALS = 5  # of a window; shorter items in proportion
COVERAGE = 0.4
PASSAGE = 50  # words of an item that suffice, however long the item is
CONSISTENT = 0.75
BITMAP_BITS = 22
MEMO_WORDS = 100_000
SLICE = 1 << 19  # bytes of text cut into windows at once; their arrays take some thirty times as many
# Unit names and signs.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent degree degrees °c °f k w kw kwh v volt volts a hz khz mhz ghz b kb mb gb tb $ € £ usd eur gbp dollar dollars euro euros cent cents mph kmh".split())
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
EDGES = "\"'`´‘’“”„«»()[]{}<>.,;:!?…*_~|-–—/\\#"
LITERAL, NUM, NAME_CASE, UNIT, NUM_UNIT, EMPTY = range(6)
EXACT = np.uint64(xxhash.xxh64_intdigest("<exact>"))
PLACEHOLDERS = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>") for k in ("number", "name", "unit", "quantity"))], np.uint64)


def classify(word: str) -> tuple[int, int, bool]:
    """Kind of a word, hash of its core, and whether it ends a sentence."""
    core = word.strip(EDGES)
    ends = word.rstrip("\"'”’»)]*_").endswith((".", "!", "?", ":"))
    low = core.lower()
    if not core:
        return (UNIT if word in UNITS else EMPTY), xxhash.xxh64_intdigest(word), ends
    value = xxhash.xxh64_intdigest(low)
    if NUMBER.fullmatch(low):
        return NUM, value, ends
    plain = low.lstrip("$€£")
    head = NUMBER.match(plain)
    if head and (plain[head.end():] in UNITS or (plain != low and head.end() == len(plain))):
        return NUM_UNIT, value, ends
    if low in UNITS:
        return UNIT, value, ends
    return (NAME_CASE if core[0].isupper() and core[1:].islower() else LITERAL), value, ends


@lru_cache(maxsize=1)
def _memo() -> dict[str, tuple[int, int, bool]]:
    return {}


def template(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, hashes of cores, slot types (0 for literals) with openers as literals and as names, and token offsets of each text."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    memo = _memo()
    if len(memo) > MEMO_WORDS:
        memo.clear()
    info = []
    for w in coded.dictionary.to_pylist():
        got = memo.get(w)
        if got is None:
            got = memo[w] = classify(w)
        info.append(got)
    kind = np.array([x[0] for x in info], np.int8)
    value = np.array([x[1] for x in info], np.uint64)
    ends = np.array([x[2] for x in info], bool)
    at = coded.indices.to_numpy()
    kind, value, ends = (x[at] if len(info) else x for x in (kind, value, ends))
    opens = np.zeros(len(kind), bool)
    opens[1:] = ends[:-1]
    opens[offsets[:-1][offsets[:-1] < len(kind)]] = True
    full = kind != EMPTY
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    kind, value, opens = kind[full], value[full], opens[full]
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = kind[:-1] == NUM
    after_number[offsets[:-1][offsets[:-1] < len(kind)]] = False  # a text does not depend on the one before it
    slot = np.where(kind == NUM, 1, np.where((kind == NAME_CASE) & ~opens, 2, np.where((kind == UNIT) & after_number, 3, np.where(kind == NUM_UNIT, 4, 0))))
    return kind, value, slot, np.where(kind == NAME_CASE, 2, slot), offsets


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
        out ^= out >> np.uint64(29)
    return mixed(out)


def _needed(size: int) -> int:
    return max(1, -(-LITERALS * size // WINDOW))


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the benchmark at every place of an item: as a template where literals suffice, in exact form where words that are literals anywhere do not.

    ``_rich``: the place has a template window; ``_plain``: the row is one.
    """
    for batch in slices(batches, limit=SLICE):
        kind, value, slot, named, offsets = template(batch.column("text"))
        heads = offsets[:-1][np.diff(offsets) > 0]
        named[heads[kind[heads] == UNIT]] = 3
        codes = np.where(slot > 0, PLACEHOLDERS[slot], value)
        owner, at, rich, plain, found, held = [], [], [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            size = min(b - a, WINDOW)
            if size == 0:
                continue
            exact, templates = (window_hashes(c[a:b], size).view(np.int64).tolist() for c in (value ^ EXACT, codes))
            for k in range(b - a - size + 1):
                span = slice(a + k, a + k + size)
                spare = int((slot[span] == 0).sum()) - _needed(size)
                enough = spare >= 0
                rows = [(True, templates[k], slot[span])] if enough else []
                open_ = np.flatnonzero(slot[span] != named[span])
                for some in chain.from_iterable(combinations(open_.tolist(), n) for n in range(1, min(len(open_), spare) + 1)):
                    mix = slot[span].copy()
                    mix[list(some)] = named[span][list(some)]
                    rows.append((False, int(window_hashes(np.where(mix > 0, PLACEHOLDERS[mix], value[span]), size).view(np.int64)[0]), mix))
                if int((kind[span] == LITERAL).sum()) < _needed(size):
                    rows.append((False, exact[k], named[span]))
                for is_plain, h, mix in rows:
                    owner.append(i)
                    at.append(k)
                    rich.append(enough)
                    plain.append(is_plain)
                    found.append(h)
                    held.append(np.where(mix > 0, value[span], np.uint64(0)).view(np.int64).tolist())
        take, lengths = pa.array(owner, pa.int64()), np.diff(offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").take(take), pa.array(at, pa.int64()), pa.array(found, pa.int64()), pa.array(held, pa.list_(pa.int64())), pa.array(lengths[owner] if owner else [], pa.int64()), pa.array(plain, pa.bool_()), pa.array(rich, pa.bool_())],
            ["item_id", "_at", "_hash", "_values", "_tokens", "_plain", "_rich"],
        )
    _memo().clear()


def _windows(sizes: list[int], bitmap: bytes):
    """Rows (doc_id, _key, _at, _hash, _values, _plain) of windows that may be in the bitmap: templates with enough literals in both readings, and exact forms."""
    bits = np.frombuffer(bitmap, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            _, value, slot, named, offsets = template(batch.column("text"))
            readings = [(np.where(s > 0, PLACEHOLDERS[s], value), value, _sums(s == 0), other, other is None) for s, other in ((slot, None), (named, _sums(slot != named)))]
            readings.append((value ^ EXACT, value, None, None, False))
            rows, places, found, held, lengths, plain = [], [], [], [], [], []
            for size in sizes:
                start = np.arange(max(len(value) - size + 1, 0))
                owner = np.searchsorted(offsets, start, "right") - 1
                inside = start + size <= offsets[owner + 1] if len(start) else np.zeros(0, bool)
                for codes, values, literal, other, is_plain in readings:
                    hashes = window_hashes(codes, size)
                    spot = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    ok = inside & ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1)
                    if literal is not None:
                        ok &= literal[start + size] - literal[start] >= _needed(size)
                    if other is not None:
                        ok &= other[start + size] > other[start]
                    rows.append(owner[ok])
                    places.append(start[ok])
                    found.append(hashes[ok])
                    plain.append(np.full(int(ok.sum()), is_plain))
                    held.append(values[start[ok][:, None] + np.arange(size)].ravel())
                    lengths.append(np.full(int(ok.sum()), size))
            owner, start, hashes, held, lengths, plain = map(np.concatenate, (rows, places, found, held, lengths, plain))
            take, lists = pa.array(owner), pa.ListArray.from_arrays(pa.array(_sums(lengths), pa.int32()), pa.array(held.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_key").take(take), pa.array(start - offsets[owner]), pa.array(hashes.view(np.int64)), lists, pa.array(plain)],
                ["doc_id", "_key", "_at", "_hash", "_values", "_plain"],
            )
        _memo().clear()

    return run


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, changed_slots, _key: documents that hold an item or a re-parameterised form of it."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    known = kept_in_light_batches(own.mapInArrow(_item_windows, "item_id long, _at long, _hash long, _values array<long>, _tokens long, _plain boolean, _rich boolean"))
    spot = F.shiftrightunsigned("_hash", 64 - BITMAP_BITS)
    # A bitmap of 2^22 bits in 128 pieces, whatever the benchmark's size.
    pieces = known.select(F.bitmap_bucket_number(spot + 1).alias("b"), F.bitmap_bit_position(spot + 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bitmap = bytearray(1 << (BITMAP_BITS - 3))
    for r in pieces:
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
    present = sorted(r["n"] for r in known.select(F.least("_tokens", F.lit(WINDOW)).alias("n")).distinct().collect()) or [WINDOW]  # at most WINDOW sizes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), row_key().alias("_key"))
    seen = rows.mapInArrow(_windows(present, bytes(bitmap)), "doc_id long, _key long, _at long, _hash long, _values array<long>, _plain boolean")
    bench = known.select("item_id", F.col("_hash").alias("_h"), F.col("_at").alias("_item_at"), F.col("_values").alias("_item_values"), F.col("_plain").alias("_item_plain"), "_rich")
    totals = known.groupBy("item_id").agg(F.countDistinct("_at").alias("_windows"), F.countDistinct(F.when(F.col("_rich"), F.col("_at"))).alias("_templates"))
    joined = seen.join(bench, F.col("_hash") == F.col("_h"))
    # Plain templates count by themselves and with all other forms: values that only the other forms show can add windows, never take any away.
    forms = F.explode(F.when(F.col("_plain") & F.col("_item_plain"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("_form")
    met = kept_in_light_batches(joined.select("doc_id", "_key", "item_id", "_item_at", "_rich", (F.col("_at") - F.col("_item_at")).alias("_diagonal"), "_values", "_item_values", forms))
    who = ["doc_id", "_key", "item_id"]
    run = [*who, "_diagonal", "_form"]
    pairs = met.select(*run, F.explode(F.arrays_zip("_item_values", "_values")).alias("v")).filter("v._item_values <> 0")
    places = pairs.groupBy(*run, F.col("v._item_values").alias("_was")).agg(F.min("v._values").alias("_lo"), F.max("v._values").alias("_hi"))
    slots = places.groupBy(*run).agg(F.count(F.lit(1)).alias("_slots"), F.sum((F.col("_lo") == F.col("_hi")).cast("long")).alias("_steady"), F.sum((F.col("_lo") != F.col("_was")).cast("long")).alias("_changed"))
    left, right = met.groupBy(*run).agg(F.collect_set(F.struct("_item_at", "_rich")).alias("_places")), slots
    on = [left[c].eqNullSafe(right[c]) for c in run]
    runs = left.join(right, on, "left").select(*(left[c] for c in run), "_places", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_slots", "_steady", "_changed")))
    steady = runs.filter(F.col("_steady") >= CONSISTENT * F.col("_slots")).groupBy(*who, "_diagonal").agg(F.max_by(F.struct("_places", "_slots", "_changed"), "_form").alias("r")).select(*who, "r.*")
    places = F.array_distinct(F.flatten(F.collect_list("_places")))
    found = steady.groupBy(*who).agg(places.alias("_places"), F.max("_slots").alias("n_slots"), F.min("_changed").alias("changed_slots"))
    found = found.withColumn("n_windows", F.size("_places").cast("long")).withColumn("_met", F.size(F.filter("_places", lambda p: p["_rich"])))
    total = checked_broadcast(totals.withColumnRenamed("item_id", "_item"), 32)
    covered = found.join(total, F.col("item_id").eqNullSafe(F.col("_item"))).withColumn("coverage", F.round(F.col("n_windows") / F.col("_windows"), 6))
    enough = (F.col("coverage") >= coverage) | (F.round(F.col("_met") / F.nullif("_templates", F.lit(0)), 6) >= coverage) | (F.col("n_windows") >= PASSAGE - WINDOW + 1)
    return covered.filter(enough).select("doc_id", "item_id", "n_windows", "coverage", "n_slots", "changed_slots", "_key")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without leaks, with all their columns."""
    gone = kept(leaks(docs, items).select("_key").distinct())
    return docs.withColumn("_key", row_key()).join(checked_broadcast(gone, 16), "_key", "left_anti").drop("_key")
