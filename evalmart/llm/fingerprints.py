"""Threshold-scaled sketches: every five-word shingle hash below a fixed fraction of the hash range is kept.

Sketches of any two texts, however unequal, share one threshold, so intersection over the smaller sketch estimates
containment, and the sketch of a union is the union of the sketches. Should no hash fall below the threshold, the smallest
one stands in; that rule survives merging too (drop what is above the threshold once anything is below it).

All of it is column expressions. Neighbours in id order come from explicit range buckets, so texts are shuffled once: each
bucket also gets a copy of the first document of the next one. A repeated id splits over buckets by text hash.

Defined results: null and empty text have the empty fingerprint; two equal fingerprints have likeness 1, an empty and a
full one 0; with fewer than five words the whole sequence is one shingle; null ids come first; documents of one id follow
each other by text hash; a lone document is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmart.functions.text import bind
from evalmart.llm.common import text_of

SHINGLE = 5
FRACTION_BITS = 2  # keeps one hash in four
MAX_BUCKETS = 512


def sketch(text: Column, size: int = SHINGLE, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sorted distinct shingle hashes below 2^-fraction_bits of the range."""
    limit = 1 << (63 - fraction_bits)

    def shingles(words: Column) -> Column:
        last = F.greatest(F.size(words) - (size - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, size)))

    def kept(hashes: Column) -> Column:
        # half of the range is negative: h in [-limit, limit) is the fraction 2^-fraction_bits of all values
        low = F.filter(hashes, lambda h: (h >= -limit) & (h < limit))
        return bind(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(F.array_min(hashes))))

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    nothing = F.array().cast("array<bigint>")
    return bind(words, lambda w: F.when(F.size(w) == 0, nothing).otherwise(bind(shingles(w), kept)))


def merge_sketches(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sketch of the union of the two shingle sets."""
    limit = 1 << (63 - fraction_bits)
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: (h >= -limit) & (h < limit))
    return F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(both) > 0, F.array(F.array_min(both))).otherwise(both)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.least(F.size(a), F.size(b)))


def fingerprint(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lower(F.hex(h))), " ")


def _bucket(docs: DataFrame, buckets: int) -> Column:
    """Range bucket of (doc_id, _h); equal edges share out the rows of that id by hash."""
    marks = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("doc_id", marks, 10_000)).first()[0] if marks else None
    edges = F.array(*(F.lit(int(e)) for e in found or [])).cast("array<bigint>")
    known = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ties = F.size(F.filter(edges, lambda e: e == known))
    return F.size(F.filter(edges, lambda e: e < known)) + F.floor((F.col("_h").cast("double") / float(1 << 64) + 0.5) * ties).cast("int")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and the next document's ``_text`` and ``_kept`` in id order, with the sketch ``_kept`` of each text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.withColumn("_b", _bucket(rows, buckets))
    key = F.struct(F.col("doc_id").isNotNull().alias("_known"), "doc_id", "_h")
    heads = sorted(((r["_b"], r["k"]) for r in rows.groupBy("_b").agg(F.min(key).alias("k")).collect()), key=lambda x: x[0])
    # At most ``buckets`` rows: the first document of each bucket is also a guest of the bucket before (of the last one, if none is).
    guests = spark.createDataFrame(
        [(k["doc_id"], k["_h"], heads[i - 1][0]) for i, (_, k) in enumerate(heads)], "_id long, _hash long, _home int")
    same = rows["doc_id"].eqNullSafe(guests["_id"]) & (rows["_h"] == guests["_hash"])
    place = F.struct(F.col("_b").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_home").alias("b"), F.lit(True).alias("guest"))
    at = F.explode(F.when(F.col("_home").isNull(), F.array(place)).otherwise(F.array(place, guest)))
    dealt = rows.join(F.broadcast(guests), same, "left").withColumn("_at", at).select("doc_id", "text", "_h", "_at.b", "_at.guest")
    dealt = dealt.repartition(buckets, "b").withColumn("_kept", sketch(F.col("text")))
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").asc_nulls_first(), "_h")
    return dealt.select("doc_id", "text", "_kept", "guest", F.lead("text").over(order).alias("_next_text"), F.lead("_kept").over(order).alias("_next_kept")).filter(~F.col("guest"))


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text: the last half of the code points gives way to the first as many of the next document's.
    """
    rows = with_next(docs, buckets or min(MAX_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("_next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "_kept", "_next_kept", bind(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), sketch(e).alias("kept"))).alias("_e"))
    return rows.select(
        "doc_id", "n_chars", F.col("_e.sha").alias("edited_sha256"), fingerprint(F.col("_kept")).alias("fingerprint"), fingerprint(F.col("_e.kept")).alias("edited_fingerprint"),
        containment(F.col("_kept"), F.col("_e.kept")).alias("near_edited"), containment(F.col("_kept"), F.col("_next_kept")).alias("near_next"),
    )
