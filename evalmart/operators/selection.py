"""Selection without sorting groups: the first rows, the n-th row and exact percentiles of groups of any size.

Counts decide where the wanted rows lie, and only the rows there are ranked or looked at again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalmart.operators.prefix import DEFAULT_WIDTH, chunk_offsets, ordinal_chunks
from evalmart.session import stored

DIGITS = 4
BINS = 4096


def first_by_digest(df: DataFrame, group: Sequence[str], digest: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows per group by a hex digest, then ``tie``; the leading digits are evenly spread chunks."""
    chunk = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint")
    return _first(df, group, [digest, *tie], n, chunk, 16**DIGITS).drop("_rank")


def nth_by_ordinal(df: DataFrame, group: Sequence[str], order: str, n: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The ``n``-th row per group by an integer column that is unique in the group."""
    return _first(df, group, [order], n, *ordinal_chunks(df, order, width)).filter(F.col("_rank") == n).drop("_rank")


def _first(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, chunk: Column, chunks: int) -> DataFrame:
    """Rows are counted per chunk; chunks that begin after the n-th row go, and what is left is ranked inside its chunk."""
    tagged = df.withColumn("_chunk", F.struct(*[F.col(g) for g in group], chunk.alias("_n")))
    totals = tagged.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_sum"))
    reached = chunk_offsets(totals, group, chunks).filter(F.col("_offset") < n)
    inside = Window.partitionBy("_chunk").orderBy(*order)
    met = tagged.join(reached, "_chunk").withColumn("_rank", F.col("_offset") + F.row_number().over(inside))
    return met.filter(F.col("_rank") <= n).drop("_chunk", "_offset")


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group, ``wanted`` by name; null values do not count.

    Each wanted rank has an interval of values that holds it. A pass counts the rows of the interval in bins, takes the bin of
    the rank and shrinks the interval to the values found there, until one value is left. A pass reads the rows once, combines
    in each task, and keeps a few counters per group, whatever the group's size.
    """
    key = F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0).alias("_all"))
    rows = df.filter(F.col(value).isNotNull()).select(key.alias("_g"), F.col(value).alias("_v"))
    sizes = stored(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), f((F.col("_n") - 1) * F.lit(float(p))).cast("bigint").alias("rank")) for name, p in wanted.items() for f in (F.floor, F.ceil)])
    targets = sizes.select("_g", "_lo", "_hi", F.explode(F.array_distinct(F.transform(ranks, lambda r: r["rank"]))).alias("_rank"), F.lit(0).cast("bigint").alias("_before"))
    while True:
        targets = stored(targets)
        open_ = targets.filter("_lo < _hi")
        if open_.isEmpty():
            break
        targets = targets.filter("_lo = _hi").unionByName(_narrowed(rows, open_))
    found = targets.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))  # a few ranks
    where = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    at = lambda f, p: F.element_at("_at", f(where(p)).cast("bigint")).cast("double")
    share = lambda p: where(p) - F.floor(where(p))
    result = [F.when(share(p) == 0, at(F.floor, p)).otherwise(at(F.floor, p) * (1 - share(p)) + at(F.ceil, p) * share(p)).alias(name) for name, p in wanted.items()]
    joined = sizes.select("_g", "_n").join(found, "_g")
    return joined.select(*[F.col("_g")[g].alias(g) for g in group], *result)


def _narrowed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    intervals = targets.groupBy("_g").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_i"))  # at most two a percentile
    mine = F.filter("_i", lambda i: (F.col("_v") >= i["_lo"]) & (F.col("_v") <= i["_hi"]))
    inside = rows.join(intervals, "_g").select("_g", "_v", F.explode(mine).alias("_i")).select("_g", "_v", "_i.*")
    lo, hi, v = (F.col(c).cast("double") / 2 for c in ("_lo", "_hi", "_v"))  # halves: no range overflows
    place = F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
    # Values too close for doubles to part: the smallest one gets a bin of its own, so every pass ends with less.
    bin_ = F.when(F.col("_v") == F.col("_lo"), F.lit(-1)).when(F.col("_v") == F.col("_hi"), F.lit(BINS)).when(hi > lo, place).otherwise(F.lit(0))
    counted = inside.groupBy("_g", "_lo", "_hi", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_lo", "_hi").orderBy("_bin"))
    bins = counted.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    met = targets.join(bins, ["_g", "_lo", "_hi"]).withColumn("_at", F.col("_rank") - F.col("_before"))
    hit = met.filter((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_upto")))
    return hit.select("_g", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "_rank", (F.col("_before") + F.col("_from")).alias("_before"))
