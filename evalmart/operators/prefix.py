"""Running totals, ranks and bounded lists that never put a whole group into one task.

A window over a hot group is one task. Here the order key is cut into chunks of bounded width: the window
over rows runs inside (group, chunk), and only one total per chunk crosses chunks. Where the key is sparse, chunks
are as many as rows; so chunks are cut into wider chunks by a fixed radix, until a group can only have few of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalmart.session import pin

DEFAULT_WIDTH = 1_000_000
RADIX = 1_000_000  # most chunks of a group in one window
FEW_GROUPS = 100_000  # most groups whose starts all go to every task


def running_total(
    df: DataFrame, group: Sequence[str], order: str, value: Column, out: str = "running",
    width: int = DEFAULT_WIDTH, keep_previous: str | None = None,
) -> DataFrame:
    """Running sum of ``value`` by ``order`` (an integer column, unique in the group).

    ``width`` is in units of the order key, so a chunk holds at most ``width`` rows. The range of the key tells how many chunks
    a group can have, and so how many levels of them are needed.
    """
    return _running(df, group, [order], value, out, keep_previous, *ordinal_chunks(df, order, width))


def ordinal_chunks(df: DataFrame, order: str, width: int) -> tuple[Column, int]:
    """Chunk of an integer order key, and how many chunks its range can have."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    return F.expr(f"`{order}` div {int(width)}L"), 1 if low is None else (int(high) - int(low)) // int(width) + 2


def running_count(df: DataFrame, group: Sequence[str], order: str, out: str = "rank", width: int = DEFAULT_WIDTH):
    """``row_number`` by an integer order key."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), out, width)


def running_count_by_digest(df: DataFrame, group: Sequence[str], digest: str, out: str = "rank", hex_digits: int = 4,
                            tie: Sequence[str] = ()):
    """``row_number`` by a hex digest, then ``tie``: the leading digits are evenly spread chunks in the same order."""
    chunk = F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")
    return _running(df, group, [digest, *tie], F.lit(1).cast("bigint"), out, None, chunk, 16 ** hex_digits)


def chunk_offsets(totals: DataFrame, group: Sequence[str], chunks: int) -> DataFrame:
    """``_offset`` of each ``_chunk``: the sum of the group's earlier ones, of which there are ``chunks`` at most."""
    parts, number = [F.col("_chunk")[g] for g in group], F.col("_chunk._n")
    before = lambda *by: F.coalesce(F.sum("_sum").over(
        Window.partitionBy(*by).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if chunks <= RADIX:
        return totals.select("_chunk", before(*parts).alias("_offset"))
    wide = totals.withColumn("_wide", F.struct(*[p.alias(g) for g, p in zip(group, parts, strict=True)], F.expr(f"_chunk._n div {RADIX}L").alias("_n")))
    above = wide.groupBy(F.col("_wide").alias("_chunk")).agg(F.sum("_sum").alias("_sum"))
    base = chunk_offsets(above, group, chunks // RADIX + 1).select(F.col("_chunk").alias("_wide"), F.col("_offset").alias("_base"))
    return wide.join(base, "_wide").select("_chunk", (F.col("_base") + before("_wide")).alias("_offset"))


def _running(df, group, order, value, out, keep_previous, chunk, chunks):
    # Struct keys compare null group values as equal, so such rows are kept.
    tagged = df.withColumn("_chunk", F.struct(*[F.col(g) for g in group], chunk.alias("_n"))).withColumn("_v", value)
    totals = tagged.groupBy("_chunk").agg(F.sum("_v").alias("_sum"))
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    result = tagged.join(chunk_offsets(totals, group, chunks), "_chunk").withColumn(out, F.col("_offset") + F.sum("_v").over(inside))
    if keep_previous:
        result = result.withColumn(keep_previous, F.col(out) - F.col("_v"))
    return result.drop("_chunk", "_v", "_offset")


def ordered_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank", partitions: int | None = None
) -> DataFrame:
    """``row_number`` for any order key: range partitions, then one offset per partition.

    The range partitions are pinned first, because a second run of the sampling may cut elsewhere.
    """
    keys = [*group, *order]
    ranged = (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys))
    pinned = pin(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    key = F.struct(*[F.col(g) for g in group]) if group else F.lit(0)
    cells = pin(pinned.groupBy(part.alias("_part"), key.alias("_g")).agg(F.count(F.lit(1)).alias("_size"), F.min(local).alias("_first")))
    sizes = cells.groupBy("_part").agg(F.sum("_size").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))  # bounded by the partition count
    placed = pinned.withColumn("_part", part).join(offsets, "_part").withColumn(out, F.col("_offset") + local + 1)
    if group:
        starts = cells.join(offsets, "_part").groupBy("_g").agg(F.min(F.col("_offset") + F.col("_first") + 1).alias("_start"), F.count(F.lit(1)).alias("_parts"))
        placed = _with_starts(placed.withColumn("_g", key), starts).withColumn(out, F.col(out) - F.col("_start") + 1)
        placed = placed.drop("_g", "_start")
    return placed.drop("_at", "_part", "_offset")


def _with_starts(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows with the ``_start`` of their group. A group of more than one range partition is never gathered in one task: such groups
    are as few as partitions, so their starts go to the rows. So do all starts if they are few."""
    if starts.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(starts.drop("_parts")), "_g")
    wide = F.broadcast(starts.filter("_parts > 1").drop("_parts"))
    narrow = rows.join(wide, "_g", "left_anti").join(starts.filter("_parts = 1").drop("_parts"), "_g")
    return rows.join(wide, "_g").unionByName(narrow)


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group, for the few rows of a preview; the rank limit is applied in each task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def preview_ids(df: DataFrame, group: Sequence[str], id_col: str, n: int) -> DataFrame:
    """Distinct id count, the first ``n`` ids as text and the count of the others."""
    distinct = df.select(*group, id_col).distinct()
    counts = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("n_ids"))
    head = first_n(distinct, group, [id_col], n).groupBy(*group).agg(
        F.array_join(F.sort_array(F.collect_list(id_col)), ",").alias("preview")
    )
    return counts.join(head, list(group)).withColumn("more", F.greatest(F.col("n_ids") - n, F.lit(0)))
