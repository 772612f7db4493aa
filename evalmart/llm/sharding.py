"""Sharding by extendible hashing: a directory of hash-prefix bits in which only oversized buckets split on another bit.

The key's bits are the MD5 of (doc_id, text); rows that are equal in both go on with the bits of their row number, so even
one key with a third of all rows splits. Sizes are summed per prefix: once for fine cells and all their ancestors, and once
more for the rows of those cells alone that are still too large. Texts are never shuffled.

Defined results: null or empty text has 0 bytes and still a shard; a null doc_id is hashed as the word null; repeated rows
get shards like any others; one text above the limit is alone in its shard, marked by shard_bytes above the limit; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmart.llm.common import kept, text_of

SHARD_BYTES = 16 << 20
CELL_BITS = 4
MORE_BITS = 8


def _bits(hexadecimal: Column) -> Column:
    return F.concat(*(F.lpad(F.conv(F.substring(hexadecimal, at, 8), 16, 2), 32, "0") for at in (1, 9, 17, 25)))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell -> its shard: the shortest prefix of at least ``low`` bits that fits, else the cell itself."""
    above = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    above = above.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    sizes = above.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == high)
    first = F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_docs")))
    return above.join(sizes, "prefix").groupBy("cell").agg(first.alias("leaf")).select("cell", "leaf.*")


def extendible_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs of every row.

    The key rows are kept in a table: sizes and assignment must see the same row numbers.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    active = kept(keyed).withColumn("_bits", F.concat(_bits(F.col("_key")), _bits(F.md5(F.col("_row").cast("string")))))
    total = active.agg(F.sum("n_bytes")).first()[0] or 0
    want = max(0, math.ceil(math.log2(max(1, total) / limit)))
    low, high, out = max(0, want - 6), want + CELL_BITS, None
    while low and active.groupBy(F.expr(f"substring(_bits, 1, {low})")).agg(F.sum("n_bytes").alias("b")).filter(F.col("b") <= limit).limit(1).count():
        low = max(0, low - 6)  # a shallow bucket that fits must not be split
    while True:
        rows = active.withColumn("cell", F.expr(f"substring(_bits, 1, {high})"))
        cells = rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        leaves = _leaves(cells, low, high, limit)
        over = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1) & F.lit(high < 256)
        part = rows.join(leaves.filter(~over), "cell").select("doc_id", "n_bytes", F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_docs")
        out = part if out is None else out.unionByName(part)
        large = leaves.filter(over)
        if not large.limit(1).count():
            return out
        active = kept(rows.join(large.select("cell"), "cell", "left_semi").drop("cell"))
        low, high = high + 1, min(256, high + MORE_BITS)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Documents as Parquet, one folder per shard; needs unique doc_id."""
    assigned = extendible_shards(docs, limit).select("doc_id", "shard")
    docs.join(assigned, "doc_id").repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


ORACLE_SQL = f"""
WITH keyed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         from_hex(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')))::BIT::VARCHAR AS bits
  FROM documents
), paths AS (SELECT doc_id, n_bytes, d AS depth, substr(bits, 1, d::BIGINT) AS shard FROM keyed, range(0, 33) AS t(d)),
sizes AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM paths GROUP BY ALL),
leaf AS (SELECT doc_id, min(depth) AS depth FROM paths JOIN sizes USING (depth, shard) WHERE shard_bytes <= {SHARD_BYTES} GROUP BY doc_id)
SELECT p.doc_id, p.n_bytes, p.shard, p.depth::INTEGER AS depth, s.shard_bytes, s.shard_docs
FROM paths p JOIN leaf USING (doc_id, depth) JOIN sizes s USING (depth, shard)
"""
