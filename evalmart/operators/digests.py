"""Digests of sets, ordered lists and record sets, as hash trees of one shape at every size.

Each line is hashed in its own task; equal lines are counted before anything is gathered. A leaf is the set of line hashes
that share their first ``LEAF_DIGITS`` hex digits, every level above drops ``STEP_DIGITS`` of them, and the root hashes what
is left. So no task holds more than one leaf or 16 ** STEP_DIGITS children, whatever the lines' lengths, and a group with
one line more has the same form. Both numbers are part of the digest's name in the column ``form``; digests of other numbers,
or of lines simply joined, have other values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.hashing import canonical_json

LEAF_DIGITS = 6
STEP_DIGITS = 2
FORM = f"sha256-tree-{LEAF_DIGITS}-{STEP_DIGITS}"


def lines_digest(df: DataFrame, group: Sequence[str], line: Column, distinct: bool = False) -> DataFrame:
    """Digest of each group's lines, whatever their order: group, digest, n_lines, form.

    A leaf hashes ``hash:count LF`` of its lines in hash order, an inner node ``prefix:hash LF`` of its children. Leaves are
    dealt out one by one, 16 ** LEAF_DIGITS of them to a group; the levels above, one short row per leaf, lie in the partitions
    of the first ``STEP_DIGITS`` and share one shuffle. A null line is no line.
    """
    key = F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0).alias("all"))
    hashed = df.select(key.alias("_g"), F.sha2(line, 256).alias("_h")).filter("_h IS NOT NULL")
    copies = F.lit(1).cast("bigint") if distinct else F.count(F.lit(1))
    level = hashed.groupBy("_g", "_h").agg(copies.alias("_c")).select(
        "_g", F.left("_h", F.lit(LEAF_DIGITS)).alias("_b"), F.concat("_h", F.lit(":"), F.col("_c").cast("string"), F.lit("\n")).alias("_line"),
        F.col("_c").alias("_n"))
    for digits in range(LEAF_DIGITS, -1, -STEP_DIGITS):
        by = ["_g"] if digits == 0 else ["_g", "_b"] if digits == LEAF_DIGITS else ["_g", "_top", "_b"]
        node = level.groupBy(*by).agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("_line")), ""), 256).alias("_h"), F.sum("_n").alias("_n"))
        if digits:
            level = node.select(
                "_g", F.left("_b", F.lit(STEP_DIGITS)).alias("_top"), F.left("_b", F.lit(digits - STEP_DIGITS)).alias("_b"),
                F.concat("_b", F.lit(":"), "_h", F.lit("\n")).alias("_line"), "_n")
        if digits == LEAF_DIGITS:
            level = level.repartition("_g", "_top")
    return node.select(*[F.col("_g")[g].alias(g) for g in group], F.col("_h").alias("digest"), F.col("_n").alias("n_lines"), F.lit(FORM).alias("form"))


def set_digest(df: DataFrame, group: Sequence[str], name: str, sha: str) -> DataFrame:
    """Order-independent digest of named files: ``name NUL sha LF`` per distinct file."""
    return lines_digest(df, group, F.concat(F.col(name), F.lit("\0"), F.col(sha), F.lit("\n")), True)


def tree_digest(df: DataFrame, group: Sequence[str], path: str, sha: str) -> DataFrame:
    """Digest of a file tree from ``sha  path`` lines."""
    return lines_digest(df, group, F.concat(F.col(sha), F.lit("  "), F.col(path), F.lit("\n")))


def release_root(records: DataFrame, group: Sequence[str], columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Root of release records: digest of their canonical JSON lines."""
    text = canonical_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), exact)
    return lines_digest(records, group, F.concat(text, F.lit("\n")))


def ordered_ids_digest(df: DataFrame, group: Sequence[str], id_col: str, order: str) -> DataFrame:
    """Digest of the ids with their positions: ``position TAB id LF``, so another order is another digest."""
    return lines_digest(df, group, F.concat(F.col(order).cast("string"), F.lit("\t"), F.col(id_col), F.lit("\n")))


def release_id(tag: str, manifest_sha: Column, ids_sha: Column, policy_sha: Column, public_root: Column, private_root: Column) -> Column:
    """Content-bound release id: the leading 24 hex digits of the joined digests under a domain tag."""
    return F.left(F.sha2(F.concat_ws("\0", F.lit(tag), manifest_sha, ids_sha, policy_sha, public_root, private_root), 256), F.lit(24))
