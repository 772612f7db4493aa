"""Release audits: repository audit, bundle checks, code trees, freezes, build plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.operators.digests import release_root
from evalmart.operators.joins import compare_file_sets, field_equality, hash_overlap, source_overlap
from evalmart.operators.leaks import scan_content
from evalmart.operators.rules import path_policy

# Roles that are sensitive, roles of sanitised pairs, columns of a release record.
SENSITIVE_PREFIXES = ("judge.", "reference.", "legacy.", "authoring.oracle", "privacy.")
SANITIZED_ROLES = (
    "runtime.sanitized_ooxml_input", "environment.sanitized_ooxml_input", "context.gene_gemini31pro", "context.gene_opus48",
)
ORIGINAL_ROLE = "privacy.host_path_metadata"
RUNTIME_PREFIXES = ("runtime.", "environment.")
RECORD_COLUMNS = ("bundle_path", "family", "execution_mode", "materialize", "mode", "role", "sha256", "size", "source_relpath", "task_id")
HEX64 = "^[0-9a-f]{64}$"
CODE_SUFFIXES = r"\.(?:py|md|txt|json|jsonl|yaml|yml|toml|cfg|ini|csv|sh|tex|cff)$"


def rows(df: DataFrame, code: str | Column, key: str | Column) -> DataFrame:
    code_col = F.lit(code) if isinstance(code, str) else code
    return df.select(code_col.alias("code"), (F.col(key) if isinstance(key, str) else key).alias("key"))


def audit_repository(classified: DataFrame, content: DataFrame, globs: Sequence[str], regexes: Sequence[str]) -> DataFrame:
    """All violations (code, key) of classified assets.

    ``classified`` comes from ``classify_assets`` with path, sha256, size; ``content`` has path, content, sha256.
    It is read once per kind of check, so persist it or write it first when the inventory is large.
    """
    fine = classified.filter("state = 'classified'")
    public = fine.filter("distribution = 'public'")
    scanned = scan_content(content.join(public.select("path").distinct(), "path", "left_semi"), globs, regexes)
    destinations = fine.filter("bundle_path IS NOT NULL").groupBy("distribution", "bundle_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    overlaps = hash_overlap(fine, SENSITIVE_PREFIXES)
    own = F.when(F.col("state") == "unclassified", "unclassified_asset").when(F.col("state") == "conflict", "classification_conflict").when(
        ~F.col("safe_path"), "unsafe_destination")
    return (
        rows(classified, own, "path").filter("code IS NOT NULL")
        .unionByName(rows(destinations, "duplicate_bundle_destination", "bundle_path"))
        .unionByName(rows(scanned, F.concat(F.lit("public_"), "code"), F.concat_ws(" ", "path", "pattern")))
        .unionByName(rows(overlaps, "sensitive_content_cross_distribution", "sha256"))
    )


def release_inventory(classified: DataFrame) -> DataFrame:
    """Record counts and bytes by distribution and by role."""
    finest = classified.filter("state = 'classified'").groupBy("distribution", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    d, r = F.col("distribution"), F.col("role")
    return finest.groupingSets([[d], [d, r]], d, r).agg(
        F.grouping("role").alias("_g"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    ).select("distribution", F.when(F.col("_g") == 1, "all").otherwise(F.col("role")).alias("role"), "n", "bytes")


def release_records(classified: DataFrame) -> DataFrame:
    """Records of the build plan, one per asset with a destination."""
    return classified.filter("state = 'classified' AND bundle_path IS NOT NULL").select("distribution", *[
        F.col(c) if c in classified.columns else F.lit(None).cast("string").alias(c) for c in RECORD_COLUMNS])


def release_roots(records: DataFrame) -> DataFrame:
    return release_root(records, ["distribution"], list(RECORD_COLUMNS))


def runtime_view(classified: DataFrame) -> DataFrame:
    """Public runtime files (task_id, path, source): their own path, and the flat path of ``data/`` files where free."""
    is_runtime = F.lit(False)
    for prefix in RUNTIME_PREFIXES:
        is_runtime = is_runtime | F.col("role").startswith(prefix)
    own = classified.filter((F.col("distribution") == "public") & is_runtime).select(
        "task_id", F.col("relpath").alias("path"), F.col("relpath").alias("source"))
    flat = own.filter(F.col("path").startswith("data/")).withColumn("path", F.regexp_replace("path", "^data/", ""))
    free = flat.join(own.select("task_id", "path"), ["task_id", "path"], "left_anti")
    return own.unionByName(free)


def record_codes(records: DataFrame) -> DataFrame:
    """Shape violations of release records."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    codes = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("mode").isin("0644", "0755"), F.lit(False)), "invalid_asset_mode"), F.when(blank("role"), "invalid_asset_role"),
        F.when(~F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False)), "invalid_asset_sha256"),
        F.when(~F.coalesce(F.col("size") >= 0, F.lit(False)), "invalid_asset_size"), F.when(F.col("materialize").isNull(), "invalid_asset_materialize")))
    return records.select(F.explode(codes).alias("code"), F.col("bundle_path").alias("key"))


def verify_bundle(records: DataFrame, actual: DataFrame, checksums: DataFrame, declared_root: str | None = None) -> DataFrame:
    """All violations of one bundle: record shapes, repeated paths, files, checksums, root.

    ``actual``: path, sha256, size of the files on disk; ``checksums``: path, sha256.
    """
    twice = records.groupBy("bundle_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Of a repeated path, the smallest and the largest record are compared, whatever the partitioning.
    record = F.struct("sha256", "size")
    outer = records.groupBy(F.col("bundle_path").alias("path")).agg(F.array_distinct(F.array(F.min(record), F.max(record))).alias("r"))
    declared = outer.select("path", F.explode("r").alias("r")).select("path", "r.sha256", "r.size")
    files = compare_file_sets(declared, actual)
    sums = compare_file_sets(checksums, actual, ["sha256"])
    out = (
        record_codes(records).unionByName(rows(twice, "duplicate_bundle_path", "bundle_path"))
        .unionByName(rows(files, F.concat(F.lit("asset_"), "code"), "key"))
        .unionByName(rows(sums, F.concat(F.lit("checksum_"), "code"), "key")))
    if declared_root is not None:
        root = release_root(records, [], list(RECORD_COLUMNS))
        out = out.unionByName(rows(root.filter(F.col("digest") != declared_root), "asset_root_mismatch", "digest"))
    return out


def cross_bundle(public: DataFrame, private: DataFrame, public_fields: DataFrame, private_fields: DataFrame) -> DataFrame:
    """Violations between two bundles: fields, shared sources that are no sanitised pair, shared sensitive bytes."""
    allowed = (
        F.col("pub.role").isin(list(SANITIZED_ROLES)) & ~F.col("pub.materialize") & (F.col("prv.role") == ORIGINAL_ROLE) & F.col("prv.materialize"))
    named = lambda df: df.withColumnRenamed("source_relpath", "source_path")
    shared = source_overlap(named(public), named(private), allowed)
    both = public.withColumn("distribution", F.lit("public")).unionByName(private.withColumn("distribution", F.lit("private")))
    overlaps = hash_overlap(both.withColumnRenamed("bundle_path", "path"), SENSITIVE_PREFIXES)
    return (
        rows(field_equality(public_fields, private_fields), "cross_bundle_mismatch", "field")
        .unionByName(rows(shared, "public_private_source_overlap", "source_path"))
        .unionByName(rows(overlaps, "cross_bundle_sensitive_hash_overlap", "sha256")))


def verify_tree(manifest: DataFrame, actual: DataFrame, components: Sequence[str], basenames: Sequence[str], regexes: Sequence[str],
                exempt: DataFrame | None = None) -> DataFrame:
    """Violations of a code tree: file set, path policy, forbidden content of its text files.

    ``actual``: path, sha256, size, content.
    """
    files = compare_file_sets(manifest, actual)
    paths = actual.select(path_policy(F.col("path"), components, basenames).alias("code"), F.col("path").alias("key")).filter("code IS NOT NULL")
    text = actual.filter(F.lower("path").rlike(CODE_SUFFIXES) | F.col("path").endswith(".gitignore"))
    content = scan_content(text, [], regexes, exempt)
    return files.unionByName(paths).unionByName(rows(content, "code", F.concat_ws(" ", "path", "pattern")).withColumn("code", F.lit("forbidden_content")))


def manifest_from_release(records: DataFrame, role: str = "prompt.task") -> DataFrame:
    """Task rows of a public release: one per prompt record."""
    return records.filter(F.col("role") == role).select(
        "task_id", "family", "execution_mode", F.lit("public_bundle").alias("source"), F.concat(F.lit("scenarios/"), "task_id").alias("rel_dir"))


def manifest_violations(tasks: DataFrame, expected: int) -> DataFrame:
    """Prompt records without task, tasks with several prompts, and a count that is not the canonical one."""
    blank = rows(tasks.filter("coalesce(task_id, '') = ''"), "prompt_without_task", "rel_dir")
    twice = rows(tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_task", "task_id")
    count = tasks.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)
    return blank.unionByName(twice).unionByName(rows(count, "task_count_mismatch", F.col("n").cast("string")))


def check_freeze(published: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Files of a rebuild against the published set: missing, extra, other bytes, other size."""
    return compare_file_sets(published, rebuilt)
