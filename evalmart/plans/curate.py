"""Curation jobs: quarantine, flat layout, consolidation, attempt bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.redact import sanitize_attempt, sanitize_verdict_tail
from evalmart.functions.text import strip
from evalmart.operators.curation import normalize_calibration, with_drop_reason
from evalmart.operators.latest import dedup_keep_last, dedup_stats
from evalmart.operators.metrics import manifest_summary
from evalmart.operators.sampling import assign_flat_ids, assign_ids
from evalmart.session import stored

FAILED = ("fail", "error")


def quarantine(tasks: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks that did not fail their selftest, and the manifest summary of those left."""
    failed = results.filter(F.col("status").isin(*FAILED)).select("task_id").distinct()
    kept = tasks.join(failed, "task_id", "left_anti")
    return kept, manifest_summary(kept)


def flatten_layout(tasks: DataFrame, exclude_sources: Sequence[str], prefix: str, width: int, folder: str = "tasks") -> DataFrame:
    """Tasks of the kept sources under new flat ids in family and id order; the first id stays as legacy id.

    ``width`` is the least width of the number.
    """
    kept = tasks.filter(~F.coalesce(F.col("source").isin(list(exclude_sources)), F.lit(False))) if exclude_sources else tasks
    legacy = F.coalesce("legacy_task_id", "task_id") if "legacy_task_id" in tasks.columns else F.col("task_id")
    named = assign_flat_ids(kept.withColumn("_legacy", legacy), ["family", "task_id"], prefix, width)
    return named.drop("legacy_task_id").withColumnRenamed("_legacy", "legacy_task_id").withColumn("task_id", F.col("flat_id")).withColumn(
        "rel_dir", F.concat(F.lit(folder + "/"), "flat_id")).drop("flat_id")


class Source(NamedTuple):
    """One source of a consolidation: its rows, the rules that drop rows, and where records of runs recur, the key whose last
    record by ``order`` stays. ``calibration`` names the columns with a record's summary and its anchors."""

    rows: DataFrame
    rules: Sequence[tuple[str, Column]] = ()
    dedup: Column | None = None
    order: Sequence[str] = ()
    calibration: tuple[str, str] | None = None


class Consolidated(NamedTuple):
    manifest: DataFrame
    summary: DataFrame
    dedup: DataFrame


def _kept(source: Source) -> DataFrame:
    return with_drop_reason(source.rows, source.rules).filter("drop_reason IS NULL").drop("drop_reason") if source.rules else source.rows


def _prepared(name: str, source: Source) -> DataFrame:
    rows = _kept(source)
    if source.dedup is not None:
        rows = dedup_keep_last(rows, source.dedup, source.order).drop("n_copies")
    if source.calibration is not None:
        summary, anchors = source.calibration
        rows = rows.withColumn("calibration", normalize_calibration(F.col(summary), F.col(anchors))).drop(summary, anchors)
    return rows.withColumn("source", F.lit(name))


def consolidate(sources: Mapping[str, Source | tuple], prefixes: Mapping[str, str], modes: Mapping[str, str], order: Sequence[str] = ("orig_id",),
                width: int = 4) -> DataFrame:
    """One manifest from several sources: each filtered by its own rules, freed of earlier runs, tagged, numbered within its family."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_prepared(name, Source(*s)) for name, s in sources.items()])
    lookup = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("family"))
    if "execution_mode" not in rows.columns:
        rows = rows.withColumn("execution_mode", F.lit(None).cast("string"))
    rows = rows.withColumn("execution_mode", F.coalesce("execution_mode", lookup(modes))).withColumn("_p", F.coalesce(lookup(prefixes), F.lit("x")))
    numbered = assign_ids(rows, "family", ["source", *order], F.col("_p"), width)
    return numbered.withColumn("task_id", F.concat_ws("/", "family", "local_id")).drop("_p", "local_id")


def consolidation(sources: Mapping[str, Source | tuple], prefixes: Mapping[str, str], modes: Mapping[str, str], order: Sequence[str] = ("orig_id",),
                  width: int = 4) -> Consolidated:
    """The whole job: the manifest, its summary, and per source with recurring records how many were seen, stayed and went."""
    manifest = stored(consolidate(sources, prefixes, modes, order, width))
    stats = [dedup_stats(_kept(s), s.dedup).select(F.lit(name).alias("source"), "*") for name, s in ((n, Source(*x)) for n, x in sources.items()) if s.dedup is not None]
    none = manifest.sparkSession.createDataFrame([], "source string, seen bigint, survivors bigint, collisions bigint, dropped_by_dedup bigint")
    return Consolidated(manifest, manifest_summary(manifest), reduce(DataFrame.unionByName, stats, none))


def attempt_bundles(cases: DataFrame, results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Case, outcome and task of each key, with attempt and log tails made safe to show."""
    raw = F.coalesce(F.nullif("raw_response", F.lit("")), "extracted_code", F.lit(""))
    attempt = F.when(F.col("execution_mode") == "text_short_answer", sanitize_attempt(raw)).otherwise(strip(raw))
    block = F.concat_ws(
        "\n", F.concat(F.lit("passed: "), F.when(F.col("passed") == 1, "true").otherwise("false")),
        F.concat(F.lit("error_type: "), F.coalesce("error_type", F.lit("unknown"))),
        F.nullif(sanitize_verdict_tail(F.col("stdout_tail")), F.lit("")))
    joined = cases.join(results.drop("task_id", "model", "condition", "family"), "trial_key").join(tasks, "task_id")
    return joined.select("trial_key", "task_id", "family", "execution_mode", attempt.alias("attempt"), block.alias("verdict_block"))
