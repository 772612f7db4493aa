"""Corpus curation: funnels, gates, calibration, targets, quarantine inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.checks import first_code
from evalmart.functions.numeric import ratio

# Verdicts of a calibration and the share of kept tasks that opens the next phase.
EASY, HARD, MIXED, BROKEN = "REJECT_trivially_easy", "KEEP_hard", "KEEP_discriminating", "ISOLATE_likely_broken"
GO_SHARE = 0.40


def with_drop_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """First failing rule per row, null for kept rows."""
    return df.withColumn("drop_reason", first_code(*rules))


def funnel(df: DataFrame, rules: Sequence[tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Rows seen, kept and dropped per reason."""
    counts = with_drop_reason(df, rules).groupBy(*by, F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy(*by).agg(F.sum("n").alias("n")).withColumn("outcome", F.lit("seen"))
    return counts.unionByName(seen.select(counts.columns))


def gate_report(records: DataFrame, passed: str = "pass_pre_calibration") -> DataFrame:
    """Pass count and reject counts per gate by family."""
    gate = F.when(F.col("verdict") == passed, passed).otherwise(F.coalesce("gate", F.lit("unknown")))
    counts = records.groupBy("family", gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("family").agg(F.sum("n").alias("total"))
    return counts.join(totals, "family").withColumn("share", F.round(ratio(F.col("n"), F.col("total")), 6))


def normalize_calibration(summary: Column, anchors: Column) -> Column:
    """One calibration record from two shapes: the first anchor's values, else the document's totals.

    ``summary`` has anchor_model, n_pass, n_solved, total_pass, n_trials, total_trials, final_label, verdict.
    """
    first = F.get(anchors, F.lit(0))
    return F.struct(
        F.coalesce(first["model"], summary["anchor_model"]).alias("anchor"),
        F.coalesce(first["n_pass"], summary["n_pass"], summary["n_solved"], summary["total_pass"]).alias("n_pass"),
        F.coalesce(first["n_trials"], summary["n_trials"], summary["total_trials"]).alias("n_trials"),
        F.coalesce(summary["final_label"], summary["verdict"]).alias("verdict"))


def band(n_solved: Column, k: int) -> Column:
    text = n_solved.cast("string")
    return F.when(n_solved == 0, f"0_of_{k}_hard_no_solve").when(n_solved == k, f"{k}_of_{k}_trivially_easy").otherwise(
        F.concat(text, F.lit(f"_of_{k}_discriminating")))


def calibration_verdict(n_solved: Column, k: int, reject_all_fail: bool = False) -> Column:
    return F.when(n_solved == k, EASY).when(n_solved == 0, BROKEN if reject_all_fail else HARD).otherwise(MIXED)


def calibrate(trials: DataFrame, k: int, reject_all_fail: bool = False) -> DataFrame:
    """Band and verdict per task from its solved trials (task_id, family, solved)."""
    per_task = trials.groupBy("task_id", "family").agg(F.sum("solved").cast("bigint").alias("n_solved"))
    n = F.col("n_solved")
    return per_task.withColumn("band", band(n, k)).withColumn("verdict", calibration_verdict(n, k, reject_all_fail))


def calibration_yield(calibrated: DataFrame) -> DataFrame:
    """Kept, rejected and isolated tasks per family and the go signal."""
    v = F.col("verdict")
    out = calibrated.groupBy("family").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v == MIXED).alias("n_discriminating"), F.count_if(v == HARD).alias("n_hard"),
        F.count_if(v == EASY).alias("n_easy"), F.count_if(v == BROKEN).alias("n_isolated"))
    keep = F.col("n_discriminating") + F.col("n_hard")
    return out.withColumn("n_keep", keep).withColumn("keep_percent", F.floor(100 * keep / F.col("total")).cast("bigint")).withColumn(
        "go", keep >= GO_SHARE * F.col("total"))


def target_progress(tasks: DataFrame, assets: DataFrame, target: int) -> DataFrame:
    """Evolved assets per family against the target, and whether every family has reached it."""
    evolved = assets.filter("generation_source = 'evolved'").select("task_id", F.lit(1).alias("_e"))
    per = tasks.join(evolved, "task_id", "left").groupBy("family").agg(F.count("_e").alias("evolved"))
    done = per.agg(F.bool_and(F.col("evolved") >= target).alias("all_reached"))
    return per.withColumn("reached", F.col("evolved") >= target).crossJoin(F.broadcast(done))  # one row


def status_by_family(results: DataFrame) -> DataFrame:
    """Selftest statuses per family, absent ones 0."""
    s = F.col("status")
    return results.groupBy("family").agg(*[F.count_if(s == x).alias(f"n_{x}") for x in ("pass", "fail", "error", "skip")])
