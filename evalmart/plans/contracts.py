"""Contracts of run logs: record rules, single values, resume, comparability, merge evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.checks import code_array
from evalmart.operators.joins import diff_run_identity, merge_state, prompt_parity

# Names and defaults of the run contract.
PROTOCOL_FIELDS = ("prompt_protocol", "scoring_protocol", "runtime_protocol")
LEGACY_PROTOCOL = "legacy-v1"
HEX64 = "^[0-9a-f]{64}$"
RESUME_FIELDS = (
    "models", "conditions", "selected_task_ids", "asset_digest", "manifest_sha256", "score_pass_threshold",
    "runtime_policy", "model_registry", "api_protocol", "source_digest",
)


def _blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def single_values(log: DataFrame, fields: Sequence[str], config: Mapping[str, str] | None = None,
                  defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Per field: its value over all records and the config, how many records have it, whether it was inferred.

    A field with more than one value has state ``mixed``. Smallest and largest value decide, so no value set
    is collected.
    """
    config, defaults = config or {}, defaults or {f: LEGACY_PROTOCOL for f in PROTOCOL_FIELDS}
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for f in fields:
        value = _blank_to_null(F.col(f))
        aggregates += [F.min(value).alias(f"_lo_{f}"), F.max(value).alias(f"_hi_{f}"), F.count(value).alias(f"_c_{f}")]
    one = log.agg(*aggregates)
    rows = []
    for f in fields:
        given = F.lit(config.get(f)).cast("string")
        lo, hi = F.least(F.col(f"_lo_{f}"), given), F.greatest(F.col(f"_hi_{f}"), given)
        state = F.when(lo.isNull(), F.lit("inferred" if f in defaults else "absent")).when(lo != hi, "mixed").otherwise("single")
        rows.append(F.struct(
            F.lit(f).alias("field"), F.when(lo == hi, lo).when(lo.isNull(), F.lit(defaults.get(f))).alias("value"),
            F.col(f"_c_{f}").alias("n_with"), F.col("_n").alias("n_records"), state.alias("state")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def model_ids(log: DataFrame) -> DataFrame:
    """Requested model ids per alias; more than one is a violation."""
    alias = F.coalesce(_blank_to_null(F.col("model")), F.lit("<unlabeled>"))
    pairs = log.select(alias.alias("alias"), _blank_to_null(F.col("model_id")).alias("model_id")).distinct()
    return pairs.groupBy("alias").agg(
        F.count("model_id").alias("n_ids"), F.min("model_id").alias("first_id"), F.max("model_id").alias("last_id")
    ).withColumn("violation", F.col("n_ids") > 1)


def hash_stability(log: DataFrame, key: str = "trial_key") -> DataFrame:
    """Logical trials whose prompt hashes changed between records."""
    changed = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return log.groupBy(key).agg(
        changed("user_hash").alias("user_changed"), changed("system_hash").alias("system_changed"),
        F.max_by("user_hash", "seq").alias("latest_user_hash"),
    ).filter("user_changed OR system_changed")


def result_codes(expected: Mapping[str, str]) -> Column:
    """All broken rules of a nested result record. ``expected`` holds the run's metadata values."""
    rec, trial, ev, tok = F.col, F.col("trial"), F.col("eval"), F.col("tokens")
    derived = F.concat_ws("::", trial["model"], trial["condition"], trial["task_id"])
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    nonneg = lambda c: F.coalesce(finite(c) & (c >= 0), F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rules = [(f"contract_{f}", ~F.col(f).eqNullSafe(F.lit(v))) for f, v in expected.items()]
    rules += [
        ("trial_missing", trial.isNull()), ("trial_key_blank", blank(trial["trial_key"])),
        ("trial_key_disagrees", trial["model"].isNotNull() & trial["condition"].isNotNull() & trial["task_id"].isNotNull()
         & (derived != trial["trial_key"])),
        ("eval_missing", ev.isNull()), ("eval_mode_blank", blank(ev["mode"])), ("eval_passed", ev["passed"].isNull()),
        *[(f"eval_{f}", ~nonneg(ev[f].cast("double"))) for f in ("n_pass", "n_fail", "n_total")],
        ("eval_pass_rate", ~nonneg(ev["pass_rate"])), ("eval_pass_rate_over_1", ev["pass_rate"] > 1),
        ("eval_agg_score", ev["agg_score"].isNotNull() & ~finite(ev["agg_score"])),
        ("eval_scores", ev["scores"].isNull() | F.exists(F.map_values(ev["scores"]), lambda v: ~finite(v))),
        ("eval_error_type_blank", blank(ev["error_type"])), ("model_id_blank", blank(rec("model_id"))),
        ("tokens_missing", tok.isNull()),
        *[(f"tokens_{f}", ~F.coalesce(tok[f] >= 0, F.lit(False))) for f in ("input", "output", "thoughts", "system_chars", "user_chars")],
        ("cost_usd", ~nonneg(rec("cost_usd"))), ("elapsed_s", ~nonneg(rec("elapsed_s"))),
        ("cumulative_cost_usd", rec("cumulative_cost_usd").isNotNull() & ~nonneg(rec("cumulative_cost_usd"))),
        ("prompt_sha256", (ev["error_type"] != "api_error") & ~F.coalesce(
            rec("prompt_sha256.system").rlike(HEX64) & rec("prompt_sha256.user").rlike(HEX64), F.lit(False))),
    ]
    return code_array(*rules)


def check_results(log: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per broken rule of each record: code, trial key, ordinal."""
    return log.select(F.explode(result_codes(expected)).alias("code"), F.col("trial.trial_key").alias("key"), "seq")


def not_selected(log: DataFrame, grid: DataFrame) -> DataFrame:
    """Keys of the log that the run's grid does not hold."""
    return log.select(F.col("trial.trial_key").alias("trial_key")).distinct().join(
        grid.select("trial_key"), "trial_key", "left_anti")


def check_resume(old: DataFrame, new: DataFrame, fields: Sequence[str] = RESUME_FIELDS) -> DataFrame:
    """Fields (field, value) of a run config that must not change when it is resumed.

    A run without fingerprint cannot be resumed; a field the old config lacks is not compared.
    """
    fingerprint = old.agg(F.count_if((F.col("field") == "run_fingerprint") & F.col("value").isNotNull()).alias("n")).filter(
        "n = 0").select(F.lit("no_fingerprint").alias("code"), F.lit("run_fingerprint").alias("field"))
    both = old.filter(F.col("value").isNotNull()).select("field", F.col("value").alias("_old")).join(
        new.select("field", F.col("value").alias("_new")), "field", "left")
    watched = F.col("field").isin([*fields, "run_fingerprint", "runtime_protocol"])
    changed = both.filter(watched & ~F.col("_old").eqNullSafe(F.col("_new"))).select(F.lit("changed").alias("code"), "field")
    return fingerprint.unionByName(changed)


def comparability(identity_a: DataFrame, identity_b: DataFrame, prompts_a: DataFrame, prompts_b: DataFrame,
                  treatment_prefix: str = "with_gene") -> DataFrame:
    """All reasons against comparing two runs: identity fields and prompt hashes."""
    fields = diff_run_identity(identity_a, identity_b).select(F.concat(F.lit("identity_"), "code").alias("code"), F.col("field").alias("key"))
    prompts = prompt_parity(prompts_a, prompts_b, treatment_prefix).select(
        "code", F.concat_ws("::", "model", "condition", "task_id").alias("key"))
    return fields.unionByName(prompts)


def merge_evidence(base: DataFrame, supplement: DataFrame, key: str, content: Column) -> DataFrame:
    """Counts of a merge and whether it is free of conflicts."""
    states = merge_state(base, supplement, key, content)
    return states.agg(
        F.coalesce(F.sum("n_base"), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum("n_supplement"), F.lit(0)).alias("supplement_rows"),
        F.count_if(F.col("state") == "new").alias("appended_rows"), F.count_if(F.col("state") == "same").alias("same_rows"),
        F.count_if(F.col("state") == "conflict").alias("conflicts"),
        F.count_if(F.col("state") == "duplicate_base").alias("duplicate_base_keys"),
    ).withColumn("merged_rows", F.col("base_rows") + F.col("appended_rows")).withColumn(
        "clean", (F.col("conflicts") == 0) & (F.col("duplicate_base_keys") == 0))
