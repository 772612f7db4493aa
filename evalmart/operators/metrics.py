"""Metric rows and the report aggregates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.numeric import display_percent, exact_round, ratio, wilson
from evalmart.schemas import CONDITION_ALIASES

# Error types that count as an error rather than a failed attempt.
ERROR_TYPES = ("api_error", "no_code", "no_task_dir", "no_test_script", "missing_gene", "prompt_build_error")


def first_positive(*cols: Column) -> Column:
    """First value that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], F.lit(0)).cast("bigint")


def token_struct(input_: Sequence[Column], output: Sequence[Column], thoughts: Sequence[Column]) -> Column:
    """Token record from the spellings in use, with completion and total."""
    i, o, t = first_positive(*input_), first_positive(*output), first_positive(*thoughts)
    return F.struct(
        i.alias("input"), o.alias("output"), t.alias("thoughts"), (o + t).alias("completion_plus_thoughts"),
        (i + o + t).alias("total"),
    )


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested result records as flat rows; a missing outcome counts as not passed, missing tokens as 0."""
    t = token_struct([F.col("tokens.input")], [F.col("tokens.output")], [F.col("tokens.thoughts")])
    return results.select(
        F.col("trial.trial_key").alias("trial_key"), F.col("trial.model").alias("model"),
        F.col("trial.condition").alias("condition"), F.col("trial.task_id").alias("task_id"),
        F.when(F.coalesce(F.col("eval.passed"), F.lit(False)), 1).otherwise(0).alias("passed"),
        F.col("eval.error_type").alias("error_type"), t.alias("_t"),
        *[F.col(c) for c in ("seq",) if c in results.columns],
    ).select(
        "*", F.col("_t.input").alias("input_tokens"), F.col("_t.output").alias("output_tokens"),
        F.col("_t.thoughts").alias("thoughts_tokens"), F.col("_t.total").alias("total_tokens"),
    ).drop("_t")


def to_metrics(latest: DataFrame, tasks: DataFrame, models: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Flat rows joined to their task and model; rows of unknown identity are left to ``unknown_identity``."""
    return (
        latest.filter(F.col("condition").isin(list(conditions)))
        .join(tasks, "task_id").join(models, "model")
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("thoughts_tokens"))
    )


def unknown_identity(latest: DataFrame, tasks: DataFrame, models: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Rows whose task, model or condition is not known."""
    t = tasks.select("task_id", F.lit(True).alias("_t"))
    m = models.select("model", F.lit(True).alias("_m"))
    code = (
        F.when(F.col("_t").isNull(), "unknown_task").when(F.col("_m").isNull(), "unknown_model")
        .when(~F.col("condition").isin(list(conditions)), "unknown_condition")
    )
    return latest.join(t, "task_id", "left").join(m, "model", "left").select(
        code.alias("code"), F.col("trial_key").alias("key")
    ).filter("code IS NOT NULL")


def add_cost(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Cost in USD to six decimals from prices per million tokens; an unknown model costs 0, thoughts are free.

    ``prices`` (model, input_price, output_price) holds one row per priced model.
    """
    million = F.lit(1_000_000).cast("decimal(10,0)")

    def part(tokens, price):
        return F.coalesce(tokens, F.lit(0)).cast("decimal(15,0)") * F.coalesce(price, F.lit(0)).cast("decimal(9,4)")

    raw = (part(F.col("input_tokens"), F.col("input_price")) + part(F.col("output_tokens"), F.col("output_price")))
    cost = F.round(raw / million, 6).cast("decimal(18,6)")
    return df.join(prices, model, "left").withColumn("cost_usd", cost).drop("input_price", "output_price")


def normalize_condition(name: Column) -> Column:
    """Full condition name from its short spelling; other names stay."""
    aliases = F.create_map(*[F.lit(part) for pair in CONDITION_ALIASES.items() for part in pair])
    return F.coalesce(F.element_at(aliases, name), name)


def classify_status(passed: Column, error_type: Column) -> Column:
    error = F.coalesce(error_type, F.lit(""))
    return (
        F.when(passed, "pass").when(error == "skipped_unrunnable", "skip")
        .when(error.isin(list(ERROR_TYPES)), "error").otherwise("fail")
    )


def _rate_columns() -> list[Column]:
    p, n = F.col("passed"), F.col("n")
    bounds = wilson(p, n)
    return [
        F.round(ratio(p, n), 6).alias("pass_rate"), display_percent(p, n).alias("pass_rate_percent"),
        F.round(bounds["low"], 6).alias("wilson_low"), F.round(bounds["high"], 6).alias("wilson_high"),
    ]


def headline(metrics: DataFrame, subsets: DataFrame, by: Sequence[str] = ("model", "condition"),
             grid: DataFrame | None = None) -> DataFrame:
    """Per subset and group: n, passed, rate with interval, tokens in total, per task and per pass.

    ``subsets`` is long (subset, task_id). With ``grid`` the empty groups are kept.
    """
    keys = ["subset", *by]
    agg = metrics.join(subsets, "task_id").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"), F.sum("total_tokens").alias("total_tokens")
    )
    if grid is not None:
        agg = grid.join(agg, keys, "left").fillna(0, ["n", "passed", "total_tokens"])
    return agg.select(
        *keys, "n", "passed", "total_tokens", *_rate_columns(),
        F.round(ratio(F.col("total_tokens"), F.col("n")), 6).alias("avg_tokens_per_task"),
        F.round(ratio(F.col("total_tokens"), F.nullif(F.col("passed"), F.lit(0))), 6).alias("tokens_per_passed_task"),
    )


def tracks(metrics: DataFrame, subsets: DataFrame) -> DataFrame:
    """Headline counts split by family."""
    return metrics.join(subsets, "task_id").groupBy("subset", "family", "model", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed")
    ).withColumn("pass_rate_percent", display_percent(F.col("passed"), F.col("n")))


def run_summary(latest: DataFrame) -> DataFrame:
    """Means per model and condition, overall and by family, by source and by error type.

    The grouping sets run over rows already summed at the finest grain. Sums are decimals, so the result does
    not depend on the order of addition.
    """
    dims = ["model", "condition", "family", "source", "error_type"]
    exact = "decimal(28,9)"
    finest = latest.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"),
        F.sum(F.coalesce(F.col("pass_rate"), F.lit(0.0)).cast(exact)).alias("rate"),
        F.sum(F.col("agg_score").cast(exact)).alias("score"), F.count("agg_score").alias("n_score"),
    )
    base = [F.col("model"), F.col("condition")]
    sets = [base, [*base, F.col("family")], [*base, F.col("source")], [*base, F.col("error_type")]]
    out = finest.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping("family").alias("_f"), F.grouping("source").alias("_s"), F.grouping("error_type").alias("_e"),
        F.sum("n").alias("n"), F.sum("passed").alias("_p"), F.sum("rate").alias("_r"), F.sum("score").alias("_sc"),
        F.sum("n_score").alias("_ns"),
    )
    level = F.when(F.col("_f") == 0, "family").when(F.col("_s") == 0, "source").when(F.col("_e") == 0, "error_type")
    member = (
        F.when(F.col("_f") == 0, F.col("family")).when(F.col("_s") == 0, F.col("source"))
        .when(F.col("_e") == 0, F.col("error_type"))
    )
    return out.select(
        "model", "condition", F.coalesce(level, F.lit("all")).alias("level"),
        F.coalesce(member, F.lit("all")).alias("member"), "n",
        exact_round(ratio(F.col("_p"), F.col("n")), 4).alias("pass_mean"),
        exact_round(ratio(F.col("_r"), F.col("n")), 4).alias("pass_rate_mean"),
        exact_round(F.coalesce(ratio(F.col("_sc"), F.nullif(F.col("_ns"), F.lit(0))), F.lit(0.0)), 4).alias("score_mean"),
    )


def status_summary(latest: DataFrame) -> DataFrame:
    """Status counts and cost by model and condition, by condition and by family."""
    finest = latest.groupBy("model", "condition", "family", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost")
    )
    m, c, f = F.col("model"), F.col("condition"), F.col("family")
    out = finest.groupingSets([[m, c], [c], [f]], m, c, f).agg(
        F.grouping("model").alias("_m"), F.grouping("condition").alias("_c"),
        *[F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(f"n_{s}")
          for s in ("pass", "fail", "error", "skip")],
        F.sum("cost").alias("cost_usd"),
    )
    level = F.when(F.col("_m") == 0, "model_condition").when(F.col("_c") == 0, "condition").otherwise("family")
    name = F.when(F.col("_m") == 0, F.concat_ws("::", "model", "condition")).when(F.col("_c") == 0, c).otherwise(f)
    return out.select(level.alias("level"), name.alias("bucket"), "n_pass", "n_fail", "n_error", "n_skip", "cost_usd")


def manifest_summary(tasks: DataFrame) -> DataFrame:
    """Task counts in total and by family, execution mode and source; a missing label counts as ``None``."""
    dims = {"family": "by_family", "execution_mode": "by_execution_mode", "source": "by_source"}
    finest = tasks.groupBy(*[F.coalesce(F.col(d).cast("string"), F.lit("None")).alias(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n")
    )
    cols = [F.col(d) for d in dims]
    out = finest.groupingSets([[], *[[c] for c in cols]], *cols).agg(
        *[F.grouping(d).alias(f"_{d}") for d in dims], F.sum("n").alias("n")
    )
    field, member = F.lit("total_tasks"), F.lit("all")
    for d, label in dims.items():
        field = F.when(F.col(f"_{d}") == 0, label).otherwise(field)
        member = F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(member)
    return out.select(field.alias("field"), member.alias("member"), F.coalesce("n", F.lit(0)).alias("n"))


def check_summary(declared: DataFrame, tasks: DataFrame) -> DataFrame:
    """Declared summary rows (field, member, n) that the tasks do not bear out, and the reverse."""
    computed = manifest_summary(tasks).withColumnRenamed("n", "computed")
    both = declared.withColumnRenamed("n", "declared").join(computed, ["field", "member"], "full_outer")
    return both.filter(~F.col("declared").eqNullSafe(F.col("computed")))


def check_grid(metrics: DataFrame, models: DataFrame, conditions: DataFrame, expected: int) -> DataFrame:
    """Model and condition cells whose row count is not the expected one, absent cells included."""
    counts = metrics.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("n"))
    grid = models.select("model").distinct().crossJoin(conditions.select("condition").distinct())
    return grid.join(counts, ["model", "condition"], "left").select(
        "model", "condition", F.coalesce("n", F.lit(0)).alias("n"), F.lit(expected).cast("bigint").alias("expected")
    ).filter("n <> expected")


def registry(logs: DataFrame, run: str = "run_id", key: str = "trial_key") -> DataFrame:
    """Raw, logical and superseded record counts and the byte size of each run's log."""
    per_key = logs.groupBy(run, key).agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
    out = per_key.groupBy(run).agg(
        F.sum("_n").alias("raw_records"), F.count(F.lit(1)).alias("logical_records"), F.sum("_b").alias("bytes")
    )
    return out.withColumn("superseded_records", F.col("raw_records") - F.col("logical_records"))


def exploration_metrics(calls: DataFrame) -> DataFrame:
    """API calls, tokens and averages by family and in total (api calls only)."""
    per_family = calls.groupBy("family", "task_id").agg(
        F.sum("api_call").alias("calls"), F.sum(F.col("api_call") * F.col("total_tokens")).alias("tokens")
    ).groupBy("family").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("calls").alias("calls"), F.sum("tokens").alias("total_tokens")
    )
    out = per_family.rollup("family").agg(
        F.grouping("family").alias("_g"), F.sum("tasks").alias("tasks"), F.sum("calls").alias("calls"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    return out.select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("family")).alias("family"), "tasks", "calls", "total_tokens",
        F.round(ratio(F.col("total_tokens"), F.nullif(F.col("calls"), F.lit(0))), 6).alias("avg_tokens_per_call"),
        F.round(ratio(F.col("total_tokens"), F.col("tasks")), 6).alias("avg_tokens_per_task"),
    )


def success_rounds(calls: DataFrame) -> DataFrame:
    """Tasks by the round in which they ended."""
    last = calls.groupBy("task_id").agg(F.max("rollout").alias("success_round"))
    return last.groupBy("success_round").agg(F.count(F.lit(1)).alias("tasks"))


def trace_stats(traces: DataFrame, max_rollouts: int) -> DataFrame:
    """Solved traces within ``max_rollouts``: rollouts up to the solving one, their calls and tokens.

    ``traces`` holds one row per rollout with its trace's ``n_iters`` and ``solved``. Seed rollouts cost nothing.
    """
    kept = traces.filter(
        F.col("solved") & (F.col("n_iters") > 0) & (F.col("n_iters") <= max_rollouts)
    ).filter(F.col("rollout") <= F.col("n_iters"))
    return kept.groupBy("task_id", "n_iters").agg(
        F.count(F.lit(1)).alias("rollouts"), F.sum("api_call").alias("api_calls"),
        F.sum(1 - F.col("api_call")).alias("seed_rollouts"),
        F.sum(F.col("api_call") * F.col("total_tokens")).alias("total_tokens"),
    )


def token_efficiency(runs: DataFrame) -> DataFrame:
    """Calls, passes and tokens per mode, with tokens per task and per pass."""
    return runs.groupBy("mode").agg(
        F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("tasks"), F.sum("passed").alias("passed"),
        F.sum("total_tokens").alias("total_tokens"),
    ).select(
        "*", display_percent(F.col("passed"), F.col("tasks")).alias("pass_rate_percent"),
        F.round(ratio(F.col("total_tokens"), F.col("tasks")), 6).alias("avg_tokens_per_task"),
        F.round(ratio(F.col("total_tokens"), F.nullif(F.col("passed"), F.lit(0))), 6).alias("tokens_per_passed_task"),
    )


def token_efficiency_by_track(pairs: DataFrame) -> DataFrame:
    """Exploration against reuse by family and in total; averages of the total come from its sums.

    ``pairs``: family, explore_tasks, explore_calls, explore_tokens, reuse_tasks, reuse_passed, reuse_tokens.
    """
    names = [c for c in pairs.columns if c != "family"]
    sums = pairs.groupBy("family").agg(*[F.sum(c).alias(c) for c in names])
    out = sums.rollup("family").agg(F.grouping("family").alias("_g"), *[F.sum(c).alias(c) for c in names])
    explore = ratio(F.col("explore_tokens"), F.nullif(F.col("explore_tasks"), F.lit(0)))
    reuse = ratio(F.col("reuse_tokens"), F.nullif(F.col("reuse_tasks"), F.lit(0)))
    return out.select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("family")).alias("family"), *names,
        F.round(explore, 6).alias("explore_avg"), F.round(reuse, 6).alias("reuse_avg"),
        F.round(100 * (F.try_divide(reuse, explore) - 1), 6).alias("avg_change_percent"),
    )


def compare_conditions(shared: DataFrame, conditions: Sequence[str], base: str) -> DataFrame:
    """Pass percent per condition and its difference to the base, by family and in total within a model.

    ``shared`` has one row per model and task with a 0/1 column per condition.
    """
    cols = [F.sum(c).alias(c) for c in conditions]
    per_family = shared.groupBy("model", "family").agg(F.count(F.lit(1)).alias("n"), *cols)
    m, f = F.col("model"), F.col("family")
    out = per_family.groupingSets([[m], [m, f]], m, f).agg(
        F.grouping("family").alias("_g"), F.sum("n").alias("n"), *cols
    )
    pct = {c: 100 * ratio(F.col(c), F.col("n")) for c in conditions}
    return out.select(
        "model", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("family")).alias("family"), "n",
        *[F.round(pct[c], 6).alias(f"pct_{c}") for c in conditions],
        *[F.round(pct[c] - pct[base], 6).alias(f"delta_{c}") for c in conditions if c != base],
    )


def churn(shared: DataFrame, base: str, other: str) -> DataFrame:
    """Tasks that flipped between two conditions, per model."""
    gain = (F.col(base) == 0) & (F.col(other) == 1)
    loss = (F.col(base) == 1) & (F.col(other) == 0)
    return shared.groupBy("model").agg(
        F.count_if(gain).alias("fail_to_pass"), F.count_if(loss).alias("pass_to_fail")
    ).withColumn("net", F.col("fail_to_pass") - F.col("pass_to_fail"))
