"""Pass rates, comparisons, tokens and costs over the trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmart import adapters as A
from evalmart.catalog import query
from evalmart.functions import numeric as N
from evalmart.operators import latest as L, metrics as M, paired as P, selection as SL, subsets as S


def latest(spark, d, *columns):
    return L.latest_by_key(A.trials(spark, d), columns=columns or None)


OUTCOME = ("model", "condition", "task_id", "family", "passed")
TOKENS = ("input_tokens", "output_tokens", "thoughts_tokens")


def metric_rows(spark, d):
    return latest(spark, d, *OUTCOME, *TOKENS).withColumn(
        "total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("thoughts_tokens"))


def task_dim(spark, d):
    return A.trials(spark, d).select("task_id", "family").distinct()


def producer(spark, d, condition):
    """A producer's source per task: evolved once a trial with its asset passed."""
    own = A.trials(spark, d).groupBy("task_id").agg(
        F.max(F.when(F.col("condition") == condition, F.col("passed"))).alias("p"))
    source = F.when(F.col("p") == 1, "evolved").when(F.col("p") == 0, "reference_distilled").otherwise("skill_distilled")
    return own.select("task_id", source.alias("generation_source"))


def subsets(spark, d):
    return S.build_subsets(
        task_dim(spark, d), producer(spark, d, "with_asset_a"), producer(spark, d, "with_asset_b"))


def prices(spark):
    return spark.createDataFrame([("m0", 5.0, 25.0), ("m1", 3.0, 15.0)], "model string, input_price double, output_price double")


SUBSETS_SQL = """
prod AS (SELECT task_id, max(CASE WHEN condition='with_asset_a' THEN passed END) AS a,
           max(CASE WHEN condition='with_asset_b' THEN passed END) AS b FROM trials GROUP BY task_id),
subsets AS (SELECT 'full' AS subset, task_id FROM prod UNION ALL SELECT 'evolved', task_id FROM prod WHERE a = 1
  UNION ALL SELECT 'distilled', task_id FROM prod WHERE a = 0 OR a IS NULL
  UNION ALL SELECT 'common', task_id FROM prod WHERE a = 1 AND b = 1)"""
METRICS_SQL = """
metrics AS (SELECT *, input_tokens + output_tokens + thoughts_tokens AS total_tokens FROM latest)"""
Z2 = "3.8414588206941236"
RATE_SQL = f"""round(passed / n, 6) AS pass_rate, format('{{:.1f}}', CAST(format('{{:.4f}}', passed / n) AS DOUBLE) * 100) AS pass_rate_percent,
  round(100 * ((passed/n + {Z2}/(2*n)) / (1 + {Z2}/n) - 1.959963984540054 * sqrt((passed/n)*(1-passed/n)/n + {Z2}/(4*n*n)) / (1 + {Z2}/n)), 6) AS wilson_low,
  round(100 * ((passed/n + {Z2}/(2*n)) / (1 + {Z2}/n) + 1.959963984540054 * sqrt((passed/n)*(1-passed/n)/n + {Z2}/(4*n*n)) / (1 + {Z2}/n)), 6) AS wilson_high"""


@query("wn1_latest", "trials latest",
       "SELECT trial_key, seq, model, condition, task_id, family, error_type, passed, input_tokens, output_tokens, thoughts_tokens FROM latest")
def wn1_latest(spark, d):
    return latest(spark, d).drop("ts")


@query("se1_subsets", "trials", f", {SUBSETS_SQL} SELECT subset, task_id FROM subsets")
def se1_subsets(spark, d):
    return subsets(spark, d)


@query("se2_subset_contract", "trials", f""", {SUBSETS_SQL},
pt AS (SELECT task_id, max(CASE WHEN subset='full' THEN 1 ELSE 0 END) AS w,
  count(*) FILTER (subset IN ('evolved','common')) AS n_parts FROM subsets WHERE subset IN ('full','evolved','common') GROUP BY task_id)
SELECT CASE WHEN w = 0 THEN 'outside_whole' WHEN n_parts = 0 THEN 'uncovered' ELSE 'overlap' END AS code, task_id AS key, n_parts
FROM pt WHERE w = 0 OR n_parts <> 1""")
def se2_subset_contract(spark, d):
    return S.check_subsets(subsets(spark, d), "full", ["evolved", "common"])


@query("prj7_membership", "trials latest", f""", {SUBSETS_SQL},
mem AS (SELECT task_id, coalesce(max(CASE WHEN subset='evolved' THEN subset END), max(CASE WHEN subset='distilled' THEN subset END)) AS subset,
  string_agg(subset, ';' ORDER BY CASE subset WHEN 'full' THEN 1 WHEN 'evolved' THEN 2 WHEN 'distilled' THEN 3 ELSE 4 END) AS subset_memberships
  FROM subsets GROUP BY task_id)
SELECT trial_key, latest.task_id, subset, subset_memberships FROM latest JOIN mem ON latest.task_id = mem.task_id""")
def prj7_membership(spark, d):
    return S.add_membership(latest(spark, d, "task_id"), subsets(spark, d))


@query("ag1_headline", "trials latest", f""", {SUBSETS_SQL}, {METRICS_SQL},
g AS (SELECT subset, model, condition, count(*) AS n, sum(passed) AS passed, sum(total_tokens) AS total_tokens
  FROM metrics JOIN subsets USING (task_id) GROUP BY ALL)
SELECT subset, model, condition, n, passed, total_tokens, {RATE_SQL},
  round(total_tokens / n, 6) AS avg_tokens_per_task, round(total_tokens / nullif(passed, 0), 6) AS tokens_per_passed_task FROM g""")
def ag1_headline(spark, d):
    return M.headline(metric_rows(spark, d), subsets(spark, d))


@query("ag2_tracks", "trials latest", f""", {SUBSETS_SQL}, {METRICS_SQL},
g AS (SELECT subset, family, model, condition, count(*) AS n, sum(passed) AS passed FROM metrics JOIN subsets USING (task_id) GROUP BY ALL)
SELECT *, format('{{:.1f}}', CAST(format('{{:.4f}}', passed / n) AS DOUBLE) * 100) AS pass_rate_percent FROM g""")
def ag2_tracks(spark, d):
    return M.tracks(metric_rows(spark, d), subsets(spark, d))


def summary_rows(spark, d):
    return latest(spark, d, "seq", "error_type", *OUTCOME, *TOKENS).select(
        "model", "condition", "family", F.concat(F.lit("s"), (F.col("seq") % 5).cast("string")).alias("source"),
        "error_type", "passed", (F.col("output_tokens") / 100).alias("pass_rate"),
        F.when(F.col("error_type") != "api_error", F.col("input_tokens") / 1000).alias("agg_score"))


@query("ag3_run_summary", "trials latest", """,
r AS (SELECT model, condition, family, concat('s', CAST(seq % 5 AS VARCHAR)) AS source, error_type, passed,
  CAST(output_tokens / 100 AS DECIMAL(28,9)) AS rate,
  CASE WHEN error_type <> 'api_error' THEN CAST(input_tokens / 1000 AS DECIMAL(28,9)) END AS score FROM latest),
g AS (SELECT model, condition, family, source, error_type, grouping(family) AS gf, grouping(source) AS gs, grouping(error_type) AS ge,
  count(*) AS n, sum(passed) AS p, sum(rate) AS r, sum(score) AS sc, count(score) AS ns FROM r
  GROUP BY GROUPING SETS ((model, condition), (model, condition, family), (model, condition, source), (model, condition, error_type)))
SELECT model, condition, CASE WHEN gf = 0 THEN 'family' WHEN gs = 0 THEN 'source' WHEN ge = 0 THEN 'error_type' ELSE 'all' END AS level,
  CASE WHEN gf = 0 THEN family WHEN gs = 0 THEN source WHEN ge = 0 THEN error_type ELSE 'all' END AS member, n,
  CAST(format('{:.4f}', CAST(p AS DOUBLE) / n) AS DOUBLE) AS pass_mean, CAST(format('{:.4f}', CAST(r AS DOUBLE) / n) AS DOUBLE) AS pass_rate_mean,
  CAST(format('{:.4f}', coalesce(CAST(sc AS DOUBLE) / nullif(ns, 0), 0.0)) AS DOUBLE) AS score_mean FROM g""")
def ag3_run_summary(spark, d):
    return M.run_summary(summary_rows(spark, d))


COST_SQL = """
priced AS (SELECT l.*, coalesce(CAST(round(input_tokens * coalesce(pi, 0) / 1000000 + output_tokens * coalesce(po, 0) / 1000000, 6) AS DECIMAL(18,6)), 0) AS cost_usd
  FROM {src} l LEFT JOIN (VALUES ('m0', CAST(5.0 AS DECIMAL(9,4)), CAST(25.0 AS DECIMAL(9,4))), ('m1', 3.0, 15.0)) p(model, pi, po) ON l.model = p.model)"""


@query("prj3_cost", "trials", f", {COST_SQL.format(src='trials')} SELECT seq, model, CAST(cost_usd AS DOUBLE) AS cost_usd FROM priced")
def prj3_cost(spark, d):
    return M.add_cost(A.trials(spark, d), prices(spark)).select(
        "seq", "model", F.col("cost_usd").cast("double").alias("cost_usd"))


@query("prj8_status", "trials latest", """
SELECT trial_key, CASE WHEN passed = 1 THEN 'pass' WHEN error_type = 'api_error' THEN 'error' ELSE 'fail' END AS status FROM latest""")
def prj8_status(spark, d):
    return latest(spark, d, "passed", "error_type").select(
        "trial_key", M.classify_status(F.col("passed") == 1, F.col("error_type")).alias("status"))


@query("ag4_status_summary", "trials latest", f""", {COST_SQL.format(src='latest')},
r AS (SELECT *, CASE WHEN passed = 1 THEN 'pass' WHEN error_type = 'api_error' THEN 'error' ELSE 'fail' END AS status FROM priced),
g AS (SELECT model, condition, family, grouping(model) AS gm, grouping(condition) AS gc,
  count(*) FILTER (status='pass') AS n_pass, count(*) FILTER (status='fail') AS n_fail, count(*) FILTER (status='error') AS n_error,
  count(*) FILTER (status='skip') AS n_skip, sum(cost_usd) AS cost_usd
  FROM r GROUP BY GROUPING SETS ((model, condition), (condition), (family)))
SELECT CASE WHEN gm = 0 THEN 'model_condition' WHEN gc = 0 THEN 'condition' ELSE 'family' END AS level,
  CASE WHEN gm = 0 THEN concat_ws('::', model, condition) WHEN gc = 0 THEN condition ELSE family END AS bucket,
  n_pass, n_fail, n_error, n_skip, CAST(cost_usd AS DOUBLE) AS cost_usd FROM g""")
def ag4_status_summary(spark, d):
    rows = M.add_cost(latest(spark, d, "error_type", *OUTCOME, *TOKENS), prices(spark)).withColumn(
        "status", M.classify_status(F.col("passed") == 1, F.col("error_type")))
    return M.status_summary(rows).withColumn("cost_usd", F.col("cost_usd").cast("double"))


MANIFEST_SQL = """
ms AS (SELECT family, execution_mode, source, grouping(family) AS gf, grouping(execution_mode) AS gm, grouping(source) AS gs, count(*) AS n
  FROM {src} GROUP BY GROUPING SETS ((), (family), (execution_mode), (source))),
computed AS (SELECT CASE WHEN gf = 0 THEN 'by_family' WHEN gm = 0 THEN 'by_execution_mode' WHEN gs = 0 THEN 'by_source' ELSE 'total_tasks' END AS field,
  CASE WHEN gf = 0 THEN family WHEN gm = 0 THEN execution_mode WHEN gs = 0 THEN source ELSE 'all' END AS member, n FROM ms)"""


@query("ag5_manifest_summary", "tasks", f", {MANIFEST_SQL.format(src='tasks')} SELECT field, member, n FROM computed")
def ag5_manifest_summary(spark, d):
    return M.manifest_summary(A.tasks(spark, d))


@query("ag6_summary_diff", "tasks", f""", {MANIFEST_SQL.format(src='tasks')},
declared AS (SELECT field, member, n AS declared FROM (SELECT CASE WHEN gf = 0 THEN 'by_family' WHEN gm = 0 THEN 'by_execution_mode' WHEN gs = 0 THEN 'by_source' ELSE 'total_tasks' END AS field,
  CASE WHEN gf = 0 THEN family WHEN gm = 0 THEN execution_mode WHEN gs = 0 THEN source ELSE 'all' END AS member, n FROM (
  SELECT family, execution_mode, source, grouping(family) AS gf, grouping(execution_mode) AS gm, grouping(source) AS gs, count(*) AS n
  FROM tasks WHERE quality IS NULL OR quality = 1 GROUP BY GROUPING SETS ((), (family), (execution_mode), (source)))))
SELECT coalesce(c.field, d.field) AS field, coalesce(c.member, d.member) AS member, declared, n AS computed
FROM computed c FULL JOIN declared d ON c.field = d.field AND c.member = d.member WHERE declared IS DISTINCT FROM n""")
def ag6_summary_diff(spark, d):
    tasks = A.tasks(spark, d)
    declared = M.manifest_summary(tasks.filter("quality IS NULL OR quality = 1"))
    return M.check_summary(declared, tasks)


@query("ag7_grid", "trials latest", """,
t AS (SELECT count(DISTINCT task_id) AS expected FROM trials),
g AS (SELECT m.model, c.condition FROM (SELECT DISTINCT model FROM trials) m CROSS JOIN (SELECT DISTINCT condition FROM trials) c)
SELECT g.model, g.condition, count(l.trial_key) AS n, any_value(expected) AS expected
FROM g CROSS JOIN t LEFT JOIN latest l ON l.model = g.model AND l.condition = g.condition GROUP BY ALL HAVING count(l.trial_key) <> any_value(expected)""")
def ag7_grid(spark, d):
    log = A.trials(spark, d)
    counts = M.check_grid(latest(spark, d, *OUTCOME), log, log, -1).drop("expected")
    expected = log.agg(F.count_distinct("task_id").alias("expected"))
    return counts.crossJoin(F.broadcast(expected)).filter("n <> expected")  # one row


@query("ag8_registry", "trials", """
SELECT concat('run', CAST(seq % 4 AS VARCHAR)) AS run_id, count(*) AS raw_records, count(DISTINCT trial_key) AS logical_records,
  sum(length(trial_key)) AS bytes, count(*) - count(DISTINCT trial_key) AS superseded_records FROM trials GROUP BY 1""")
def ag8_registry(spark, d):
    logs = A.trials(spark, d).select(
        F.concat(F.lit("run"), (F.col("seq") % 4).cast("string")).alias("run_id"), "trial_key",
        F.length("trial_key").cast("bigint").alias("bytes"))
    return M.registry(logs)


@query("ag9_exploration", "rollouts", """,
c AS (SELECT concat('f', CAST(CAST(substr(task_id, 2) AS BIGINT) % 4 AS VARCHAR)) AS family, * FROM rollouts),
g AS (SELECT family, count(DISTINCT task_id) AS tasks, sum(api_call) AS calls, sum(api_call * total_tokens) AS total_tokens FROM c GROUP BY ROLLUP(family))
SELECT coalesce(family, 'all') AS family, tasks, calls, total_tokens, round(total_tokens / nullif(calls, 0), 6) AS avg_tokens_per_call,
  round(total_tokens / tasks, 6) AS avg_tokens_per_task FROM g""")
def ag9_exploration(spark, d):
    number = F.substring("task_id", 2, 20).cast("bigint")
    return M.exploration_metrics(A.rollouts(spark, d).withColumn(
        "family", F.concat(F.lit("f"), (number % 4).cast("string"))))


@query("ag9_success_rounds", "rollouts", """
SELECT r AS success_round, count(*) AS tasks FROM (SELECT task_id, max(rollout) AS r FROM rollouts GROUP BY 1) GROUP BY 1""")
def ag9_success_rounds(spark, d):
    return M.success_rounds(A.rollouts(spark, d))


TRACE_SQL = """
tr AS (SELECT *, max(rollout) OVER (PARTITION BY task_id) AS n_iters,
  max(CASE WHEN api_call = 1 THEN rollout END) OVER (PARTITION BY task_id) AS last_api FROM rollouts),
ts AS (SELECT task_id, n_iters, count(*) AS rollouts, sum(api_call) AS api_calls, sum(1 - api_call) AS seed_rollouts,
  sum(api_call * total_tokens) AS total_tokens FROM tr WHERE last_api = n_iters AND n_iters <= 6 GROUP BY ALL)"""


def traces(spark, d):
    """A trace counts as solved when its last turn is a model call."""
    r = A.rollouts(spark, d)
    ends = r.groupBy("task_id").agg(
        F.max("rollout").alias("n_iters"), F.max(F.when(F.col("api_call") == 1, F.col("rollout"))).alias("_a"))
    ends = ends.select("task_id", "n_iters", F.coalesce(F.col("_a") == F.col("n_iters"), F.lit(False)).alias("solved"))
    return r.join(ends, "task_id")


@query("ag10_trace_stats", "rollouts", f", {TRACE_SQL} SELECT * FROM ts")
def ag10_trace_stats(spark, d):
    return M.trace_stats(traces(spark, d), 6)


@query("ag11_token_efficiency", "trials latest rollouts", f""", {METRICS_SQL},
runs AS (SELECT 'exploration' AS mode, task_id, sum(api_call) AS calls, 1 AS passed, sum(api_call * total_tokens) AS total_tokens FROM rollouts GROUP BY task_id
  UNION ALL SELECT condition, trial_key, 1, passed, total_tokens FROM metrics)
SELECT mode, sum(calls) AS calls, count(*) AS tasks, sum(passed) AS passed, sum(total_tokens) AS total_tokens,
  format('{{:.1f}}', CAST(format('{{:.4f}}', sum(passed) / count(*)) AS DOUBLE) * 100) AS pass_rate_percent, round(sum(total_tokens) / count(*), 6) AS avg_tokens_per_task,
  round(sum(total_tokens) / nullif(sum(passed), 0), 6) AS tokens_per_passed_task FROM runs GROUP BY mode""")
def ag11_token_efficiency(spark, d):
    explored = A.rollouts(spark, d).groupBy("task_id").agg(
        F.sum("api_call").alias("calls"), F.sum(F.col("api_call") * F.col("total_tokens")).alias("total_tokens")
    ).select(F.lit("exploration").alias("mode"), "calls", F.lit(1).alias("passed"), "total_tokens")
    single = metric_rows(spark, d).select(F.col("condition").alias("mode"), F.lit(1).alias("calls"), "passed", "total_tokens")
    return M.token_efficiency(explored.unionByName(single))


@query("ag11_by_track", "trials latest", f""", {METRICS_SQL},
g AS (SELECT family, count(*) FILTER (condition='no_context') AS explore_tasks, count(*) FILTER (condition='no_context') AS explore_calls,
  coalesce(sum(total_tokens) FILTER (condition='no_context'), 0) AS explore_tokens, count(*) FILTER (condition='with_asset_a') AS reuse_tasks,
  coalesce(sum(passed) FILTER (condition='with_asset_a'), 0) AS reuse_passed, coalesce(sum(total_tokens) FILTER (condition='with_asset_a'), 0) AS reuse_tokens
  FROM metrics GROUP BY ROLLUP(family))
SELECT coalesce(family, 'all') AS family, explore_tasks, explore_calls, explore_tokens, reuse_tasks, reuse_passed, reuse_tokens,
  round(explore_tokens / nullif(explore_tasks, 0), 6) AS explore_avg, round(reuse_tokens / nullif(reuse_tasks, 0), 6) AS reuse_avg,
  round(100 * ((reuse_tokens / nullif(reuse_tasks, 0)) / nullif(explore_tokens / nullif(explore_tasks, 0), 0) - 1), 6) AS avg_change_percent FROM g""")
def ag11_by_track(spark, d):
    a, b = F.col("condition") == "no_context", F.col("condition") == "with_asset_a"
    one = lambda c: F.when(c, 1).otherwise(0)
    return M.token_efficiency_by_track(metric_rows(spark, d).select(
        "family", one(a).alias("explore_tasks"), one(a).alias("explore_calls"),
        F.when(a, F.col("total_tokens")).otherwise(0).alias("explore_tokens"), one(b).alias("reuse_tasks"),
        F.when(b, F.col("passed")).otherwise(0).alias("reuse_passed"),
        F.when(b, F.col("total_tokens")).otherwise(0).alias("reuse_tokens")))


CONDITIONS = list(A.CONDITION_NAMES)
SHARED_SQL = """
shared AS (SELECT model, family, task_id, """ + ", ".join(
    f"max(CASE WHEN condition='{c}' THEN passed END) AS {c}" for c in CONDITIONS
) + " FROM latest GROUP BY ALL HAVING " + " AND ".join(
    f"max(CASE WHEN condition='{c}' THEN passed END) IS NOT NULL" for c in CONDITIONS) + ")"


@query("jn5_common_tasks", "trials latest", f", {SHARED_SQL} SELECT * FROM shared")
def jn5_common_tasks(spark, d):
    return P.common_tasks(latest(spark, d, *OUTCOME), CONDITIONS)


@query("ag12_compare", "trials latest", f""", {SHARED_SQL},
g AS (SELECT model, family, count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in CONDITIONS)} FROM shared GROUP BY GROUPING SETS ((model), (model, family)))
SELECT model, coalesce(family, 'ALL') AS family, n, {', '.join(f'round(100 * ({c} / n), 6) AS pct_{c}' for c in CONDITIONS)},
  {', '.join(f'round(100 * ({c} / n) - 100 * (no_context / n), 6) AS delta_{c}' for c in CONDITIONS[1:])} FROM g""")
def ag12_compare(spark, d):
    return M.compare_conditions(P.common_tasks(latest(spark, d, *OUTCOME), CONDITIONS), CONDITIONS, "no_context")


@query("ag13_churn", "trials latest", f""", {SHARED_SQL}
SELECT model, count(*) FILTER (no_context = 0 AND with_asset_a = 1) AS fail_to_pass, count(*) FILTER (no_context = 1 AND with_asset_a = 0) AS pass_to_fail,
  count(*) FILTER (no_context = 0 AND with_asset_a = 1) - count(*) FILTER (no_context = 1 AND with_asset_a = 0) AS net FROM shared GROUP BY model""")
def ag13_churn(spark, d):
    return M.churn(P.common_tasks(latest(spark, d, *OUTCOME), CONDITIONS), "no_context", "with_asset_a")


COMPARISONS = [("full", "with_asset_a", "with_skill"), ("evolved", "with_asset_a", "with_skill"),
               ("distilled", "with_asset_a", "with_skill"), ("common", "with_asset_a", "with_asset_b")]
PAIRS_SQL = SUBSETS_SQL + """,
comparisons AS (SELECT * FROM (VALUES """ + ", ".join(str(c) for c in COMPARISONS) + """) v(subset, treatment, comparator)),
pairs AS (SELECT s.subset, c.treatment, c.comparator, l.model, l.task_id, max(CASE WHEN l.condition = c.treatment THEN passed END) AS t,
  max(CASE WHEN l.condition = c.comparator THEN passed END) AS c
  FROM latest l JOIN subsets s ON l.task_id = s.task_id JOIN comparisons c ON c.subset = s.subset
  WHERE l.condition IN (c.treatment, c.comparator) GROUP BY ALL),
counts AS (SELECT subset, treatment, comparator, model, count(*) AS n, sum(t) AS treatment_passed, sum(c) AS comparator_passed,
  count(*) FILTER (t > c) AS treatment_only, count(*) FILTER (t < c) AS comparator_only,
  20260718 + CAST('0x' || substr(sha256(concat_ws('|', subset, model, treatment, comparator)), 1, 8) AS BIGINT) AS seed
  FROM pairs WHERE t IS NOT NULL AND c IS NOT NULL GROUP BY subset, treatment, comparator, model)"""
MCNEMAR_SQL = """CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1),
  lambda k: exp(lgamma({b} + {c} + 1) - lgamma(k + 1) - lgamma({b} + {c} - k + 1) - ({b} + {c}) * ln(2.0))))) END"""
BOOT_SQL = """
reps AS (SELECT {keys}, it, 100 * sum(CASE WHEN idx < treatment_only THEN 1 WHEN idx < treatment_only + comparator_only THEN -1 ELSE 0 END) / n AS mean
  FROM (SELECT {keys}, n, treatment_only, comparator_only, it,
    CAST('0x' || substr(md5(concat_ws('|', CAST(seed AS VARCHAR), CAST(it AS VARCHAR), CAST(draw AS VARCHAR))), 1, 8) AS BIGINT) % n AS idx
    FROM (SELECT *, unnest(range(1, n + 1)) AS draw FROM (SELECT *, unnest(range(1, 5001)) AS it FROM counts))) GROUP BY {keys}, it, n),
ci AS (SELECT {keys}, round(quantile_cont(mean, 0.025), 6) AS low_pp, round(quantile_cont(mean, 0.975), 6) AS high_pp FROM reps GROUP BY {keys})"""


@query("jn4_pairs", "trials latest", f", {PAIRS_SQL} SELECT * FROM pairs")
def jn4_pairs(spark, d):
    return P.pair_outcomes(latest(spark, d, *OUTCOME), subsets(spark, d), COMPARISONS)


@query("jn4_incomplete", "trials latest", f""", {PAIRS_SQL},
sz AS (SELECT subset, count(DISTINCT task_id) AS expected FROM subsets GROUP BY 1)
SELECT subset, treatment, comparator, model, complete, expected FROM (SELECT subset, treatment, comparator, model,
  count(*) FILTER (t IS NOT NULL AND c IS NOT NULL) AS complete FROM pairs GROUP BY ALL) JOIN sz USING (subset) WHERE complete <> expected""")
def jn4_incomplete(spark, d):
    s = subsets(spark, d)
    return P.incomplete_pairs(P.pair_outcomes(latest(spark, d, *OUTCOME), s, COMPARISONS), s)


@query("st6_paired_tests", "trials latest", f""", {PAIRS_SQL}, {BOOT_SQL.format(keys='subset, treatment, comparator, model')}
SELECT subset, treatment, comparator, model, n, treatment_passed, comparator_passed,
  format('{{:.1f}}', CAST(format('{{:.4f}}', treatment_passed / n) AS DOUBLE) * 100) AS treatment_percent, format('{{:.1f}}', CAST(format('{{:.4f}}', comparator_passed / n) AS DOUBLE) * 100) AS comparator_percent,
  round(100 * ((treatment_passed - comparator_passed) / n), 6) AS delta_pp, low_pp, high_pp, treatment_only, comparator_only,
  round({MCNEMAR_SQL.format(b='treatment_only', c='comparator_only')}, 8) AS mcnemar_p, seed
FROM counts JOIN ci USING (subset, treatment, comparator, model)""")
def st6_paired_tests(spark, d):
    return P.paired_tests(latest(spark, d, *OUTCOME), subsets(spark, d), COMPARISONS, exact_draws=True)


@query("st6_paired_tests_scale")
def st6_paired_tests_scale(spark, d):
    return P.paired_tests(latest(spark, d, *OUTCOME), subsets(spark, d), COMPARISONS)


def label_counts(spark, d):
    pairs = A.paired_labels(spark, d).select(F.col("treatment").alias("t"), F.col("comparator").alias("c"))
    return P.pair_counts(pairs, []).withColumn("seed", F.lit(N.SEED_BASE).cast("bigint"))


LABEL_COUNTS_SQL = """
counts AS (SELECT count(*) AS n, sum(treatment) AS treatment_passed, sum(comparator) AS comparator_passed,
  count(*) FILTER (treatment > comparator) AS treatment_only, count(*) FILTER (treatment < comparator) AS comparator_only,
  20260718 AS seed FROM paired_labels)"""


@query("st2_mcnemar", "paired_labels", f""", {LABEL_COUNTS_SQL}
SELECT n, treatment_only, comparator_only, round({MCNEMAR_SQL.format(b='treatment_only', c='comparator_only')}, 8) AS p_value FROM counts""")
def st2_mcnemar(spark, d):
    return label_counts(spark, d).select(
        "n", "treatment_only", "comparator_only",
        F.round(N.mcnemar_exact(F.col("treatment_only"), F.col("comparator_only")), 8).alias("p_value"))


@query("st3_bootstrap", "paired_labels", f""", {LABEL_COUNTS_SQL}, {BOOT_SQL.format(keys='seed')} SELECT seed, low_pp, high_pp FROM ci""")
def st3_bootstrap(spark, d):
    return P.bootstrap_by_draws(label_counts(spark, d), ["seed"], F.col("seed"))


@query("st3_bootstrap_scale")
def st3_bootstrap_scale(spark, d):
    return P.bootstrap_by_counts(label_counts(spark, d), ["seed"], F.col("seed"))


@query("st4_percentile", "trials latest", """
SELECT model, round(quantile_cont(input_tokens, 0.025), 6) AS p025, round(quantile_cont(input_tokens, 0.5), 6) AS p50,
  round(quantile_cont(input_tokens, 0.975), 6) AS p975 FROM trials GROUP BY model""")
def st4_percentile(spark, d):
    found = SL.exact_percentiles(A.trials(spark, d), ["model"], "input_tokens", {"p025": 0.025, "p50": 0.5, "p975": 0.975})
    return found.select("model", *[F.round(c, 6).alias(c) for c in ("p025", "p50", "p975")])


@query("st4_percentile_decimal", sql="""
SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag""")
def st4_percentile_decimal(spark, d):
    found = SL.exact_percentiles(A.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p90": 0.9})
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p10", "p90")])


@query("st5_seed", "trials", """
SELECT DISTINCT model, condition, 20260718 + CAST('0x' || substr(sha256(concat_ws('|', model, condition)), 1, 8) AS BIGINT) AS seed FROM trials""")
def st5_seed(spark, d):
    return A.trials(spark, d).select("model", "condition").distinct().withColumn(
        "seed", N.stable_seed(F.col("model"), F.col("condition")))


@query("st1_wilson", "trials latest", f""",
g AS (SELECT family, count(*) AS n, sum(passed) AS passed FROM latest GROUP BY family) SELECT family, n, passed, {RATE_SQL} FROM g""")
def st1_wilson(spark, d):
    g = latest(spark, d, *OUTCOME).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"))
    return g.select("family", "n", "passed", *M._rate_columns())


@query("st8_success_rate", "rollouts", """
SELECT task_id, max(rollout) AS n_iters, CAST(format('{:.4f}', CAST(1 AS DOUBLE) / max(rollout)) AS DOUBLE) AS success_rate FROM rollouts GROUP BY task_id""")
def st8_success_rate(spark, d):
    return A.rollouts(spark, d).groupBy("task_id").agg(F.max("rollout").alias("n_iters")).withColumn(
        "success_rate", N.success_rate(F.col("n_iters")))


@query("prj2_tokens", "trials", """
SELECT seq, input_tokens AS input, output_tokens AS output, thoughts_tokens AS thoughts, output_tokens + thoughts_tokens AS completion_plus_thoughts,
  input_tokens + output_tokens + thoughts_tokens AS total FROM trials""")
def prj2_tokens(spark, d):
    # Two spellings: the longer name is present on even ordinals only.
    even = F.col("seq") % 2 == 0
    both = lambda c: [F.when(even, F.col(c)), F.when(~even, F.col(c))]
    t = M.token_struct(both("input_tokens"), both("output_tokens"), both("thoughts_tokens"))
    return A.trials(spark, d).select("seq", t.alias("t")).select("seq", "t.*")


@query("jn3_metrics", "trials latest", f""", {METRICS_SQL},
td AS (SELECT DISTINCT task_id AS tid, family FROM trials)
SELECT trial_key, m.task_id, td.family, concat('model ', model) AS model_name, condition, passed, total_tokens
FROM metrics m JOIN td ON td.tid = m.task_id WHERE condition IN ('no_context','with_skill','with_asset_a')""")
def jn3_metrics(spark, d):
    models = A.trials(spark, d).select("model").distinct().withColumn("model_name", F.concat(F.lit("model "), "model"))
    rows = M.to_metrics(latest(spark, d).drop("family"), task_dim(spark, d), models, CONDITIONS[:3])
    return rows.select("trial_key", "task_id", "family", "model_name", "condition", "passed", "total_tokens")


@query("jn3_unknown", "trials latest", """,
known AS (SELECT DISTINCT task_id FROM trials WHERE family <> 'rule')
SELECT CASE WHEN k.task_id IS NULL THEN 'unknown_task' WHEN model = 'm2' THEN 'unknown_model' ELSE 'unknown_condition' END AS code, trial_key AS key
FROM latest l LEFT JOIN known k ON l.task_id = k.task_id WHERE k.task_id IS NULL OR model = 'm2' OR condition = 'with_asset_b'""")
def jn3_unknown(spark, d):
    log = A.trials(spark, d)
    return M.unknown_identity(
        latest(spark, d), log.filter("family <> 'rule'").select("task_id").distinct(),
        log.filter("model <> 'm2'").select("model").distinct(), CONDITIONS[:3])


ROLLOUT_SQL = TRACE_SQL + """,
one AS (SELECT concat('C', CAST(CAST(substr(task_id, 2) AS BIGINT) AS VARCHAR)) AS task_id, max(passed) AS passed, sum(input_tokens) AS tokens
  FROM latest WHERE model = 'm0' AND condition = 'with_asset_a' GROUP BY 1)"""


@query("jn8_rollout_vs_oneshot", "trials latest rollouts", f""", {ROLLOUT_SQL}
SELECT count(*) AS selected, sum(api_calls) AS rollout_calls, sum(ts.total_tokens) AS rollout_tokens, count(one.task_id) AS oneshot_calls,
  coalesce(sum(one.tokens), 0) AS oneshot_tokens, count(*) FILTER (one.task_id IS NULL) AS missing_budget, count(*) FILTER (one.passed IS NULL) AS missing_result,
  count(*) FILTER (one.passed = 1) AS both_correct, coalesce(sum(ts.total_tokens) FILTER (one.passed = 1), 0) AS both_rollout_tokens,
  coalesce(sum(one.tokens) FILTER (one.passed = 1), 0) AS both_oneshot_tokens FROM ts LEFT JOIN one ON ts.task_id = one.task_id""")
def jn8_rollout_vs_oneshot(spark, d):
    from evalmart.operators.joins import rollout_vs_oneshot

    one = latest(spark, d).filter("model = 'm0' AND condition = 'with_asset_a'").withColumn(
        "task_id", F.concat(F.lit("C"), F.substring("task_id", 2, 20).cast("bigint").cast("string")))
    budget = one.groupBy("task_id").agg(F.sum("input_tokens").alias("tokens"))
    results = one.groupBy("task_id").agg(F.max("passed").alias("passed"))
    return rollout_vs_oneshot(M.trace_stats(traces(spark, d), 6), budget, results)
