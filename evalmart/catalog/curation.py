"""Curation over the task documents, labels, trials and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmart import adapters as A
from evalmart.catalog import query
from evalmart.catalog.analytics import latest, producer, task_dim
from evalmart.operators import curation as CU, joins as J, latest as L, metrics as M, prefix as X, sampling as SA, selection as SL
from evalmart.plans import curate as PC
from evalmart.sources import files as FI
from evalmart.functions import gates as GA


def rules():
    return [("drop_too_short", F.col("n_chars") < 100), ("drop_toxic", F.col("toxic") == 1), ("drop_low_quality", F.col("quality") == 0)]


REASON = "CASE WHEN n_chars < 100 THEN 'drop_too_short' WHEN toxic = 1 THEN 'drop_toxic' WHEN quality = 0 THEN 'drop_low_quality' ELSE 'kept' END"


@query("ag14_funnel", "tasks", f"""
SELECT source, {REASON} AS outcome, count(*) AS n FROM tasks GROUP BY ALL UNION ALL SELECT source, 'seen', count(*) FROM tasks GROUP BY source""")
def ag14_funnel(spark, d):
    return CU.funnel(A.tasks(spark, d), rules(), ["source"])


@query("ag15_dedup_stats", sql="""
SELECT count(*) AS seen, count(DISTINCT text) AS survivors, count(*) - count(DISTINCT text) AS collisions, count(*) - count(DISTINCT text) AS dropped_by_dedup FROM documents""")
def ag15_dedup_stats(spark, d):
    return L.dedup_stats(A.tasks(spark, d), F.sha1("text"))


@query("wn2_dedup", "tasks", """
SELECT CASE WHEN quality IS NOT NULL THEN concat('scenario_name:', source) ELSE concat('content_sha1:', sha1(concat(text, chr(10), '<<<SEP>>>', chr(10), family))) END AS dedup_key,
  count(*) AS n_copies, arg_max(task_id, seq) AS task_id FROM tasks GROUP BY 1""")
def wn2_dedup(spark, d):
    rows = A.tasks(spark, d)
    key = L.task_dedup_key(F.when(F.col("quality").isNotNull(), F.col("source")), F.col("text"), F.col("family"))
    return L.dedup_keep_last(rows.select("task_id", "text", "family", "source", "quality", "seq"), key, ["seq", "task_id"]).select(
        "dedup_key", "n_copies", "task_id")


@query("ag16_gates", "tasks", f"""
, g AS (SELECT family, {REASON.replace("'kept'", "'pass_pre_calibration'")} AS gate, count(*) AS n FROM tasks GROUP BY ALL)
SELECT *, sum(n) OVER (PARTITION BY family) AS total, round(n / sum(n) OVER (PARTITION BY family), 6) AS share FROM g""")
def ag16_gates(spark, d):
    records = CU.with_drop_reason(A.tasks(spark, d), rules()).select(
        "family", F.col("drop_reason").alias("gate"), F.when(F.col("drop_reason").isNull(), "pass_pre_calibration").otherwise("fail").alias("verdict"))
    return CU.gate_report(records)


CAL_SQL = """
cal AS (SELECT task_id, family, sum(passed) AS n_solved FROM latest WHERE condition = 'no_context' GROUP BY ALL),
calv AS (SELECT *, CASE WHEN n_solved = 0 THEN '0_of_3_hard_no_solve' WHEN n_solved = 3 THEN '3_of_3_trivially_easy' ELSE concat(n_solved, '_of_3_discriminating') END AS band,
  CASE WHEN n_solved = 3 THEN 'REJECT_trivially_easy' WHEN n_solved = 0 THEN 'KEEP_hard' ELSE 'KEEP_discriminating' END AS verdict FROM cal)"""


def calibrated(spark, d):
    return CU.calibrate(latest(spark, d, "condition", "task_id", "family", "passed").filter("condition = 'no_context'").select("task_id", "family", F.col("passed").alias("solved")), 3)


@query("ag17_calibrate", "trials latest", f", {CAL_SQL} SELECT * FROM calv")
def ag17_calibrate(spark, d):
    return calibrated(spark, d)


@query("ag17_yield", "trials latest", f""", {CAL_SQL},
y AS (SELECT family, count(*) AS total, count(*) FILTER (verdict = 'KEEP_discriminating') AS n_discriminating, count(*) FILTER (verdict = 'KEEP_hard') AS n_hard,
  count(*) FILTER (verdict = 'REJECT_trivially_easy') AS n_easy, 0 AS n_isolated FROM calv GROUP BY family)
SELECT *, n_discriminating + n_hard AS n_keep, CAST(floor(100 * (n_discriminating + n_hard) / total) AS BIGINT) AS keep_percent, n_discriminating + n_hard >= 0.4 * total AS go FROM y""")
def ag17_yield(spark, d):
    return CU.calibration_yield(calibrated(spark, d))


@query("prj9_calibration", sql="""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'anchor' END AS anchor, CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN 7 ELSE 9 END AS n_pass,
  CASE WHEN p_size % 2 = 0 THEN 50 ELSE 60 END AS n_trials, CASE WHEN p_size > 25 THEN 'final' ELSE 'plain' END AS verdict FROM part""")
def prj9_calibration(spark, d):
    size = F.col("p_size")
    null = F.lit(None).cast("int")
    summary = F.struct(
        F.lit("anchor").alias("anchor_model"), F.when(size % 3 == 0, 7).alias("n_pass"), F.lit(9).alias("n_solved"), null.alias("total_pass"),
        null.alias("n_trials"), F.lit(60).alias("total_trials"), F.when(size > 25, "final").alias("final_label"), F.lit("plain").alias("verdict"))
    anchors = F.when(size % 2 == 0, F.array(F.struct(F.col("p_brand").alias("model"), size.alias("n_pass"), F.lit(50).alias("n_trials"))))
    return A.table(spark, d, "part").select("p_partkey", CU.normalize_calibration(summary, anchors).alias("c")).select("p_partkey", "c.*")


@query("prj10_mode", "tasks", """
SELECT task_id, CASE WHEN quality IS NULL THEN 'subprocess_cli_no_ref' WHEN contains(text, 'the') THEN 'subprocess_cli' ELSE 'subprocess_ref_runner' END AS mode FROM tasks""")
def prj10_mode(spark, d):
    script = F.replace("text", F.lit("the"), F.lit("generated.py"))
    return A.tasks(spark, d).select("task_id", GA.detect_mode(F.col("quality").isNotNull(), script).alias("mode"))


@query("prj11_files", "trials", """
SELECT task_id, max(CASE WHEN condition = 'no_context' THEN condition END) AS task,
  coalesce(max(CASE WHEN condition = 'with_asset_b' AND passed = 1 THEN condition END), max(CASE WHEN condition = 'with_skill' AND passed = 1 THEN condition END)) AS skill FROM trials WHERE passed = 1 GROUP BY task_id""")
def prj11_files(spark, d):
    names = A.trials(spark, d).filter("passed = 1").select("task_id", F.col("condition").alias("name"))
    return FI.files_struct(names, [("task", ["no_context"]), ("skill", ["with_asset_b", "with_skill"])])


@query("prj12_ignored", sql="""
SELECT p_partkey, p_size % 4 <> 3 AS ignored FROM part""")
def prj12_ignored(spark, d):
    size = F.col("p_size") % 4
    path = F.concat(F.lit("a/"), F.when(size == 0, "__pycache__").when(size == 1, "_trace_x").when(size == 2, "generated.py").otherwise("keep.py"), F.lit("/"), "p_brand")
    return A.table(spark, d, "part").select("p_partkey", FI.is_ignored(path).alias("ignored"))


@query("prj12_layout_debris", sql="SELECT p_partkey, p_size % 5 <> 4 AS dropped FROM part")
def prj12_layout_debris(spark, d):
    m = F.col("p_size") % 5
    path = F.concat(F.lit("a/"), F.when(m == 0, "_bad_solutions/x").when(m == 1, "_trace.json").when(m == 2, "_s5_attempt3.py").when(m == 3, "_design.json").otherwise("_s5_attempt3.txt"))
    return A.table(spark, d, "part").select("p_partkey", FI.is_layout_debris(path).alias("dropped"))


@query("wn7_cap", "tasks", """
SELECT task_id, family FROM tasks QUALIFY row_number() OVER (PARTITION BY family ORDER BY sha256(concat_ws('|', '42', task_id)), task_id) <= 7""")
def wn7_cap(spark, d):
    return SA.cap_per_group(A.tasks(spark, d).select("task_id", "family"), "family", "task_id", 7, 42)


@query("wn7_cap_large", "trials", """
SELECT model, seq FROM trials QUALIFY row_number() OVER (PARTITION BY model ORDER BY sha256(concat_ws('|', '5', CAST(seq AS VARCHAR)))) <= 2500""")
def wn7_cap_large(spark, d):
    return SA.cap_per_group(A.trials(spark, d).select("model", "seq"), "model", "seq", 2500, 5)


@query("so2_sample_large", "trials", "SELECT seq FROM trials ORDER BY sha256(concat_ws('|', '9', CAST(seq AS VARCHAR))) LIMIT 6000")
def so2_sample_large(spark, d):
    return SA.sample_n(A.trials(spark, d).select("seq"), "seq", 6000, 9)


@query("wn8_nth_success", "trials", """
SELECT model, seq FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq) AS r FROM trials WHERE passed = 1) WHERE r = 1200""")
def wn8_nth_success(spark, d):
    return SL.nth_by_ordinal(A.trials(spark, d).filter("passed = 1").select("model", "seq"), ["model"], "seq", 1200, width=500)


@query("wn7_seeded_rank", "tasks", """
SELECT task_id, family, row_number() OVER (PARTITION BY family ORDER BY sha256(concat_ws('|', '42', task_id))) AS rank FROM tasks""")
def wn7_seeded_rank(spark, d):
    from evalmart.functions.numeric import seeded_digest

    rows = A.tasks(spark, d).select("task_id", "family", seeded_digest(42, F.col("task_id")).alias("digest"))
    return X.running_count_by_digest(rows, ["family"], "digest").drop("digest")


@query("wn8_stop_at_target", "trials", """,
h AS (SELECT family, seq, row_number() OVER (PARTITION BY family ORDER BY seq) AS rn FROM trials WHERE passed = 1),
f AS (SELECT g.family, max(seq) FILTER (rn = 20) AS filled FROM (SELECT DISTINCT family FROM trials) g LEFT JOIN h ON g.family = h.family AND rn <= 20 GROUP BY g.family),
e AS (SELECT CASE WHEN count(*) FILTER (filled IS NULL) = 0 THEN max(filled) END AS stop FROM f)
SELECT t.seq, t.family, t.passed FROM trials t JOIN f ON f.family = t.family CROSS JOIN e WHERE (filled IS NULL OR seq <= filled) AND (stop IS NULL OR seq <= stop)""")
def wn8_stop_at_target(spark, d):
    return J.stop_at_target(A.trials(spark, d).select("seq", "family", "passed"), "family", "seq", F.col("passed") == 1, 20)


@query("wn9_family_ids", "tasks", """
SELECT task_id, family, concat(substr(family, 1, 1), '_', lpad(CAST(row_number() OVER (PARTITION BY family ORDER BY source, task_id) AS VARCHAR), 4, '0')) AS local_id FROM tasks""")
def wn9_family_ids(spark, d):
    rows = A.tasks(spark, d).select("task_id", "family", "source")
    return SA.assign_ids(rows, "family", ["source", "task_id"], F.substring("family", 1, 1)).select("task_id", "family", "local_id")


@query("so3_task_order", "tasks", "SELECT task_id, row_number() OVER (ORDER BY family, task_id) AS rank FROM tasks")
def so3_task_order(spark, d):
    return X.ordered_rank(A.tasks(spark, d).select("task_id", "family"), [], ["family", "task_id"]).select("task_id", "rank")


@query("so1_report_order", "trials latest", """
SELECT trial_key, row_number() OVER (ORDER BY CASE model WHEN 'm2' THEN 1 WHEN 'm0' THEN 2 ELSE 3 END, CASE condition WHEN 'with_skill' THEN 1 ELSE 2 END, task_id, trial_key) AS at FROM latest""")
def so1_report_order(spark, d):
    rows = latest(spark, d, "model", "condition", "task_id")
    by_model, by_condition = J.report_ranks(["m2", "m0"], ["with_skill"])
    keyed = rows.withColumn("_m", by_model).withColumn("_c", by_condition)
    return X.ordered_rank(keyed, [], ["_m", "_c", "task_id", "trial_key"], "at").select("trial_key", "at")


@query("so2_sample", "tasks", "SELECT task_id FROM tasks ORDER BY sha256(concat_ws('|', '7', task_id)) LIMIT 50")
def so2_sample(spark, d):
    return SA.sample_n(A.tasks(spark, d).select("task_id"), "task_id", 50, 7)


@query("wn10_fit_budget", "rollouts", """,
r AS (SELECT task_id, rollout, text, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY task_id ORDER BY rollout ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM rollouts)
SELECT task_id, rollout, md5(left(text, CAST(room AS BIGINT))) AS snippet FROM r WHERE room > 0 AND length(text) > 0""")
def wn10_fit_budget(spark, d):
    rows = A.rollouts(spark, d).select("task_id", "rollout", "text")
    return SA.fit_budget(rows, ["task_id"], "rollout", 1500).select("task_id", "rollout", F.md5("snippet").alias("snippet"))


@query("wn11_replace_failed", "tasks", """
SELECT task_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'crash' ELSE 'kept' END AS verdict,
  CASE WHEN toxic = 1 AND quality = 1 THEN n_chars ELSE seq END AS score, coalesce(toxic = 1 AND quality = 1, false) AS replaced FROM tasks""")
def wn11_replace_failed(spark, d):
    t = A.tasks(spark, d)
    old = t.select("task_id", F.when(F.col("toxic") == 1, "crash").otherwise("kept").alias("verdict"), F.col("seq").alias("score"))
    newest = t.filter("quality = 1").select("task_id", F.lit(2).alias("attempt"), F.lit("pass").alias("verdict"), F.col("n_chars").alias("score"))
    earlier = newest.withColumns({"attempt": F.lit(1), "verdict": F.lit("fail"), "score": F.col("score") + 1})
    return L.replace_failed(old, newest.unionByName(earlier), "task_id", "attempt")


@query("ag24_target_progress", "trials", """,
p AS (SELECT task_id, min(family) AS family, max(CASE WHEN condition = 'with_asset_a' THEN passed END) AS a FROM trials GROUP BY 1),
g AS (SELECT family, count(*) FILTER (a = 1) AS evolved FROM p GROUP BY 1)
SELECT *, evolved >= 30 AS reached, bool_and(evolved >= 30) OVER () AS all_reached FROM g""")
def ag24_target_progress(spark, d):
    return CU.target_progress(task_dim(spark, d), producer(spark, d, "with_asset_a"), 30)


STATUS = "CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'fail' WHEN quality = 1 THEN 'pass' ELSE 'skip' END"


def selftest(spark, d):
    return A.tasks(spark, d).select("task_id", "family", F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "fail").when(
        F.col("quality") == 1, "pass").otherwise("skip").alias("status"))


@query("ag25_selftest", "tasks", f"""
SELECT family, count(*) FILTER (s = 'pass') AS n_pass, count(*) FILTER (s = 'fail') AS n_fail, count(*) FILTER (s = 'error') AS n_error, count(*) FILTER (s = 'skip') AS n_skip
FROM (SELECT family, {STATUS} AS s FROM tasks) GROUP BY family""")
def ag25_selftest(spark, d):
    return CU.status_by_family(selftest(spark, d))


@query("in8_quarantine", "tasks", f"SELECT task_id, family FROM tasks WHERE {STATUS} NOT IN ('fail', 'error')")
def in8_quarantine(spark, d):
    return PC.quarantine(A.tasks(spark, d), selftest(spark, d))[0].select("task_id", "family")


@query("in8_summary", "tasks", f""",
kept AS (SELECT * FROM tasks WHERE {STATUS} NOT IN ('fail', 'error'))
SELECT CASE WHEN grouping(family) = 0 THEN 'by_family' WHEN grouping(execution_mode) = 0 THEN 'by_execution_mode' WHEN grouping(source) = 0 THEN 'by_source' ELSE 'total_tasks' END AS field,
  coalesce(family, execution_mode, source, 'all') AS member, count(*) AS n FROM kept GROUP BY GROUPING SETS ((), (family), (execution_mode), (source))""")
def in8_summary(spark, d):
    return PC.quarantine(A.tasks(spark, d), selftest(spark, d))[1]


@query("in9_flat_layout", "tasks", """
SELECT 'T' || lpad(CAST(row_number() OVER (ORDER BY family, task_id) AS VARCHAR), 4, '0') AS task_id, task_id AS legacy_task_id,
  'tasks/T' || lpad(CAST(row_number() OVER (ORDER BY family, task_id) AS VARCHAR), 4, '0') AS rel_dir FROM tasks WHERE source <> 'src1'""")
def in9_flat_layout(spark, d):
    return PC.flatten_layout(A.tasks(spark, d), ["src1"], "T", 4).select("task_id", "legacy_task_id", "rel_dir")


@query("in10_consolidate", "tasks rollouts", """,
u AS (SELECT 'docs' AS source, family, task_id AS orig_id FROM tasks WHERE coalesce(toxic, 0) <> 1 AND n_chars >= 100
  UNION ALL SELECT 'chats', kind, concat(task_id, '-', rollout) FROM rollouts WHERE total_tokens >= 20
  UNION ALL SELECT 'bench', 'en', concat('B', item_id) FROM benchmark)
SELECT source, family, orig_id, concat(family, '/', CASE family WHEN 'en' THEN 'e' WHEN 'user' THEN 'u' ELSE 'x' END, '_', lpad(CAST(row_number() OVER (PARTITION BY family ORDER BY source, orig_id) AS VARCHAR), 4, '0')) AS task_id,
  CASE family WHEN 'en' THEN 'text_short_answer' END AS execution_mode FROM u""")
def in10_consolidate(spark, d):
    docs = A.tasks(spark, d).select("family", F.col("task_id").alias("orig_id"), "toxic", "n_chars")
    chats = A.rollouts(spark, d).select(F.col("kind").alias("family"), F.concat_ws("-", "task_id", "rollout").alias("orig_id"), "total_tokens")
    bench = A.table(spark, d, "benchmark").select(F.lit("en").alias("family"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("orig_id"))
    return PC.consolidate(
        {"docs": (docs, [("toxic", F.col("toxic") == 1), ("short", F.col("n_chars") < 100)]), "chats": (chats, [("short", F.col("total_tokens") < 20)]), "bench": (bench, [])},
        {"en": "e", "user": "u"}, {"en": "text_short_answer"}).select("source", "family", "orig_id", "task_id", "execution_mode")


RUNS_SQL = """,
runs AS (SELECT task_id, family, text, quality, seq, unnest(range(1, seq % 3 + 2)) AS run FROM tasks WHERE n_chars >= 50),
kept AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY run DESC, task_id DESC) = 1),
bench AS (SELECT concat('B', item_id) AS orig_id FROM benchmark),
all_rows AS (SELECT 'bench' AS source, 'en' AS family, orig_id, NULL AS run, NULL AS verdict, NULL AS n_pass FROM bench
  UNION ALL SELECT 'runs', family, task_id, run, CASE WHEN seq % 2 = 0 THEN 'middle' ELSE 'easy' END, CASE WHEN seq % 2 = 0 THEN seq % 5 ELSE 9 END FROM kept)"""


def runs_and_bench(spark, d):
    """Tasks that came out of up to three runs each, copies of one text among them, beside the benchmark."""
    anchor = F.struct(F.lit("m").alias("model"), (F.col("seq") % 5).cast("bigint").alias("n_pass"), F.lit(5).cast("bigint").alias("n_trials"))
    none = F.lit(None).cast("bigint")
    summary = F.struct(F.lit(None).cast("string").alias("anchor_model"), none.alias("n_pass"), none.alias("n_solved"), F.lit(9).cast("bigint").alias("total_pass"),
                       none.alias("n_trials"), F.lit(10).cast("bigint").alias("total_trials"), F.when(F.col("seq") % 2 == 0, "middle").alias("final_label"), F.lit("easy").alias("verdict"))
    runs = A.tasks(spark, d).withColumn("run", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("seq") % 3 + 1))).select(
        F.col("task_id").alias("orig_id"), "family", "text", "n_chars", "run", F.concat(F.lit("2024010"), F.col("run").cast("string"), F.lit("T000000_x")).alias("run_name"),
        summary.alias("totals"), F.when(F.col("seq") % 2 == 0, F.array(anchor)).alias("anchors"))
    bench = A.table(spark, d, "benchmark").select(F.lit("en").alias("family"), F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("orig_id"))
    key = L.task_dedup_key(F.lit(None).cast("string"), F.col("text"), F.lit(""))
    sources = {"runs": PC.Source(runs, [("short", F.col("n_chars") < 50)], key, ["run_name", "orig_id"], ("totals", "anchors")), "bench": (bench,)}
    return PC.consolidation(sources, {"en": "e"}, {"en": "text_short_answer"})


@query("in10_manifest", "tasks", f"""{RUNS_SQL}
SELECT source, family, orig_id, run, verdict, n_pass, concat(family, '/', CASE family WHEN 'en' THEN 'e' ELSE 'x' END, '_', lpad(CAST(row_number() OVER (PARTITION BY family ORDER BY source, orig_id) AS VARCHAR), 4, '0')) AS task_id FROM all_rows""")
def in10_manifest(spark, d):
    return runs_and_bench(spark, d).manifest.select("source", "family", "orig_id", "run", "calibration.verdict", "calibration.n_pass", "task_id")


@query("in10_summary", "tasks", f"""{RUNS_SQL}
SELECT 'total_tasks' AS field, 'all' AS member, count(*) AS n FROM all_rows UNION ALL SELECT 'by_family', coalesce(family, 'None'), count(*) FROM all_rows GROUP BY ALL
UNION ALL SELECT 'by_execution_mode', CASE WHEN family = 'en' THEN 'text_short_answer' ELSE 'None' END, count(*) FROM all_rows GROUP BY ALL UNION ALL SELECT 'by_source', source, count(*) FROM all_rows GROUP BY ALL""")
def in10_summary(spark, d):
    return runs_and_bench(spark, d).summary


@query("in10_dedup", "tasks", f"""{RUNS_SQL}
SELECT 'runs' AS source, seen, survivors, seen - survivors AS collisions, seen - survivors AS dropped_by_dedup FROM (SELECT (SELECT count(*) FROM runs) AS seen, (SELECT count(*) FROM kept) AS survivors)""")
def in10_dedup(spark, d):
    return runs_and_bench(spark, d).dedup


@query("in9_summary", "tasks", """
, t AS (SELECT * FROM tasks WHERE source <> 'src1')
SELECT 'total_tasks' AS field, 'all' AS member, count(*) AS n FROM t UNION ALL SELECT 'by_family', coalesce(family, 'None'), count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'by_execution_mode', coalesce(execution_mode, 'None'), count(*) FROM t GROUP BY ALL UNION ALL SELECT 'by_source', coalesce(source, 'None'), count(*) FROM t GROUP BY ALL""")
def in9_summary(spark, d):
    return M.manifest_summary(PC.flatten_layout(A.tasks(spark, d), ["src1"], "T", 4))


@query("in13_bundles", "rollouts", r"""
SELECT concat(task_id, '::', rollout) AS trial_key, task_id, CASE WHEN api_call = 1 THEN 'text_short_answer' ELSE 'other' END AS execution_mode,
  md5(CASE WHEN api_call = 1 THEN regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '-?[0-9]+(?:\.[0-9]+)?', '<num>', 'g') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS attempt,
  concat('passed: ', CASE WHEN api_call = 1 THEN 'true' ELSE 'false' END, chr(10), 'error_type: ', kind, chr(10), 'at <path> now') AS verdict_block FROM rollouts""")
def in13_bundles(spark, d):
    r = A.rollouts(spark, d).withColumn("trial_key", F.concat_ws("::", "task_id", "rollout"))
    cases = r.select("trial_key", F.col("trial_key").alias("task_id"), F.col("text").alias("raw_response"), F.lit("").alias("extracted_code"))
    results = r.select("trial_key", F.col("api_call").alias("passed"), F.col("kind").alias("error_type"), F.lit("PASS: x\nat /tmp/run/a.py now\n").alias("stdout_tail"))
    tasks = r.select(F.col("trial_key").alias("task_id"), F.lit("f").alias("family"), F.when(F.col("api_call") == 1, "text_short_answer").otherwise("other").alias("execution_mode"))
    return PC.attempt_bundles(cases, results, tasks).select(
        "trial_key", F.substring_index("task_id", "::", 1).alias("task_id"), "execution_mode", F.md5("attempt").alias("attempt"), "verdict_block")
