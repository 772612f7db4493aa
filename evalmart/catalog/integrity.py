"""Run-log integrity over the trial log, the ledger and the task documents."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from evalmart import adapters as A
from evalmart.catalog import query
from evalmart.catalog.analytics import latest
from evalmart.functions.hashing import canonical_json
from evalmart.operators import budget as B, joins as J, latest as L, metrics as M, prefix as X, sampling as SA
from evalmart.plans import contracts as C
from evalmart.schemas import CONDITIONS
from evalmart.sources import documents as D, files as FI, logs as G


def raw_lines(spark, d):
    """Event properties are good lines; document texts stand for torn and foreign ones."""
    good = A.table(spark, d, "events").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("line_id"), F.col("props").alias("value"))
    foreign = A.table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("line_id"), F.col("text").alias("value"))
    torn = A.table(spark, d, "events").select(F.concat(F.lit("X"), F.col("event_id").cast("string")).alias("line_id"), F.concat("props", "props").alias("value"))
    return good.unionByName(foreign).unionByName(torn)


LINES_SQL = """
lines AS (SELECT concat('E', CAST(event_id AS VARCHAR)) AS line_id, props AS value FROM events
  UNION ALL SELECT concat('D', CAST(doc_id AS VARCHAR)), text FROM documents
  UNION ALL SELECT concat('X', CAST(event_id AS VARCHAR)), concat(props, props) FROM events)"""


@query("src1_strict_violations", sql=f"WITH {LINES_SQL} SELECT line_id FROM lines WHERE regexp_matches(value, '\\S') AND NOT (json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value ELSE '0' END) = 'OBJECT')")
def src1_strict_violations(spark, d):
    return G.bad_lines(raw_lines(spark, d)).select("line_id")


@query("src2_lenient_read", sql=f"WITH {LINES_SQL} SELECT line_id, CAST(json_extract_string(value, '$.k') AS BIGINT) AS k FROM lines WHERE substr(line_id, 1, 1) = 'E' AND json_valid(value)")
def src2_lenient_read(spark, d):
    return G.parse_log(raw_lines(spark, d), T.StructType([T.StructField("k", T.LongType())]), mode="lenient")


@query("src3_trial_key", "trials", "SELECT seq, trial_key, CASE WHEN seq % 4 = 3 THEN concat('x', trial_key) ELSE trial_key END AS nested_first FROM trials")
def src3_trial_key(spark, d):
    own = F.when(F.col("seq") % 2 == 0, F.col("trial_key")).when(F.col("seq") % 4 == 3, F.col("trial_key"))
    nested = F.when(F.col("seq") % 4 == 1, F.col("trial_key")).when(F.col("seq") % 4 == 3, F.concat(F.lit("x"), "trial_key"))
    log = A.trials(spark, d).select("seq", own.alias("k"), F.struct(nested.alias("trial_key")).alias("trial")).withColumnRenamed("k", "trial_key")
    return log.select("seq", G.trial_key_col().alias("key"), G.trial_key_col(True).alias("nested_first")).withColumnRenamed("key", "trial_key")


@query("src9_scenario", sql="""
SELECT CAST(event_id AS BIGINT) AS event_id, json_extract_string(props, '$.k') AS k FROM events
UNION ALL SELECT -1 - doc_id, NULL FROM documents""")
def src9_scenario(spark, d):
    yaml_like = A.table(spark, d, "events").select("event_id", F.col("props").alias("text"))
    prose = A.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("event_id"), "text")
    return D.parse_scenario(yaml_like.unionByName(prose), keys=["k"]).drop("text")


@query("src10_csv_sample", sql=r"""
SELECT doc_id, substr(array_to_string(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')[1:9],
  lambda l: array_to_string(list_transform(regexp_extract_all(l, '(?:^|,)("(?:[^"]|"")*"|[^,]*)', 1)[1:20],
    lambda c: CASE WHEN starts_with(c, '"') THEN replace(regexp_replace(c, '^"|"$', '', 'g'), '""', '"') ELSE c END), ',')), chr(10)), 1, 2200) AS sample FROM documents""")
def src10_csv_sample(spark, d):
    return A.table(spark, d, "documents").select("doc_id", D.csv_sample(F.col("text")).alias("sample"))


@query("src11_checksums", "assets", """,
l AS (SELECT path, CASE WHEN size % 2 = 0 THEN sha256 ELSE substr(sha256, 2) END AS sha FROM assets)
SELECT 'malformed' AS code, CAST(NULL AS VARCHAR) AS key FROM l WHERE length(sha) = 63
UNION ALL SELECT 'duplicate_path', path FROM l WHERE length(sha) = 64 GROUP BY path HAVING count(*) > 1""")
def src11_checksums(spark, d):
    sha = F.when(F.col("size") % 2 == 0, F.col("sha256")).otherwise(F.substring("sha256", 2, 64))
    lines = A.assets(spark, d).select(F.concat_ws("  ", sha, "path").alias("value"))
    return FI.checksum_violations(FI.parse_checksums(lines))


@query("prj4_select", "tasks", """
SELECT task_id, family, source FROM tasks WHERE family IN ('en', 'fr') AND execution_mode IN ('pytest_pkg', 'subprocess_cli') AND NOT (source = 'src3') AND task_id NOT IN ('D1', 'D4')""")
def prj4_select(spark, d):
    tasks = A.tasks(spark, d).withColumn("orig_id", F.col("source"))
    return J.select_tasks(tasks, families=["en", "fr"], modes=["pytest_pkg", "subprocess_cli"], skip_ids=["src3", "D1"],
                          default_skip_ids=["D4"]).select("task_id", "family", "source")


@query("prj4_unmatched", "tasks", """
SELECT DISTINCT concat('D', CAST(event_id AS VARCHAR)) AS id FROM events WHERE concat('D', CAST(event_id AS VARCHAR)) NOT IN (SELECT task_id FROM tasks)""")
def prj4_unmatched(spark, d):
    asked = A.table(spark, d, "events").select(F.concat(F.lit("D"), F.col("event_id").cast("string")).alias("id"))
    return J.unmatched_ids(A.tasks(spark, d), asked)


@query("prj5_condition", "trials", """
SELECT seq, CASE WHEN condition = 'with_skill' THEN 'with_skill' WHEN condition = 'no_context' THEN 'no_context' ELSE replace(condition, 'with_', '') END AS condition,
  condition IN ('with_skill', 'no_context') AS known FROM trials""")
def prj5_condition(spark, d):
    short = F.regexp_replace("condition", "^with_", "")
    named = M.normalize_condition(short)
    return A.trials(spark, d).select("seq", named.alias("condition"), named.isin(list(CONDITIONS)).alias("known"))


GRID_SQL = """
grid AS (SELECT task_id, model, condition, concat_ws('::', model, condition, task_id) AS trial_key
  FROM (SELECT DISTINCT task_id FROM trials) CROSS JOIN (VALUES ('m0'),('m1'),('m2')) m(model)
  CROSS JOIN (VALUES ('no_context'),('with_skill'),('with_asset_a'),('with_asset_b')) c(condition))"""
MODELS = ["m0", "m1", "m2"]


def grid(spark, d):
    return J.trial_grid(A.trials(spark, d).select("task_id").distinct(), MODELS, A.CONDITION_NAMES)


@query("jn1_grid", "tasks", """
SELECT task_id, family, model, condition, concat_ws('::', model, condition, task_id) AS trial_key FROM tasks
CROSS JOIN (VALUES ('m0'),('m1'),('m2')) m(model) CROSS JOIN (VALUES ('no_context'),('with_skill'),('with_asset_a'),('with_asset_b')) c(condition)""")
def jn1_grid(spark, d):
    return J.trial_grid(A.tasks(spark, d).select("task_id", "family"), MODELS, A.CONDITION_NAMES)


@query("jn2_plan_resume", "trials", f""", {GRID_SQL},
st AS (SELECT trial_key, max(CASE WHEN error_type <> 'api_error' THEN 1 ELSE 0 END) AS done FROM trials GROUP BY 1)
SELECT g.task_id, g.model, g.condition, g.trial_key, CASE WHEN st.done = 0 THEN 'retry_api_error' ELSE 'never_tried' END AS reason
FROM grid g LEFT JOIN st ON st.trial_key = g.trial_key WHERE coalesce(done, 0) = 0""")
def jn2_plan_resume(spark, d):
    return L.plan_resume(grid(spark, d), A.trials(spark, d))


ROLES_SQL = """
roles AS (SELECT DISTINCT task_id, condition AS role FROM trials WHERE passed = 1 AND output_tokens >= 90),
gone AS (SELECT g.* FROM grid g WHERE condition <> 'no_context' AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.task_id = g.task_id AND r.role = g.condition))"""


def _needs():
    return {c: c for c in A.CONDITION_NAMES if c != "no_context"}


def _roles(spark, d):
    return A.trials(spark, d).filter("passed = 1 AND output_tokens >= 90").select("task_id", F.col("condition").alias("role"))


@query("prj17_kept_grid", "trials", f", {GRID_SQL}, {ROLES_SQL} SELECT task_id, model, condition, trial_key FROM grid WHERE task_id NOT IN (SELECT task_id FROM gone)")
def prj17_kept_grid(spark, d):
    return J.filter_missing_assets(grid(spark, d), _roles(spark, d), _needs())[0]


@query("prj17_dropped", "trials", f", {GRID_SQL}, {ROLES_SQL} SELECT condition, count(DISTINCT task_id) AS dropped_tasks FROM gone GROUP BY 1")
def prj17_dropped(spark, d):
    return J.filter_missing_assets(grid(spark, d), _roles(spark, d), _needs())[1]


@query("jn6_coalesce_dim", "trials", """,
a AS (SELECT task_id, min(family) AS f FROM trials WHERE model = 'm0' GROUP BY 1),
b AS (SELECT task_id, concat('alt_', min(family)) AS f FROM trials WHERE model = 'm1' GROUP BY 1)
SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.f, b.f) AS family FROM a FULL JOIN b ON a.task_id = b.task_id""")
def jn6_coalesce_dim(spark, d):
    log = A.trials(spark, d)
    base = log.filter("model = 'm0'").groupBy("task_id").agg(F.min("family").alias("family"))
    alt = log.filter("model = 'm1'").groupBy("task_id").agg(F.concat(F.lit("alt_"), F.min("family")).alias("family"))
    return J.coalesce_dim(base, alt, "task_id", "family")


RECON_SQL = """
r AS (SELECT trial_key, task_id, model AS model_id, input_tokens, output_tokens, thoughts_tokens FROM latest WHERE error_type <> 'api_error'),
c AS (SELECT trial_key, CASE WHEN output_tokens = 77 THEN 'other' ELSE task_id END AS task_id FROM latest WHERE output_tokens <> 13),
b AS (SELECT trial_key, model AS model_id, CASE WHEN output_tokens = 50 THEN input_tokens + 1 ELSE input_tokens END AS input_tokens, output_tokens, thoughts_tokens
  FROM latest WHERE thoughts_tokens <> 3),
j AS (SELECT r.*, c.trial_key AS ck, c.task_id AS ct, b.trial_key AS bk, b.input_tokens AS bi FROM r LEFT JOIN c ON c.trial_key = r.trial_key LEFT JOIN b ON b.trial_key = r.trial_key)"""


@query("jn7_reconcile", "trials latest", f""", {RECON_SQL}
SELECT 'missing_case' AS code, trial_key AS key FROM j WHERE ck IS NULL UNION ALL SELECT 'missing_budget', trial_key FROM j WHERE bk IS NULL
UNION ALL SELECT 'case_task_id', trial_key FROM j WHERE ck IS NOT NULL AND ct <> task_id
UNION ALL SELECT 'budget_input_tokens', trial_key FROM j WHERE bk IS NOT NULL AND bi <> input_tokens""")
def jn7_reconcile(spark, d):
    rows = latest(spark, d).withColumn("model_id", F.col("model"))
    cases = rows.filter("output_tokens <> 13").withColumn(
        "task_id", F.when(F.col("output_tokens") == 77, "other").otherwise(F.col("task_id")))
    budget = rows.filter("thoughts_tokens <> 3").withColumn(
        "input_tokens", F.when(F.col("output_tokens") == 50, F.col("input_tokens") + 1).otherwise(F.col("input_tokens")))
    return J.reconcile(rows.filter("error_type <> 'api_error'"), cases, budget,
                       ["model_id", "input_tokens", "output_tokens", "thoughts_tokens"])


def merge_sides(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    base = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("task_id"), "text")
    new = F.col("doc_id") % 10 == 0
    supplement = docs.select(
        F.concat(F.when(new, "S").otherwise("D"), F.col("doc_id").cast("string")).alias("task_id"),
        F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return base, supplement


MERGE_SQL = """
base AS (SELECT concat('D', CAST(doc_id AS VARCHAR)) AS task_id, text FROM documents),
supp AS (SELECT concat(CASE WHEN doc_id % 10 = 0 THEN 'S' ELSE 'D' END, CAST(doc_id AS VARCHAR)) AS task_id, CASE WHEN doc_id % 7 = 1 THEN concat(text, '!') ELSE text END AS text FROM documents),
st AS (SELECT coalesce(b.task_id, s.task_id) AS task_id, CASE WHEN b.task_id IS NULL THEN 'new' WHEN s.task_id IS NULL THEN 'base_only'
  WHEN b.text = s.text THEN 'same' ELSE 'conflict' END AS state FROM base b FULL JOIN supp s ON b.task_id = s.task_id)"""


@query("jn9_merge_state", sql=f"WITH {MERGE_SQL} SELECT task_id, CASE WHEN state = 'new' THEN 0 ELSE 1 END AS n_base, CASE WHEN state = 'base_only' THEN 0 ELSE 1 END AS n_supplement, state FROM st")
def jn9_merge_state(spark, d):
    base, supplement = merge_sides(spark, d)
    return J.merge_state(base, supplement, "task_id", F.col("text"))


@query("jn9_merge", sql=f"WITH {MERGE_SQL} SELECT task_id, md5(text) AS text_md5 FROM (SELECT * FROM base UNION ALL SELECT * FROM supp WHERE task_id IN (SELECT task_id FROM st WHERE state = 'new'))")
def jn9_merge(spark, d):
    base, supplement = merge_sides(spark, d)
    return J.merge_supplement(base, supplement, "task_id", F.col("text"), on_conflict="keep_base").select("task_id", F.md5("text").alias("text_md5"))


@query("jn9_conflicts", sql=f"""WITH {MERGE_SQL},
twice AS (SELECT * FROM supp UNION ALL SELECT task_id, concat(text, '?') FROM supp WHERE task_id LIKE 'S%0' AND task_id NOT LIKE 'S%00' UNION ALL SELECT * FROM supp WHERE task_id LIKE 'S%00'),
k AS (SELECT task_id, count(*) AS n_supplement, count(DISTINCT text) AS contents FROM twice GROUP BY 1)
SELECT k.task_id, CASE WHEN b.task_id IS NULL THEN 0 ELSE 1 END AS n_base, n_supplement, 'conflict' AS state FROM k LEFT JOIN base b USING (task_id) WHERE contents > 1 OR b.text <> (SELECT any_value(text) FROM supp WHERE supp.task_id = k.task_id)""")
def jn9_conflicts(spark, d):
    """Most keys that only the supplement has come again there: with another text, or with the same."""
    base, supplement = merge_sides(spark, d)
    same = F.col("task_id").like("S%00")
    again = supplement.filter(F.col("task_id").like("S%0")).withColumn("text", F.when(same, F.col("text")).otherwise(F.concat("text", F.lit("?"))))
    return J.merge_conflicts(base, supplement.unionByName(again), "task_id", F.col("text")).select("task_id", "n_base", "n_supplement", "state")


@query("in4_merge_evidence", sql=f"""WITH {MERGE_SQL}
SELECT (SELECT count(*) FROM base) AS base_rows, (SELECT count(*) FROM supp) AS supplement_rows, count(*) FILTER (state = 'new') AS appended_rows,
  count(*) FILTER (state = 'same') AS same_rows, count(*) FILTER (state = 'conflict') AS conflicts, 0 AS duplicate_base_keys,
  (SELECT count(*) FROM base) + count(*) FILTER (state = 'new') AS merged_rows, count(*) FILTER (state = 'conflict') = 0 AS clean FROM st""")
def in4_merge_evidence(spark, d):
    base, supplement = merge_sides(spark, d)
    return C.merge_evidence(base, supplement, "task_id", F.col("text"))


def run_fields(spark, d, parity):
    return A.trials(spark, d).filter(F.col("seq") % 2 == parity).groupBy(
        F.concat_ws(".", "condition", "task_id").alias("field")).agg(F.max("output_tokens").cast("string").alias("value"))


FIELDS_SQL = """
fa AS (SELECT concat_ws('.', condition, task_id) AS field, CAST(max(output_tokens) AS VARCHAR) AS value FROM trials WHERE seq % 2 = 0 GROUP BY 1),
fb AS (SELECT concat_ws('.', condition, task_id) AS field, CAST(max(output_tokens) AS VARCHAR) AS value FROM trials WHERE seq % 2 = 1 GROUP BY 1),
fd AS (SELECT coalesce(fa.field, fb.field) AS field, fa.value AS base_value, fb.value AS other_value,
  CASE WHEN fa.value IS NULL OR fb.value IS NULL THEN 'missing' WHEN fa.value <> fb.value THEN 'differs' END AS code FROM fa FULL JOIN fb ON fa.field = fb.field)"""


@query("jn14_identity_diff", "trials", f", {FIELDS_SQL} SELECT * FROM fd WHERE code IS NOT NULL")
def jn14_identity_diff(spark, d):
    return J.diff_run_identity(run_fields(spark, d, 0), run_fields(spark, d, 1))


def prompts(spark, d, parity):
    user = F.when(F.col("output_tokens") < 3, None).when(F.col("output_tokens") > 95, F.sha2("trial_key", 256)).otherwise(F.sha2("task_id", 256))
    system = F.when(F.col("output_tokens") < 3, None).when(
        F.col("output_tokens") % 10 == 9, F.sha2(F.col("seq").cast("string"), 256)).otherwise(F.sha2("condition", 256))
    return L.latest_by_key(A.trials(spark, d).filter(F.col("seq") % 2 == parity)).select(
        "model", "task_id", "condition", user.alias("user_hash"), system.alias("system_hash"))


def _prompts_sql(name, parity):
    return f"""{name} AS (SELECT model, task_id, condition, CASE WHEN output_tokens < 3 THEN NULL WHEN output_tokens > 95 THEN sha256(trial_key) ELSE sha256(task_id) END AS u,
  CASE WHEN output_tokens < 3 THEN NULL WHEN output_tokens % 10 = 9 THEN sha256(CAST(seq AS VARCHAR)) ELSE sha256(condition) END AS s
  FROM (SELECT * FROM trials WHERE seq % 2 = {parity} QUALIFY row_number() OVER (PARTITION BY trial_key ORDER BY seq DESC) = 1))"""


PARITY_SQL = f"""{_prompts_sql('pa', 0)}, {_prompts_sql('pb', 1)},
ua AS (SELECT model, task_id, min(u) lo, max(u) hi, max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) gap FROM pa GROUP BY ALL),
ub AS (SELECT model, task_id, min(u) lo, max(u) hi, max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) gap FROM pb GROUP BY ALL),
par AS (SELECT CASE WHEN ua.gap + ub.gap > 0 THEN 'user_hash_missing' WHEN ua.lo <> ua.hi OR ub.lo <> ub.hi THEN 'user_hash_inconsistent'
  WHEN ua.lo <> ub.lo THEN 'user_hash_differs' END AS code, ua.model, ua.task_id, CAST(NULL AS VARCHAR) AS condition
  FROM ua JOIN ub ON ua.model = ub.model AND ua.task_id = ub.task_id
  UNION ALL SELECT CASE WHEN pa.s IS NULL OR pb.s IS NULL THEN 'system_hash_missing' WHEN pa.condition LIKE 'with\\_asset%' ESCAPE '\\' THEN NULL
  WHEN pa.s <> pb.s THEN 'system_hash_differs' END, pa.model, pa.task_id, pa.condition
  FROM pa JOIN pb ON pa.model = pb.model AND pa.task_id = pb.task_id AND pa.condition = pb.condition)"""


@query("jn15_prompt_parity", "trials", f", {PARITY_SQL} SELECT code, model, task_id, condition FROM par WHERE code IS NOT NULL")
def jn15_prompt_parity(spark, d):
    return J.prompt_parity(prompts(spark, d, 0), prompts(spark, d, 1), "with_asset")


@query("in3_comparability", "trials", f""", {FIELDS_SQL}, {PARITY_SQL}
SELECT concat('identity_', code) AS code, field AS key FROM fd WHERE code IS NOT NULL
UNION ALL SELECT code, concat_ws('::', model, condition, task_id) FROM par WHERE code IS NOT NULL""")
def in3_comparability(spark, d):
    return C.comparability(run_fields(spark, d, 0), run_fields(spark, d, 1), prompts(spark, d, 0), prompts(spark, d, 1), "with_asset")


@query("in2_resume", "trials", """,
o AS (SELECT concat_ws('.', condition, family) AS field, CAST(count(*) AS VARCHAR) AS value FROM trials WHERE seq % 2 = 0 GROUP BY 1),
n AS (SELECT concat_ws('.', condition, family) AS field, CAST(count(*) AS VARCHAR) AS value FROM trials WHERE seq % 2 = 1 GROUP BY 1)
SELECT 'no_fingerprint' AS code, 'run_fingerprint' AS field UNION ALL
SELECT 'changed', o.field FROM o LEFT JOIN n ON o.field = n.field WHERE o.field LIKE 'no\\_context%' ESCAPE '\\' AND o.value IS DISTINCT FROM n.value""")
def in2_resume(spark, d):
    def fields(parity):
        return A.trials(spark, d).filter(F.col("seq") % 2 == parity).groupBy(
            F.concat_ws(".", "condition", "family").alias("field")).agg(F.count(F.lit(1)).cast("string").alias("value"))

    watched = [f"no_context.{f}" for f in ("code", "env", "math", "rule")]
    return C.check_resume(fields(0), fields(1), watched)


@query("jn19_exclude_known", "tasks", """
SELECT task_id, CASE WHEN source = 'src2' AND toxic = 1 THEN 'toxic' WHEN source = 'src2' AND toxic = 0 THEN 'unknown' END AS category,
  CASE WHEN source = 'src2' AND toxic IS NOT NULL THEN 'skip' ELSE 'run' END AS status FROM tasks""")
def jn19_exclude_known(spark, d):
    tasks = A.tasks(spark, d)
    known = tasks.filter("toxic IS NOT NULL").select(
        F.col("task_id").alias("orig_id"), F.when(F.col("toxic") == 1, "toxic").alias("category"))
    return J.exclude_known(tasks.withColumn("orig_id", F.col("task_id")).select("task_id", "source", "orig_id"), known, "src2").select(
        "task_id", "category", "status")


RESULT_SQL = """
res AS (SELECT *, CASE WHEN output_tokens = 7 THEN 'hardened-v2' ELSE 'legacy-v1' END AS runtime_protocol, thoughts_tokens - 1 AS n_total,
  input_tokens / 500 AS pass_rate, CASE WHEN output_tokens = 11 THEN '' ELSE concat('vendor/', model) END AS model_id,
  CASE WHEN error_type = 'api_error' THEN NULL WHEN output_tokens = 99 THEN 'bad' ELSE sha256(task_id) END AS user_hash,
  CASE WHEN error_type = 'api_error' THEN NULL ELSE sha256(condition) END AS system_hash,
  CASE WHEN output_tokens = 21 THEN 'other' ELSE trial_key END AS rkey FROM trials)"""


def results(spark, d):
    """Nested result records with some broken rules."""
    t = A.trials(spark, d)
    out = F.col("output_tokens")
    api = F.col("error_type") == "api_error"
    user = F.when(api, None).when(out == 99, "bad").otherwise(F.sha2("task_id", 256))
    return t.select(
        "seq", F.lit("v2").alias("schema_version"), F.lit(None).cast("string").alias("prompt_protocol"),
        F.when(out == 7, "hardened-v2").otherwise("legacy-v1").alias("runtime_protocol"),
        F.sha2(F.lit("run"), 256).alias("run_fingerprint"), F.sha2(F.lit("manifest"), 256).alias("manifest_sha256"),
        F.when(out == 11, "").otherwise(F.concat(F.lit("vendor/"), "model")).alias("model_id"),
        F.struct(F.when(~api, F.sha2("condition", 256)).alias("system"), user.alias("user")).alias("prompt_sha256"),
        F.struct("task_id", "family", "model", "condition", F.when(out == 21, "other").otherwise(F.col("trial_key")).alias("trial_key")).alias("trial"),
        F.struct(
            F.lit("subprocess").alias("mode"), (F.col("passed") == 1).alias("passed"), F.col("passed").cast("bigint").alias("n_pass"),
            (1 - F.col("passed")).cast("bigint").alias("n_fail"), (F.col("thoughts_tokens") - 1).alias("n_total"),
            (F.col("input_tokens") / 500).alias("pass_rate"), F.when(~api, out / 100).alias("agg_score"),
            F.create_map(F.lit("total"), out / 100).alias("scores"), "error_type").alias("eval"),
        F.struct(F.col("input_tokens").alias("input"), out.alias("output"), F.col("thoughts_tokens").alias("thoughts"),
                 F.lit(1).cast("bigint").alias("system_chars"), F.lit(1).cast("bigint").alias("user_chars")).alias("tokens"),
        F.lit(0.5).alias("cost_usd"), F.lit(None).cast("double").alias("cumulative_cost_usd"), F.lit(1.0).alias("elapsed_s"),
    )


@query("in1_result_contract", "trials", f""", {RESULT_SQL}
SELECT 'contract_runtime_protocol' AS code, rkey AS key, seq FROM res WHERE runtime_protocol <> 'legacy-v1'
UNION ALL SELECT 'trial_key_disagrees', rkey, seq FROM res WHERE rkey <> trial_key UNION ALL SELECT 'eval_n_total', rkey, seq FROM res WHERE n_total < 0
UNION ALL SELECT 'eval_pass_rate_over_1', rkey, seq FROM res WHERE pass_rate > 1 UNION ALL SELECT 'model_id_blank', rkey, seq FROM res WHERE model_id = ''
UNION ALL SELECT 'prompt_sha256', rkey, seq FROM res WHERE error_type <> 'api_error' AND NOT regexp_matches(user_hash, '^[0-9a-f]{{64}}$')""")
def in1_result_contract(spark, d):
    return C.check_results(results(spark, d), {"schema_version": "v2", "runtime_protocol": "legacy-v1"})


@query("prj1_flatten", "trials", f""", {RESULT_SQL}
SELECT rkey AS trial_key, model, condition, task_id, passed, error_type, seq, input_tokens, output_tokens, thoughts_tokens,
  input_tokens + output_tokens + thoughts_tokens AS total_tokens FROM res""")
def prj1_flatten(spark, d):
    from evalmart.operators.metrics import flatten_results

    return flatten_results(results(spark, d))


@query("ag19_single_values", "trials", f""", {RESULT_SQL}
SELECT 'runtime_protocol' AS field, CAST(NULL AS VARCHAR) AS value, count(*) AS n_with, count(*) AS n_records, 'mixed' AS state FROM res
UNION ALL SELECT 'prompt_protocol', 'legacy-v1', 0, count(*), 'inferred' FROM res
UNION ALL SELECT 'run_fingerprint', sha256('run'), count(*), count(*), 'single' FROM res
UNION ALL SELECT 'manifest_sha256', CAST(NULL AS VARCHAR), count(*), count(*), 'mixed' FROM res""")
def ag19_single_values(spark, d):
    return C.single_values(results(spark, d), ["runtime_protocol", "prompt_protocol", "run_fingerprint", "manifest_sha256"],
                           {"manifest_sha256": "0" * 64})


@query("ag20_model_ids", "trials", f""", {RESULT_SQL}
SELECT model AS alias, count(DISTINCT nullif(model_id, '')) AS n_ids, min(nullif(model_id, '')) AS first_id, max(nullif(model_id, '')) AS last_id,
  count(DISTINCT nullif(model_id, '')) > 1 AS violation FROM res GROUP BY model""")
def ag20_model_ids(spark, d):
    return C.model_ids(results(spark, d).select(F.col("trial.model").alias("model"), "model_id"))


@query("ag21_hash_stability", "trials", f""", {RESULT_SQL}
SELECT trial_key, coalesce(min(user_hash) <> max(user_hash), false) AS user_changed, coalesce(min(system_hash) <> max(system_hash), false) AS system_changed,
  arg_max(coalesce(user_hash, '~'), seq) AS latest_user_hash FROM res GROUP BY 1 HAVING min(user_hash) <> max(user_hash) OR min(system_hash) <> max(system_hash)""")
def ag21_hash_stability(spark, d):
    log = results(spark, d).select(
        F.concat_ws("::", "trial.model", "trial.condition", "trial.task_id").alias("trial_key"), "seq",
        F.col("prompt_sha256.user").alias("user_hash"), F.col("prompt_sha256.system").alias("system_hash"))
    return C.hash_stability(log).withColumn("latest_user_hash", F.coalesce("latest_user_hash", F.lit("~")))


@query("ag22_duplicates", "assets", """
SELECT sha256, count(*) AS n, min(asset_id) AS first_member, max(asset_id) AS last_member FROM assets GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT sha256(text), count(*), min('D' || doc_id), max('D' || doc_id) FROM documents GROUP BY text HAVING count(*) > 1""")
def ag22_duplicates(spark, d):
    docs = A.tasks(spark, d).select(F.sha2("text", 256).alias("sha256"), F.col("task_id").alias("member"))
    files = A.assets(spark, d).select("sha256", F.col("asset_id").alias("member"))
    return J.duplicates(docs.unionByName(files), ["sha256"], "member")


@query("ag23_feedback", "trials", """
SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS pos,
  left(concat_ws(chr(10), concat('model=', model, ' condition=', condition, ' error_type=', error_type), right(props, 5)), 20) AS feedback
FROM trials JOIN events ON event_id = seq WHERE condition = 'no_context'""")
def ag23_feedback(spark, d):
    log = A.trials(spark, d).join(
        A.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("stdout_tail")), "seq")
    return SA.collect_feedback(log.withColumn("stderr_tail", F.lit(None).cast("string")), tail_out=5, tail_err=5, cut=20)


LEDGER_SQL = """
run AS (SELECT *, sum(cost_usd) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM ledger),
led AS (SELECT *, spent - cost_usd AS before FROM run)"""


@query("wn3_ledger", "ledger", f""", {LEDGER_SQL}
SELECT run_id, seq, CAST(spent AS DOUBLE) AS spent, 'cumulative_mismatch' AS code FROM led WHERE seq % 97 = 5""")
def wn3_ledger(spark, d):
    stored = B.with_cumulative(A.ledger(spark, d)).select(
        "run_id", "seq", "cost_usd", F.when(F.col("seq") % 97 == 5, F.col("spent") + 1).otherwise(F.col("spent")).alias("stored"))
    return B.check_ledger(stored, "stored").select("run_id", "seq", F.col("spent").cast("double").alias("spent"), "code")


@query("wn3_cumulative", "ledger", f", {LEDGER_SQL} SELECT run_id, seq, CAST(spent AS DOUBLE) AS spent, CAST(before AS DOUBLE) AS before FROM led")
def wn3_cumulative(spark, d):
    return B.with_cumulative(A.ledger(spark, d)).select(
        "run_id", "seq", F.col("spent").cast("double").alias("spent"), F.col("before").cast("double").alias("before"))


@query("wn4_alerts", "ledger", f""", {LEDGER_SQL}
SELECT run_id, seq, bucket, bucket * 300000.0 AS threshold, CAST(spent AS DOUBLE) AS spent FROM (SELECT *, unnest(range(CAST(floor(before / 300000) AS BIGINT) + 1, CAST(floor(spent / 300000) AS BIGINT) + 1)) AS bucket FROM led)""")
def wn4_alerts(spark, d):
    return B.budget_alerts(A.ledger(spark, d), "300000").select(
        "run_id", "seq", "bucket", F.col("threshold").cast("double").alias("threshold"), F.col("spent").cast("double").alias("spent"))


@query("wn5_breaker", "ledger", f""", {LEDGER_SQL}
SELECT run_id, state, count(*) AS n, max(seq) FILTER (state = 'trip') AS trip_at FROM (SELECT *, CASE WHEN before >= 5000000 THEN 'after' WHEN spent >= 5000000 THEN 'trip' ELSE 'ok' END AS state FROM led) GROUP BY ALL""")
def wn5_breaker(spark, d):
    return B.budget_breaker(A.ledger(spark, d), "5000000").groupBy("run_id", "state").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("state") == "trip", F.col("seq"))).alias("trip_at"))


@query("fn2_canonical_json", sql="SELECT event_id, replace(props, ' ', '') AS canonical, concat('sha256:', sha256(replace(props, ' ', ''))) AS content_id FROM events")
def fn2_canonical_json(spark, d):
    from evalmart.functions.hashing import content_id

    return A.table(spark, d, "events").select("event_id", canonical_json(F.col("props")).alias("canonical"), content_id(F.col("props")).alias("content_id"))


@query("so4_preview", "trials", """,
u AS (SELECT DISTINCT model, condition, task_id FROM trials),
r AS (SELECT *, row_number() OVER (PARTITION BY model, condition ORDER BY task_id) AS rn FROM u)
SELECT model, condition, count(*) AS n_ids, string_agg(task_id, ',' ORDER BY task_id) FILTER (rn <= 5) AS preview, greatest(count(*) - 5, 0) AS more FROM r GROUP BY ALL""")
def so4_preview(spark, d):
    return X.preview_ids(A.trials(spark, d), ["model", "condition"], "task_id", 5)


@query("se5_keys", sql="SELECT event_id, 'j' AS missing, 'k' AS unknown FROM events")
def se5_keys(spark, d):
    keys = SA.check_keys(F.col("props"), required=["j"], allowed=["j"])
    return A.table(spark, d, "events").select(
        "event_id", F.array_join(keys["missing"], ",").alias("missing"), F.array_join(keys["unknown"], ",").alias("unknown"))
