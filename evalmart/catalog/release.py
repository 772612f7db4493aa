"""Release audit over the page inventory and the document corpus as file sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmart import adapters as A
from evalmart.catalog import query
from evalmart.catalog.analytics import METRICS_SQL, metric_rows
from evalmart.functions import hashing as H
from evalmart.functions.text import is_safe_relpath
from evalmart.operators import digests as DG, joins as J, rules as R
from evalmart.plans import audit as AU
from evalmart.sources import sinks as SK

# A policy over the pages: language folders decide the distribution.
RULES = [
    {"id": "pages", "priority": 10, "match": {"scope": "scenario", "relpaths": ["*"]},
     "classification": {"distribution": "public", "role": "runtime.page", "destination": "runtime/{task_id}/{relpath}"}},
    {"id": "german", "priority": 20, "match": {"families": ["de"]},
     "classification": {"distribution": "private", "role": "judge.page", "destination": "private/{task_id}/{name}", "materialize": False}},
    {"id": "french", "priority": 20, "match": {"family": "fr", "official": True},
     "classification": {"distribution": "public", "role": "context.page", "destination": "context/{collection}/{name}", "transform": "strip"}},
    {"id": "clash", "priority": 20, "match": {"source_relpaths": ["*/de/1*"]},
     "classification": {"distribution": "excluded", "role": "excluded.page"}},
    {"id": "rest", "priority": 5, "match": {"scope": "collection", "collections": ["en"], "has_task_id": True},
     "classification": {"distribution": "private", "role": "reference.page", "destination": "provenance/{collection}/{relpath}"}},
]


def page_files(spark, d):
    return A.assets(spark, d).withColumn("path", F.regexp_replace("path", "/+$", ""))


def inventory(spark, d):
    relpath = F.regexp_extract("path", "^[^/]*/(.*)$", 1)
    return page_files(spark, d).select(
        "path", "sha256", "size", F.col("path").alias("source_relpath"), relpath.alias("relpath"), F.regexp_extract(relpath, "^([a-z]+)/", 1).alias("collection"),
        F.regexp_extract(relpath, "^([a-z]+)/", 1).alias("family"), F.lit(None).cast("string").alias("execution_mode"), F.col("asset_id").alias("task_id"),
        (F.col("size") % 2 == 0).alias("official"), F.when(F.col("size") % 3 == 0, "collection").otherwise("scenario").alias("scope"), F.lit("0644").alias("mode"))


INVENTORY_SQL = """
pf AS (SELECT * REPLACE (regexp_replace(path, '/+$', '') AS path) FROM assets),
inv AS (SELECT path, sha256, size, asset_id AS task_id, regexp_extract(path, '^[^/]*/(.*)$', 1) AS relpath, regexp_extract(regexp_extract(path, '^[^/]*/(.*)$', 1), '^([a-z]+)/', 1) AS family,
  size % 2 = 0 AS official, CASE WHEN size % 3 = 0 THEN 'collection' ELSE 'scenario' END AS scope FROM pf),
mt AS (SELECT *, list_filter([CASE WHEN scope = 'scenario' THEN {'p': 10, 'id': 'pages'} END, CASE WHEN family = 'de' THEN {'p': 20, 'id': 'german'} END,
  CASE WHEN family = 'fr' AND official THEN {'p': 20, 'id': 'french'} END, CASE WHEN regexp_matches(path, '(?s)/de/1') THEN {'p': 20, 'id': 'clash'} END,
  CASE WHEN scope = 'collection' AND family = 'en' THEN {'p': 5, 'id': 'rest'} END], lambda m: m IS NOT NULL) AS ms FROM inv),
win AS (SELECT *, list_sort(list_transform(list_filter(ms, lambda m: m.p = list_max(list_transform(ms, lambda x: x.p))), lambda m: m.id)) AS ids FROM mt),
res AS (SELECT *, CASE WHEN len(ids) = 1 THEN 'classified' WHEN len(ids) > 1 THEN 'conflict' ELSE 'unclassified' END AS state, CASE WHEN len(ids) = 1 THEN ids[1] END AS rule_id FROM win),
cl0 AS (SELECT *, CASE rule_id WHEN 'pages' THEN 'public' WHEN 'french' THEN 'public' WHEN 'clash' THEN 'excluded' WHEN 'german' THEN 'private' WHEN 'rest' THEN 'private' END AS distribution,
  CASE rule_id WHEN 'pages' THEN 'runtime.page' WHEN 'french' THEN 'context.page' WHEN 'clash' THEN 'excluded.page' WHEN 'german' THEN 'judge.page' WHEN 'rest' THEN 'reference.page' END AS role,
  CASE rule_id WHEN 'pages' THEN concat('runtime/', task_id, '/', relpath) WHEN 'french' THEN concat('context/', family, '/', regexp_extract(relpath, '([^/]*)$', 1))
    WHEN 'german' THEN concat('private/', task_id, '/', regexp_extract(relpath, '([^/]*)$', 1)) WHEN 'rest' THEN concat('provenance/', family, '/', relpath) END AS bundle_path,
  CASE rule_id WHEN 'german' THEN false WHEN 'clash' THEN false ELSE CASE WHEN rule_id IS NOT NULL THEN official END END AS materialize FROM res),
cl AS (SELECT path, sha256, size, task_id, relpath, family, state, rule_id, distribution, role, bundle_path, materialize FROM cl0
  UNION ALL SELECT path, sha256, size, task_id, relpath, family, state, 'french__private_original', 'private', 'privacy.host_path_metadata',
    CASE WHEN scope = 'collection' THEN concat('provenance/', family, '/', relpath) ELSE concat('scenarios/', task_id, '/', relpath) END, true FROM cl0 WHERE rule_id = 'french')"""


def classified(spark, d):
    return R.classify_assets(inventory(spark, d), RULES)


@query("jn10_matches", "assets", f", {INVENTORY_SQL} SELECT task_id, array_to_string(list_sort(list_transform(ms, lambda m: concat(m.p, ':', m.id))), ',') AS matched FROM mt")
def jn10_matches(spark, d):
    named = F.transform("matched", lambda m: F.concat_ws(":", m["priority"].cast("string"), m["id"]))
    return R.match_rules(inventory(spark, d), RULES).select("task_id", F.array_join(F.sort_array(named), ",").alias("matched"))


@query("wn6_winner", "assets", f", {INVENTORY_SQL} SELECT task_id, state, rule_id, array_to_string(ids, ',') AS winners FROM res")
def wn6_winner(spark, d):
    return R.resolve_winner(R.match_rules(inventory(spark, d), RULES)).select("task_id", "state", "rule_id", F.array_join("winners", ",").alias("winners"))


@query("prj15_classified", "assets", f", {INVENTORY_SQL} SELECT task_id, state, rule_id, distribution, role, bundle_path, materialize FROM cl")
def prj15_classified(spark, d):
    return classified(spark, d).select("task_id", "state", "rule_id", "distribution", "role", "bundle_path", "materialize")


@query("ag18_inventory", "assets", f""", {INVENTORY_SQL}
SELECT distribution, coalesce(role, 'all') AS role, count(*) AS n, sum(size) AS bytes FROM cl WHERE state = 'classified' GROUP BY GROUPING SETS ((distribution), (distribution, role))""")
def ag18_inventory(spark, d):
    return AU.release_inventory(classified(spark, d))


GLOBS, REGEXES = ["*/fr/9*"], [r"track\([0-9]*7\)"]


@query("in5_repository_audit", "assets", f""", {INVENTORY_SQL},
pub AS (SELECT DISTINCT c.path, content FROM cl c JOIN pf a ON a.path = c.path WHERE distribution = 'public' AND state = 'classified')
SELECT 'unclassified_asset' AS code, path AS key FROM cl WHERE state = 'unclassified' UNION ALL SELECT 'classification_conflict', path FROM cl WHERE state = 'conflict'
UNION ALL SELECT 'duplicate_bundle_destination', bundle_path FROM cl WHERE bundle_path IS NOT NULL AND state = 'classified' GROUP BY distribution, bundle_path HAVING count(*) > 1
UNION ALL SELECT 'public_forbidden_asset', concat(path, ' */fr/9*') FROM pub WHERE contains(path, '/fr/9')
UNION ALL SELECT 'public_forbidden_content', concat(path, ' track\\([0-9]*7\\)') FROM pub WHERE regexp_matches(content, 'track\\([0-9]*7\\)')
UNION ALL SELECT 'sensitive_content_cross_distribution', sha256 FROM cl WHERE state = 'classified' AND size > 0 AND (distribution = 'public' OR (distribution = 'private' AND role IN ('judge.page', 'reference.page', 'privacy.host_path_metadata')))
  GROUP BY sha256 HAVING count(*) FILTER (distribution = 'public') > 0 AND count(*) FILTER (distribution = 'private') > 0""")
def in5_repository_audit(spark, d):
    content = page_files(spark, d).select("path", "sha256", "content").distinct()
    return AU.audit_repository(classified(spark, d), content, GLOBS, REGEXES)


@query("in14_release_records", "assets", f", {INVENTORY_SQL} SELECT distribution, bundle_path, role, sha256, size, path AS source_relpath, task_id FROM cl WHERE state = 'classified' AND bundle_path IS NOT NULL")
def in14_release_records(spark, d):
    return AU.release_records(classified(spark, d)).select("distribution", "bundle_path", "role", "sha256", "size", "source_relpath", "task_id")


def tree_sql(src: str, group: str, line: str, copies: str = "count(*)") -> str:
    """The digest tree of ``digests.lines_digest`` over the lines of a table, as CTEs and the final SELECT."""
    levels = "".join(f""",
n{d} AS (SELECT {group}, left(k, {d}) AS k, sha256(string_agg(line, '' ORDER BY line)) AS h, sum(n) AS n FROM l{d} GROUP BY {group}, left(k, {d})),
l{d - 2} AS (SELECT {group}, k, concat(k, ':', h, chr(10)) AS line, n FROM n{d})""" for d in (6, 4, 2))
    return f""",
cnt AS (SELECT {group}, sha256({line}) AS k, {copies} AS n FROM {src} GROUP BY {group}, sha256({line})),
l6 AS (SELECT {group}, k, concat(k, ':', n, chr(10)) AS line, n FROM cnt){levels}
SELECT {group}, sha256(string_agg(line, '' ORDER BY line)) AS digest, CAST(sum(n) AS BIGINT) AS n_lines, 'sha256-tree-6-2' AS form FROM l0 GROUP BY {group}"""


@query("in14_release_roots", "assets", f""", {INVENTORY_SQL},
ln AS (SELECT distribution, concat('{{"bundle_path":"', bundle_path, '","execution_mode":null,"family":"', family, '","materialize":', materialize, ',"mode":"0644","role":"', role, '","sha256":"', sha256,
  '","size":', size, ',"source_relpath":"', path, '","task_id":"', task_id, '"}}', chr(10)) AS line FROM cl WHERE state = 'classified' AND bundle_path IS NOT NULL)""" + tree_sql("ln", "distribution", "line"))
def in14_release_roots(spark, d):
    return AU.release_roots(AU.release_records(classified(spark, d)))


@query("in14_runtime_view", "assets", f""", {INVENTORY_SQL},
own AS (SELECT task_id, replace(relpath, 'fr/', 'data/') AS path FROM cl WHERE distribution = 'public' AND (role LIKE 'runtime.%' OR role LIKE 'environment.%'))
SELECT task_id, path, path AS source FROM own UNION ALL SELECT task_id, substr(path, 6), path FROM own o WHERE path LIKE 'data/%'
  AND NOT EXISTS (SELECT 1 FROM own x WHERE x.task_id = o.task_id AND x.path = substr(o.path, 6))""")
def in14_runtime_view(spark, d):
    return AU.runtime_view(classified(spark, d).withColumn("relpath", F.replace("relpath", F.lit("fr/"), F.lit("data/"))))


DOCS_SQL = """
ds AS (SELECT concat('d/', doc_id, '.txt') AS path, sha256(text) AS sha256, n_chars AS size, doc_id FROM documents),
ac AS (SELECT CASE WHEN doc_id % 50 = 3 THEN concat('x/', path) ELSE path END AS path, CASE WHEN doc_id % 50 = 7 THEN sha256('other') ELSE sha256 END AS sha256,
  CASE WHEN doc_id % 50 = 9 THEN size + 1 ELSE size END AS size FROM ds),
fs AS (SELECT coalesce(d.path, a.path) AS key, d.path AS dp, a.path AS ap, d.sha256 AS dsha, a.sha256 AS asha, d.size AS dsz, a.size AS asz FROM ds d FULL JOIN ac a ON d.path = a.path),
fv AS (SELECT 'missing' AS code, key FROM fs WHERE ap IS NULL UNION ALL SELECT 'extra', key FROM fs WHERE dp IS NULL
  UNION ALL SELECT 'sha256_mismatch', key FROM fs WHERE dsha <> asha UNION ALL SELECT 'size_mismatch', key FROM fs WHERE dsz <> asz)"""


def doc_files(spark, d):
    return A.table(spark, d, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"), "doc_id")


def actual_files(spark, d):
    m = F.col("doc_id") % 50
    return doc_files(spark, d).select(
        F.when(m == 3, F.concat(F.lit("x/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(m == 7, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(m == 9, F.col("size") + 1).otherwise(F.col("size")).alias("size"))


@query("jn12_file_sets", sql=f"WITH {DOCS_SQL} SELECT code, key FROM fv")
def jn12_file_sets(spark, d):
    return J.compare_file_sets(doc_files(spark, d), actual_files(spark, d))


@query("in12_freeze", sql=f"WITH {DOCS_SQL} SELECT code, count(*) AS n FROM fv GROUP BY code")
def in12_freeze(spark, d):
    return AU.check_freeze(doc_files(spark, d), actual_files(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("in6_verify_bundle", sql=f"""WITH {DOCS_SQL}
SELECT concat('asset_', code) AS code, key FROM fv UNION ALL SELECT concat('checksum_', code), key FROM fv WHERE code <> 'size_mismatch'
UNION ALL SELECT 'invalid_asset_mode', path FROM ds WHERE doc_id % 40 = 1""")
def in6_verify_bundle(spark, d):
    files = doc_files(spark, d)
    records = files.select(F.col("path").alias("bundle_path"), "sha256", "size", F.lit("runtime.doc").alias("role"), F.lit(True).alias("materialize"),
                           F.when(F.col("doc_id") % 40 == 1, "0777").otherwise("0644").alias("mode"))
    return AU.verify_bundle(records, actual_files(spark, d), files.select("path", "sha256"))


def sided(spark, d):
    side = F.when(F.col("doc_id") % 2 == 0, "public").otherwise("private")
    return doc_files(spark, d).select("path", "sha256", "size", side.alias("distribution"), F.when(side == "public", "runtime.doc").when(
        F.col("doc_id") % 3 == 0, "authoring.notes").otherwise("judge.doc").alias("role"))


OVERLAP_SQL = """
sd AS (SELECT path, sha256, size, CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'private' END AS distribution, CASE WHEN doc_id % 2 = 0 THEN 'runtime.doc' WHEN doc_id % 3 = 0 THEN 'authoring.notes' ELSE 'judge.doc' END AS role FROM ds),
ov AS (SELECT sha256, count(*) FILTER (distribution = 'public') AS n_public, count(*) FILTER (role = 'judge.doc') AS n_private, min(path) FILTER (distribution = 'public') AS first_public,
  min(path) FILTER (role = 'judge.doc') AS first_private FROM sd WHERE size > 0 GROUP BY sha256 HAVING count(*) FILTER (distribution = 'public') > 0 AND count(*) FILTER (role = 'judge.doc') > 0)"""


@query("jn11_hash_overlap", sql=f"WITH {DOCS_SQL}, {OVERLAP_SQL} SELECT * FROM ov")
def jn11_hash_overlap(spark, d):
    return J.hash_overlap(sided(spark, d), AU.SENSITIVE_PREFIXES)


@query("jn11_members", sql=f"WITH {DOCS_SQL}, {OVERLAP_SQL} SELECT sha256, CASE WHEN distribution = 'public' THEN 'public' ELSE 'private' END AS side, path, role FROM sd WHERE size > 0 AND role <> 'authoring.notes' AND sha256 IN (SELECT sha256 FROM ov)")
def jn11_members(spark, d):
    rows = sided(spark, d)
    return J.overlap_members(rows, J.hash_overlap(rows, AU.SENSITIVE_PREFIXES), AU.SENSITIVE_PREFIXES)


@query("jn13_cross_bundle", sql=f"""WITH {DOCS_SQL}, {OVERLAP_SQL},
pu AS (SELECT sha256, any_value(path) AS p FROM sd WHERE distribution = 'public' GROUP BY 1)
SELECT 'cross_bundle_mismatch' AS code, family AS key FROM (SELECT lang AS family, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY lang) WHERE a <> b
UNION ALL SELECT 'cross_bundle_sensitive_hash_overlap', sha256 FROM ov
UNION ALL SELECT 'public_private_source_overlap', concat('s/', k) FROM (SELECT doc_id // 4 AS k, max(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS a, max(doc_id % 2) AS b FROM documents GROUP BY 1) WHERE a = 1 AND b = 1""")
def jn13_cross_bundle(spark, d):
    rows = sided(spark, d).withColumnRenamed("path", "bundle_path").withColumn(
        "source_relpath", F.concat(F.lit("s/"), F.expr("CAST(regexp_extract(bundle_path, '([0-9]+)', 1) AS BIGINT) div 4").cast("string"))).withColumn("materialize", F.lit(True))
    fields = lambda r: A.table(spark, d, "documents").filter(F.col("doc_id") % 2 == r).groupBy(F.col("lang").alias("field")).agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    pub, prv = rows.filter("distribution = 'public'").drop("distribution"), rows.filter("distribution = 'private'").drop("distribution")
    return AU.cross_bundle(pub, prv, fields(0), fields(1))


@query("jn16_resolve_asset", "tasks assets", """
SELECT t.task_id, coalesce(max(CASE WHEN a.path = concat('x/', t.task_id) THEN a.path END), max(CASE WHEN a.asset_id = replace(t.task_id, 'D', 'P') THEN a.asset_id END)) AS resolved_path
FROM tasks t LEFT JOIN assets a ON a.asset_id = replace(t.task_id, 'D', 'P') GROUP BY t.task_id""")
def jn16_resolve_asset(spark, d):
    have = A.assets(spark, d).select(F.col("asset_id").alias("path"))
    return J.resolve_asset(A.tasks(spark, d), "task_id", [F.concat(F.lit("x/"), "task_id"), F.replace("task_id", F.lit("D"), F.lit("P"))], have)


@query("jn17_coverage", "trials", """,
e AS (SELECT condition AS role, count(DISTINCT task_id) AS actual FROM trials WHERE passed = 1 AND model = 'm0' GROUP BY 1), t AS (SELECT count(DISTINCT task_id) AS n FROM trials)
SELECT coalesce(e.role, 'with_gold') AS role, CASE WHEN e.role = 'no_context' OR e.role IS NULL THEN n ELSE actual END AS expected, coalesce(actual, 0) AS actual,
  CASE WHEN e.role = 'no_context' OR e.role IS NULL THEN n ELSE actual END = coalesce(actual, 0) AS ok
FROM (SELECT * FROM e UNION ALL SELECT NULL, NULL) e CROSS JOIN t""")
def jn17_coverage(spark, d):
    log = A.trials(spark, d)
    have = log.filter("passed = 1 AND model = 'm0'").select(F.col("condition").alias("role"), "task_id")
    tasks = log.select("task_id").distinct()
    expected = tasks.agg(F.count(F.lit(1)).alias("expected")).select(F.explode(F.array(F.lit("no_context"), F.lit("with_gold"))).alias("role"), "expected")
    return J.coverage(have, tasks, expected)


@query("jn17_gaps", "trials", """
SELECT r.role, t.task_id FROM (SELECT DISTINCT task_id FROM trials) t CROSS JOIN (VALUES ('no_context'), ('with_skill')) r(role)
WHERE NOT EXISTS (SELECT 1 FROM trials x WHERE x.passed = 1 AND x.model = 'm0' AND x.condition = r.role AND x.task_id = t.task_id)""")
def jn17_gaps(spark, d):
    log = A.trials(spark, d)
    return J.coverage_gaps(log.filter("passed = 1 AND model = 'm0'").select(F.col("condition").alias("role"), "task_id"), log, ["no_context", "with_skill"])


@query("jn18_presence", "assets", """,
dirs AS (SELECT DISTINCT regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS dir FROM assets),
l AS (SELECT asset_id AS task_id, regexp_extract(path, '^([^/]*)/', 1) AS host FROM assets)
SELECT task_id, host AS dir, concat(host, '/fr') AS found_at, 'present' AS code FROM l WHERE concat(host, '/fr') IN (SELECT dir FROM dirs)""")
def jn18_presence(spark, d):
    listed = A.assets(spark, d).select(F.col("asset_id").alias("task_id"), F.regexp_extract("path", "^([^/]*)/", 1).alias("dir"))
    return J.check_presence(listed, A.assets(spark, d), [F.concat("dir", F.lit("/fr")), F.concat(F.lit("scenarios/"), "dir")], must_exist=False)


@query("jn21_sources", "assets", f""", {DOCS_SQL},
g AS (SELECT path, count(*) AS n, min(sha256) AS s, min(size) AS z FROM (SELECT path, sha256, size FROM ac UNION ALL SELECT path, sha256, size FROM ds WHERE doc_id % 50 = 11) GROUP BY path)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "group", ds.path, CASE WHEN g.path IS NULL THEN 'no_candidate' WHEN n > 1 THEN 'ambiguous' WHEN s <> ds.sha256 THEN 'sha256_mismatch'
  WHEN z <> ds.size THEN 'size_mismatch' ELSE 'ok' END AS state FROM ds LEFT JOIN g ON g.path = ds.path""")
def jn21_sources(spark, d):
    files = doc_files(spark, d)
    groups = files.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("group"), "path", "sha256", "size")
    twice = files.filter(F.col("doc_id") % 50 == 11).select("path", "sha256", "size")
    return J.resolve_sources(groups, actual_files(spark, d).unionByName(twice))


@query("jn22_materialize", sql=f"""WITH {DOCS_SQL},
rel AS (SELECT path AS bundle_path, concat('s/', doc_id // 2) AS source_path, sha256 FROM ds),
cl AS (SELECT source_path, min(sha256) <> max(sha256) AS clash FROM rel GROUP BY 1)
SELECT rel.bundle_path, rel.source_path, rel.sha256, CASE WHEN ac.path IS NULL THEN 'missing' WHEN ac.sha256 <> rel.sha256 THEN 'digest_mismatch' WHEN clash THEN 'collision' ELSE 'copy' END AS state
FROM rel LEFT JOIN ac ON ac.path = rel.bundle_path JOIN cl ON cl.source_path = rel.source_path""")
def jn22_materialize(spark, d):
    release = doc_files(spark, d).select(F.col("path").alias("bundle_path"), F.concat(F.lit("s/"), F.expr("doc_id div 2").cast("string")).alias("source_path"), "sha256")
    return J.plan_materialize(release, actual_files(spark, d))


@query("in7_verify_tree", sql=f"""WITH {DOCS_SQL},
atx AS (SELECT ac.path, text FROM ac JOIN documents ON ac.path IN (concat('d/', doc_id, '.txt'), concat('x/d/', doc_id, '.txt')))
SELECT code, key FROM fv UNION ALL SELECT 'forbidden_component', path FROM ac WHERE path LIKE 'x/%' UNION ALL SELECT 'forbidden_basename', path FROM ac WHERE path = 'd/5.txt'
UNION ALL SELECT 'forbidden_content', concat(path, ' [0-9]{{{{6}}}}') FROM atx WHERE regexp_matches(text, '[0-9]{{6}}')""".replace("{{{{6}}}}", "{6}").replace("{{6}}", "{6}"))
def in7_verify_tree(spark, d):
    content = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    m = F.col("doc_id") % 50
    full = doc_files(spark, d).join(content, "doc_id").select(
        F.when(m == 3, F.concat(F.lit("x/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(m == 7, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(m == 9, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "content")
    return AU.verify_tree(doc_files(spark, d), full, ["X"], ["5.TXT"], ["[0-9]{6}"])


@query("in11_manifest", "assets", f""", {INVENTORY_SQL}
SELECT task_id, family, 'public_bundle' AS source, concat('scenarios/', task_id) AS rel_dir FROM cl WHERE role = 'runtime.page'""")
def in11_manifest(spark, d):
    return AU.manifest_from_release(classified(spark, d), "runtime.page").drop("execution_mode")


@query("fn1_digests", "assets", "SELECT asset_id, sha256, sha1(content) AS sha1 FROM assets")
def fn1_digests(spark, d):
    return A.assets(spark, d).select("asset_id", H.content_sha256(F.col("content")).alias("sha256"), H.content_sha1(F.col("content")).alias("sha1"))


@query("fn3_content_id", sql="""SELECT event_id, concat('sha256:', sha256(concat('{"k":', json_extract_string(props, '$.k'), ',"v":"', event_type, '"}'))) AS content_id FROM events""")
def fn3_content_id(spark, d):
    doc = F.concat(F.lit('{ "v": "'), "event_type", F.lit('", "k" : '), F.get_json_object("props", "$.k"), F.lit(" }"))
    return A.table(spark, d, "events").select("event_id", H.content_id(doc, exact=True).alias("content_id"))


@query("fn4_set_digest", "tasks", tree_sql("tasks", "source", "concat(task_id, chr(0), sha256(text), chr(10))", "1"))
def fn4_set_digest(spark, d):
    return DG.set_digest(A.tasks(spark, d).withColumn("sha", F.sha2("text", 256)), ["source"], "task_id", "sha")


@query("fn5_release_root", "tasks", """,
ln AS (SELECT family, concat('{"n_chars":', n_chars, ',"source":"', source, '","task_id":"', task_id, '"}', chr(10)) AS line FROM tasks)""" + tree_sql("ln", "family", "line"))
def fn5_release_root(spark, d):
    return DG.release_root(A.tasks(spark, d), ["family"], ["task_id", "source", "n_chars"])


@query("fn6_ordered_ids", "tasks", tree_sql("tasks", "family", "concat(seq, chr(9), task_id, chr(10))"))
def fn6_ordered_ids(spark, d):
    return DG.ordered_ids_digest(A.tasks(spark, d), ["family"], "task_id", "seq")


@query("fn6_release_id", "assets", "SELECT asset_id, substr(sha256(concat_ws(chr(0), 'release-content', sha256, sha256(path), sha256(asset_id), sha256, sha256(path))), 1, 24) AS release_id FROM assets")
def fn6_release_id(spark, d):
    p, i = F.sha2("path", 256), F.sha2("asset_id", 256)
    return A.assets(spark, d).select("asset_id", DG.release_id("release-content", F.col("sha256"), p, i, F.col("sha256"), p).alias("release_id"))


@query("fn7_tree_digest", "tasks", tree_sql("tasks", "source", "concat(sha256(text), '  ', task_id, chr(10))"))
def fn7_tree_digest(spark, d):
    return DG.tree_digest(A.tasks(spark, d).withColumn("sha", F.sha2("text", 256)), ["source"], "task_id", "sha")


@query("snk3_checksum_lines", "assets", "SELECT path, concat(sha256, '  ', path) AS value FROM assets")
def snk3_checksum_lines(spark, d):
    return SK.checksum_lines(A.assets(spark, d))


@query("snk2_jsonl_lines", "tasks", """SELECT concat('{"n_chars":', n_chars, ',"source":"', source, '","task_id":"', task_id, '"}') AS value FROM tasks""")
def snk2_jsonl_lines(spark, d):
    return SK.jsonl_lines(A.tasks(spark, d).select("task_id", "source", "n_chars"))


@query("snk4_report_lines", "trials latest", f""", {METRICS_SQL},
g AS (SELECT model, condition, concat(format('{{:.1f}}', CAST(format('{{:.4f}}', sum(passed) / count(*)) AS DOUBLE) * 100), '% (', sum(passed), '/', count(*), ')') AS cell FROM metrics GROUP BY ALL)
SELECT model, concat('| ', model, ' | ', coalesce(max(cell) FILTER (condition = 'no_context'), ''), ' | ', coalesce(max(cell) FILTER (condition = 'with_skill'), ''), ' |') AS line FROM g GROUP BY model""")
def snk4_report_lines(spark, d):
    from evalmart.functions.numeric import display_percent

    g = metric_rows(spark, d).groupBy("model", "condition").agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("p"))
    g = g.withColumn("cell", F.concat(display_percent(F.col("p"), F.col("n")), F.lit("% ("), F.col("p").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")")))
    return SK.report_lines(g, "model", "condition", F.col("cell"), ["no_context", "with_skill"])


@query("se4_unscanned", "assets", "SELECT DISTINCT path FROM assets WHERE path NOT IN (SELECT path FROM assets WHERE size % 2 = 0)")
def se4_unscanned(spark, d):
    files = A.assets(spark, d)
    return J.unscanned_paths(files, files.filter("size % 2 = 0"))


@query("prj13_safe_path", sql="SELECT page_id, false AS raw_safe, true AS path_safe, page_id % 2 = 0 AS crafted_safe FROM pages")
def prj13_safe_path(spark, d):
    crafted = F.concat(F.lit("a\\"), F.when(F.col("page_id") % 2 == 0, "b").otherwise(".."), F.lit("/c"))
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return A.table(spark, d, "pages").select(
        "page_id", is_safe_relpath(F.concat(F.lit("/"), path)).alias("raw_safe"), is_safe_relpath(path).alias("path_safe"), is_safe_relpath(crafted).alias("crafted_safe"))


@query("prj14_path_policy", "assets", """
SELECT path, CASE WHEN contains(path, '/fr/') THEN 'forbidden_component' WHEN path LIKE '%/25' THEN 'forbidden_basename' END AS code FROM assets""")
def prj14_path_policy(spark, d):
    return A.assets(spark, d).select("path", R.path_policy(F.col("path"), ["FR"], ["25"]).alias("code"))


@query("prj16_strip_field", sql="""SELECT event_id, concat('{"k":', json_extract_string(props, '$.k'), '}') AS stripped FROM events""")
def prj16_strip_field(spark, d):
    doc = F.concat(F.lit('{"evolve": {"a": [1, 2]}, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return A.table(spark, d, "events").select("event_id", R.strip_field(doc, "evolve").alias("stripped"))


@query("prj18_context_assets", sql="""
SELECT p_partkey, p_size % 5 IN (0, 3, 4) AS context, p_size % 5 IN (3, 4) AS docs FROM part""")
def prj18_context_assets(spark, d):
    m = F.col("p_size") % 5
    path = F.when(m == 0, F.concat(F.lit("package/"), "p_brand", F.lit(".py"))).when(m == 1, F.concat(F.lit("data/_gold/"), "p_brand")).when(
        m == 2, "data/test_script.py").when(m == 3, "skill/SKILL.md").otherwise(F.concat(F.lit("other/ReadMe_"), "p_brand", F.lit(".md")))
    return A.table(spark, d, "part").select("p_partkey", R.is_context_asset(path).alias("context"), R.is_context_asset(path, True).alias("docs"))
