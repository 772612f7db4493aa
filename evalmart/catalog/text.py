"""Leakage, redaction, grading, JSON documents and document gates over the text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evalmart import adapters as A
from evalmart.catalog import query
from evalmart.functions import gates as GA, grading as GR, jsondoc as JD, literals as LI, numeric as N, redact as R, text as TX
from evalmart.operators import leaks as LK
from evalmart.session import dealt

LINES = r"regexp_split_to_array({0}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def lines_sql(col):
    split = LINES.format(col)
    return f"(CASE WHEN ({split})[-1] = '' THEN ({split})[1:-2] ELSE {split} END)"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TRIVIAL = "regexp_matches({0}, '^-?0*[0-9]$')"
NUMBERS = "list_filter(regexp_extract_all({0}, '-?[0-9]+(?:\\.[0-9]+)?'), lambda n: NOT regexp_matches(n, '^-?0*[0-9]$'))"
STRUCTURED = (
    "(CASE WHEN regexp_matches({0}, '^-?[0-9]+(?:\\.[0-9]+)?$') THEN NOT regexp_matches({0}, '^-?0*[0-9]$') "
    "ELSE starts_with({0}, '--') OR regexp_matches({0}, '[0-9_./\\\\]') OR regexp_matches({0}, '^[A-Z][A-Z0-9_-]{{2,}}$') END)"
)
FLAGS = "regexp_extract_all(lower({0}), '--[a-z][a-z0-9_-]*[a-z0-9]')"
PLAIN = (
    "list_distinct(list_concat(list_concat(" + NUMBERS + ", list_filter(list_transform(regexp_extract_all({0}, '[''\"]([^''\"]{{2,80}})[''\"]', 1), "
    "lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), lambda q: length(regexp_replace(q, '[^A-Za-z0-9]', '', 'g')) >= 3)), " + FLAGS + "))"
)


def skill_sql(col):
    low = f"list_transform(regexp_extract_all({col}, '[''\"]([^''\"]{{2,64}})[''\"]', 1), lambda q: lower(regexp_replace(q, '^\\s+|\\s+$', '', 'g')))"
    kept = f"list_filter({low}, lambda q: length(regexp_replace(q, '[^a-z0-9]', '', 'g')) >= 3 AND {STRUCTURED.format('q')})"
    return f"list_distinct(list_concat(list_concat({NUMBERS.format(col)}, {kept}), {FLAGS.format(col)}))"


@query("tx1_literals_plain", sql=f"SELECT page_id, unnest({PLAIN.format('html')}) AS token FROM pages")
def tx1_literals_plain(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.explode(LI.hard_literals(F.col("html"), "plain")).alias("token"))


@query("tx1_literals_skill", sql=f"SELECT doc_id, unnest({skill_sql('text')}) AS token FROM documents")
def tx1_literals_skill(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.explode(LI.hard_literals(F.col("text"), "skill")).alias("token"))


STOP = "(" + ", ".join(f"'{w}'" for w in LI.STOPWORDS) + ")"
EDGE = "^[`''\".,:;()\\[\\]{}<>]+|[`''\".,:;()\\[\\]{}<>]+$"


def hard_sql(col):
    return f"list_filter({skill_sql(col)}, lambda t: t NOT IN {STOP} OR regexp_matches(t, '^-?[0-9]'))"


def public_sql(col):
    form = f"lower(regexp_replace(t, '{EDGE}', '', 'g'))"
    ok = f"(length(regexp_replace(t, '[^a-z0-9]', '', 'g')) >= 2 AND t NOT IN {STOP} AND {STRUCTURED.format('t')})"
    runs = f"list_filter(regexp_extract_all({col}, '[A-Za-z0-9_./\\\\-]+'), lambda t: regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9_./\\\\-]{{1,80}}$'))"
    bare = f"list_filter(list_transform({runs}, lambda t: {form}), lambda t: {ok})"
    num = "regexp_matches(t, '^-?[0-9]+(?:\\.[0-9]+)?$')"
    stems = (f"list_filter(list_transform(list_filter({bare}, lambda t: contains(t, '.') AND NOT {num}), "
             f"lambda t: regexp_replace(regexp_extract(t, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')), lambda t: {ok})")
    percent = f"(CASE WHEN regexp_matches({col}, '(?i)%|\\bpercent(?:age)?\\b') THEN ['100'] ELSE [] END)"
    seen = f"list_concat(list_concat(list_concat({hard_sql(col)}, {percent}), {bare}), {stems})"
    clean = "regexp_replace(t, '^[./]+', '')"
    base = f"regexp_extract(CASE WHEN {clean} = '' THEN t ELSE {clean} END, '([^/\\\\]*)$', 1)"
    stem = f"CASE WHEN contains({base}, '.') AND NOT regexp_matches({base}, '^-?[0-9]+(?:\\.[0-9]+)?$') THEN regexp_replace({base}, '\\.[^.]*$', '') END"
    more = f"list_filter(list_transform(flatten(list_transform({seen}, lambda t: [{clean}, {base}, {stem}])), lambda t: {form}), lambda t: coalesce({ok}, false))"
    return f"list_distinct(list_concat({seen}, {more}))"


@query("tx2_public_tokens", sql=f"SELECT doc_id, unnest({public_sql('text')}) AS token FROM documents")
def tx2_public_tokens(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.explode(LI.public_tokens(F.col("text"))).alias("token"))


# Public text of a task: its odd lines. Hidden text: its even lines. Audited text: the whole document.
HALVES_SQL = f"""
halves AS (SELECT concat('D', CAST(doc_id AS VARCHAR)) AS task_id, text,
  array_to_string(list_filter({lines_sql('text')}, lambda l, i: i % 2 = 1), chr(10)) AS public,
  array_to_string(list_filter({lines_sql('text')}, lambda l, i: i % 2 = 0), chr(10)) AS hidden FROM documents),
pv AS (SELECT task_id, token FROM (SELECT task_id, unnest({hard_sql('hidden')}) AS token, {public_sql('public')} AS pub FROM halves) WHERE NOT list_contains(pub, token))"""


def halves(spark, d):
    lines = TX.lines_of(F.col("text"))
    pick = lambda r: F.array_join(F.filter(lines, lambda line, i: i % 2 == r), "\n")
    return A.tasks(spark, d).select("task_id", "text", pick(0).alias("public"), pick(1).alias("hidden"))


def vocab(spark, d):
    return halves(spark, d).select("task_id", LI.private_vocab(F.col("hidden"), F.col("public")).alias("tokens"))


@query("tx3_private_vocab", sql=f"WITH {HALVES_SQL} SELECT task_id, token FROM pv")
def tx3_private_vocab(spark, d):
    h = halves(spark, d)
    roles = F.array(F.struct(F.lit("task").alias("role"), F.col("public").alias("text")), F.struct(F.lit("oracle").alias("role"), F.col("hidden").alias("text")))
    long = h.select("task_id", F.explode(roles).alias("r")).select("task_id", "r.role", "r.text")
    return LK.build_private_vocab(long).select("task_id", F.explode("tokens").alias("token"))


@query("se3_private_tokens", sql=f"WITH {HALVES_SQL} SELECT task_id, token FROM pv")
def se3_private_tokens(spark, d):
    h = halves(spark, d)
    return LK.private_tokens(h.select("task_id", F.col("hidden").alias("text")), h.select("task_id", F.col("public").alias("text")))


def bound_sql(text, token, cls):
    return f"regexp_matches({text}, concat('(^|[^{cls}])', regexp_escape({token}), '($|[^{cls}])'))"


for _name, _cls in (("word", "A-Za-z0-9_."), ("decimal", "0-9."), ("digit", "0-9")):
    @query(f"tx4_leaks_{_name}", sql=f"""WITH {HALVES_SQL}
SELECT h.task_id, 'text' AS loc, token FROM halves h JOIN pv ON pv.task_id = h.task_id
WHERE length(regexp_replace(token, '[^A-Za-z0-9]', '', 'g')) >= 2 AND CASE WHEN regexp_matches(token, '[A-Za-z]')
  THEN {bound_sql('lower(text)', 'token', 'A-Za-z0-9_')} ELSE {bound_sql('text', 'token', _cls)} END""")
    def _tx4(spark, d, boundary=_name):
        texts = halves(spark, d).select("task_id", F.lit("text").alias("loc"), "text")
        return LK.find_literal_leaks(texts, vocab(spark, d), boundary)


@query("jn20_corpus_leaks", sql=f"""
WITH ph AS (SELECT item_id, lower({STRIP.format('unnest(string_split(text, chr(10)))')}) AS phrase FROM benchmark),
ok AS (SELECT DISTINCT item_id, phrase FROM ph WHERE length(regexp_replace(phrase, '[^A-Za-z0-9]', '', 'g')) >= 2)
SELECT doc_id, count(DISTINCT item_id || phrase) AS n_phrases FROM documents JOIN ok ON contains(lower(text), phrase)
WHERE {bound_sql('lower(text)', 'phrase', 'A-Za-z0-9_')} GROUP BY doc_id""")
def jn20_corpus_leaks(spark, d):
    items = A.table(spark, d, "benchmark")
    phrases = items.select("item_id", F.posexplode(F.split("text", "\n")).alias("at", "phrase"))
    phrases = phrases.select(F.sha2(F.concat_ws("|", F.col("item_id").cast("string"), F.lower(TX.strip(F.col("phrase")))), 256).alias("phrase_id"), "phrase").distinct()
    hits = LK.find_corpus_leaks(A.table(spark, d, "documents"), phrases.dropDuplicates(["phrase_id"]), "doc_id", "phrase_id")
    return hits.groupBy("doc_id").agg(F.count_distinct("phrase_id").alias("n_phrases"))


def option_tasks(spark, d):
    return A.table(spark, d, "part").select(
        F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("task_id"), F.regexp_replace("p_type", "E", "_E").alias("text"),
        F.concat(F.lit("Pick. ANSWER: <one of: "), F.replace("p_type", F.lit(" "), F.lit(" | ")), F.lit(">\nWhich of the following fits: `"),
                 F.col("p_brand"), F.lit("`?")).alias("task_text"), F.lit("summary").alias("loc"))


OPTIONS_SQL = """
opt AS (SELECT concat('R', CAST(p_partkey AS VARCHAR)) AS task_id, unnest(list_distinct(list_append(string_split(lower(p_type), ' '), lower(p_brand)))) AS token,
  lower(replace(p_type, 'E', '_E')) AS low FROM part)"""


@query("tx5_options", sql=f"WITH {OPTIONS_SQL} SELECT task_id, token FROM opt")
def tx5_options(spark, d):
    return LK.options_of(option_tasks(spark, d)).select("task_id", F.explode("options").alias("token"))


@query("tx5_option_leaks", sql=f"WITH {OPTIONS_SQL} SELECT task_id, 'summary' AS loc, token FROM opt WHERE {bound_sql('low', 'token', 'A-Za-z0-9_')}")
def tx5_option_leaks(spark, d):
    tasks = option_tasks(spark, d)
    return LK.find_option_leaks(tasks.select("task_id", "loc", "text"), LK.options_of(tasks))


TOKENS_SQL = """
src AS (SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS task_id, lower(concat(replace(p_name, ' ', '_'), ' --', replace(p_brand, '#', '-'), ' ', p_type, '.csv task.md max_files')) AS t,
  lower(replace(p_name, ' ', '_')) AS text FROM part),
tok AS (SELECT task_id, text, unnest(list_distinct(list_concat(list_concat(list_filter(regexp_extract_all(t, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b'), lambda x: x <> 'max_files'),
  regexp_extract_all(t, '--[a-z][a-z0-9_-]*[a-z0-9]')), list_filter(regexp_extract_all(t, '\\b([a-z][a-z0-9_-]*\\.(?:csv|md))\\b', 1), lambda x: x <> 'task.md')))) AS token FROM src)"""


def token_tasks(spark, d):
    return A.table(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("task_id"), F.lit("summary").alias("loc"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("text"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" --"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(" "),
                 F.col("p_type"), F.lit(".csv task.md max_files")).alias("task_text"))


@query("tx6_task_tokens", sql=f"WITH {TOKENS_SQL} SELECT task_id, token FROM tok")
def tx6_task_tokens(spark, d):
    return token_tasks(spark, d).select("task_id", F.explode(LI.task_tokens(F.col("task_text"))).alias("token"))


@query("tx6_token_leaks", sql=f"WITH {TOKENS_SQL} SELECT task_id, 'summary' AS loc, token FROM tok WHERE contains(text, token)")
def tx6_token_leaks(spark, d):
    rows = token_tasks(spark, d)
    return LK.find_token_leaks(rows.select("task_id", "loc", "text"), rows.select("task_id", "task_text"))


def audits(spark, d):
    t = A.tasks(spark, d)
    audit = LI.answer_audit(
        F.col("execution_mode"), F.when(F.col("family") == "en", "rule_following").otherwise("other"),
        F.array(F.get(F.split("text", " "), F.lit(0)), F.col("n_chars").cast("string")), F.array("source"), F.col("text"), F.lit(""))
    return t.select("task_id", audit.alias("a")).select("task_id", "a.*")


AUDIT_SQL = f"""
au AS (SELECT task_id, text, lower(text) AS low, regexp_replace(lower(text), '\\s+', '', 'g') AS compact, unnest(list_concat(list_concat(
  [{{'kind': 'expected_answer', 'token': regexp_replace(lower({STRIP.format("string_split(text, ' ')[1]")}), '\\s+', '', 'g')}}, {{'kind': 'expected_answer', 'token': CAST(n_chars AS VARCHAR)}},
   {{'kind': 'enum_token', 'token': source}}],
  list_transform(list_filter([lower({STRIP.format("string_split(text, ' ')[1]")})], lambda e: regexp_matches(e, '^[a-z][a-z0-9_]{{2,}}$')), lambda e: {{'kind': 'enum_token', 'token': e}})),
  list_transform(list_distinct(list_concat(list_concat([CAST(n_chars AS VARCHAR)], regexp_extract_all(string_split(text, ' ')[1], '-?[0-9]+(?:\\.[0-9]+)?')),
    CASE WHEN family = 'en' THEN flatten(list_transform(list_filter({lines_sql('text')}, lambda l: regexp_matches(lower(l), 'threshold|cutoff|baseline|window|hours|hour|days|day|stipend|rating|tier|band|rule')),
      lambda l: regexp_extract_all(l, '-?[0-9]+(?:\\.[0-9]+)?'))) ELSE [] END)), lambda n: {{'kind': 'numeric_token', 'token': n}}))) AS k
  FROM tasks WHERE execution_mode = 'text_short_answer'),
aud AS (SELECT DISTINCT task_id, text, low, compact, k.kind AS kind, k.token AS token FROM au WHERE k.token <> '')"""


@query("tx7_answer_audit", "tasks", f", {AUDIT_SQL} SELECT task_id, kind, token FROM aud")
def tx7_answer_audit(spark, d):
    name = lambda c, k: F.transform(c, lambda t: F.struct(F.lit(k).alias("kind"), t.alias("token")))
    return audits(spark, d).select("task_id", F.explode(F.concat(
        name("expected_texts", "expected_answer"), name("enum_tokens", "enum_token"), name("numeric_tokens", "numeric_token"))).alias("k")
    ).select("task_id", "k.kind", "k.token")


@query("tx7_answer_leaks", "tasks", f""", {AUDIT_SQL} SELECT task_id, 'text' AS loc, token, kind FROM aud WHERE CASE kind WHEN 'expected_answer' THEN contains(compact, token)
  WHEN 'enum_token' THEN {bound_sql('low', 'token', 'A-Za-z0-9_')} ELSE {bound_sql('text', 'token', '0-9')} END""")
def tx7_answer_leaks(spark, d):
    texts = A.tasks(spark, d).select("task_id", F.lit("text").alias("loc"), "text")
    return LK.find_answer_leaks(texts, audits(spark, d))


@query("tx8_gold_literals", sql=rf"""
WITH src AS (SELECT concat('D', CAST(doc_id AS VARCHAR)) AS id, {STRIP.format('text')} AS t, source AS pub FROM documents),
cells AS (SELECT id, pub, unnest(CASE WHEN contains({lines_sql('t')}[1], ',') AND len({lines_sql('t')}) > 1
  THEN flatten(list_transform(list_filter({lines_sql('t')}[2:], lambda l: l <> ''), lambda l: list_transform(regexp_extract_all(l, '(?:^|,)("(?:[^"]|"")*"|[^,]*)', 1),
    lambda c: CASE WHEN starts_with(c, '"') THEN replace(regexp_replace(c, '^"|"$', '', 'g'), '""', '"') ELSE c END))) ELSE {lines_sql('t')} END) AS c FROM src WHERE t <> ''
  UNION ALL SELECT concat('E', CAST(event_id AS VARCHAR)), event_type, unnest([event_type, 'k' || json_extract_string(props, '$.k'), 'True', 'deep' || json_extract_string(props, '$.k')]) FROM events),
lit AS (SELECT DISTINCT id, pub, {STRIP.format('c')} AS literal FROM cells)
SELECT id, literal FROM lit WHERE length(literal) BETWEEN 1 AND 500 AND length(regexp_replace(literal, '[^A-Za-z0-9]', '', 'g')) >= 2
  AND NOT regexp_matches(literal, '^-?[0-9]+(?:\.[0-9]+)?$') AND NOT contains(lower(pub), lower(literal))""")
def tx8_gold_literals(spark, d):
    docs = A.table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("source").alias("pub"))
    k = F.get_json_object("props", "$.k")
    deep = reduce(lambda inner, _: F.struct(F.array(inner).alias("in")), range(6), F.concat(F.lit("deep"), k))  # 12 levels down
    json = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.array(F.concat(F.lit("k"), k)).alias("list")).alias("inner"), k.cast("int").alias("number"), F.lit(True).alias("flag"), deep.alias("deep")))
    events = A.table(spark, d, "events").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), json.alias("text"), F.col("event_type").alias("pub"))
    return LK.gold_literals(docs.unionByName(events), "id", "text", "pub")


@query("tx9_redact_literals", sql=f"""WITH {HALVES_SQL},
v AS (SELECT task_id, list(token ORDER BY length(token) DESC, token) AS toks FROM pv GROUP BY 1)
SELECT h.task_id, md5(list_reduce(list_prepend(text, coalesce(toks, [])), lambda t, k: CASE WHEN regexp_matches(k, '[A-Za-z]')
  THEN regexp_replace(regexp_replace(t, concat('(?i)(^|[^A-Za-z0-9_])', regexp_escape(k), '($|[^A-Za-z0-9_])'), concat('\\1', {{repl}}, '\\2'), 'g'), concat('(?i)(^|[^A-Za-z0-9_])', regexp_escape(k), '($|[^A-Za-z0-9_])'), concat('\\1', {{repl}}, '\\2'), 'g')
  ELSE regexp_replace(regexp_replace(t, concat('(^|[^A-Za-z0-9_.])', regexp_escape(k), '($|[^A-Za-z0-9_.])'), concat('\\1', {{repl}}, '\\2'), 'g'), concat('(^|[^A-Za-z0-9_.])', regexp_escape(k), '($|[^A-Za-z0-9_.])'), concat('\\1', {{repl}}, '\\2'), 'g') END)) AS redacted
FROM halves h LEFT JOIN v ON v.task_id = h.task_id""".replace("{repl}", """CASE WHEN regexp_matches(k, '^-?[0-9]+(?:\\.[0-9]+)?$') THEN 'the task-specific numeric value'
  WHEN regexp_matches(k, '[/\\\\.]') THEN 'the task-specified file or path' WHEN contains(k, '_') THEN 'the task-specific field' ELSE 'the task-specific term' END"""))
def tx9_redact_literals(spark, d):
    rows = halves(spark, d).join(vocab(spark, d), "task_id")
    return rows.select("task_id", F.md5(R.redact_literals(F.col("text"), F.col("tokens"))).alias("redacted"))


@query("tx10_sanitize_skill", sql=f"""
WITH s AS (SELECT doc_id, concat('# Decision procedure and output', chr(10), text, chr(10), '- **Action**: keep', chr(10), '## Notes', chr(10), text) AS t,
  {lines_sql('text')} AS ls FROM documents)
SELECT doc_id, md5(regexp_replace(array_to_string(list_concat(list_concat(list_concat(['# Decision procedure and output'],
  list_transform(ls, lambda l: CASE WHEN regexp_matches(l, '^#{{1,6}}\\s') THEN rtrim(l) WHEN regexp_matches(lower(l), 'emit |output |return ') THEN '[SANITIZED: final-output mapping removed]' ELSE regexp_replace(l, '\\s+$', '') END)),
  ['  - **Action**: [SANITIZED: concrete action mapping removed; infer from public task only]', '## Notes']), list_transform(ls, lambda l: regexp_replace(l, '\\s+$', ''))), chr(10)), '^\\s+|\\s+$', '', 'g')) AS clean FROM s""")
def tx10_sanitize_skill(spark, d):
    docs = A.table(spark, d, "documents")
    skill = F.concat(F.lit("# Decision procedure and output\n"), "text", F.lit("\n- **Action**: keep\n## Notes\n"), "text")
    none = F.array().cast("array<string>")
    return docs.select("doc_id", F.md5(R.sanitize_skill(skill, none, none)).alias("clean"))


@query("tx11_sanitize_teacher", sql=r"""
WITH s AS (SELECT c_custkey, concat('The hidden oracle uses GOLD_DATA; gold and a private checker, expected = ''', c_name, ''', got: ', c_mktsegment, chr(10), 'ANSWER: ', c_custkey) AS t FROM customer)
SELECT c_custkey, concat('The non-obvious task-author uses TARGET_DATA; target and a internal evaluation tool, expected = <redacted>, got: <candidate_output>', chr(10), 'ANSWER: <redacted>') AS clean FROM s""")
def tx11_sanitize_teacher(spark, d):
    text = F.concat(F.lit("The hidden oracle uses GOLD_DATA; gold and a private checker, expected = '"), "c_name", F.lit("', got: "), "c_mktsegment",
                    F.lit("\nANSWER: "), F.col("c_custkey").cast("string"))
    none = F.array().cast("array<string>")
    return A.table(spark, d, "customer").select("c_custkey", R.sanitize_teacher(text, none, none).alias("clean"))


@query("tx12_sanitize_attempt", sql=rf"""
WITH s AS (SELECT doc_id, {STRIP.format(f"array_to_string(list_filter({lines_sql('text')}, lambda l: NOT regexp_matches({STRIP.format('l')}, '(?i)^[[:space:]]*(ANSWER|ANALYSIS)[[:space:]]*:')), chr(10))")} AS t FROM documents)
SELECT doc_id, md5(CASE WHEN t = '' THEN '(text response redacted: ANSWER/ANALYSIS removed)' ELSE regexp_replace(t, '-?[0-9]+(?:\.[0-9]+)?', '<num>', 'g') END) AS clean FROM s""")
def tx12_sanitize_attempt(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(R.sanitize_attempt(F.col("text"))).alias("clean"))


@query("tx13_verdict_tail", sql=rf"""
WITH s AS (SELECT page_id, replace(replace(html, '>', concat('>', chr(10))), 'nav', 'PASS:') AS t FROM pages),
k AS (SELECT page_id, list_filter(list_transform(list_filter({lines_sql('t')}, lambda l: NOT regexp_matches(l, '(?i)(PASS:|FAIL:|SCORE:|expected\s*=)') AND NOT contains(lower(l), 'short test summary info')),
  lambda l: {STRIP.format("regexp_replace(l, '/[A-Za-z0-9_.~/-]+(?:/[A-Za-z0-9_.~-]+)+', '<path>', 'g')")}), lambda l: l <> '') AS ls FROM s)
SELECT page_id, md5(array_to_string(ls[-24:], chr(10))) AS tail FROM k""")
def tx13_verdict_tail(spark, d):
    text = F.replace(F.replace("html", F.lit(">"), F.lit(">\n")), F.lit("nav"), F.lit("PASS:"))
    return A.table(spark, d, "pages").select("page_id", F.md5(R.sanitize_verdict_tail(text)).alias("tail"))


@query("tx14_redact_secrets", sql=r"""
SELECT c_custkey, concat('see https://', lower(c_mktsegment), '.example.com:8080/a/', c_custkey, '. Bearer <redacted> db_password=<redacted> api-key: <redacted>, <redacted> done ', c_name) AS clean FROM customer""")
def tx14_redact_secrets(spark, d):
    text = F.concat(F.lit("see HTTPS://user:pw@"), F.col("c_mktsegment"), F.lit(".Example.com:8080/a/"), F.col("c_custkey").cast("string"), F.lit("?k=1#f. Bearer "),
                    F.md5("c_name"), F.lit(" db_password='"), F.col("c_name"), F.lit("' api-key: "), F.md5("c_name"), F.lit(", sk-"), F.md5("c_name"), F.lit(" done "), F.col("c_name"))
    rows = dealt(A.table(spark, d, "customer").select("c_custkey", text.alias("text")))
    return rows.select("c_custkey", R.redact_secrets(F.col("text")).alias("clean"))


@query("tx14_redact_urls", sql="""
SELECT page_id, CASE WHEN regexp_matches(path, '(?i)(?:key|token|secret|password|credential)') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/<redacted>'
  ELSE regexp_replace(url, '[?#].*$', '') END AS clean FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def tx14_redact_urls(spark, d):
    return A.table(spark, d, "pages").select("page_id", R.safe_url(F.col("url")).alias("clean"))


@query("tx15_scan_content", "assets", r"""
SELECT path, 'forbidden_asset' AS code, CASE WHEN regexp_matches(path, '(?s)^.*/fr/.*$') THEN '*/fr/*' ELSE '*/d?/[0-9]*' END AS pattern FROM assets
  WHERE regexp_matches(path, '(?s)^.*/fr/.*$') OR regexp_matches(path, '(?s)^.*/d./[0-9].*$')
UNION ALL SELECT path, 'forbidden_content', r FROM assets, (VALUES ('track\([0-9]+\)'), ('</pre>'), ('[0-9]{3}-[0-9]{4}')) v(r) WHERE regexp_matches(content, r)""")
def tx15_scan_content(spark, d):
    return LK.scan_content(A.assets(spark, d), ["*/fr/*", "*/d?/[0-9]*"], [r"track\([0-9]+\)", "</pre>", "[0-9]{3}-[0-9]{4}"])


@query("tx16_forbidden_terms", sql="""
SELECT p_partkey, array_to_string(list_filter(['hidden', 'oracle', 'private', 'keyword_only'], lambda n: n IN (CASE WHEN contains(p_type, 'TIN') THEN 'hidden' END,
  CASE WHEN contains(p_type, 'STEEL') AND p_size < 20 THEN 'oracle' END, CASE WHEN contains(p_type, 'BRASS') THEN 'private' END, CASE WHEN contains(p_type, 'COPPER') THEN 'keyword_only' END)), ',') AS terms FROM part""")
def tx16_forbidden_terms(spark, d):
    text = F.col("p_type")
    for old, new in (("TIN", "a Hidden rule"), ("STEEL", "the oracle"), ("BRASS", "PRIVATE"), ("COPPER", "keyword-only")):
        text = F.replace(text, F.lit(old), F.lit(new))
    public = F.when(F.col("p_size") >= 20, "an Oracle database").otherwise("")
    return A.table(spark, d, "part").select("p_partkey", F.array_join(GA.forbidden_terms(text, public, strict=True), ",").alias("terms"))


WORDS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'))"


@query("tx17_document_gates", sql=f"""
SELECT doc_id, CASE WHEN len(list_filter({lines_sql('text')}, lambda l: regexp_matches(l, '\\S'))) < 22 THEN 'missing_sections,missing_cli_line,missing_flags,too_short' ELSE 'missing_sections,missing_cli_line,missing_flags' END AS task_codes,
  CASE WHEN {WORDS_SQL} < 80 THEN 'missing_sections,too_short' ELSE 'missing_sections' END AS skill_codes,
  CASE WHEN {WORDS_SQL} < 60 THEN 'too_short,missing_headings' ELSE 'missing_headings' END AS agent_codes,
  CASE WHEN {WORDS_SQL} < 40 THEN 'too_short,missing_headings' ELSE 'missing_headings' END AS rewrite_codes FROM documents""")
def tx17_document_gates(spark, d):
    text = F.col("text")
    return A.table(spark, d, "documents").select("doc_id", *[
        F.array_join(GA.document_gates(text, p), ",").alias(f"{p}_codes") for p in ("task", "skill", "agent", "rewrite")])


def designs(spark, d):
    """Design documents from parts: chains of p_size % 5 + 1 steps, sequential or parallel."""
    n = (F.col("p_size") % 5 + 1).cast("int")
    step = lambda i: F.struct(
        F.concat(F.lit("step_"), i.cast("string")).alias("step_id"),
        F.when((F.col("p_partkey") % 2 == 0) & (i > 1), F.array(F.concat(F.lit("step_"), (i - 1).cast("string")))).otherwise(
            F.array().cast("array<string>")).alias("depends_on"))
    chain = F.transform(F.sequence(F.lit(1), n), step)
    words = F.split("p_type", " ")
    hidden = F.array(F.struct(F.col("p_type").alias("detail_for_oracle"), F.when(F.col("p_size") > 45, "").otherwise("why").alias("recoverability_reason"),
                              F.lit("x = y").alias("operation_name_for_task")))
    d_ = F.struct(
        chain.alias("rule_chain"), chain.alias("derivation_chain"), hidden.alias("hidden_conventions"),
        F.lit("integer").alias("answer_format"), F.create_map(F.lit("a"), F.col("p_size").cast("string")).alias("input_constants"),
        F.array().cast("array<string>").alias("deliverables"),
        F.lit(None).cast("struct<invocation:string,output_files:array<string>>").alias("io_contract"),
        F.get(words, F.lit(0)).alias("expected_answer"), F.array("p_brand", F.get(words, F.lit(0))).alias("answer_space"),
        F.get(words, F.lit(1)).alias("predicted_no_context_answer"))
    family = F.when(F.col("p_partkey") % 3 == 0, "rule_following").when(F.col("p_partkey") % 3 == 1, "math_reasoning").otherwise("agent_env_synth")
    return A.table(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_size", d_.alias("d"), family.alias("family"))


@query("tx18_design_gates", sql="""
SELECT p_partkey, CASE WHEN p_size % 5 + 1 < 3 THEN 'chain_too_short' WHEN p_partkey % 2 = 1 THEN 'chain_too_shallow' WHEN p_size > 45 THEN 'hidden_recover'
  WHEN p_partkey % 3 = 2 THEN 'deliverables_too_few' WHEN p_partkey % 3 = 0 AND string_split(p_type, ' ')[1] = string_split(p_type, ' ')[2] THEN 'rule_no_trap' ELSE 'pass' END AS code FROM part""")
def tx18_design_gates(spark, d):
    return designs(spark, d).select("p_partkey", F.coalesce(GA.design_gates(F.col("d"), F.col("family"), 3, 1, 1), F.lit("pass")).alias("code"))


@query("tx20_task_text_gates", sql="""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND length(p_type) >= 12 THEN 'hidden_detail_leaked' WHEN p_partkey % 3 = 1 AND NOT contains(concat(replace(p_name, ' ', ''), ' '), CAST(p_size AS VARCHAR)) THEN 'constants_missing'
  WHEN p_partkey % 3 = 0 THEN 'no_question' WHEN p_partkey % 3 = 2 THEN 'no_cli' ELSE 'no_output_format' END AS code FROM part""")
def tx20_task_text_gates(spark, d):
    text = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(""))
    return designs(spark, d).select("p_partkey", GA.task_text_gates(text, F.col("d"), F.col("family")).alias("code"))


@query("tx21_variant_gates", sql="""
SELECT p_partkey, CASE WHEN p_size % 5 + 1 < 3 THEN 'too_few_variants' WHEN p_size % 5 + 1 > 3 AND p_partkey % 2 = 0 THEN 'vacuous_variant' ELSE 'pass' END AS code FROM part""")
def tx21_variant_gates(spark, d):
    n = (F.col("p_size") % 5 + 1).cast("int")
    variants = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.cast("string").alias("naive_wrong_answer"), F.when((F.col("p_partkey") % 2 == 0) & (i == 4), "4").otherwise("right").alias("correct_answer")))
    return A.table(spark, d, "part").select("p_partkey", F.coalesce(GA.variant_gates(variants, F.lit(3)), F.lit("pass")).alias("code"))


@query("tx19_chain_depth", sql=f"""
WITH RECURSIVE l AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents),
s AS (SELECT doc_id, unnest(list_transform(ls, lambda x, i: {{'id': i, 'dep': CASE WHEN i = 1 THEN NULL ELSE 1 + length(x) % (i - 1) END}})) AS s FROM l),
e AS (SELECT doc_id, s.id AS id, s.dep AS dep FROM s),
r AS (SELECT doc_id, id, 1 AS depth FROM e WHERE dep IS NULL UNION ALL SELECT e.doc_id, e.id, r.depth + 1 FROM e JOIN r ON e.doc_id = r.doc_id AND e.dep = r.id)
SELECT doc_id, max(depth) AS depth FROM r GROUP BY doc_id""")
def tx19_chain_depth(spark, d):
    lines = TX.lines_of(F.col("text"))
    steps = F.transform(lines, lambda x, i: F.struct(
        (i + 1).cast("string").alias("step_id"),
        F.when(i > 0, F.array((1 + F.length(x) % i).cast("string"))).otherwise(F.array().cast("array<string>")).alias("depends_on")))
    return A.table(spark, d, "documents").filter("text <> ''").select("doc_id", GA.chain_depth(steps).alias("depth"))


@query("tx22_script_gates", sql="""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'names_reference' WHEN p_size > 30 THEN 'no_L1_runs' WHEN p_partkey % 4 < 2 THEN 'too_few_L2' WHEN p_size < 10 THEN 'no_score' ELSE 'pass' END AS code FROM part""")
def tx22_script_gates(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    text = F.concat(
        F.when(size > 40, "import reference_solution\n").otherwise(""), F.when(size > 30, "").otherwise("L1_runs "), F.lit("L1_output_exists\n"),
        F.array_join(F.transform(F.sequence(F.lit(0), key % 4), lambda i: F.concat(F.lit("L2_c"), i.cast("string"))), "\n"),
        F.when(size < 10, "").otherwise("\nprint('SCORE:total=1')"))
    return A.table(spark, d, "part").select("p_partkey", F.coalesce(GA.script_gates(text), F.lit("pass")).alias("code"))


@query("tx23_code_policy", sql="""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'syntax' END, CASE WHEN p_size <= 40 AND p_size > 30 THEN 'import_not_allowed' END,
  CASE WHEN p_size <= 40 AND p_partkey % 2 = 0 THEN 'too_few_functions' END, 'no_output_flag') AS codes FROM part""")
def tx23_code_policy(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    code = F.concat(
        F.lit("import argparse\nfrom os.path import join\n"), F.when(size > 40, "def :\n").when(size > 30, "import torch.nn\n").otherwise(""),
        F.lit("def main():\n    p = argparse.ArgumentParser()\n    p.add_argument('--input')\ndef a():\n    pass\n"), F.when(key % 2 == 1, "def b():\n    pass\n").otherwise(""))
    rows = A.table(spark, d, "part").select("p_partkey", code.alias("code"))
    return GA.code_policy(rows, "code").select("p_partkey", F.array_join("codes", ",").alias("codes"))


@query("tx24_file_blocks", sql="""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('a/', page_id, '.txt') ELSE concat('../', page_id, '.txt') END AS path, concat(url, chr(10)) AS content, page_id % 2 = 0 AS safe FROM pages
UNION ALL SELECT page_id, 'b.txt', concat('last', chr(10)), true FROM pages""")
def tx24_file_blocks(spark, d):
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "a/").otherwise("../"), F.col("page_id").cast("string"), F.lit(".txt"))
    text = F.concat(F.lit('Reply:\n<file path="'), path, F.lit('">```text\n'), F.col("url"),
                    F.lit('\n```</file> <file path="b.txt">first</file><file path="b.txt">\nlast\n</file>'))
    return GA.extract_file_blocks(A.table(spark, d, "pages").select("page_id", text.alias("text")), "page_id", "text")


@query("tx25_promotion", "tasks", """
SELECT task_id, CASE WHEN quality IS NULL AND toxic IS NULL AND n_chars % 2 = 0 THEN 'skip_already_promoted' WHEN quality IS NULL THEN 'skip_no_sanitized'
  WHEN toxic = 1 THEN 'promote_only' WHEN n_chars % 2 = 0 AND quality = 1 THEN 'skip_already_promoted' ELSE 'needs_promotion' END AS state FROM tasks""")
def tx25_promotion(spark, d):
    oracle = F.when(F.coalesce("toxic", F.lit(0)) == 0, F.col("text"))
    sanitized = F.when(F.col("quality") == 1, F.col("text")).when(F.col("quality") == 0, F.concat("text", F.lit("?")))
    archived = F.when(F.col("n_chars") % 2 == 0, F.col("text"))
    return A.tasks(spark, d).select("task_id", GA.promotion_state(oracle, sanitized, archived).alias("state"))


@query("tx26_prompts", "tasks", """,
g AS (SELECT task_id, text, model, condition FROM tasks CROSS JOIN (VALUES ('m0'),('m1')) m(model) CROSS JOIN (VALUES ('no_context'),('with_skill')) c(condition)),
p AS (SELECT g.*, CASE WHEN condition = 'with_skill' AND quality = 1 AND regexp_matches(t.text, '\\S') THEN concat('You are given the following skill package for this task. Use it to guide your answer.', chr(10), chr(10), '<skill-package>', chr(10),
  regexp_replace(t.text, '^\\s+|\\s+$', '', 'g'), chr(10), '</skill-package>') ELSE '' END AS sys FROM g JOIN tasks t ON t.task_id = g.task_id)
SELECT concat_ws('::', model, condition, task_id) AS trial_key, length(sys) AS system_chars, length(text) AS user_chars, sha256(sys) AS system_hash, sha256(text) AS user_hash FROM p""")
def tx26_prompts(spark, d):
    from evalmart.operators.joins import trial_grid

    t = A.tasks(spark, d)
    skills = t.filter("quality = 1").select("task_id", F.lit("skill").alias("role"), "text")
    return LK.assemble_prompts(
        trial_grid(t.select("task_id"), ["m0", "m1"], ["no_context", "with_skill"]), t.select("task_id", F.col("text").alias("user_text")),
        skills, {"with_skill": "skill"}, {"with_skill": LK.SKILL_WRAP})


@query("tx27_literal_blocks", sql=f"""
WITH s AS (SELECT doc_id, regexp_replace(text, '[\\[\\]{{}}]', '', 'g') AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_concat(['x = 1', 'EXPECTED = <case/output literals redacted>', 'def f():'], {lines_sql('t')}), chr(10))) AS code FROM s""")
def tx27_literal_blocks(spark, d):
    body = F.regexp_replace("text", r"[\[\]{}]", "")
    code = F.concat(F.lit("x = 1\nEXPECTED = {\n"), body, F.lit("\n}\ndef f():\n"), body)
    return A.table(spark, d, "documents").select("doc_id", F.md5(GA.strip_literal_blocks(code)).alias("code"))


@query("tx28_signatures", sql=f"""
SELECT doc_id, md5(array_to_string(list_transform({lines_sql('text')}, lambda l: regexp_replace(regexp_replace(concat('def ', l), '^\\s+|\\s+$', '', 'g'), ':+$', '')), chr(10))) AS signatures
FROM documents WHERE NOT list_bool_or(list_transform({lines_sql('text')}, lambda l: NOT regexp_matches(l, '\\S')))""")
def tx28_signatures(spark, d):
    full = ~F.exists(TX.lines_of(F.col("text")), lambda line: ~line.rlike(r"\S"))
    code = F.array_join(F.transform(TX.lines_of(F.col("text")), lambda line: F.concat(F.lit("def "), line)), "\n")
    return A.table(spark, d, "documents").filter(full).select("doc_id", F.md5(GA.code_signatures(code)).alias("signatures"))


LOG_SQL = """
lg AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def logs(spark, d):
    """Test logs from events: named and bare scores, checks, pytest summaries, error texts."""
    k = F.get_json_object("props", "$.k").cast("int")
    ks = k.cast("string")
    e = A.table(spark, d, "events").withColumn("k", k)
    return e.select(
        "event_id", "k", "event_type",
        F.concat(F.lit("SCORE:"), F.col("event_type"), F.lit("="), ks, F.lit("\nSCORE:final_"), F.col("event_type"), F.lit("=0.5\nScore: "), ks, F.lit("\nscore = 2\nSCORE:"),
                 F.col("event_type"), F.lit(":1.25\n")).alias("scores"),
        F.concat(F.when(k > 50, "PASS:a\nPASS:b\n").otherwise("PASS:a\n"), F.when(k % 10 == 0, "FAIL:c\n").otherwise("")).alias("checks"),
        F.concat(F.lit("tests passed in 3s\n=== "), (k + 1).cast("string"), F.lit(" passed, "), (k % 3).cast("string"), F.lit(" failed, 1 error in 0.12s ===\n")).alias("pytest"),
        F.when(k % 4 == 0, "Traceback\nValueError: bad").when(k % 4 == 1, "x ImportError y").when(k % 4 == 2, "TimeoutExpired\nz").otherwise("boom").alias("stderr"))


@query("fn11_scores", sql=f"""WITH {LOG_SQL}
SELECT event_id, event_type AS name, 1.25 AS value FROM lg UNION ALL SELECT event_id, 'final_' || event_type, 0.5 FROM lg UNION ALL SELECT event_id, 'score_1', k FROM lg UNION ALL SELECT event_id, 'score_2', 2.0 FROM lg""")
def fn11_scores(spark, d):
    return logs(spark, d).select("event_id", F.explode(GR.parse_scores(F.col("scores"))).alias("s")).select("event_id", "s.name", "s.value")


@query("fn12_aggregate", sql=f"""WITH {LOG_SQL}
SELECT event_id, 0.5 AS run, 0.5 AS report, round((1.25 + 0.5 + k + 2.0) / 4, 6) AS priority FROM lg""")
def fn12_aggregate(spark, d):
    s = GR.parse_scores(F.col("scores"))
    return logs(spark, d).select("event_id", *[F.round(GR.aggregate_score(s, v), 6).alias(v) for v in ("run", "report", "priority")])


@query("fn13_pytest", sql=f"""WITH {LOG_SQL}
SELECT event_id, k + 1 AS n_pass, k % 3 + 1 AS n_fail, CASE WHEN k > 50 THEN 2 ELSE 1 END AS checks_pass, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS checks_fail FROM lg""")
def fn13_pytest(spark, d):
    p, c = GR.parse_pytest(F.col("pytest")), GR.count_pass_fail(F.col("checks"))
    return logs(spark, d).select("event_id", p["n_pass"].alias("n_pass"), p["n_fail"].alias("n_fail"), c["n_pass"].alias("checks_pass"), c["n_fail"].alias("checks_fail"))


@query("fn14_stderr", sql=f"WITH {LOG_SQL} SELECT event_id, CASE k % 4 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'import_error' WHEN 2 THEN 'timeout' ELSE 'runtime_error' END AS kind FROM lg")
def fn14_stderr(spark, d):
    return logs(spark, d).select("event_id", GR.classify_stderr(F.col("stderr")).alias("kind"))


@query("fn15_verdict", sql=f"""WITH {LOG_SQL},
c AS (SELECT *, CASE WHEN k > 50 THEN 2 ELSE 1 END AS np, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS nf, CASE WHEN k = 7 THEN 1 ELSE 0 END AS rc FROM lg)
SELECT event_id, CASE WHEN k = 99 THEN false ELSE rc = 0 AND nf = 0 AND k >= 20 END AS passed, CASE WHEN k = 99 THEN 0 ELSE np END AS n_pass, CASE WHEN k = 99 THEN 1 ELSE nf END AS n_fail,
  round(CASE WHEN k = 99 THEN 0.0 ELSE np / (np + nf) END, 6) AS pass_rate, CASE WHEN k <> 99 THEN CAST(k / 20 AS DOUBLE) END AS agg_score,
  CASE WHEN k = 99 THEN 'timeout' WHEN rc = 0 AND nf = 0 AND k >= 20 THEN 'success' WHEN nf > 0 THEN 'test_failure' WHEN k < 20 THEN 'low_score' ELSE 'test_failure' END AS error_type FROM c""")
def fn15_verdict(spark, d):
    out = F.concat(F.col("checks"), F.lit("SCORE:total="), (F.col("k") / 20).cast("decimal(10,2)").cast("string"), F.lit("\n"))
    v = GR.verdict(F.when(F.col("k") == 7, 1).otherwise(0), out, F.lit(""), F.when(F.col("k") == 99, "timeout_60s"), F.lit("subprocess_cli"))
    return logs(spark, d).select("event_id", v.alias("v")).select(
        "event_id", "v.passed", "v.n_pass", "v.n_fail", F.round("v.pass_rate", 6).alias("pass_rate"), "v.agg_score", "v.error_type")


@query("fn16_grade_enum", sql="""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'no_ANSWER_line' WHEN p_size < 20 THEN 'out_of_space' WHEN p_size < 30 THEN 'match' ELSE 'wrong_value' END AS grade FROM part""")
def fn16_grade_enum(spark, d):
    size = F.col("p_size")
    text = F.concat(F.lit("Because.\n"), F.when(size < 10, "no line").when(size < 20, "ANSWER: nowhere ").when(size < 30, F.concat(F.lit("answer:  "), F.lower("p_type"), F.lit("  ")))
                    .otherwise(F.concat(F.lit("ANSWER: "), "p_brand")), F.lit("\nANALYSIS: x"))
    grade = GR.grade_enum(GR.extract_answer(text), F.col("p_type"), F.array("p_type", "p_brand"))
    return A.table(spark, d, "part").select("p_partkey", grade.alias("grade"))


@query("fn17_canonical_answer", sql="""
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS int_value, concat('(', l_partkey, ',-', l_suppkey, ')') AS tuple_value, lower(l_returnflag) AS enum_value,
  CASE WHEN l_partkey % l_suppkey = 0 THEN CAST(l_partkey // l_suppkey AS VARCHAR) ELSE concat(l_partkey // gcd(l_partkey, l_suppkey), '/', l_suppkey // gcd(l_partkey, l_suppkey)) END AS fraction_value,
  'not_integer' AS code FROM lineitem WHERE l_suppkey > 0""")
def fn17_canonical_answer(spark, d):
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    none = F.array().cast("array<string>")
    value = lambda raw, fmt, space=none: GR.canonical_answer(raw, F.lit(fmt), space, fmt == "fraction")
    return A.table(spark, d, "lineitem").filter("l_suppkey > 0").select(
        "l_orderkey", "l_linenumber", value(F.concat(F.lit(" +00"), p, F.lit(" ")), "integer")["value"].alias("int_value"),
        value(F.concat(F.lit("("), p, F.lit(", -"), s, F.lit(" )")), "tuple_int")["value"].alias("tuple_value"),
        value(F.col("l_returnflag"), "enum", F.array(F.lit("A"), F.lit("N"), F.lit("R")))["value"].alias("enum_value"),
        value(F.concat(p, F.lit(" / "), s), "fraction")["value"].alias("fraction_value"),
        value(F.concat(p, F.lit("x")), "integer")["error"].alias("code"))


@query("fn18_toxicology", sql="""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'ref_aggregate_low' ELSE '' END AS ref, CASE WHEN p_partkey % 5 = 0 THEN 'format_only_not_valid' ELSE '' END AS quality,
  concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'empty_not_caught' END, CASE WHEN p_size < 10 THEN 'naive_score_high' END) AS bad,
  NOT (p_size > 40 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_size < 10) AS ok FROM part""")
def fn18_toxicology(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    log = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kinds = F.array(
        F.struct(F.lit("reference").alias("kind"), log("PASS:L1_runs\nSCORE:total=", F.when(size > 40, "0.9").otherwise("1.0")).alias("log")),
        F.struct(F.lit("empty_output").alias("kind"), F.when(key % 7 == 0, "PASS:L1_runs").otherwise("FAIL:L1_output_exists").alias("log")),
        F.struct(F.lit("format_only").alias("kind"), log(F.when(key % 5 == 0, "FAIL:L1_x").otherwise("PASS:L1_valid_json"), "\nSCORE:total=0.1").alias("log")),
        F.struct(F.lit("naive_baseline").alias("kind"), log("PASS:L1_valid_json\nPASS:L2_a\nPASS:L2_b\nFAIL:L2_c\nSCORE:mean=", F.when(size < 10, "0.8").otherwise("0.3")).alias("log")))
    reports = dealt(A.table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", F.explode(kinds).alias("r")).select("p_partkey", "r.kind", GR.parse_report(F.col("r.log")).alias("report"))
    out = GR.toxicology(reports, "p_partkey")
    return out.select("p_partkey", F.array_join("ref_failures", ",").alias("ref"), F.array_join("bad_quality_failures", ",").alias("quality"),
                      F.array_join("bad_failures", ",").alias("bad"), "ok")


@query("fn19_extract_code", sql="""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('x = ', conv_id) WHEN role = 'user' THEN 'def broken(:' ELSE 'pass  # longest one' END AS code FROM conversations""")
def fn19_extract_code(spark, d):
    turn = F.col("turn")
    text = F.concat(F.col("text"), F.lit("\n```"), F.when(turn % 2 == 0, "python").otherwise(""), F.lit("\n"),
                    F.when(turn % 2 == 0, F.concat(F.lit("x = "), F.col("conv_id").cast("string"), F.lit("\n```\n```python\nthis is not ( code at all\n```"))).when(
                        F.col("role") == "user", "def broken(:\n```").otherwise("pass\n```\n```\npass  # longest one\n```"))
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(text, "`{4,}", "").alias("reply"))
    return GR.extract_code(rows, "reply").select("conv_id", "turn", "code")


@query("fn20_extract_json", sql="SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS found FROM events")
def fn20_extract_json(spark, d):
    m = F.col("event_id") % 3
    text = F.when(m == 0, F.concat(F.lit("Reply:\n```json\n"), "props", F.lit("\n```\nDone {x}"))).when(
        m == 1, F.concat(F.lit("Here: "), "props", F.lit(" ok"))).otherwise(F.concat(F.lit("none } { "), "props", F.lit("x")))
    return A.table(spark, d, "events").select("event_id", JD.extract_json(F.when(m == 2, F.lit("no object } here {")).otherwise(text)).alias("found"))


def payloads(spark, d):
    size = F.col("p_size")
    items = lambda n, text: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(text, F.lit(" "), i.cast("string")))
    payload = F.struct(
        F.lit("Gene").alias("type"), F.rpad("p_name", 30 + F.col("p_size") * 2, ".").alias("summary"),
        F.when(size % 3 == 0, "debug").when(size % 3 == 1, "Testing").otherwise("weird").alias("category"), items(size % 12 + 1, F.col("p_brand")).alias("signals_match"),
        items(size % 9 + 1, F.rpad("p_type", 20, "-")).alias("strategy"), items(F.lit(1), F.lit("needs")).alias("preconditions"),
        F.struct(F.when(size > 48, 90).otherwise(3).alias("max_files"), F.array(F.lit(".env")).alias("forbidden_paths")).alias("constraints"),
        F.array().cast("array<string>").alias("validation"))
    return A.table(spark, d, "part").select("p_partkey", "p_size", F.to_json(payload).alias("json"))


@query("fn22_validate_payload", sql="""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 3 <> 0 THEN 'category' END, CASE WHEN NOT 30 + p_size * 2 BETWEEN 50 AND 300 THEN 'summary_length' END,
  CASE WHEN NOT p_size % 12 + 1 BETWEEN 5 AND 10 THEN 'signals_count' END, CASE WHEN NOT p_size % 9 + 1 BETWEEN 3 AND 8 THEN 'strategy_count' END, CASE WHEN p_size > 48 THEN 'max_files' END) AS codes FROM part""")
def fn22_validate_payload(spark, d):
    return payloads(spark, d).select("p_partkey", F.array_join(JD.validate_payload(F.col("json"))["codes"], ",").alias("codes"))


@query("fn21_soft_fix", sql="""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'debug' WHEN 1 THEN 'test' ELSE 'other' END AS category, least(p_size % 12 + 1, 10) AS n_signals, least(p_size % 9 + 1, 8) AS n_strategy,
  CASE WHEN p_size > 48 THEN 50 ELSE 3 END AS max_files FROM part""")
def fn21_soft_fix(spark, d):
    p = JD.soft_fix_payload(JD.parse_payload(F.col("json")), clamp=True)
    return payloads(spark, d).select("p_partkey", p.alias("p")).select(
        "p_partkey", "p.category", F.size("p.signals_match").alias("n_signals"), F.size("p.strategy").alias("n_strategy"), "p.constraints.max_files")


@query("fn23_scalar_leaves", sql="""
WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events)
SELECT event_id, '$.a.k' AS path, k AS value FROM k UNION ALL SELECT event_id, '$.b[0]', event_type FROM k UNION ALL SELECT event_id, '$.b[1].c.d.e', k FROM k
UNION ALL SELECT event_id, '$.z.z[0].z.z[0].z.z[0].z.z[0]', k FROM k UNION ALL SELECT event_id, '$.t', 'true' FROM k""")
def fn23_scalar_leaves(spark, d):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"a": '), "props", F.lit(', "n": null, "b": ["'), "event_type", F.lit('", {"c": {"d": {"e": '), k, F.lit('}}}], "t": true, "z": {"z": [' + '{"z": {"z": [' * 3), k, F.lit("]}}" * 3 + "]}}"))
    return JD.scalar_leaves(A.table(spark, d, "events").select("event_id", doc.alias("doc")), "event_id", "doc")


@query("fn24_shapes", sql="SELECT event_type, 'OBJECT<k: BIGINT>' AS shape FROM events GROUP BY 1")
def fn24_shapes(spark, d):
    return JD.corpus_shape(A.table(spark, d, "events"), "props", "event_type")


@query("fn25_payload_strings", sql="""
SELECT p_partkey, 'summary' AS loc, rpad(p_name, 30 + p_size * 2, '.') AS text FROM part
UNION ALL SELECT p_partkey, concat('signals_match[', i - 1, ']'), concat(p_brand, ' ', i) FROM (SELECT *, unnest(range(1, p_size % 12 + 2)) AS i FROM part)
UNION ALL SELECT p_partkey, concat('strategy[', i - 1, ']'), concat(rpad(p_type, 20, '-'), ' ', i) FROM (SELECT *, unnest(range(1, p_size % 9 + 2)) AS i FROM part)
UNION ALL SELECT p_partkey, 'preconditions[0]', 'needs 1' FROM part""")
def fn25_payload_strings(spark, d):
    return payloads(spark, d).select("p_partkey", F.explode(JD.payload_strings(JD.parse_payload(F.col("json")))).alias("s")).select("p_partkey", "s.loc", "s.text")


@query("fn9_missing_constants", sql="""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '123456' END AS missing FROM customer""")
def fn9_missing_constants(spark, d):
    text = F.concat(F.lit("Use "), F.when(F.col("c_custkey") % 2 == 0, "123,456").otherwise("12"), F.lit(" and 7_000 for "), "c_name")
    return A.table(spark, d, "customer").select("c_custkey", F.array_join(N.missing_constants(text, F.array(F.lit("123456"), F.lit("7000"))), ",").alias("missing"))


@query("fn8_token_counts", sql="""
SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS count, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN c_custkey * 1000 END AS written, c_acctbal >= 0 AS ok, CASE WHEN c_acctbal >= 0 THEN 'yes' ELSE 'no' END AS answer FROM customer""")
def fn8_token_counts(spark, d):
    """Counts that come as numbers, and as text: empty, with separators, or with a fraction, which is no count."""
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    written = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(key.cast("string"), F.lit("_000"))).otherwise(F.concat(key.cast("string"), F.lit(".7")))
    return A.table(spark, d, "customer").select(
        "c_custkey", N.token_count(bal).alias("count"), N.token_count(written).alias("written"), N.finite_nonneg(bal).alias("ok"), N.yes_no(bal >= 0).alias("answer"))


@query("wn12_line_windows", sql=f"""
SELECT doc_id, md5(array_to_string({lines_sql('text')}[-24:], chr(10))) AS tail, md5(array_to_string({lines_sql('text')}[1:5], chr(10))) AS head, md5(right(text, 1800)) AS tail_chars FROM documents""")
def wn12_line_windows(spark, d):
    t = F.col("text")
    return A.table(spark, d, "documents").select(
        "doc_id", F.md5(TX.tail_lines(t, 24)).alias("tail"), F.md5(TX.head_lines(t, 5)).alias("head"), F.md5(TX.tail_chars(t, 1800)).alias("tail_chars"))


@query("so5_longest", sql=f"""
SELECT doc_id, list_reduce({lines_sql('text')}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS line FROM documents WHERE len({lines_sql('text')}) > 0""")
def so5_longest(spark, d):
    return A.table(spark, d, "documents").filter(F.size(TX.lines_of(F.col("text"))) > 0).select("doc_id", GR.longest(TX.lines_of(F.col("text"))).alias("line"))


@query("fn13_outcome", sql=f"WITH {LOG_SQL} SELECT event_id, k + 1 AS n_pass, k % 3 AS n_fail, 1 AS n_error FROM lg")
def fn13_outcome(spark, d):
    return logs(spark, d).select("event_id", GR.pytest_outcome(F.col("pytest")).alias("o")).select("event_id", "o.n_pass", "o.n_fail", "o.n_error")


@query("tx17_scenario_gates", sql="""
SELECT p_partkey, CASE WHEN p_size > 45 THEN 'yaml_error' WHEN p_size > 40 THEN 'not_a_mapping' WHEN p_size > 30 THEN 'missing_keys' WHEN p_size % 3 = 0 THEN 'difficulty'
  WHEN p_size % 2 = 0 THEN 'tags' ELSE 'pass' END AS code FROM part""")
def tx17_scenario_gates(spark, d):
    size = F.col("p_size")
    body = F.concat(
        F.lit("id: 1\nname: "), "p_name", F.lit("\ndomain: d\ndifficulty: "), F.when(size % 3 == 0, "extreme").otherwise("easy"),
        F.when(size > 30, "").otherwise("\nsource: s"), F.lit("\ntags: "), F.when(size % 2 == 0, "[]").otherwise("[a, b]"), F.lit("\nrequired_packages: []\n"))
    text = F.when(size > 45, "a: [b\nc: }").when(size > 40, "- a\n- b\n").otherwise(body)
    rows = A.table(spark, d, "part").select("p_partkey", text.alias("text"))
    return GA.scenario_gates(rows, "text").select("p_partkey", F.coalesce("code", F.lit("pass")).alias("code"))


@query("tx17_unmentioned", sql="""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brushed') OR contains(lower(p_type), 'copper') THEN '' ELSE 'the Brushed copper' END AS missing FROM part""")
def tx17_unmentioned(spark, d):
    operations = F.array(F.lit("the Brushed copper"), F.lit("a of it"))
    return A.table(spark, d, "part").select("p_partkey", F.array_join(GA.unmentioned_operations(F.col("p_type"), operations), ",").alias("missing"))


@query("tx27_script_excerpt", sql="""
SELECT p_partkey, concat_ws(chr(10), 'import os', 'GOLD = <case/output literals redacted>', 'def check():', concat('    print("', p_name, '")'),
  CASE WHEN p_size > 20 THEN '    x = candidate' END) AS excerpt FROM part""")
def tx27_script_excerpt(spark, d):
    code = F.concat(F.lit('import os\nGOLD = [\n "'), "p_type", F.lit('",\n]\n\ndef check():\n    y = 1\n    print("'), "p_name", F.lit('")\n'),
                    F.when(F.col("p_size") > 20, "    x = candidate\n").otherwise("    z = 2\n"))
    return A.table(spark, d, "part").select("p_partkey", GA.script_excerpt(code, 4000).alias("excerpt"))


@query("tx8_python_gold", sql="""
SELECT id, literal FROM (SELECT p_partkey AS id, p_brand AS pub, unnest([p_type, 'k' || p_size]) AS literal FROM part) WHERE NOT contains(lower(pub), lower(literal))
UNION ALL SELECT p_partkey, 'True' FROM part UNION ALL SELECT p_partkey, 'shown' FROM part WHERE p_size > 25""")
def tx8_python_gold(spark, d):
    code = F.concat(F.lit("def f():\n    EXPECTED = {'a': '"), "p_type", F.lit("', 'b': [12, '"), "p_brand", F.lit("']}\nmy_answer = 'k"), F.col("p_size").cast("string"),
                    F.lit("'\nother = 'nothing'\n"), F.when(F.col("p_size") > 25, "gold = ('shown', None)\n").otherwise("gold = f()\n"), F.lit("answers = [True]\n"))
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), code.alias("code"), F.col("p_brand").alias("pub"))
    return LK.python_gold_literals(rows, "id", "code", "pub")
