"""One changed field per case: contracts, comparability, merge, rules, digests, audits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evalmart.checks import ContractError, require_empty
from evalmart.functions.hashing import canonical_json
from evalmart.operators import digests as DG, joins as J, rules as R, curation as CU
from evalmart.plans import audit as AU, contracts as C


def fields(spark, **values):
    return spark.createDataFrame(list(values.items()), "field string, value string")


def test_identity_diff(spark, rows):
    base = dict(runtime_protocol="v2", manifest_sha256="m", model_id="x", threshold="1.0", backend="docker")
    assert rows(J.diff_run_identity(fields(spark, **base), fields(spark, **base))) == []
    for name in base:
        other = {**base, name: "changed"}
        assert rows(J.diff_run_identity(fields(spark, **base), fields(spark, **other)), "field", "code") == [(name, "differs")]
        gone = {k: v for k, v in base.items() if k != name}
        assert rows(J.diff_run_identity(fields(spark, **base), fields(spark, **gone)), "field", "code") == [(name, "missing")]


PROMPT = "model string, task_id string, condition string, user_hash string, system_hash string"


@pytest.mark.parametrize("other, want", [
    ([("m", "t", "no_context", "u", "s")], []),
    ([("m", "t", "no_context", "U", "s")], ["user_hash_differs"]),
    ([("m", "t", "no_context", "u", "S")], ["system_hash_differs"]),
    ([("m", "t", "no_context", "u", None)], ["system_hash_missing"]),
    ([("m", "t", "no_context", None, "s")], ["user_hash_missing"]),
    ([("m", "t", "no_context", "u", "s"), ("m", "t", "with_skill", "v", "z")], ["user_hash_inconsistent"]),
    ([("m", "x", "no_context", "U", "S")], [])])
def test_prompt_parity(spark, rows, other, want):
    base = spark.createDataFrame([("m", "t", "no_context", "u", "s")], PROMPT)
    assert [r[0] for r in rows(J.prompt_parity(base, spark.createDataFrame(other, PROMPT)), "code")] == want


def test_treatment_may_change_its_system_prompt(spark, rows):
    base = spark.createDataFrame([("m", "t", "with_gene_a", "u", "s")], PROMPT)
    assert rows(J.prompt_parity(base, spark.createDataFrame([("m", "t", "with_gene_a", "u", "S")], PROMPT))) == []


def test_single_values(spark):
    log = spark.createDataFrame([("v1", None, "f"), ("v2", None, "f"), (None, " ", "f")], "runtime_protocol string, prompt_protocol string, run_fingerprint string")
    got = {r.field: (r.value, r.state, r.n_with) for r in C.single_values(log, ["runtime_protocol", "prompt_protocol", "run_fingerprint"]).collect()}
    assert got == {"runtime_protocol": (None, "mixed", 2), "prompt_protocol": ("legacy-v1", "inferred", 0), "run_fingerprint": ("f", "single", 3)}
    clash = {r.field: r.state for r in C.single_values(log, ["run_fingerprint"], {"run_fingerprint": "g"}).collect()}
    assert clash == {"run_fingerprint": "mixed"}


def test_resume(spark, rows):
    old = dict(run_fingerprint="a", models="m", conditions="c", runtime_policy="p")
    assert rows(C.check_resume(fields(spark, **old), fields(spark, **old))) == []
    assert rows(C.check_resume(fields(spark, **old), fields(spark, **{**old, "models": "n"}))) == [("changed", "models")]
    assert ("no_fingerprint", "run_fingerprint") in rows(C.check_resume(fields(spark, models="m"), fields(spark, **old)))
    with pytest.raises(ContractError, match="models"):
        require_empty(C.check_resume(fields(spark, **old), fields(spark, **{**old, "models": "n"})))


def test_merge_rules(spark, rows):
    schema = "k string, v string"
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4"), ("d", "4")], schema)
    supp = spark.createDataFrame([("a", "1"), ("b", "X"), ("c", "3"), ("c", "3"), ("e", "5"), ("e", "6")], schema)
    assert rows(J.merge_state(base, supp, "k", F.col("v")), "k", "state") == [("a", "same"), ("b", "conflict"), ("c", "new"), ("d", "duplicate_base"), ("e", "conflict")]
    with pytest.raises(Exception, match="merge conflict: "):
        J.merge_supplement(base, supp, "k", F.col("v")).collect()
    assert rows(J.merge_supplement(base, supp, "k", F.col("v"), on_conflict="keep_base")) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("d", "4")]
    left, right = spark.createDataFrame([("x", "1")], schema), spark.createDataFrame([("y", "2")], schema)
    one = J.merge_supplement(J.merge_supplement(base.distinct(), left, "k", F.col("v")), right, "k", F.col("v"))
    two = J.merge_supplement(J.merge_supplement(base.distinct(), right, "k", F.col("v")), left, "k", F.col("v"))
    assert rows(one) == rows(two)


def test_canonical_json(spark):
    text = '{"b": 1.0, "a": {"y": 1e3, "x": "é"}, "b": 2.50}'
    row = spark.createDataFrame([(text,)], "t string").select(canonical_json(F.col("t"), True).alias("x"), canonical_json(F.lit('{"b":1,"a":[2, 3]}')).alias("n")).first()
    assert row.x == '{"a":{"x":"é","y":1000.0},"b":2.5}' and row.n == '{"a":[2,3],"b":1}'


def tree(lines):
    """The digest tree by its definition, over (line, copies)."""
    level = [(hashlib.sha256(line.encode()).hexdigest(), n) for line, n in lines]
    level = [(h[:6], f"{h}:{n}\n") for h, n in level]
    for digits in (4, 2, 0):
        nodes = {}
        for prefix, line in level:
            nodes.setdefault(prefix, []).append(line)
        level = [(p[:digits], f"{p}:{hashlib.sha256(''.join(sorted(own)).encode()).hexdigest()}\n") for p, own in nodes.items()]
    return hashlib.sha256("".join(sorted(line for _, line in level)).encode()).hexdigest()


def test_digests_ignore_order_and_partitioning(spark, rows):
    files = [("a.txt", hashlib.sha256(b"alpha\n").hexdigest()), ("nested/b.txt", hashlib.sha256(b"beta\n").hexdigest())]
    want = tree([(f"{n}\0{s}\n", 1) for n, s in files])
    df = spark.createDataFrame([*reversed(files), files[0]], "name string, sha string")
    assert rows(DG.set_digest(df, [], "name", "sha")) == [(want, 2, "sha256-tree-6-2")]
    many = spark.range(500).select(F.col("id").cast("string").alias("name"), F.sha1(F.col("id").cast("string")).alias("sha"))
    one = rows(DG.set_digest(many, [], "name", "sha"))
    assert one == rows(DG.set_digest(many.repartition(7), [], "name", "sha"))
    assert one[0][:2] == (tree([(f"{i}\0{hashlib.sha1(str(i).encode()).hexdigest()}\n", 1) for i in range(500)]), 500)
    changed = many.withColumn("sha", F.when(F.col("name") == "3", "x").otherwise(F.col("sha")))
    assert rows(DG.set_digest(changed, [], "name", "sha")) != one
    ids = spark.createDataFrame([("b", 1), ("a", 2)], "id string, pos int")
    assert rows(DG.ordered_ids_digest(ids, [], "id", "pos"))[0][0] == tree([("1\tb\n", 1), ("2\ta\n", 1)])


def test_hot_line_stays_one_row(spark, rows):
    hot = spark.range(300).select(F.when(F.col("id") < 200, "same").otherwise(F.col("id").cast("string")).alias("line"))
    one = rows(DG.lines_digest(hot, [], F.col("line")))
    assert one[0][0] == tree([("same", 200), *((str(i), 1) for i in range(200, 300))])
    assert one == rows(DG.lines_digest(hot.repartition(5), [], F.col("line")))
    assert one != rows(DG.lines_digest(hot.limit(299), [], F.col("line")))


ASSET = "source_relpath string, relpath string, scope string, collection string, task_id string, family string, execution_mode string, official boolean"


def test_rule_priority_and_keys(spark, rows):
    rules = [
        {"id": "low", "priority": 1, "match": {"scope": "scenario"}, "classification": {"distribution": "public", "role": "r", "destination": "x/{name}"}},
        {"id": "task", "priority": 5, "match": {"task_ids": ["T1", "T2"]}, "classification": {"distribution": "private", "role": "judge.x", "destination": "{task_id}/{relpath}"}},
        {"id": "glob", "priority": 5, "match": {"relpaths": ["*.md"], "has_task_id": True}, "classification": {"distribution": "excluded", "role": "n"}},
        {"id": "unsafe", "priority": 9, "match": {"relpaths": "up"}, "classification": {"distribution": "public", "role": "r", "destination": "../{name}"}}]
    data = [("s/a", "d/a.txt", "scenario", None, "T9", "f", "m", True), ("s/b", "b.txt", "scenario", None, "T1", "f", "m", False), ("s/c", "c.md", "scenario", None, "T1", "f", "m", None),
            ("s/d", "d.md", "scenario", None, "T9", "f", "m", None), ("s/e", "e.txt", "other", None, None, None, None, None), ("s/f", "up", "scenario", None, None, None, None, None)]
    got = R.classify_assets(spark.createDataFrame(data, ASSET), rules)
    assert rows(got, "relpath", "state", "rule_id", "distribution", "bundle_path", "materialize", "safe_path") == sorted([
        ("d/a.txt", "classified", "low", "public", "x/a.txt", True, True), ("b.txt", "classified", "task", "private", "T1/b.txt", False, True),
        ("c.md", "conflict", None, None, None, None, None), ("d.md", "classified", "glob", "excluded", None, False, None),
        ("e.txt", "unclassified", None, None, None, None, None), ("up", "classified", "unsafe", "public", "../up", False, False)], key=repr)


def test_path_predicates(spark):
    paths = [("a/b", True), ("", False), ("/a", False), ("a/../b", False), ("..\\a", False), ("a//b", True), ("a..b", True)]
    df = spark.createDataFrame(paths, "p string, want boolean")
    from evalmart.functions.text import is_safe_relpath

    assert all(r.got == r.want for r in df.select("want", is_safe_relpath(F.col("p")).alias("got")).collect())
    policy = R.path_policy(F.col("p"), ["Private"], ["KEYS.txt"])
    got = {r.p: r.c for r in spark.createDataFrame([("x/PRIVATE/y",), ("a/keys.TXT",), ("keys.txt/a",)], "p string").select("p", policy.alias("c")).collect()}
    assert got == {"x/PRIVATE/y": "forbidden_component", "a/keys.TXT": "forbidden_basename", "keys.txt/a": None}


def test_bundle_root(spark, rows):
    schema = "bundle_path string, family string, execution_mode string, materialize boolean, mode string, role string, sha256 string, size bigint, source_relpath string, task_id string"
    sha = hashlib.sha256(b"x").hexdigest()
    records = spark.createDataFrame([("p/a", "f", None, True, "0644", "runtime.a", sha, 1, "s/a", "T1")], schema)
    actual = spark.createDataFrame([("p/a", sha, 1)], "path string, sha256 string, size bigint")
    sums = actual.select("path", "sha256")
    line = ('{"bundle_path":"p/a","execution_mode":null,"family":"f","materialize":true,"mode":"0644","role":"runtime.a","sha256":"%s","size":1,"source_relpath":"s/a","task_id":"T1"}\n' % sha)
    root = tree([(line, 1)])
    assert rows(AU.verify_bundle(records, actual, sums, root)) == []
    assert [r[0] for r in rows(AU.verify_bundle(records, actual, sums, "0" * 64))] == ["asset_root_mismatch"]
    moved = actual.withColumn("size", F.lit(2).cast("bigint"))
    assert [r[0] for r in rows(AU.verify_bundle(records, moved, sums, root))] == ["asset_size_mismatch"]


def test_calibration(spark, rows):
    trials = spark.createDataFrame([("a", "f", s) for s in (0, 0, 0)] + [("b", "f", s) for s in (1, 1, 1)] + [("c", "f", s) for s in (1, 0, 1)], "task_id string, family string, solved int")
    assert rows(CU.calibrate(trials, 3), "task_id", "band", "verdict") == [
        ("a", "0_of_3_hard_no_solve", "KEEP_hard"), ("b", "3_of_3_trivially_easy", "REJECT_trivially_easy"), ("c", "2_of_3_discriminating", "KEEP_discriminating")]
    assert CU.calibrate(trials, 3, True).filter("verdict = 'ISOLATE_likely_broken'").count() == 1
    row = CU.calibration_yield(CU.calibrate(trials, 3)).first()
    assert (row.n_keep, row.keep_percent, row.go) == (2, 66, True)


def test_merge_conflicts_name_supplement_only_keys(spark, rows):
    from evalmart.operators import joins as J

    base = spark.createDataFrame([("A", "1"), ("B", "2")], "k string, v string")
    supplement = spark.createDataFrame([("N", "1"), ("N", "2"), ("M", "1"), ("A", "9")], "k string, v string")
    got = rows(J.merge_conflicts(base, supplement, "k", F.col("v")), "k", "n_base", "state")
    assert got == [("A", 1, "conflict"), ("N", 0, "conflict")]
