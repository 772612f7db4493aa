"""Files in and out: logs, manifests, folders, inventories, archives, sinks."""

import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F, types as T

from evalmart.operators.latest import latest_by_key
from evalmart.schemas import METRICS, RESULT, TASK
from evalmart.sources import documents as D, files as FI, logs as G, sinks as SK

K = T.StructType([T.StructField("k", T.LongType()), T.StructField("trial_key", T.StringType())])


@pytest.fixture
def log_file(tmp_path):
    lines = [b'{"k": 1, "trial_key": "a"}', b"", b"   ", b"[1, 2]", b'{"k": 2}{"k": 3}', b'{"k": 4} x', b"NaN", b'{"k": 5, "trial_key": "caf\xff"}', b'{"k": 6, "trial_key": "a"}', b"{torn"]
    path = tmp_path / "log.jsonl"
    path.write_bytes(b"\n".join(lines) + b"\n")
    return str(path)


def test_lenient_log_keeps_order(spark, log_file):
    got = G.read_log(spark, log_file, K, "lenient")
    assert sorted(r.k for r in got.collect()) == [1, 5, 6]
    assert {r.trial_key: r.k for r in latest_by_key(got).collect()} == {"a": 6, "caf�": 5}


def test_strict_log_fails_closed(spark, log_file, tmp_path):
    assert G.bad_lines(G.read_lines(spark, log_file)).count() == 6
    with pytest.raises(Exception, match="not a JSON object"):
        G.read_log(spark, log_file, K).collect()
    good = tmp_path / "good.jsonl"
    good.write_text('{"k": 1, "trial_key": "m::c::t::x"}\n')
    parts = G.with_trial_parts(G.read_log(spark, str(good), K)).first()
    assert (parts.model, parts.condition, parts.task_id) == ("m", "c", "t::x")


def test_result_schema_reads_nested_records(spark, tmp_path):
    record = {"trial": {"trial_key": "m::c::t", "task_id": "t", "model": "m", "condition": "c"}, "eval": {"passed": True, "scores": {"a": 1.0}}, "tokens": {"input": 5}, "cost_usd": 0.1}
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(record) + "\n")
    row = G.read_log(spark, str(path), RESULT).first()
    assert row.trial.trial_key == "m::c::t" and row.eval.scores == {"a": 1.0} and row.tokens.input == 5


def test_manifest_and_text(spark, tmp_path, rows):
    (tmp_path / "tasks" / "T1").mkdir(parents=True)
    (tmp_path / "tasks" / "T1" / "task.md").write_text("hello\nworld")
    manifest = {"summary": {"total_tasks": 2}, "tasks": [
        {"task_id": "T1", "family": "code", "rel_dir": "tasks/T1", "files": {"task": "task.md"}}, {"task_id": "T2", "family": "math", "rel_dir": "tasks/T2", "files": {}}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest, indent=1))
    tasks = D.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert tasks.schema == TASK and tasks.count() == 2
    text = D.read_task_text(spark, str(tmp_path), tasks, {"task": "task.md", "ref": "reference_solution.py"})
    assert rows(text) == [("T1", "ref", ""), ("T1", "task", "hello\nworld"), ("T2", "ref", ""), ("T2", "task", "")]


def test_json_dir_and_metrics(spark, tmp_path, rows):
    d = tmp_path / "assets"
    d.mkdir()
    (d / "T1.json").write_text('{"k": 1}')
    (d / "T2.json").write_text("broken")
    (d / "T3.txt").write_text('{"k": 3}')
    assert rows(D.read_json_dir(spark, str(d), K), "doc_id", "k") == [("T1", 1)]
    header = [f.name for f in METRICS.fields]
    values = {**{h: "x" for h in header}, **{f.name: "7" for f in METRICS.fields if f.dataType == T.LongType()}}
    (tmp_path / "m.csv").write_text(",".join(header) + "\n" + ",".join(values[h] for h in header) + "\n")
    row = D.read_metrics_csv(spark, str(tmp_path / "m.csv")).first()
    assert row.passed == 7 and row.task_id == "x" and len(row) == 28


def test_scenarios(spark):
    texts = [(1, "name: A\nanswer_format: enum\nnested:\n  name: no"), (2, "name: 'B'\n: : bad [\n name: no\n# name: no\nanswer_format: \"integer\""), (3, None), (4, "- list")]
    df = spark.createDataFrame(texts, "i int, text string")
    assert {r.i: (r.name, r.answer_format) for r in D.parse_scenario(df).collect()} == {1: ("A", "enum"), 2: ("B", "integer"), 3: (None, None), 4: (None, None)}


def test_csv_sample(spark):
    text = 'a,b,"c,d"\n1,"x ""y""",3\n' + "\n".join("r,s,t" for _ in range(20))
    row = spark.createDataFrame([(text,)], "t string").select(D.csv_sample(F.col("t"), 3, 2).alias("s"), D.csv_columns(F.col("t")).alias("c")).first()
    assert row.s == 'a,b\n1,x "y"\nr,s' and row.c == "csv columns: a, b, c,d"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "pool"
    for name, data in {"T0001/a.txt": b"alpha\n", "T0001/nested/b.bin": b"\x00\x01", "T0002/__pycache__/x.pyc": b"x", "T0002/_trace_1.json": b"{}", "shared/c.md": b""}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def test_inventory(spark, tree, rows):
    got = FI.scan_assets(spark, str(tree))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert rows(got, "path", "task_id", "size", "sha256") == [
        ("T0001/a.txt", "T0001", 6, "b6a98d9ce9a2d9149288fa3df42d377c3e42737afdcdaf714e33c0a100b51060"),
        ("T0001/nested/b.bin", "T0001", 2, sha(b"\x00\x01")), ("shared/c.md", None, 0, sha(b""))]


def test_checksum_round_trip(spark, tree, tmp_path, rows):
    files = FI.scan_assets(spark, str(tree))
    SK.write_checksums(files, str(tmp_path / "sums"))
    back = FI.read_checksums(spark, str(tmp_path / "sums"))
    assert FI.checksum_violations(back).count() == 0 and rows(back, "path", "sha256") == rows(files, "path", "sha256")
    bad = spark.createDataFrame([("zz  x",), ("a" * 64 + "  p",), ("a" * 64 + "  p",), (" ",)], "value string")
    assert rows(FI.checksum_violations(FI.parse_checksums(bad))) == [("duplicate_path", "p"), ("malformed", None)]


def test_archives(spark, tmp_path):
    root = tmp_path / "arch"
    root.mkdir()
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("ok.txt", "hello")
        z.writestr("../up.txt", "x")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "target")
        z.writestr("dir/", "")
    with tarfile.open(root / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
        sym = tarfile.TarInfo("s")
        sym.type = tarfile.SYMTYPE
        t.addfile(sym)
    (root / "c.zip").write_bytes(b"PK broken")
    files = FI.scan_assets(spark, str(root), keep_content=True)
    got = {(r.path, r.member): (r.code, r.sha256) for r in FI.explode_archives(files).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("a.zip", "ok.txt"): (None, sha(b"hello")), ("a.zip", "../up.txt"): ("unsafe_member", None), ("a.zip", "link"): ("unsafe_member", None),
                   ("b.tar.gz", "in.txt"): (None, sha(b"abc")), ("b.tar.gz", "s"): ("unsafe_member", None), ("c.zip", None): ("unreadable_archive", None)}
    assert {r.code for r in FI.explode_archives(files, max_entries=1).filter("path = 'a.zip'").collect()} == {"limit_exceeded"}


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 2), ("a", "y", 1)], "model string, condition string, n int")
    SK.write_report(df, str(tmp_path / "r"), ["n", "model"], ["model"])
    text = next((tmp_path / "r").glob("*.csv")).read_text()
    assert text == "n,model\n1,a\n2,b\n"
    SK.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lines = SK.report_lines(df, "model", "condition", F.col("n").cast("string"), ["x", "y"])
    SK.write_markdown(lines, str(tmp_path / "m"), "model", ["x", "y"], "Model")
    assert next((tmp_path / "m").glob("*.txt")).read_text() == "| Model | x | y |\n|---|---|---|\n| a |  | 1 |\n| b | 2 |  |\n"


def test_json_object_lines_like_a_strict_parser(spark):
    from evalmart.functions.hashing import is_json_object

    good = ['{}', ' {"a": [1, {"b": "}]"}]} ', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": "\\u00e9"}']
    bad = ['{"a": 1}{"b": 2}', '{"a": 1},{"b": 2}', '{"a": 1} x', '[{}]', '1', '"x"', '{"a": 1}], [{}', '{"a": 1}, "b": {}', '{"a": 01}', '{"a"', "{'a': 1}", '{"a": 1,}', 'null', '{"a": 1}}']
    df = spark.createDataFrame([(line,) for line in good + bad], "v string")
    got = {r.v: r.ok for r in df.select("v", is_json_object(F.col("v")).alias("ok")).collect()}
    assert got == {**{g: True for g in good}, **{b: False for b in bad}}
