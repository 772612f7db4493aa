"""Streams in several batches, with a restart and a replayed batch."""

import time

import pytest
from pyspark.sql import functions as F, types as T

from evalmart.operators import budget as B, latest as L
from evalmart.streaming import jobs as SJ

SCHEMA = T.StructType([T.StructField("trial_key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("v", T.LongType())])


@pytest.fixture
def folder(spark, tmp_path):
    data = [(f"k{i % 7}" if i % 3 else "hot", i, i * 2) for i in range(100)]
    src = tmp_path / "src"

    def add(low, high):
        spark.createDataFrame([d for d in data if low <= d[1] < high], SCHEMA).coalesce(1).write.mode("append").json(str(src))

    return data, src, add, tmp_path


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))


def test_latest_and_merge_over_restarts(spark, folder, rows):
    data, src, add, tmp = folder
    for low, high in ((0, 40), (30, 70), (70, 100)):
        add(low, high)
        for job, name in ((SJ.stream_latest, "latest"), (SJ.stream_merge, "merge")):
            job(stream(spark, src), str(tmp / name), str(tmp / f"ck-{name}")).awaitTermination()
    want = rows(L.latest_by_key(spark.createDataFrame(data, SCHEMA)), "trial_key", "seq", "v")
    for name in ("latest", "merge"):
        assert rows(SJ.current_latest(spark, str(tmp / name), SCHEMA), "trial_key", "seq", "v") == want
    # a committed key is not applied again: a replay of old records as a later batch adds nothing
    old = spark.createDataFrame(data[:50], SCHEMA)
    SJ.idempotent_merge(old, 99, str(tmp / "merge"))
    assert SJ.read_batches(spark, str(tmp / "merge"), SCHEMA).filter("batch_id = 99").count() == 0


def test_replayed_batch_replaces_itself(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1, 1)], SCHEMA)
    for _ in range(3):
        SJ.idempotent_merge(batch, 0, str(tmp_path / "t"))
    assert SJ.read_batches(spark, str(tmp_path / "t"), SCHEMA).count() == 1


def test_budget_in_batches_equals_one_pass(spark, tmp_path, rows):
    schema = "run_id string, seq bigint, cost_usd decimal(18,6)"
    full = spark.range(90).select(F.when(F.col("id") % 3 == 0, "r1").otherwise("hot").alias("run_id"), F.col("id").alias("seq"), (F.col("id") % 11).cast("decimal(18,6)").alias("cost_usd"))
    src = str(tmp_path / "src")
    for low, high in ((0, 30), (30, 31), (31, 90)):
        full.filter(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(src)
        live = spark.readStream.schema(T._parse_datatype_string(schema)).option("maxFilesPerTrigger", 1).parquet(src)
        SJ.stream_budget(live, "25", "100", str(tmp_path / "alerts"), str(tmp_path / "ck")).awaitTermination()
    got = SJ.read_batches(spark, str(tmp_path / "alerts"), SJ.ALERT)
    assert rows(got.filter("bucket IS NOT NULL"), "run_id", "seq", "bucket") == rows(B.budget_alerts(full, "25"), "run_id", "seq", "bucket")
    assert rows(got.filter("tripped").select("run_id", "seq").distinct()) == rows(B.budget_breaker(full, "100").filter("state = 'trip'"), "run_id", "seq")


def test_ingest_and_windows(spark, tmp_path, rows):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.txt").write_text('{"k": 1}\n{"k": 2}{"k": 3}\n\n{"k": -4}\n')
    schema = T.StructType([T.StructField("k", T.LongType())])
    rules = F.array_compact(F.array(F.when(F.col("k") < 0, F.lit("negative"))))
    SJ.stream_log(spark.readStream.text(str(lines)), schema, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck"), rules).awaitTermination()
    assert rows(SJ.read_batches(spark, str(tmp_path / "good"), schema), "k") == [(1,)]
    assert [r[0] for r in rows(SJ.read_batches(spark, str(tmp_path / "bad"), "value string, codes array<string>").select(F.array_join("codes", ",")))] == ["negative", "not_a_json_object"]
    events = spark.range(40).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id") * 7)).alias("ts"), (F.col("id") % 2).alias("passed"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    out = SJ.activity_windows(live, width="1 hour")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ckw")).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(SJ.activity_windows(events, width="1 hour"))


def test_batch_sessions_equal_the_stream(spark, tmp_path, rows):
    import random

    rng = random.Random(4)
    at, data = 0, []
    for i in range(300):
        at += rng.choice([1, 5, 30, 60, 61, 200])
        data.append((at, "hot" if i % 3 else "k", i % 2))
    events = spark.createDataFrame(data, "s bigint, k string, passed bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = SJ.activity_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), gap="1 minute", by=["k"])
    q = live.writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert rows(spark.table("sess")) == rows(SJ.activity_windows(events, gap="1 minute", by=["k"]))


def test_budget_at_the_limit_without_a_step(spark, tmp_path, rows):
    schema = "run_id string, seq bigint, cost_usd decimal(18,6)"
    src = str(tmp_path / "src")
    data = [(None, 1, 3), ("r", 2, 3), ("r", 1, 4), ("r", 3, None), ("r", 4, 9)]
    spark.createDataFrame([(r, s, c if c is None else __import__("decimal").Decimal(c)) for r, s, c in data], schema).write.parquet(src)
    SJ.stream_budget(spark.readStream.schema(schema).parquet(src), "100", "7", str(tmp_path / "a"), str(tmp_path / "ck")).awaitTermination()
    assert rows(SJ.read_batches(spark, str(tmp_path / "a"), SJ.ALERT).select("run_id", "seq", "bucket", F.col("spent").cast("string"), "tripped")) == [("r", 2, None, "7.000000", True)]


RECORD = "side string, trial_key string, seq bigint, task_id string, cost string, error_type string"


def test_reconcile_over_batches(spark, tmp_path, rows):
    batches = [
        [("case", "a", 1, "t", None, None), ("budget", "a", 1, None, "5", None), ("result", "a", 2, "t", "5", "ok"), ("result", "b", 3, "t", "5", "ok"), ("result", "e", 9, "t", "5", "api_error")],
        [("case", "b", 4, "other", None, None), ("result", "c", 5, "t", "1", "ok"), ("budget", "c", 5, None, "2", None), ("case", "d", 1, "t", None, None)],
        [("budget", "b", 6, None, "5", None), ("case", "b", 7, "t", None, None), ("result", "c", 8, "t", "2", "ok"), ("result", "a", 10, "t", "5", "api_error")],
    ]
    want = [
        [("missing_budget", "b"), ("missing_case", "b")],
        [("budget_cost", "c"), ("case_task_id", "b"), ("missing_budget", "b"), ("missing_case", "c")],
        [("missing_case", "c")],
    ]
    src = str(tmp_path / "src")
    for batch, expected in zip(batches, want, strict=True):
        spark.createDataFrame(batch, RECORD).coalesce(1).write.mode("append").parquet(src)
        live = spark.readStream.schema(RECORD).parquet(src)
        part = lambda side: live.filter(F.col("side") == side)  # noqa: B023, E731
        SJ.stream_reconcile(part("result"), part("case"), part("budget"), ["cost"], str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
        assert rows(SJ.current_violations(spark, str(tmp_path / "t")), "code", "key") == expected


def test_reconcile_waits_with_patience(spark, tmp_path, rows):
    """Timers make a query that never runs out of work, so it is stopped, not awaited."""
    src = str(tmp_path / "src")

    def step(*batch):
        spark.createDataFrame(list(batch), RECORD).coalesce(1).write.mode("append").parquet(src)

    def found(expected):
        for _ in range(60):
            time.sleep(0.5)
            if rows(SJ.current_violations(spark, str(tmp_path / "t")), "code", "key") == expected:
                return True
        return False

    step(("result", "a", 1, "t", "5", "ok"), ("budget", "a", 1, None, "6", None))
    live = spark.readStream.schema(RECORD).parquet(src)
    part = lambda side: live.filter(F.col("side") == side)
    query = SJ.stream_reconcile(part("result"), part("case"), part("budget"), ["cost"], str(tmp_path / "t"), str(tmp_path / "ck"), patience_ms=1000, available_now=False)
    try:
        assert found([("budget_cost", "a"), ("missing_case", "a")])
        step(("case", "a", 2, "t", None, None))
        assert found([("budget_cost", "a")])
    finally:
        query.stop()


def test_late_rows_are_dropped(spark, tmp_path, rows):
    src, at = str(tmp_path / "src"), F.timestamp_seconds
    schema = "ts timestamp, passed bigint"
    for batch in ([0, 30, 4000, 9000], [10, 3500, 8900, 9100, 20000]):
        spark.createDataFrame([(s, 1) for s in batch], "s bigint, passed bigint").select(at("s").alias("ts"), "passed").coalesce(1).write.mode("append").parquet(src)
        live = spark.readStream.schema(schema).parquet(src)
        SJ.stream_windows(SJ.activity_windows(live, width="1 hour"), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    got = SJ.read_batches(spark, str(tmp_path / "t"), "start timestamp, end timestamp, n bigint, passed bigint")
    assert rows(got.select(F.unix_seconds("start"), "n")) == [(0, 2), (3600, 1), (7200, 3)]
