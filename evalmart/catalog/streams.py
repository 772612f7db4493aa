"""The streaming jobs, run to the end of the tables, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from evalmart import adapters as A
from evalmart.catalog import ORACLES, query
from evalmart.catalog import analytics as AN, integrity as IG
from evalmart.session import checkpoint_dir
from evalmart.streaming import jobs as SJ


def place(spark, name):
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def finish(q):
    q.awaitTermination()


class _Streamed:
    """Session stand-in whose reader yields streams, so the batch adapters build streaming views."""

    def __init__(self, spark, d):
        self._spark, self._d = spark, d
        self.read = self

    def parquet(self, path):
        name = path.rsplit("/", 1)[1]
        schema = self._spark.read.parquet(path).schema
        return self._spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(self._d)


def streamed(spark, d, adapter):
    return adapter(_Streamed(spark, d), d)


@query("ss1_ingest", sql="""
SELECT 'good' AS side, concat('E', event_id) AS line_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '' AS codes FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 90
UNION ALL SELECT 'quarantine', concat('E', event_id), NULL, 'k_too_large' FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90
UNION ALL SELECT 'quarantine', concat('X', event_id), NULL, 'not_a_json_object' FROM events""")
def ss1_ingest(spark, d):
    e = streamed(spark, d, lambda s, p: A.table(s, p, "events"))
    both = F.array(F.struct(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("line_id"), F.col("props").alias("value")),
                   F.struct(F.concat(F.lit("X"), F.col("event_id").cast("string")).alias("line_id"), F.concat("props", "props").alias("value")))
    lines = e.select(F.explode(both).alias("l")).select("l.line_id", "l.value")
    good, bad, ck = place(spark, "good"), place(spark, "quarantine"), place(spark, "ck")
    rules = F.array_compact(F.array(F.when(F.col("k") >= 90, F.lit("k_too_large"))))
    finish(SJ.stream_log(lines, T.StructType([T.StructField("k", T.LongType())]), good, bad, ck, rules))
    g = SJ.read_batches(spark, good, "line_id string, k bigint").select(F.lit("good").alias("side"), "line_id", "k", F.lit("").alias("codes"))
    q = SJ.read_batches(spark, bad, "line_id string, value string, codes array<string>").select(
        F.lit("quarantine").alias("side"), "line_id", F.lit(None).cast("bigint").alias("k"), F.array_join("codes", ",").alias("codes"))
    return g.unionByName(q)


def _latest_schema(spark, d):
    return A.trials(spark, d).schema


@query("ss2_latest")
def ss2_latest(spark, d):
    log = streamed(spark, d, A.trials)
    target = place(spark, "latest")
    finish(SJ.stream_latest(log, target, place(spark, "ck")))
    columns = ["trial_key", *[c for c in log.columns if c != "trial_key"]]
    schema = T.StructType([_latest_schema(spark, d)[c] for c in columns])
    return SJ.current_latest(spark, target, schema).select(*[c for c in log.columns]).drop("ts")


ORACLES["ss2_latest"] = ORACLES["wn1_latest"]


SLICES = 2  # the stream is stopped and started again between them


def in_slices(spark, frame, name, slice_of, job, slices=SLICES):
    """Rows in order of their slice number, each slice a batch of its own after a restart of the job."""
    folder = place(spark, name)
    rows = frame.withColumn("_slice", slice_of).persist()
    try:
        for k in range(slices):
            rows.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(folder)
            finish(job(spark.readStream.schema(frame.schema).parquet(folder)))
    finally:
        rows.unpersist()


def by_ordinal(df, seq="seq", slices=SLICES):
    """Slice number by the place in the range of the ordinal."""
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    width = ((high or 0) - (low or 0)) // slices + 1
    return F.floor((F.col(seq) - F.lit(low or 0)) / width).cast("int")


@query("ss5_merge")
def ss5_merge(spark, d):
    log = A.trials(spark, d)
    twice = log.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1))))  # every record is delivered again in the last batch
    target, ck = place(spark, "merge"), place(spark, "ck")
    late = F.when(F.col("_again") == 1, SLICES - 1).otherwise(by_ordinal(log))
    in_slices(spark, twice, "log", late, lambda live: SJ.stream_merge(live.drop("_again"), target, ck))
    return SJ.current_latest(spark, target, log.schema).drop("ts")


ORACLES["ss5_merge"] = ORACLES["wn1_latest"]


@query("ss3_budget", "ledger", f""", {IG.LEDGER_SQL}
SELECT run_id, seq, bucket, CAST(spent AS DOUBLE) AS spent, before < 5000000 AND spent >= 5000000 AS tripped
FROM (SELECT *, unnest(range(CAST(floor(before / 300000) AS BIGINT) + 1, CAST(floor(spent / 300000) AS BIGINT) + 1)) AS bucket FROM led)
UNION ALL SELECT run_id, seq, NULL, CAST(spent AS DOUBLE), true FROM led WHERE before < 5000000 AND spent >= 5000000 AND floor(before / 300000) = floor(spent / 300000)""")
def ss3_budget(spark, d):
    ledger, alerts, ck = A.ledger(spark, d), place(spark, "alerts"), place(spark, "ck")
    in_slices(spark, ledger, "ledger", by_ordinal(ledger), lambda live: SJ.stream_budget(live, "300000", "5000000", alerts, ck))
    return SJ.read_batches(spark, alerts, SJ.ALERT).select("run_id", "seq", "bucket", F.col("spent").cast("double").alias("spent"), "tripped")


@query("ss4_reconcile")
def ss4_reconcile(spark, d):
    """Results arrive in log order; cases of odd ordinals come one batch after them, those of even ones before."""
    newest = AN.latest(spark, d).withColumn("model_id", F.col("model"))
    cases = newest.filter("output_tokens <> 13").withColumn("task_id", F.when(F.col("output_tokens") == 77, "other").otherwise(F.col("task_id")))
    budget = newest.filter("thoughts_tokens <> 3").withColumn(
        "input_tokens", F.when(F.col("output_tokens") == 50, F.col("input_tokens") + 1).otherwise(F.col("input_tokens")))
    results = A.trials(spark, d).withColumn("model_id", F.col("model"))
    columns = ["trial_key", "seq", "task_id", "model_id", "input_tokens", "output_tokens", "thoughts_tokens", "error_type"]
    told = lambda df, side: df.select(F.lit(side).alias("side"), *columns)
    both = told(results, "result").unionByName(told(cases, "case")).unionByName(told(budget, "budget"))
    slice_of = F.when(F.col("side") == "result", by_ordinal(results)).otherwise((F.col("seq") % SLICES).cast("int"))
    target, ck = place(spark, "reconcile"), place(spark, "ck")
    part = lambda live, side: live.filter(F.col("side") == side)
    in_slices(spark, both, "records", slice_of, lambda live: SJ.stream_reconcile(
        part(live, "result"), part(live, "case"), part(live, "budget"), ["model_id", "input_tokens", "output_tokens", "thoughts_tokens"], target, ck))
    return SJ.current_violations(spark, target)


ORACLES["ss4_reconcile"] = ORACLES["jn7_reconcile"]


def _epoch(df):
    return df.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@query("ss6_tumbling", "trials", """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, epoch_us(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR) AS "end", model, count(*) AS n, sum(passed) AS passed FROM trials GROUP BY ALL""")
def ss6_tumbling(spark, d):
    return _epoch(SJ.activity_windows(A.trials(spark, d), width="1 hour", by=["model"]))


@query("ss6_sliding", "trials", """
SELECT epoch_us(w) AS start, epoch_us(w + INTERVAL 1 HOUR) AS "end", count(*) AS n, sum(passed) AS passed
FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS w FROM trials) GROUP BY w""")
def ss6_sliding(spark, d):
    return _epoch(SJ.activity_windows(A.trials(spark, d), width="1 hour", slide="30 minutes"))


@query("ss6_session", "trials", """,
o AS (SELECT task_id, ts, passed, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM trials),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", task_id, count(*) AS n, sum(passed) AS passed FROM g GROUP BY task_id, s""")
def ss6_session(spark, d):
    return _epoch(SJ.activity_windows(A.trials(spark, d), gap="6 hours", by=["task_id"]))


# Of the first three tenths of the time, one row in ten is held back until the last slice, when the watermark is far beyond it.
LATE_SQL = """,
bounds AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM trials),
seen AS (SELECT trials.* FROM trials, bounds WHERE NOT (seq % 10 = 3 AND epoch_us(ts) < lo + (hi - lo) * 3 // 10)),
closed AS (SELECT hi - 600000000 AS mark FROM bounds)"""


def windows_on_a_stream(spark, d, by=(), **how):
    """Appended windows over slices in time order, with rows that come too late."""
    log = A.trials(spark, d).select("seq", "ts", "passed", "model", "task_id")
    at = F.unix_micros("ts")
    lo, hi = log.agg(F.min(at), F.max(at)).first()
    late = (F.col("seq") % 10 == 3) & (at < lo + (hi - lo) * 3 // 10)
    slice_of = F.when(late | (at >= lo + (hi - lo) * 6 // 10), 1).otherwise(0)
    target, ck = place(spark, "windows"), place(spark, "ck")
    in_slices(spark, log, "log", slice_of, lambda live: SJ.stream_windows(SJ.activity_windows(live, by=by, **how), target, ck))
    kinds = {"model": "string", "task_id": "string"}
    schema = ", ".join(["start timestamp", "end timestamp", *(f"{c} {kinds[c]}" for c in by), "n bigint", "passed bigint"])
    return _epoch(SJ.read_batches(spark, target, schema).drop("batch_id"))


@query("ss6_tumbling_stream", "trials", f"""{LATE_SQL}
SELECT start, start + 3600000000 AS "end", model, count(*) AS n, sum(passed) AS passed
FROM (SELECT *, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start FROM seen) WHERE start + 3600000000 <= (SELECT mark FROM closed) GROUP BY start, model""")
def ss6_tumbling_stream(spark, d):
    return windows_on_a_stream(spark, d, ["model"], width="1 hour")


@query("ss6_sliding_stream", "trials", f"""{LATE_SQL}
SELECT epoch_us(w) AS start, epoch_us(w + INTERVAL 1 HOUR) AS "end", count(*) AS n, sum(passed) AS passed
FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS w FROM seen) GROUP BY w HAVING "end" <= (SELECT mark FROM closed)""")
def ss6_sliding_stream(spark, d):
    return windows_on_a_stream(spark, d, width="1 hour", slide="30 minutes")


@query("ss6_session_stream", "trials", f"""{LATE_SQL},
o AS (SELECT task_id, ts, passed, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM seen),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", task_id, count(*) AS n, sum(passed) AS passed FROM g GROUP BY task_id, s HAVING "end" <= (SELECT mark FROM closed)""")
def ss6_session_stream(spark, d):
    return windows_on_a_stream(spark, d, ["task_id"], gap="6 hours")
