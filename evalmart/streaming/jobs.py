"""Streaming forms of the log operators.

What a job must remember of earlier batches is keyed state (``streaming.state``). Every job writes per micro-batch into ``batch_id=<n>`` folders of its tables and overwrites that folder only, so a
batch that is replayed after a restart replaces itself. Readers merge on read; nothing rewrites a whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from evalmart.operators.latest import latest_by_key
from evalmart.sources.logs import flag_lines
from evalmart.streaming.state import PROVIDER, ROCKSDB, NewestState, SpendState, TrialState


def write_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """Idempotent commit of one micro-batch."""
    batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def read_batches(spark: SparkSession, target: str, schema: T.StructType | str) -> DataFrame:
    """All committed batches with their ``batch_id``; an empty frame before the first one."""
    base = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*base.fields, T.StructField("batch_id", T.LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", target).parquet(target)


def run(stream: DataFrame, name: str, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append",
        available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_keyed(stream: DataFrame, *how, **options) -> StreamingQuery:
    """A job with arbitrary state, which only the RocksDB store keeps; a query reads the setting when it starts."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return run(stream, *how, **options)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def stream_log(lines: DataFrame, schema: T.StructType, good: str, quarantine: str, checkpoint: str,
               rules: Column | None = None, **how) -> StreamingQuery:
    """Lines (``value`` and any id columns) to a table of records; broken lines and records go to quarantine with codes."""
    def each(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c != "value"]
        flagged = flag_lines(batch)
        parsed = flagged.withColumn("record", F.when(F.col("ok") & F.col("_utf8"), F.from_json("value", schema)))
        broken = F.when(F.col("record").isNull(), F.array(F.lit("not_a_json_object")))
        checked = rules if rules is not None else F.array().cast("array<string>")
        state = parsed.select(*others, "value", "record.*", broken.alias("_broken")).withColumn(
            "codes", F.coalesce(F.col("_broken"), checked)).drop("_broken").persist()
        try:
            write_batch(state.filter(F.size("codes") == 0).drop("codes", "value"), batch_id, good)
            write_batch(state.filter(F.size("codes") > 0).select(*others, "value", "codes"), batch_id, quarantine)
        finally:
            state.unpersist()

    return run(lines, "log", checkpoint, each, **how)


def stream_latest(log: DataFrame, target: str, checkpoint: str, key: str = "trial_key", seq: str = "seq", **how) -> StreamingQuery:
    """Newest record per key as state; each batch commits the keys that changed. ``current_latest`` reads the table."""
    others = [c for c in log.columns if c != key]
    state = log.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row"))
    flat = state.select(key, *[F.col("_row")[c].alias(c) for c in others])
    return run(flat, "latest", checkpoint, lambda batch, batch_id: write_batch(batch, batch_id, target), "update", **how)


def current_latest(spark: SparkSession, target: str, schema: T.StructType, key: str = "trial_key", seq: str = "seq") -> DataFrame:
    return latest_by_key(read_batches(spark, target, schema).drop("batch_id"), key, seq)


def idempotent_merge(batch: DataFrame, batch_id: int, target: str, key: str = "trial_key", seq: str = "seq") -> None:
    """Commit the records of a batch that are newer than what earlier batches committed under their key."""
    spark = batch.sparkSession
    newest = latest_by_key(batch, key, seq)
    done = read_batches(spark, target, batch.schema).filter(F.col("batch_id") < batch_id)
    seen = done.join(newest.select(key), key, "left_semi").groupBy(key).agg(F.max(seq).alias("_seen"))
    fresh = newest.join(seen, key, "left").filter(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen"))).drop("_seen")
    write_batch(fresh.select(*batch.columns), batch_id, target)


def stream_merge(log: DataFrame, target: str, checkpoint: str, key: str = "trial_key", seq: str = "seq", **how) -> StreamingQuery:
    """Commit each record that is newer than all committed ones of its key, once; the highest ordinal per key is state."""
    keyed = log.filter(F.coalesce(F.col(key), F.lit("")) != "")
    fresh = keyed.groupBy(key).transformWithStateInPandas(NewestState(log.columns, seq), log.schema, "Append", "None")
    return run_keyed(fresh, "merge", checkpoint, lambda batch, batch_id: write_batch(batch, batch_id, target), **how)


ALERT = "run_id string, seq bigint, bucket bigint, spent decimal(38,6), tripped boolean"
VERDICT = "key string, seq bigint, codes array<string>"


def stream_budget(ledger: DataFrame, step, limit, alerts: str, checkpoint: str, **how) -> StreamingQuery:
    """Spend per run with an alert row per crossed step and a flag on the row that reaches the limit.

    The spend so far is one state value per run. A batch brings two integers per row to its run's task; bound it with the
    source's rate options where one run fills whole batches.
    """
    rows = ledger.select("run_id", "seq", (F.coalesce("cost_usd", F.lit(0)).cast("decimal(28,6)") * 1_000_000).cast("bigint").alias("micros"))
    found = rows.groupBy("run_id").transformWithStateInPandas(SpendState(step, limit), ALERT, "Append", "None")
    return run_keyed(found, "budget", checkpoint, lambda batch, batch_id: write_batch(batch, batch_id, alerts), **how)


def stream_reconcile(results: DataFrame, cases: DataFrame, budget: DataFrame, fields: Sequence[str], target: str, checkpoint: str,
                     key: str = "trial_key", seq: str = "seq", committed: str = "error_type <> 'api_error'",
                     patience_ms: int | None = None, **how) -> StreamingQuery:
    """Violations of the commit order: a result whose case or budget row has not arrived, or disagrees.

    Three streams meet as state per trial; whenever one of its records moves, the trial's codes are written anew (none when
    all is well). ``current_violations`` reads the newest. ``patience_ms`` holds a missing record back that long.
    """
    columns = ["task_id", *fields]

    def side(df: DataFrame, name: str, there: Column) -> DataFrame:
        own = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in columns]
        return df.select(F.col(key).alias("key"), F.lit(name).alias("side"), F.col(seq).cast("bigint").alias("seq"), there.alias("there"), F.array(*own).alias("row"))

    yes = F.lit(True)
    both = side(results, "result", F.coalesce(F.expr(committed), F.lit(False))).unionByName(side(cases, "case", yes)).unionByName(side(budget, "budget", yes))
    mode = "None" if patience_ms is None else "ProcessingTime"
    judged = both.filter("key <> ''").groupBy("key").transformWithStateInPandas(TrialState(fields, patience_ms), VERDICT, "Update", mode)
    return run_keyed(judged, "reconcile", checkpoint, lambda batch, batch_id: write_batch(batch, batch_id, target), mode="update", **how)


def current_violations(spark: SparkSession, target: str) -> DataFrame:
    """code, key of the newest judgement of each trial."""
    newest = latest_by_key(read_batches(spark, target, VERDICT), "key", "batch_id", columns=["codes"])
    return newest.select(F.explode("codes").alias("code"), "key")


def activity_windows(df: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, gap: str | None = None,
                     lateness: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Activity per tumbling, sliding or session window; on a stream, rows later than the watermark are dropped."""
    if gap and not df.isStreaming:
        return _batch_sessions(df, ts, gap, by)
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    frame = F.session_window(ts, gap) if gap else F.window(ts, width, slide)
    return timed.groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "passed")


def stream_windows(windows: DataFrame, target: str, checkpoint: str, **how) -> StreamingQuery:
    """Append every window once, when the watermark has passed its end; rows that come later still are dropped."""
    return run(windows, "windows", checkpoint, lambda batch, batch_id: write_batch(batch, batch_id, target), **how)


def _batch_sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str]) -> DataFrame:
    """Sessions of a table. Rows of one gap-long slot always share a session, so they are combined in each task
    first; a key with very many rows then has one row per slot."""
    length = F.expr(f"unix_micros(timestamp_seconds(0) + interval {gap})")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = df.groupBy(*by, F.floor(at / length).alias("_slot")).agg(
        F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"))
    w = Window.partitionBy(*by).orderBy("_slot")
    fresh = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) > length).cast("int"), F.lit(1))
    numbered = slots.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(w))
    return numbered.groupBy(*by, "_session").agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("n").alias("n"), F.sum("passed").alias("passed")
    ).select(F.timestamp_micros("_lo").alias("start"), F.timestamp_micros(F.col("_hi") + length).alias("end"), *by, "n", "passed")
