"""Ordered operators with one hot group, small chunks and different partitionings."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalmart.operators import budget as B, joins as J, latest as L, prefix as X, sampling as S


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    data = [(seq, "hot" if seq % 3 == 0 else rng.choice(["a", "b", None]), rng.randint(0, 9)) for seq in range(-50, 900)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "seq bigint, g string, v bigint")


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
@pytest.mark.parametrize("partitions", [1, 5])
def test_running_total(hot, width, partitions):
    data, df = hot
    want, total = {}, defaultdict(int)
    for seq, g, v in sorted(data):
        want[seq] = (total[g] + v, total[g])
        total[g] += v
    out = X.running_total(df.repartition(partitions), ["g"], "seq", F.col("v"), "r", width, keep_previous="p")
    assert {r.seq: (r.r, r.p) for r in out.collect()} == want


def test_running_total_of_sparse_keys(spark):
    """Keys far apart: every row is a chunk of its own, and chunks of chunks bound each window."""
    keys = [0, 5, -(1 << 62), 1 << 62, *(k * 10**9 for k in range(-40, 300)), *(k * 10**15 for k in range(2, 60))]
    df = spark.createDataFrame([(k, "g" if k % 2 == 0 else "h") for k in keys], "seq bigint, g string").repartition(5).dropDuplicates()
    got = {r.seq: r.rank for r in X.running_count(df, ["g"], "seq").collect()}
    want = {k: i for odd in (0, 1) for i, k in enumerate(sorted(k for k in set(keys) if k % 2 == odd), 1)}
    assert got == want


def test_ordered_rank_spreads_a_hot_group(spark, hot):
    data, df = hot
    named = df.withColumn("id", F.concat(F.lit("k"), F.col("seq").cast("string"))).withColumn("g", F.coalesce("g", F.lit("none")))
    out = {r.id: r.rank for r in X.ordered_rank(named, ["g"], ["id"], partitions=6).collect()}
    want, by = {}, defaultdict(list)
    for seq, g, _ in data:
        by[g or "none"].append(f"k{seq}")
    for ids in by.values():
        want.update({k: i + 1 for i, k in enumerate(sorted(ids))})
    assert out == want
    alone = {r.id: r.rank for r in X.ordered_rank(named, [], ["id"], partitions=4).collect()}
    assert alone == {k: i + 1 for i, k in enumerate(sorted(want))}


@pytest.mark.parametrize("few", [0, 100_000])
def test_ordered_rank_gathers_no_group(spark, rows, hot, monkeypatch, few):
    # a group over several range partitions must not meet in one task, neither among few groups nor among many; null is a group
    data, df = hot
    monkeypatch.setattr(X, "FEW_GROUPS", few, raising=False)
    named = df.withColumn("g", F.when(F.col("seq") > 870, F.concat(F.lit("lone"), F.col("seq").cast("string"))).otherwise(F.col("g")))
    ranked = X.ordered_rank(named, ["g"], ["seq"], partitions=5)
    assert ranked.columns == ["seq", "g", "v", "rank"]
    by = defaultdict(list)
    for r in sorted(named.collect(), key=lambda r: r.seq):
        by[r.g].append((r.seq, r.g, r.v, len(by[r.g]) + 1))
    assert rows(ranked) == sorted((t for group in by.values() for t in group), key=repr)
    if few:
        assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_latest_is_idempotent_and_ignores_partitioning(spark, rows, hot):
    _, df = hot
    log = df.withColumn("trial_key", F.coalesce("g", F.lit("")))
    once = L.latest_by_key(log)
    assert rows(once) == rows(L.latest_by_key(once)) == rows(L.latest_by_key(log.repartition(7)))
    assert {r.trial_key for r in once.collect()} == {"hot", "a", "b"}
    with pytest.raises(Exception, match="missing trial_key"):
        L.latest_by_key(log, on_missing="fail").collect()


def test_completed_then_api_error(spark, rows):
    log = spark.createDataFrame([("k1", 1, "success"), ("k1", 2, "api_error"), ("k2", 3, "api_error")], "trial_key string, seq bigint, error_type string")
    grid = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "trial_key string")
    assert rows(L.plan_resume(grid, log)) == [("k2", "retry_api_error"), ("k3", "never_tried")]
    assert {r.trial_key: r.error_type for r in L.latest_by_key(log).collect()}["k1"] == "api_error"


def test_budget_small_chunks(spark, rows):
    data = [(i, "r1" if i % 4 else "r2", f"{i % 7}.500000") for i in range(1, 200)]
    df = spark.createDataFrame(data, "seq bigint, run_id string, cost string").withColumn("cost_usd", F.col("cost").cast("decimal(18,6)"))
    wide, narrow = B.budget_alerts(df, "10"), B.budget_alerts(df, "10", width=3)
    assert rows(wide) == rows(narrow)
    states = {r.state: r.n for r in B.budget_breaker(df, "100", width=5).filter("run_id = 'r1'").groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert states["trip"] == 1 and states["after"] > 0
    stored = B.with_cumulative(df, width=4).withColumn("stored", F.col("spent"))
    assert B.check_ledger(stored.select("seq", "run_id", "cost_usd", "stored"), "stored", width=11).count() == 0
    # several steps crossed by one row give one alert each, none when nothing is crossed
    jump = spark.createDataFrame([(1, "r", 5), (2, "r", 30), (3, "r", 1)], "seq bigint, run_id string, c int").withColumn("cost_usd", F.col("c").cast("decimal(18,6)"))
    assert [(r.seq, r.bucket) for r in B.budget_alerts(jump, "10").orderBy("bucket").collect()] == [(2, 1), (2, 2), (2, 3)]


def test_stop_at_target_matches_a_loop(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("abc"), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(data, "seq bigint, family string, ok boolean")
    for n in (1, 4, 500):
        got, want, counts = sorted(r.seq for r in J.stop_at_target(df, "family", "seq", F.col("ok"), n).collect()), [], defaultdict(int)
        for seq, family, ok in data:
            if all(counts[f] >= n for f in "abc"):
                break
            if counts[family] >= n:
                continue
            want.append(seq)
            counts[family] += ok
        assert got == want


def test_fit_budget_and_caps(spark, rows):
    df = spark.createDataFrame([("t", 1, "abcd"), ("t", 2, "efgh"), ("t", 3, "ij"), ("u", 1, "xy")], "task string, pos bigint, text string")
    assert rows(S.fit_budget(df, ["task"], "pos", 6, width=1), "task", "pos", "snippet") == [("t", 1, "abcd"), ("t", 2, "ef"), ("u", 1, "xy")]
    ids = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 70, "hot").otherwise("cold").alias("g"))
    capped = S.cap_per_group(ids, "g", "id", 5, 9)
    assert rows(capped) == rows(S.cap_per_group(ids.repartition(6), "g", "id", 5, 9)) and capped.count() == 10
    assert rows(S.cap_per_group(ids, "g", "id", 0, 9)) == rows(ids)


def test_ranks_of_a_cap_stay_inside_digest_chunks(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("g"))
    plan = S.cap_per_group(ids, "g", "id", 5, 9)._jdf.queryExecution().executedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number" in line and "windowspecdefinition" in line]
    assert ranks and all("windowspecdefinition(_chunk#" in line for line in ranks)


def test_replace_stage(spark):
    row = spark.range(1).select(L.replace_stage(
        F.array(F.struct(F.lit("a").alias("stage"), F.lit(1).alias("x")), F.struct(F.lit("b").alias("stage"), F.lit(2).alias("x"))), "a",
        F.struct(F.lit("a").alias("stage"), F.lit(9).alias("x"))).alias("s")).first()
    assert [tuple(s) for s in row.s] == [("b", 2), ("a", 9)]
