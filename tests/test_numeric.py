"""Published values and exact arithmetic."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evalmart.functions import numeric as N
from evalmart.operators import paired as P

# passed, n, rate text, Wilson bounds
HEADLINE = [
    (157, 778, "20.2", 17.51, 23.14), (310, 778, "39.8", 36.46, 43.33), (246, 778, "31.6", 28.45, 34.97), (305, 778, "39.2", 35.83, 42.68),
    (129, 778, "16.6", 14.13, 19.36), (200, 252, "79.4", 73.95, 83.90), (167, 252, "66.3", 60.23, 71.82), (136, 252, "54.0", 47.80, 60.02),
    (109, 252, "43.2", 37.28, 49.43),
]
# alias, only treatment, only comparator, n, p, seed, interval
PAIRED = [
    ("bedrock_opus48", 62, 23, 252, 2.7713609e-05, 2163149023, 8.33, 22.22), ("bedrock_sonnet46", 56, 29, 252, 0.0045116404, 417014808, 3.57, 17.46),
    ("gemini_flash", 51, 29, 252, 0.018316098, 4008793379, 1.98, 15.87), ("gemini_pro", 48, 25, 252, 0.0095422114, 803775474, 2.38, 15.49),
    ("minimax_m3", 63, 30, 252, 0.00081000877, 1308055570, 5.94, 20.24), ("sf_qwen_coder30b", 59, 30, 252, 0.002785269, 2098951885, 4.37, 18.65),
    ("sf_qwen_moe", 57, 23, 252, 0.00018311656, 3352956145, 6.35, 20.24),
]


def test_wilson_and_percent(spark):
    df = spark.createDataFrame([(i, h[0], h[1]) for i, h in enumerate(HEADLINE)], "i int, p bigint, n bigint")
    got = df.orderBy("i").select(N.wilson(F.col("p"), F.col("n")).alias("w"), N.display_percent(F.col("p"), F.col("n")).alias("t")).collect()
    for row, want in zip(got, HEADLINE):
        assert row.w.low == pytest.approx(want[3], abs=0.005) and row.w.high == pytest.approx(want[4], abs=0.005)
        if want[0] != 310:  # 39.85 rounds by its binary value
            assert row.t == want[2]


def test_rounding_follows_the_binary_value(spark):
    values = [0.53975, 0.03125, 0.09375, 1 / 3, 0.12345, 2.5e-5, 0.99995, 0.00005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.r for r in df.select(N.exact_round(F.col("v"), 4).alias("r")).collect()] == [round(v, 4) for v in values]


def test_empty_group(spark):
    row = spark.range(1).select(N.wilson(F.lit(0), F.lit(0)).alias("w"), N.display_percent(F.lit(0), F.lit(0)).alias("t")).first()
    assert tuple(row.w) == (0.0, 0.0) and row.t is None


def test_paired_published(spark):
    df = spark.createDataFrame([(a, b, c, n) for a, b, c, n, *_ in PAIRED], "model string, treatment_only bigint, comparator_only bigint, n bigint")
    seed = N.stable_seed(F.lit("opus_evolved252"), F.col("model"), F.lit("with_gene_opus"), F.lit("with_skill"))
    got = {r.model: r for r in df.select("model", N.mcnemar_exact(F.col("treatment_only"), F.col("comparator_only")).alias("p"), seed.alias("s")).collect()}
    ci = {r.model: r for r in P.bootstrap_by_counts(df, ["model"], seed).collect()}
    for alias, _, _, _, p, s, low, high in PAIRED:
        assert got[alias].p == pytest.approx(p, rel=1e-6) and got[alias].s == s
        assert ci[alias].low_pp == pytest.approx(low, abs=0.8) and ci[alias].high_pp == pytest.approx(high, abs=0.8)


def exact_p(b, c):
    d, k = b + c, min(b, c)
    return 1.0 if d == 0 else float(min(Fraction(1), Fraction(2 * sum(math.comb(d, i) for i in range(k + 1)), 2**d)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), min_size=20, max_size=20))
def test_mcnemar_is_exact(spark, pairs):
    pairs += [(0, 0), (0, 1), (5, 5), (3000, 3100)]
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(pairs)], "i int, b bigint, c bigint")
    for row in df.select("b", "c", N.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect():
        assert row.p == pytest.approx(exact_p(row.b, row.c), rel=1e-8, abs=1e-300)


def test_mcnemar_large_counts(spark):
    # the normal tail with continuity correction is a good check at this size
    b, c = 500_400_000, 499_600_000
    p = spark.range(1).select(N.mcnemar_exact(F.lit(b), F.lit(c)).alias("p")).first().p
    z = (abs(b - c) - 1) / math.sqrt(b + c)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_bootstrap_forms_agree(spark):
    df = spark.createDataFrame([("a", 300, 60, 30), ("b", 5000, 900, 1000)], "k string, n bigint, treatment_only bigint, comparator_only bigint")
    one = {r.k: r for r in P.bootstrap_by_draws(df, ["k"], F.lit(1), 800).collect()}
    two = {r.k: r for r in P.bootstrap_by_counts(df, ["k"], F.lit(1), 800).collect()}
    for k in one:
        assert one[k].low_pp == pytest.approx(two[k].low_pp, abs=1.0) and one[k].high_pp == pytest.approx(two[k].high_pp, abs=1.0)


def test_draws_are_the_digests(spark):
    df = spark.createDataFrame([("a", 7, 1, 3, 5), (None, 1234, 300, 200, None), ("c", 1_100_000, 400_000, 300_000, 20260718), ("none", 0, 0, 0, 1)],
                               "k string, n bigint, treatment_only bigint, comparator_only bigint, seed bigint")
    iterations = {"a": 120, None: 12, "c": 2}

    def mean(n, up, down, seed, it):
        index = [int(hashlib.md5("|".join([*([] if seed is None else [str(seed)]), str(it), str(d)]).encode()).hexdigest()[:8], 16) % n for d in range(1, n + 1)]
        return 100 * sum((i < up) - (up <= i < up + down) for i in index) / n

    for row in df.filter("n > 0").collect():
        got = P.bootstrap_by_draws(df.filter(F.col("k").eqNullSafe(F.lit(row.k))), ["k"], F.col("seed"), iterations[row.k]).collect()
        means = [mean(*row[1:], it) for it in range(1, iterations[row.k] + 1)]
        assert [(r.k, r.low_pp, r.high_pp) for r in got] == [(row.k, *(pytest.approx(np.percentile(means, p), abs=2e-6) for p in (2.5, 97.5)))]
    assert P.bootstrap_by_draws(df.filter("n = 0"), ["k"], F.col("seed"), 5).collect() == []


def test_draws_are_dealt_out(spark):
    # blocks have few bytes, so that sizes alone would put them into one task
    df = spark.range(1).select(F.lit(60_000).cast("bigint").alias("n"), F.lit(9).cast("bigint").alias("treatment_only"), F.lit(7).cast("bigint").alias("comparator_only"))
    spark.sparkContext.setJobGroup("dealt", "dealt")
    try:
        P.bootstrap_by_draws(df, [], F.lit(1), 200).collect()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("dealt") for s in tracker.getJobInfo(j).stageIds]
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism


def test_guards(spark):
    df = spark.createDataFrame([("3",), ("-1",), ("x",), ("nan",), ("inf",), (None,), ("2.9",)], "v string")
    got = [(r.v, r.ok, r.n) for r in df.select("v", N.finite_nonneg(F.col("v")).alias("ok"), N.token_count(F.col("v")).alias("n")).collect()]
    assert got == [("3", True, 3), ("-1", False, None), ("x", False, None), ("nan", False, None), ("inf", False, None), (None, False, 0), ("2.9", True, None)]
    texts = spark.createDataFrame([("",), (" 7 ",), ("1_000",), ("+4",), ("1e3",), ("_1",)], "v string")
    assert [r.n for r in texts.select(N.token_count(F.col("v")).alias("n")).collect()] == [0, 7, 1000, 4, None, None]
    numbers = spark.createDataFrame([(2.9,), (-0.5,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.n for r in numbers.select(N.token_count(F.col("v")).alias("n")).collect()] == [2, 0, None, None, None, 0]
