"""Selection against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from evalmart.operators import sampling as SA, selection as SL


def percentile(values, p):
    ordered = sorted(values)
    at = (len(ordered) - 1) * p
    low = int(at)
    return float(ordered[low]) if at == low else float(ordered[low]) * (1 - (at - low)) + float(ordered[low + 1]) * (at - low)


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,4)"])
def test_percentiles(spark, kind):
    rng = random.Random(7)
    data = [("hot", rng.randint(-10**12, 10**12)) for _ in range(4000)] + [("ties", rng.choice([1, 1, 1, 2, 9])) for _ in range(500)]
    data += [("one", 5), ("pair", 1), ("pair", 2), (None, 3), (None, 4), ("null", None), ("close", 10**15), ("close", 10**15 + 1), ("close", 10**15 + 2)]
    df = spark.createDataFrame(data, "g string, v bigint").select("g", (F.col("v").cast(kind) / (1 if kind == "bigint" else F.lit(8).cast(kind))).cast(kind).alias("v")).repartition(5)
    wanted = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}
    groups = {}
    for r in df.collect():
        if r.v is not None:
            groups.setdefault(r.g, []).append(r.v)
    got = {r.g: r for r in SL.exact_percentiles(df, ["g"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in wanted.items():
            assert got[g][name] == pytest.approx(percentile(values, p), rel=1e-12)
    assert SL.exact_percentiles(df.filter("v IS NULL"), ["g"], "v", wanted).collect() == []


def test_percentiles_of_extreme_doubles(spark):
    values = [10.0**k for k in range(-300, 301, 3)] + [-1.7e308, 1.7e308, 5e-324, 1.0, 1.0000000000000002]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (0.1, 0.5, 0.77):
        assert SL.exact_percentiles(df, [], "v", {"p": p}).first().p == pytest.approx(percentile(values, p), rel=1e-12)


@pytest.mark.parametrize("n", [1, 10, 900, 5000])
def test_first_rows_by_digest(spark, n):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("g").alias("g"), F.col("id").cast("string").alias("id"))
    by_digest = df.withColumn("d", F.sha2(F.concat_ws("|", F.lit("4"), "id"), 256)).collect()
    want = []
    for g in ("hot", "g", None):
        want += [r.id for r in sorted((r for r in by_digest if r.g == g), key=lambda r: (r.d, r.id))[:n]]
    assert sorted(r.id for r in SA.cap_per_group(df, "g", "id", n, 4).collect()) == sorted(want)
    assert [r.id for r in sorted(by_digest, key=lambda r: (r.d, r.id))[:n]] == [r.id for r in SA.sample_n(df, "id", n, 4).withColumn("d", F.sha2(F.concat_ws("|", F.lit("4"), "id"), 256)).orderBy("d", "id").collect()]


def test_nth_by_ordinal(spark, rows):
    df = spark.createDataFrame([("a", k * 10**12) for k in range(50)] + [("b", -k) for k in range(5)], "g string, o bigint")
    assert rows(SL.nth_by_ordinal(df, ["g"], "o", 3, width=7)) == [("a", 2 * 10**12), ("b", -2)]
    assert rows(SL.nth_by_ordinal(df, ["g"], "o", 50)) == [("a", 49 * 10**12)]
