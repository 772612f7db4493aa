"""Same-task comparisons of two conditions: pairing, exact test, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evalmart.functions.numeric import display_percent, mcnemar_exact, ratio, stable_seed
from evalmart.session import dealt

# Fixed value: bootstrap replicates of a published comparison.
ITERATIONS = 5000
DRAW_BLOCK, DRAW_CELL = 2**20, 2**14  # draws of one block, and of one pass over arrays that fit a cache
# The constants of md5.
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def condition_columns(metrics: DataFrame, conditions: Sequence[str], keys: Sequence[str] = ("model", "task_id")):
    """One row per key with a 0/1 column per condition; null where the cell is absent. One shuffle, no join."""
    return metrics.filter(F.col("condition").isin(list(conditions))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("condition") == c, F.col("passed"))).alias(c) for c in conditions]
    )


def common_tasks(metrics: DataFrame, conditions: Sequence[str], keys: Sequence[str] = ("model", "family", "task_id")):
    """Tasks that have a record under every condition."""
    wide = condition_columns(metrics, conditions, keys)
    complete = F.lit(True)
    for c in conditions:
        complete = complete & F.col(c).isNotNull()
    return wide.filter(complete)


def pair_outcomes(metrics: DataFrame, subsets: DataFrame, comparisons: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Treatment and comparator outcome per comparison, model and task of its subset.

    ``comparisons`` are (subset, treatment, comparator). A task of the subset that lacks a side has a null there.
    """
    rows = metrics.join(subsets, "task_id")
    side = F.array_compact(F.array(*[
        F.when((F.col("subset") == s) & F.col("condition").isin(t, c), F.struct(
            F.lit(s).alias("scope"), F.lit(t).alias("treatment"), F.lit(c).alias("comparator"),
            (F.col("condition") == t).alias("is_treatment"),
        )) for s, t, c in comparisons
    ]))
    one = rows.select("model", "task_id", "passed", F.explode(side).alias("s"))
    return one.groupBy(
        F.col("s.scope").alias("subset"), F.col("s.treatment").alias("treatment"),
        F.col("s.comparator").alias("comparator"), "model", "task_id",
    ).agg(
        F.max(F.when(F.col("s.is_treatment"), F.col("passed"))).alias("t"),
        F.max(F.when(~F.col("s.is_treatment"), F.col("passed"))).alias("c"),
    )


def incomplete_pairs(pairs: DataFrame, subsets: DataFrame) -> DataFrame:
    """Comparisons whose pairs do not cover their subset on both sides."""
    sizes = subsets.groupBy("subset").agg(F.count_distinct("task_id").alias("expected"))
    covered = pairs.groupBy("subset", "treatment", "comparator", "model").agg(
        F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull()).alias("complete")
    )
    return covered.join(sizes, "subset").filter("complete <> expected")


def pair_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of a comparison over its complete pairs; all later statistics need only these."""
    done = pairs.filter(F.col("t").isNotNull() & F.col("c").isNotNull())
    return done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").cast("bigint").alias("treatment_passed"),
        F.sum("c").cast("bigint").alias("comparator_passed"),
        F.count_if(F.col("t") > F.col("c")).alias("treatment_only"),
        F.count_if(F.col("t") < F.col("c")).alias("comparator_only"),
    )


def _heads(seed: int | None, its: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Leading 32 bits of md5 of ``seed|it|draw`` for every iteration and draw; each array's numbers have equally many digits.

    Such a text is one block of a digest, so that numpy takes each step for all texts at once.
    """
    parts = [] if seed is None else [np.frombuffer(str(seed).encode(), np.uint8)[None, :]]
    digits = [x[:, None] // 10 ** np.arange(len(str(x[0])) - 1, -1, -1, dtype=np.int64) % 10 + 48 for x in (its, draws)]
    head = [np.broadcast_to(c, (len(its), c.shape[1])) for p in parts for c in (p, np.full((1, 1), 124))]
    rows, bar = np.zeros((len(its), 64), np.uint8), np.full((len(its), 1), 124)
    fixed = np.hstack([*head, digits[0], bar])
    start, end = fixed.shape[1], fixed.shape[1] + digits[1].shape[1]
    rows[:, :start], rows[:, end] = fixed, 128
    rows[:, 56:58] = [end * 8 % 256, end * 8 // 256]
    columns = np.zeros((len(draws), 64), np.uint8)
    columns[:, start:end] = digits[1]
    left, right = rows.view("<u4").T, columns.view("<u4").T
    words = [(x[:, None] | y[None, :]).ravel() if y.any() else np.repeat(x, len(draws)) if x.any() else None for x, y in zip(left, right, strict=True)]
    size = len(its) * len(draws)
    a, b, c, d = (np.full(size, v, np.uint32) for v in MD5_START)
    t, u = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three steps leave the leading word as it is
        if i < 32:  # round two is round one with other roles
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=t)
            np.bitwise_and(t, x, out=t)
            np.bitwise_xor(t, z, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        np.add(t, MD5_SINES[i], out=t)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        if word is not None:
            np.add(t, word, out=t)
        turn = MD5_TURNS[i // 16][i % 4]
        np.right_shift(t, np.uint32(32 - turn), out=u)
        np.left_shift(t, np.uint32(turn), out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(MD5_START[0])).byteswap()


def _equally_long(first: int, last: int) -> Iterator[tuple[int, int]]:
    """The range in parts whose numbers have equally many digits."""
    while first <= last:
        end = min(last, 10 ** len(str(first)) - 1)
        yield first, end
        first = end + 1


def _drawn(seed: int | None, n: int, up: int, either: int, its: tuple[int, int], draws: tuple[int, int]) -> np.ndarray:
    """Sum of the differences drawn per iteration."""
    sums = np.zeros(its[1] - its[0] + 1, np.int64)
    for d0, d1 in _equally_long(*draws):
        for a in range(d0, d1 + 1, DRAW_CELL):
            numbers = np.arange(a, min(a + DRAW_CELL, d1 + 1), dtype=np.int64)
            step = max(1, DRAW_CELL // len(numbers))
            for i0, i1 in _equally_long(*its):
                for i in range(i0, i1 + 1, step):
                    some = np.arange(i, min(i + step, i1 + 1), dtype=np.int64)
                    index = _heads(seed, some, numbers)
                    if n < 2**32:
                        index -= index // np.uint32(n) * np.uint32(n)
                    index = index.reshape(len(some), len(numbers))
                    sums[i - its[0]:i - its[0] + len(some)] += 2 * np.count_nonzero(index < up, axis=1) - np.count_nonzero(index < either, axis=1)
    return sums


@F.pandas_udf(T.ArrayType(T.LongType()))
def _draw_sums(blocks: pd.DataFrame) -> pd.Series:
    """Per block (seed, n, up, down, iterations and draws from and to): the sum of each iteration."""
    return pd.Series([_drawn(None if r[0] is None else int(r[0]), int(r[1]), int(r[2]), int(r[2]) + int(r[3]), (int(r[4]), int(r[5])), (int(r[6]), int(r[7])))
                      for r in blocks.astype(object).where(blocks.notna(), None).itertuples(index=False)], dtype=object)


def bootstrap_by_draws(counts: DataFrame, keys: Sequence[str], seed: Column, iterations: int = ITERATIONS) -> DataFrame:
    """Interval of the mean difference with every draw taken from a digest, so any engine can repeat it.

    Work is iterations x n digests. They are dealt out over the executors in blocks of equal work and counted in arrays there;
    the number of partitions is given, as blocks are too small in bytes to be left to Spark's sizes.
    """
    base = counts.select(*keys, "n", "treatment_only", "comparator_only", seed.cast("string").alias("_seed")).filter("n > 0")
    base = base.withColumn("_its", F.expr(f"cast(greatest(1L, least({iterations}L, {DRAW_BLOCK}L div n)) as int)"))
    blocks = base.withColumn("_from", F.explode(F.expr(f"sequence(1, {iterations}, _its)"))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {DRAW_BLOCK}L"))))
    blocks = dealt(blocks)
    sums = _draw_sums(F.struct(
        "_seed", "n", "treatment_only", "comparator_only", F.col("_from").alias("_first"), F.least(F.col("_from") + F.col("_its") - 1, F.lit(iterations)).alias("_last"),
        (F.col("_block") * DRAW_BLOCK + 1).alias("_low"), F.least(F.col("n"), (F.col("_block") + 1) * DRAW_BLOCK).alias("_high")))
    # the outer form, because the other one makes a filter that computes the sums once more, before blocks are dealt out
    drawn = blocks.select(*keys, "n", "_from", sums.alias("_sums")).select(*keys, "n", "_from", F.posexplode_outer("_sums").alias("_at", "_s"))
    means = drawn.groupBy(*keys, (F.col("_from") + F.col("_at")).alias("_it"), "n").agg(F.sum("_s").alias("_s")).withColumn(
        "_mean", 100 * F.col("_s") / F.col("n"))
    return _percentiles(means, keys)


def bootstrap_by_counts(counts: DataFrame, keys: Sequence[str], seed: Column, iterations: int = ITERATIONS) -> DataFrame:
    """The same interval at any size: a replicate is one multinomial over the three difference counts."""
    base = counts.filter("n > 0").select(
        *keys, F.col("n").cast("bigint").alias("n"), F.col("treatment_only").cast("bigint").alias("_up"),
        F.col("comparator_only").cast("bigint").alias("_down"), seed.cast("bigint").alias("_seed"))
    size = 500
    blocks = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // size))))
    schema = T.StructType([*[base.schema[k] for k in keys], T.StructField("_mean", T.DoubleType())])
    names = list(keys)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                n = int(row["n"])
                reps = min(size, iterations - int(row["_block"]) * size)
                rng = np.random.default_rng([int(row["_seed"]), int(row["_block"])])
                up, down = row["_up"] / n, row["_down"] / n
                got = rng.multinomial(n, [up, down, max(0.0, 1.0 - up - down)], size=reps)
                out = pd.DataFrame({"_mean": 100.0 * (got[:, 0] - got[:, 1]) / n})
                for name in names:
                    out[name] = row[name]
                yield out[[*names, "_mean"]]

    return _percentiles(blocks.repartition("_seed", "_block").mapInPandas(draw, schema), keys)


def _percentiles(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    return means.groupBy(*keys).agg(
        F.round(F.percentile("_mean", F.lit(0.025)), 6).alias("low_pp"),
        F.round(F.percentile("_mean", F.lit(0.975)), 6).alias("high_pp"),
    )


def paired_tests(metrics: DataFrame, subsets: DataFrame, comparisons: Sequence[tuple[str, str, str]],
                 iterations: int = ITERATIONS, exact_draws: bool = False) -> DataFrame:
    """Report rows: counts, rates, difference, exact p, bootstrap interval and its seed."""
    keys = ["subset", "treatment", "comparator", "model"]
    counts = pair_counts(pair_outcomes(metrics, subsets, comparisons), keys).withColumn(
        "seed", stable_seed(F.col("subset"), F.col("model"), F.col("treatment"), F.col("comparator")))
    bootstrap = bootstrap_by_draws if exact_draws else bootstrap_by_counts
    interval = bootstrap(counts, keys, F.col("seed"), iterations)
    return counts.join(interval, keys).select(
        *keys, "n", "treatment_passed", "comparator_passed",
        display_percent(F.col("treatment_passed"), F.col("n")).alias("treatment_percent"),
        display_percent(F.col("comparator_passed"), F.col("n")).alias("comparator_percent"),
        F.round(100 * ratio(F.col("treatment_passed") - F.col("comparator_passed"), F.col("n")), 6).alias("delta_pp"),
        "low_pp", "high_pp", "treatment_only", "comparator_only",
        F.round(mcnemar_exact(F.col("treatment_only"), F.col("comparator_only")), 8).alias("mcnemar_p"), "seed",
    )
