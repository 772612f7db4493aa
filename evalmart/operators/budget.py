"""Budget ledgers: running cost, alerts, circuit breaker. A run may hold most of the ledger; see ``prefix``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalmart.operators.prefix import DEFAULT_WIDTH, running_total


def with_cumulative(df: DataFrame, run: str = "run_id", seq: str = "seq", cost: str = "cost_usd",
                    width: int = DEFAULT_WIDTH, out: str = "spent") -> DataFrame:
    """Spend after (``spent``) and before (``before``) each row, in exact decimals."""
    return running_total(df, [run], seq, F.col(cost).cast("decimal(28,6)"), out, width, keep_previous="before")


def check_ledger(df: DataFrame, cumulative: str, run: str = "run_id", seq: str = "seq", cost: str = "cost_usd",
                 width: int = DEFAULT_WIDTH) -> DataFrame:
    """Rows whose stored running total is not the recomputed one, or whose cost is negative."""
    rows = with_cumulative(df, run, seq, cost, width)
    code = F.when(F.col(cost) < 0, "negative_cost").when(
        F.col(cumulative).isNotNull() & (F.col(cumulative) != F.col("spent")), "cumulative_mismatch")
    return rows.withColumn("code", code).filter("code IS NOT NULL")


def budget_alerts(df: DataFrame, step, run: str = "run_id", seq: str = "seq", cost: str = "cost_usd",
                  width: int = DEFAULT_WIDTH) -> DataFrame:
    """One row per multiple of ``step`` that the spend of a run crosses."""
    rows = with_cumulative(df, run, seq, cost, width)
    step_text = f"CAST('{step}' AS DECIMAL(28,6))"
    rows = rows.withColumn("_old", F.expr(f"before div {step_text}")).withColumn("_new", F.expr(f"spent div {step_text}"))
    crossed = rows.filter("_new > _old").withColumn("bucket", F.explode(F.sequence(F.col("_old") + 1, F.col("_new"))))
    return crossed.select(run, seq, "bucket", (F.col("bucket") * F.expr(step_text)).alias("threshold"), "spent")


def budget_breaker(df: DataFrame, limit, run: str = "run_id", seq: str = "seq", cost: str = "cost_usd",
                   width: int = DEFAULT_WIDTH) -> DataFrame:
    """State of each row: ``ok``, ``trip`` (this row reaches the limit) or ``after`` (would not have been started)."""
    rows = with_cumulative(df, run, seq, cost, width)
    bound = F.expr(f"CAST('{limit}' AS DECIMAL(28,6))")
    state = F.when(F.col("before") >= bound, "after").when(F.col("spent") >= bound, "trip").otherwise("ok")
    return rows.withColumn("state", F.when(bound > 0, state).otherwise("ok"))
