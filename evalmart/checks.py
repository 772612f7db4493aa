"""Violations as rows, and the one action that raises on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(RuntimeError):
    """A contract check found violations."""


def code_array(*pairs: tuple[str, Column]) -> Column:
    """Array of the codes whose condition is true (null counts as false)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in pairs]))


def first_code(*pairs: tuple[str, Column]) -> Column:
    """The first code whose condition is true, else null."""
    return F.coalesce(*[F.when(cond, F.lit(code)) for code, cond in pairs])


def violations(df: DataFrame, key: Column | str, codes: Column, detail: Column | None = None) -> DataFrame:
    """One row per broken rule."""
    key_col = F.col(key) if isinstance(key, str) else key
    return df.select(
        F.explode(codes).alias("code"), key_col.alias("key"),
        (detail if detail is not None else F.lit(None).cast("string")).alias("detail"),
    )


def require_empty(found: DataFrame, limit: int = 5) -> None:
    """Raise when there is any row; only ``limit`` rows reach the driver."""
    rows = found.limit(limit).collect()
    if rows:
        raise ContractError("; ".join(str(row.asDict()) for row in rows))
