"""Named task subsets as a long table, their contract and their membership labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Sources that make up the complement of the evolved subset.
DISTILLED_SOURCES = ("reference_distilled", "skill_distilled")
SUBSET_ORDER = ("full", "evolved", "distilled", "common")


def build_subsets(tasks: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Long (subset, task_id): all tasks, those evolved by the first producer, the rest, and both producers' common."""
    def named(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("subset"), "task_id")

    evolved = first.filter(F.col("generation_source") == "evolved").select("task_id").distinct()
    distilled = first.filter(F.col("generation_source").isin(list(DISTILLED_SOURCES))).select("task_id").distinct()
    also = second.filter(F.col("generation_source") == "evolved").select("task_id").distinct()
    return (
        named("full", tasks.select("task_id").distinct()).unionByName(named("evolved", evolved))
        .unionByName(named("distilled", distilled)).unionByName(named("common", evolved.intersect(also)))
    )


def check_subsets(subsets: DataFrame, whole: str, parts: Sequence[str]) -> DataFrame:
    """Tasks of the whole in no part, in several parts, or in a part only. One aggregate over the long table."""
    per_task = subsets.filter(F.col("subset").isin([whole, *parts])).groupBy("task_id").agg(
        F.max((F.col("subset") == whole).cast("int")).alias("in_whole"),
        F.count_if(F.col("subset").isin(list(parts))).alias("n_parts"),
    )
    code = (
        F.when(F.col("in_whole") == 0, "outside_whole").when(F.col("n_parts") == 0, "uncovered")
        .when(F.col("n_parts") > 1, "overlap")
    )
    return per_task.select(code.alias("code"), F.col("task_id").alias("key"), "n_parts").filter("code IS NOT NULL")


def add_membership(df: DataFrame, subsets: DataFrame, order: Sequence[str] = SUBSET_ORDER,
                   primary: Sequence[str] = ("evolved", "distilled")) -> DataFrame:
    """Primary subset and the ``;``-joined list of all subsets of each task.

    One flag per subset name, so a task's membership never needs a list of rows.
    """
    flags = subsets.groupBy("task_id").agg(*[
        F.max(F.when(F.col("subset") == name, F.lit(name))).alias(f"_in_{name}") for name in order
    ])
    label = flags.select(
        "task_id", F.coalesce(*[F.col(f"_in_{p}") for p in primary]).alias("subset"),
        F.concat_ws(";", *[F.col(f"_in_{name}") for name in order]).alias("subset_memberships"),
    )
    return df.join(label, "task_id", "left")
