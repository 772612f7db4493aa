"""Joins between manifests, grids, logs, ledgers and file sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.hashing import canonical_json
from evalmart.operators.selection import nth_by_ordinal


def trial_grid(tasks: DataFrame, models: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Every task under every model and condition, with its key.

    The configured names are exploded from a literal array inside each task row: no join, no shuffle.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition")) for m in models for c in conditions])
    return tasks.withColumn("_cell", F.explode(cells)).select(
        *tasks.columns, "_cell.model", "_cell.condition",
        F.concat_ws("::", F.col("_cell.model"), F.col("_cell.condition"), F.col("task_id")).alias("trial_key"),
    )


def select_tasks(
    tasks: DataFrame, families: Sequence[str] = (), sources: Sequence[str] = (), modes: Sequence[str] = (),
    ids: Sequence[str] = (), skip_ids: Sequence[str] = (), default_skip_ids: Sequence[str] = (),
    id_columns: Sequence[str] = ("task_id", "legacy_task_id", "orig_id"),
) -> DataFrame:
    """Task filter by label lists and by id under any of the id columns.

    An explicit id list drops the default skips only; the given skip ids still apply.
    """
    out = tasks
    for column, wanted in (("family", families), ("source", sources), ("execution_mode", modes)):
        if wanted:
            out = out.filter(F.col(column).isin(list(wanted)))
    columns = [c for c in id_columns if c in tasks.columns]

    def any_id(values: Sequence[str]) -> Column:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).isin(list(values)), F.lit(False))
        return found

    if ids:
        out = out.filter(any_id(ids))
    skip = [*skip_ids, *(() if ids else default_skip_ids)]
    return out.filter(~any_id(skip)) if skip else out


def unmatched_ids(tasks: DataFrame, requested: DataFrame, id_columns: Sequence[str] = ("task_id", "legacy_task_id", "orig_id")):
    """Requested ids (column ``id``) that no task carries in any id column."""
    known = tasks.select(F.explode(F.array_compact(F.array(*[F.col(c) for c in id_columns if c in tasks.columns]))).alias("id"))
    return requested.join(known.distinct(), "id", "left_anti")


def missing_assets(grid: DataFrame, assets: DataFrame, needs: Mapping[str, str]) -> DataFrame:
    """Grid cells whose condition needs an asset role that the task lacks. ``assets``: task_id, role."""
    role = F.lit(None).cast("string")
    for condition, wanted in needs.items():
        role = F.when(F.col("condition") == condition, F.lit(wanted)).otherwise(role)
    asked = grid.withColumn("role", role).filter("role IS NOT NULL")
    return asked.join(assets.select("task_id", "role").distinct(), ["task_id", "role"], "left_anti")


def filter_missing_assets(grid: DataFrame, assets: DataFrame, needs: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Grid of the tasks that have every needed asset, and the drop counts per condition."""
    gone = missing_assets(grid, assets, needs)
    kept = grid.join(gone.select("task_id").distinct(), "task_id", "left_anti")
    dropped = gone.groupBy("condition").agg(F.count_distinct("task_id").alias("dropped_tasks"))
    return kept, dropped


def coalesce_dim(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Label per key from two runs; the base run's wins."""
    return base.select(key, F.col(value).alias("_b")).join(
        other.select(key, F.col(value).alias("_o")), key, "full_outer"
    ).select(key, F.coalesce("_b", "_o").alias(value))


def reconcile(results: DataFrame, cases: DataFrame, budget: DataFrame, fields: Sequence[str], key: str = "trial_key"):
    """Committed results without case or budget row, or with a field that disagrees.

    All three carry one row per key already. One union and one aggregate line them up, so the logs are
    shuffled once each.
    """
    columns = ["task_id", *fields]

    def side(df: DataFrame, name: str) -> DataFrame:
        own = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
        return df.select(key, F.lit(name).alias("_side"), F.struct(*own).alias("_row"))

    both = side(results, "result").unionByName(side(cases, "case")).unionByName(side(budget, "budget"))
    lined = both.groupBy(key).agg(*[
        F.max_by("_row", F.when(F.col("_side") == s, 1)).alias(s) for s in ("result", "case", "budget")
    ]).filter("result IS NOT NULL")
    codes = [
        F.when(F.col("case").isNull(), "missing_case"), F.when(F.col("budget").isNull(), "missing_budget"),
        F.when(F.col("case").isNotNull() & ~F.col("case.task_id").eqNullSafe(F.col("result.task_id")), "case_task_id"),
        *[F.when(F.col("budget").isNotNull() & ~F.col(f"budget.{f}").eqNullSafe(F.col(f"result.{f}")), f"budget_{f}")
          for f in fields],
    ]
    return lined.select(F.explode(F.array_compact(F.array(*codes))).alias("code"), F.col(key).alias("key"))


def rollout_vs_oneshot(selected: DataFrame, budget: DataFrame, results: DataFrame) -> DataFrame:
    """Multi-round against single-call tokens over the selected traces, with the missing rows counted."""
    b = budget.select("task_id", F.col("tokens").alias("_tokens"), F.lit(1).alias("_b"))
    r = results.select("task_id", F.col("passed").alias("_passed"))
    row = selected.join(b, "task_id", "left").join(r, "task_id", "left")
    good = F.col("_passed") == 1
    return row.agg(
        F.count(F.lit(1)).alias("selected"), F.sum("api_calls").alias("rollout_calls"),
        F.sum("total_tokens").alias("rollout_tokens"), F.count("_b").alias("oneshot_calls"),
        F.coalesce(F.sum("_tokens"), F.lit(0)).alias("oneshot_tokens"),
        F.count_if(F.col("_b").isNull()).alias("missing_budget"),
        F.count_if(F.col("_passed").isNull()).alias("missing_result"), F.count_if(good).alias("both_correct"),
        F.coalesce(F.sum(F.when(good, F.col("total_tokens"))), F.lit(0)).alias("both_rollout_tokens"),
        F.coalesce(F.sum(F.when(good, F.col("_tokens"))), F.lit(0)).alias("both_oneshot_tokens"),
    )


def merge_state(base: DataFrame, supplement: DataFrame, key: str, content: Column) -> DataFrame:
    """Per key of either side: how often and with how many contents it occurs.

    Contents are reduced to digests and combined in each task, so a key that holds a third of the rows costs
    one row per task. ``state``: base_only, same, new, conflict, duplicate_base.
    """
    digest = F.sha2(F.coalesce(content, F.lit("")), 256)
    both = base.select(key, digest.alias("_d"), F.lit(1).alias("_b")).unionByName(
        supplement.select(key, digest.alias("_d"), F.lit(0).alias("_b")))
    per_key = both.groupBy(key).agg(
        F.sum("_b").alias("n_base"), F.sum(1 - F.col("_b")).alias("n_supplement"),
        F.min("_d").alias("_lo"), F.max("_d").alias("_hi"),
    )
    state = (
        F.when(F.col("n_base") > 1, "duplicate_base").when(F.col("_lo") != F.col("_hi"), "conflict")
        .when(F.col("n_base") == 0, "new").when(F.col("n_supplement") == 0, "base_only").otherwise("same")
    )
    return per_key.select(key, "n_base", "n_supplement", state.alias("state"))


CONFLICTS = ("conflict", "duplicate_base")


def merge_supplement(base: DataFrame, supplement: DataFrame, key: str, content: Column, on_conflict: str = "fail") -> DataFrame:
    """Base plus the supplement's new keys, once each. Repeats inside the supplement obey the same rule as repeats across the two.

    A key with two contents, or twice in the base, ends the job. ``on_conflict="keep_base"`` goes on with the base's records
    and leaves out what ``merge_conflicts`` lists.
    """
    if on_conflict not in ("fail", "keep_base"):
        raise ValueError(f"unknown rule for conflicts: {on_conflict}")
    state = F.col("state")
    if on_conflict == "fail":
        state = F.when(state.isin(*CONFLICTS), F.raise_error(F.concat(F.lit("merge conflict: "), F.col(key).cast("string")))).otherwise(state)
    states = merge_state(base, supplement, key, content).filter(state == "new").select(key)
    columns = [c for c in base.columns if c != key]
    new = supplement.join(states, key, "left_semi").groupBy(key).agg(F.any_value(F.struct(*columns)).alias("_r"))
    return base.unionByName(new.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in base.columns]))


def merge_conflicts(base: DataFrame, supplement: DataFrame, key: str, content: Column) -> DataFrame:
    """Keys that a merge may not settle by itself, those that only the supplement has (``n_base`` 0) among them."""
    return merge_state(base, supplement, key, content).filter(F.col("state").isin(*CONFLICTS))


def canonical_record(df: DataFrame) -> Column:
    return canonical_json(F.to_json(F.struct(*df.columns)))


def compare_file_sets(declared: DataFrame, actual: DataFrame, fields: Sequence[str] = ("sha256", "size")) -> DataFrame:
    """Declared against actual files by path: missing, extra, or a field that differs.

    One union and one aggregate instead of a full join. Both sides are unique by path.
    """
    def side(df: DataFrame, mark: int) -> DataFrame:
        return df.select("path", F.lit(mark).alias("_m"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_r"))

    lined = side(declared, 0).unionByName(side(actual, 1)).groupBy("path").agg(
        F.max_by("_r", F.when(F.col("_m") == 0, 1)).alias("d"), F.max_by("_r", F.when(F.col("_m") == 1, 1)).alias("a"))
    codes = F.array_compact(F.array(
        F.when(F.col("a").isNull(), "missing"), F.when(F.col("d").isNull(), "extra"),
        *[F.when(F.col("a").isNotNull() & F.col("d").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"d.{f}")), f"{f}_mismatch")
          for f in fields],
    ))
    return lined.select(F.explode(codes).alias("code"), F.col("path").alias("key"))


def hash_overlap(classified: DataFrame, sensitive_prefixes: Sequence[str]) -> DataFrame:
    """Public assets whose bytes equal sensitive private material, one row per digest.

    Per side only counts and the first path are kept, combined in each task, so a digest with very many
    copies stays one row. ``overlap_members`` lists the copies.
    """
    public, private = _sides(sensitive_prefixes)
    per = classified.filter((F.col("size") > 0) & (public | private)).groupBy("sha256").agg(
        F.count_if(public).alias("n_public"), F.count_if(private).alias("n_private"),
        F.min(F.when(public, F.col("path"))).alias("first_public"),
        F.min(F.when(private, F.col("path"))).alias("first_private"),
    )
    return per.filter("n_public > 0 AND n_private > 0")


def overlap_members(classified: DataFrame, overlaps: DataFrame, sensitive_prefixes: Sequence[str]) -> DataFrame:
    public, private = _sides(sensitive_prefixes)
    rows = classified.filter((F.col("size") > 0) & (public | private))
    return rows.join(overlaps.select("sha256"), "sha256", "left_semi").select(
        "sha256", F.when(public, "public").otherwise("private").alias("side"), "path", "role")


def _sides(prefixes: Sequence[str]) -> tuple[Column, Column]:
    starts = F.lit(False)
    for prefix in prefixes:
        starts = starts | F.col("role").startswith(prefix)
    return F.col("distribution") == "public", (F.col("distribution") == "private") & starts


def source_overlap(public: DataFrame, private: DataFrame, allowed: Column) -> DataFrame:
    """Source paths in both bundles, unless the pair is allowed (sanitised copy and its original).

    ``allowed`` reads ``pub.*`` and ``prv.*``.
    """
    return public.alias("pub").join(private.alias("prv"), F.col("pub.source_path") == F.col("prv.source_path")).filter(
        ~F.coalesce(allowed, F.lit(False))
    ).select(F.col("pub.source_path").alias("source_path")).distinct()


def field_equality(public: DataFrame, private: DataFrame) -> DataFrame:
    """Release fields (field, value) that differ between the two bundles."""
    return public.withColumnRenamed("value", "public_value").join(
        private.withColumnRenamed("value", "private_value"), "field", "full_outer"
    ).filter(~F.col("public_value").eqNullSafe(F.col("private_value")))


def diff_run_identity(a: DataFrame, b: DataFrame, key: str = "field") -> DataFrame:
    """Fields of two runs (key, value) that are missing on a side or differ."""
    both = a.select(key, F.col("value").alias("base_value")).join(
        b.select(key, F.col("value").alias("other_value")), key, "full_outer")
    code = F.when(F.col("base_value").isNull() | F.col("other_value").isNull(), "missing").when(
        F.col("base_value") != F.col("other_value"), "differs")
    return both.withColumn("code", code).filter("code IS NOT NULL")


def prompt_parity(a: DataFrame, b: DataFrame, treatment_prefix: str = "with_gene") -> DataFrame:
    """Prompt hashes of two runs: user hash per model and task, system hash per model, task and condition.

    Both sides hold the latest record per trial. Smallest and largest hash replace the set of hashes.
    """
    def users(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("model", "task_id").agg(
            F.min("user_hash").alias(f"{side}_lo"), F.max("user_hash").alias(f"{side}_hi"),
            F.max(F.col("user_hash").isNull()).alias(f"{side}_gap"))

    u = users(a, "a").join(users(b, "b"), ["model", "task_id"])
    user_code = (
        F.when(F.col("a_gap") | F.col("b_gap"), "user_hash_missing")
        .when((F.col("a_lo") != F.col("a_hi")) | (F.col("b_lo") != F.col("b_hi")), "user_hash_inconsistent")
        .when(F.col("a_lo") != F.col("b_lo"), "user_hash_differs")
    )
    user_rows = u.select(user_code.alias("code"), "model", "task_id", F.lit(None).cast("string").alias("condition"))
    keys = ["model", "task_id", "condition"]
    s = a.select(*keys, F.col("system_hash").alias("_a")).join(b.select(*keys, F.col("system_hash").alias("_b")), keys)
    system_code = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "system_hash_missing")
        .when(F.col("condition").startswith(treatment_prefix), None)
        .when(F.col("_a") != F.col("_b"), "system_hash_differs")
    )
    system_rows = s.select(system_code.alias("code"), *keys)
    return user_rows.unionByName(system_rows).filter("code IS NOT NULL")


def resolve_asset(df: DataFrame, key: str, candidates: Sequence[Column], inventory: DataFrame) -> DataFrame:
    """First existing path among ordered candidates, null when none exists. ``inventory``: path."""
    options = F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("path")) for i, c in enumerate(candidates)])
    asked = df.select(key, F.explode(options).alias("_o")).select(key, "_o.rank", "_o.path")
    found = asked.join(inventory.select("path").distinct(), "path", "left_semi").groupBy(key).agg(
        F.min_by("path", "rank").alias("resolved_path"))
    return df.select(key).join(found, key, "left")


def coverage(assets: DataFrame, tasks: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct covered tasks per role against the expected number, and whether all tasks are covered."""
    covered = assets.select("role", "task_id").distinct().join(tasks.select("task_id"), "task_id", "left_semi")
    actual = covered.groupBy("role").agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(actual, "role", "full_outer").select(
        "role", F.coalesce("expected", "actual").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")
    ).withColumn("ok", F.col("expected") == F.col("actual"))


def coverage_gaps(assets: DataFrame, tasks: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(role, task_id) pairs without an asset."""
    wanted = tasks.select("task_id").distinct().withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    return wanted.join(assets.select("role", "task_id").distinct(), ["role", "task_id"], "left_anti")


def check_presence(listed: DataFrame, inventory: DataFrame, layouts: Sequence[Column], must_exist: bool) -> DataFrame:
    """Listed directories (task_id, dir) that break the rule: present in public, absent locally.

    ``layouts`` render the candidate directory; the inventory's directories are its path prefixes.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    dirs = inventory.select(F.explode(F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("candidate")).distinct()
    asked = listed.select("task_id", "dir", F.posexplode(F.array(*layouts)).alias("_rank", "candidate"))
    hit = asked.join(dirs, "candidate", "left_semi").groupBy("task_id", "dir").agg(F.min_by("candidate", "_rank").alias("found_at"))
    out = listed.join(hit, ["task_id", "dir"], "left")
    broken = F.col("found_at").isNull() if must_exist else F.col("found_at").isNotNull()
    return out.filter(broken).withColumn("code", F.lit("absent" if must_exist else "present"))


def exclude_known(tasks: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """Task status: skip with its category when its original id is on the list of its source, else run."""
    listed = known.select(F.col("orig_id"), F.coalesce("category", F.lit("unknown")).alias("category"))
    own = F.when(F.col("source") == source, F.col("orig_id"))
    out = tasks.withColumn("_k", own).join(listed.withColumnRenamed("orig_id", "_k"), "_k", "left")
    return out.withColumn("status", F.when(F.col("category").isNotNull(), "skip").otherwise("run")).drop("_k")


def resolve_sources(groups: DataFrame, inventory: DataFrame) -> DataFrame:
    """Recorded files (group, path, sha256, size) against the inventory: none or several candidates, hash, size."""
    found = inventory.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size")).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("_sha").alias("_sha"), F.min("_size").alias("_size"))
    code = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no_candidate").when(F.col("n") > 1, "ambiguous")
        .when(F.col("_sha") != F.col("sha256"), "sha256_mismatch").when(F.col("_size") != F.col("size"), "size_mismatch")
        .otherwise("ok")
    )
    return groups.join(found, "path", "left").select("group", "path", code.alias("state"))


def plan_materialize(release: DataFrame, inventory: DataFrame) -> DataFrame:
    """Copy plan of release records (bundle_path, source_path, sha256): copy, missing, digest, collision."""
    have = inventory.select(F.col("path").alias("bundle_path"), F.col("sha256").alias("_have")).groupBy("bundle_path").agg(
        F.min("_have").alias("_have"))
    targets = release.groupBy("source_path").agg((F.min("sha256") != F.max("sha256")).alias("_clash"))
    state = (
        F.when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("sha256"), "digest_mismatch")
        .when(F.col("_clash"), "collision").otherwise("copy")
    )
    return release.join(have, "bundle_path", "left").join(targets, "source_path").select(
        "bundle_path", "source_path", "sha256", state.alias("state"))


def duplicates(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Keys that occur more than once, with the count and the outer members; never a list of all."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member")
    ).filter("n > 1")


def report_ranks(models: Sequence[str], conditions: Sequence[str]) -> tuple[Column, Column]:
    """Places of a row's model and condition in the configured lists; what is not listed comes last."""
    def rank(column: str, names: Sequence[str]) -> Column:
        return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0)),
                          F.lit(len(names) + 1))

    return rank("model", models), rank("condition", conditions)


def order_report(df: DataFrame, models: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Report order: configured model, configured condition, task."""
    return df.orderBy(*report_ranks(models, conditions), "task_id")


def unscanned_paths(walked: DataFrame, scanned: DataFrame) -> DataFrame:
    return walked.select("path").distinct().join(scanned.select("path"), "path", "left_anti")


def stop_index(df: DataFrame, group: str, order: str, success: Column, n: int) -> DataFrame:
    """Order key at which each group reaches its n-th success (null if never)."""
    found = df.filter(success)
    hits = nth_by_ordinal(found, [group], order, n).select(group, F.col(order).alias("filled_at"))
    return found.select(group).distinct().join(hits, group, "left")


def stop_at_target(df: DataFrame, group: str, order: str, success: Column, n: int) -> DataFrame:
    """Rows that a run processes which stops each group at its n-th success and ends once every group is full.

    A group never needs a running sum: only the order key of its n-th success matters.
    """
    groups = df.select(group).distinct()
    fill = groups.join(stop_index(df, group, order, success, n), group, "left")
    end = fill.agg(F.when(F.count_if(F.col("filled_at").isNull()) == 0, F.max("filled_at")).alias("_end"))
    kept = df.join(fill, group).crossJoin(F.broadcast(end))  # one row
    return kept.filter(
        (F.col("filled_at").isNull() | (F.col(order) <= F.col("filled_at")))
        & (F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    ).drop("filled_at", "_end")
