"""Policy rules as column expressions: matching, winner, destination, path policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.text import any_glob, bind, is_safe_relpath, normal_relpath

# Match keys of a rule and the asset column each one reads.
MATCH_COLUMNS = {
    "scope": "scope", "collection": "collection", "collections": "collection", "family": "family", "families": "family",
    "execution_mode": "execution_mode", "execution_modes": "execution_mode", "task_id": "task_id", "task_ids": "task_id",
}
GLOB_COLUMNS = {"relpaths": "relpath", "source_relpaths": "source_relpath"}
# Names and suffixes that never belong to a public context, and the roots that do.
CONTEXT_EXCLUDED = (
    "SKILL.md", "SKILL_oracle.md", "SKILL_sanitized.md", "AGENT_SKILL.md", "reference_solution.py", "reference_solution.sh",
    "test_script.py", "scenario.yaml", "metadata.json", "_gold.json", "_variants.json", "_run_record.json",
)
CONTEXT_BINARY = r"\.(?:pyc|pyo|so|dll|dylib|exe|nc)$"
CONTEXT_ROOTS = ("data", "environment", "package", "skill", "docs", "doc")
CONTEXT_DOC_ROOTS = ("data", "environment", "skill", "docs", "doc")


def _list(value: Any) -> list[str]:
    return [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]


def match_expr(match: Mapping[str, Any]) -> Column:
    """Condition of one rule; all its keys must hold, a null column matches nothing."""
    cond = F.lit(True)
    for key, value in match.items():
        if key in MATCH_COLUMNS:
            part = F.col(MATCH_COLUMNS[key]).isin(_list(value))
        elif key == "official":
            part = F.col("official").eqNullSafe(F.lit(bool(value)))
        elif key == "has_task_id":
            part = F.col("task_id").isNotNull() == F.lit(bool(value))
        else:
            part = any_glob(F.col(GLOB_COLUMNS[key]), _list(value))
        cond = cond & F.coalesce(part, F.lit(False))
    return cond


def _hits(rules: Sequence[Mapping[str, Any]], fields) -> Column:
    """One entry per rule that applies; each rule's condition and fields occur once in the projection."""
    return F.array_compact(F.array(*[
        F.when(match_expr(r["match"]), F.struct(
            F.lit(int(r.get("priority", 0))).alias("priority"), F.lit(str(r["id"])).alias("id"), *fields(r))) for r in rules]))


def match_rules(assets: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Assets with ``matched``, the array of (priority, id, ...) of every rule that applies.

    A policy is a short driver-side list, so it compiles into one projection; no join, no shuffle.
    """
    return assets.withColumn("matched", _hits(rules, lambda r: []))


def resolve_winner(matched: DataFrame) -> DataFrame:
    """Highest priority wins: ``state`` is classified, conflict (several at the top) or unclassified."""
    def top(m: Column) -> Column:
        return bind(F.array_max(F.transform(m, lambda x: x["priority"])), lambda t: F.filter(m, lambda x: x["priority"] == t))

    out = matched.withColumn("_top", bind(F.col("matched"), top))
    state = F.when(F.size("_top") == 1, "classified").when(F.size("_top") > 1, "conflict").otherwise("unclassified")
    return out.select(
        *matched.columns, F.sort_array(F.transform("_top", lambda x: x["id"])).alias("winners"), state.alias("state"),
        F.when(F.size("_top") == 1, F.get("_top", F.lit(0))).alias("winner"),
    ).withColumn("rule_id", F.col("winner.id"))


def render_template(template: str) -> Column:
    """Destination of an asset: place holders filled from its columns."""
    name = F.regexp_extract("relpath", r"([^/]*)$", 1)
    values = {
        "task_id": F.coalesce("task_id", F.lit("")), "relpath": F.col("relpath"), "collection": F.coalesce("collection", F.lit("")),
        "name": name, "source_relpath": F.col("source_relpath"),
    }
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def classify_assets(assets: DataFrame, rules: Sequence[Mapping[str, Any]], original_role: str = "privacy.host_path_metadata") -> DataFrame:
    """Classified assets: distribution, role, destination, materialize, transform.

    A transformed public asset also yields its private original. Unclassified and conflicting assets keep their
    state and have no classification.
    """
    official = F.coalesce(F.col("official"), F.lit(False)) | (F.col("scope") == "canonical")

    def fields(rule: Mapping[str, Any]) -> list[Column]:
        c = rule["classification"]
        shipped = c["distribution"] != "excluded"
        return [
            F.lit(c["distribution"]).alias("distribution"), F.lit(c["role"]).alias("role"),
            (render_template(c["destination"]) if shipped else F.lit(None).cast("string")).alias("bundle_path"),
            (F.lit(bool(c["materialize"])) if "materialize" in c else (official if shipped else F.lit(False))).alias("materialize"),
            F.lit(c.get("transform")).cast("string").alias("transform"),
        ]

    resolved = resolve_winner(assets.withColumn("matched", _hits(rules, fields)))
    original = F.when(F.col("winner.transform").isNotNull(), F.struct(
        F.lit(0).alias("priority"), F.concat("winner.id", F.lit("__private_original")).alias("id"), F.lit("private").alias("distribution"),
        F.lit(original_role).alias("role"), F.when(F.col("scope") == "collection", render_template("provenance/{collection}/{relpath}")).otherwise(
            render_template("scenarios/{task_id}/{relpath}")).alias("bundle_path"), F.lit(True).alias("materialize"), F.lit(None).cast("string").alias("transform")))
    # the asset itself, and its original where a transform is set
    both = F.when(original.isNotNull(), F.array("winner", original)).otherwise(F.array("winner"))
    out = resolved.withColumn("_c", F.explode(both)).select(
        *assets.columns, "winners", "state", F.col("_c.id").alias("rule_id"), "_c.distribution", "_c.role", "_c.bundle_path", "_c.materialize", "_c.transform")
    safe = F.when(F.col("bundle_path").isNotNull(), is_safe_relpath(F.col("bundle_path")))
    return out.withColumn("safe_path", safe).withColumn(
        "bundle_path", F.when(F.col("safe_path"), normal_relpath(F.col("bundle_path"))).otherwise(F.col("bundle_path")))


def path_policy(path: Column, components: Sequence[str], basenames: Sequence[str]) -> Column:
    """Code of a forbidden path part or file name, case ignored; null when fine."""
    parts = F.split(F.lower(path), "/")
    names = lambda v: F.array(*[F.lit(x.lower()) for x in v]) if v else F.array().cast("array<string>")
    return F.when(F.arrays_overlap(parts, names(components)), "forbidden_component").when(
        F.array_contains(names(basenames), F.element_at(parts, -1)), "forbidden_basename")


def is_context_asset(path: Column, docs_only: bool = False) -> Column:
    """Path of a public context file: below a public root or a readme, not hidden, generated or binary."""
    parts = F.split(path, "/")
    root, name = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    hidden = (
        F.exists(parts, lambda p: (p == "__pycache__") | p.startswith("_gold"))
        | (name.isin(list(CONTEXT_EXCLUDED)) & ~((root == "skill") & (name == "SKILL.md"))) | name.rlike(CONTEXT_BINARY))
    readme = F.lower(name).rlike(r"^readme.*\.(?:md|txt|rst)$")
    if docs_only:
        return ~hidden & (root != "package") & (root.isin(list(CONTEXT_DOC_ROOTS)) | readme)
    return ~hidden & (root.isin(list(CONTEXT_ROOTS)) | readme)


def strip_field(json_text: Column, field: str) -> Column:
    """JSON object without one top-level field, canonical otherwise."""
    entries = F.from_json(json_text, "map<string,variant>")
    return F.to_json(F.map_filter(entries, lambda k, v: k != field))
