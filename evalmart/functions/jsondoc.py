"""JSON documents in text: extraction, repair, validation, leaves, shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.checks import code_array, first_code
from evalmart.functions.text import strip
from evalmart.schemas import PAYLOAD
from evalmart.session import dealt, stored

# Limits, names and defaults of a payload.
STRATEGY_MAX, SIGNALS_MAX, PRECONDITIONS_MAX = 8, 10, 4
FORBIDDEN_PATHS = (".env", "secrets", "credentials")
CATEGORIES = ("innovate", "optimize", "refactor", "debug", "secure", "document", "test", "other")
CATEGORY_ALIASES = {
    "robustness": "debug", "reliability": "debug", "fix": "debug", "repair": "debug",
    "simulate": "innovate", "simulation": "innovate", "integrate": "innovate",
    "implement": "innovate", "build": "innovate", "create": "innovate", "design": "innovate",
    "performance": "optimize", "efficiency": "optimize", "speed": "optimize", "optimization": "optimize",
    "cleanup": "refactor", "restructure": "refactor", "refactoring": "refactor",
    "security": "secure",
    "validation": "test", "verify": "test", "testing": "test", "analyze": "test",
    "documentation": "document",
}
PAYLOAD_FIELDS = ("type", "summary", "category", "signals_match", "strategy", "preconditions", "constraints", "validation")
PAYLOAD_TYPE = "Gene"
JSON_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def extract_json(text: Column) -> Column:
    """JSON text in a reply: the fenced object, else from the first to the last brace; null if there is none."""
    plain = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(plain, JSON_FENCE, 1)
    body = F.when(fenced != "", fenced).otherwise(plain)
    first = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    cut = F.when((first > 0) & F.contains(body, F.lit("}")) & (last > first), F.substr(body, first, last - first + 1))
    found = F.when(body.startswith("{"), body).otherwise(cut)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def parse_payload(text: Column) -> Column:
    return F.from_json(text, PAYLOAD)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def soft_fix_payload(payload: Column, clamp: bool = False) -> Column:
    """Payload with overlong lists cut, category aliased, missing forbidden paths set, validation emptied.

    ``clamp`` also bounds the file limit and fills absent constraints.
    """
    aliases = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    category = payload["category"]
    fixed = F.when(category.isNull() | category.isin(list(CATEGORIES)), category).otherwise(
        F.coalesce(F.element_at(aliases, F.lower(strip(category))), F.lit("other")))
    limits, paths = payload["constraints"], payload["constraints"]["forbidden_paths"]
    filled = F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, paths).otherwise(_strings(FORBIDDEN_PATHS))
    max_files = limits["max_files"]
    if clamp:
        bounded = F.least(F.greatest(F.coalesce(max_files, F.lit(3)), F.lit(1)), F.lit(50)).cast("bigint")
        constraints = F.struct(bounded.alias("max_files"), filled.alias("forbidden_paths"))
    else:
        constraints = F.when(limits.isNotNull(), F.struct(max_files.alias("max_files"), filled.alias("forbidden_paths")))
    head = lambda name, n: F.when(F.size(payload[name]) > n, F.slice(payload[name], 1, n)).otherwise(payload[name])
    return F.struct(
        payload["type"].alias("type"), payload["summary"].alias("summary"), fixed.alias("category"),
        head("signals_match", SIGNALS_MAX).alias("signals_match"), head("strategy", STRATEGY_MAX).alias("strategy"),
        head("preconditions", PRECONDITIONS_MAX).alias("preconditions"), constraints.alias("constraints"),
        F.array().cast("array<string>").alias("validation"))


def payload_codes(payload: Column, keys: Column) -> tuple:
    """Rules of a payload in the order in which the first broken one is reported."""
    def outside(name: str, low: int, high: int) -> Column:
        return ~F.coalesce(F.size(payload[name]).between(low, high), F.lit(False))

    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    limits = payload["constraints"]
    return (
        ("fields", F.size(F.array_except(_strings(PAYLOAD_FIELDS), keys)) + F.size(F.array_except(keys, _strings(PAYLOAD_FIELDS))) > 0),
        ("type", ~F.coalesce(payload["type"] == PAYLOAD_TYPE, F.lit(False))),
        ("category", ~F.coalesce(payload["category"].isin(list(CATEGORIES)), F.lit(False))),
        ("summary_length", ~F.coalesce(F.length(payload["summary"]).between(50, 300), F.lit(False))),
        ("signals_count", outside("signals_match", 5, SIGNALS_MAX)),
        ("signals_blank", F.exists(payload["signals_match"], blank)),
        ("strategy_count", outside("strategy", 3, STRATEGY_MAX)),
        ("strategy_length", F.exists(payload["strategy"], lambda x: ~F.coalesce(F.length(x).between(15, 300), F.lit(False)))),
        ("preconditions_count", outside("preconditions", 0, PRECONDITIONS_MAX)),
        ("preconditions_blank", F.exists(payload["preconditions"], blank)),
        ("constraints", limits.isNull()),
        ("max_files", ~F.coalesce(limits["max_files"].between(1, 50), F.lit(False))),
        ("forbidden_paths", ~F.coalesce(F.size(limits["forbidden_paths"]) > 0, F.lit(False))),
        ("validation", ~F.coalesce(F.size(payload["validation"]) == 0, F.lit(False))),
    )


def validate_payload(text: Column) -> Column:
    """All broken rules of a payload given as JSON text, and the first one."""
    payload = parse_payload(text)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    rules = payload_codes(payload, keys)
    return F.struct(code_array(*rules).alias("codes"), first_code(*rules).alias("first"))


def payload_strings(payload: Column) -> Column:
    """Texts of a payload with their place: ``summary``, ``strategy[0]`` ..."""
    def listed(name: str) -> Column:
        return F.transform(F.coalesce(payload[name], F.array().cast("array<string>")), lambda x, i: F.struct(
            F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("loc"), x.alias("text")))

    summary = F.array(F.struct(F.lit("summary").alias("loc"), payload["summary"].alias("text")))
    return F.filter(F.concat(summary, listed("signals_match"), listed("strategy"), listed("preconditions")),
                    lambda s: s["text"].isNotNull())


LEVELS = 4  # opened in one pass over the containers that are left


def typed_leaves(df: DataFrame, key: str, json_text: str) -> DataFrame:
    """key, path, value, kind of the scalar leaves of documents, however deep.

    Recursion over tables: one pass opens some levels by a chain of generators; leaves are done then, and only the
    containers that are left go into the next pass. There are as many passes as the deepest document needs.
    """
    left = dealt(df.select(key, F.lit("$").alias("path"), F.col(json_text).alias("value")))
    leaves = None
    while True:
        opened = stored(_opened(left, key))
        done = opened.filter(~F.col("deeper")).drop("deeper")
        leaves = done if leaves is None else leaves.unionByName(done)
        left = opened.filter("deeper").select(key, "path", "value")
        if left.isEmpty():
            return leaves


def _opened(left: DataFrame, key: str) -> DataFrame:
    level = left.select(key, F.struct("path", F.try_parse_json("value").alias("v")).alias("_n"))
    path, v = F.col("_n.path"), F.col("_n.v")
    for _ in range(LEVELS):
        members = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(
            F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")))
        # the outer form, because the other one makes a filter that opens each container once more
        level = level.select(key, F.explode_outer(F.coalesce(members, items, F.array("_n"))).alias("_n"))
    kind = F.schema_of_variant(v)
    deeper = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return level.filter(v.isNotNull() & (kind != "VOID")).select(
        key, path.alias("path"), F.when(deeper, F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")).alias("value"), kind.alias("kind"), deeper.alias("deeper"))


def scalar_leaves(df: DataFrame, key: str, json_text: str) -> DataFrame:
    """Scalar leaves of documents with their path."""
    return typed_leaves(df, key, json_text).drop("kind")


def json_shape(json_text: Column) -> Column:
    """Shape of one document."""
    return F.schema_of_variant(F.try_parse_json(json_text))


def corpus_shape(df: DataFrame, json_text: str, *by: str) -> DataFrame:
    """Merged shape of a corpus, combined in each task."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(json_text)).alias("shape"))
