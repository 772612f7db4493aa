"""Digests and canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def content_sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def content_sha1(value: Column) -> Column:
    return F.sha1(value)


@F.pandas_udf(T.StringType())
def _canonical_exact(values: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return values.map(one)


def canonical_json(text: Column, exact: bool = False) -> Column:
    """JSON text with sorted keys and no blanks.

    The native form rewrites ``1.0`` as ``1``; ``exact`` keeps number spellings and lets a repeated key win last.
    """
    return _canonical_exact(text) if exact else F.to_json(F.try_parse_json(text))


def stable_digest(text: Column, exact: bool = False) -> Column:
    return F.sha2(canonical_json(text, exact), 256)


def content_id(text: Column, exact: bool = False) -> Column:
    return F.concat(F.lit("sha256:"), stable_digest(text, exact))


def is_json_object(line: Column) -> Column:
    """True when the whole line is one JSON object; trailing bytes make it false.

    The native parser ignores what follows a value. Inside brackets and as a member of an object, nothing can
    follow unseen, so a line that parses both ways is fine. Only the others (bad ones, repeated keys) go to Python.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))).cast("array<variant>")
    as_member = F.try_parse_json(F.concat(F.lit('{"r":'), line, F.lit("}")))
    fine = F.coalesce(line.rlike(r"^\s*\{") & (F.size(in_list) == 1) & as_member.isNotNull(), F.lit(False))
    return fine | _is_json_object(F.when(~fine, line))


@F.pandas_udf(T.BooleanType())
def _is_json_object(lines: pd.Series) -> pd.Series:
    def one(line):
        if line is None:
            return False
        try:
            return isinstance(json.loads(line), dict)
        except (ValueError, RecursionError):
            return False

    return lines.map(one).astype(bool)
