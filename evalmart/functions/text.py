"""Text helpers shared by the scanners: lines, patterns, bounded search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Line ends as a Unicode-aware splitter sees them.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once. Inside a lambda, any other outer expression is computed per element."""
    return F.get(F.transform(F.array(value), lambda x: fn(x)), F.lit(0))


def bind_all(values: dict[str, Column], fn: Callable[[Column], Column]) -> Column:
    """``bind`` for several values; ``fn`` gets a struct of them."""
    return bind(F.struct(*[v.alias(k) for k, v in values.items()]), fn)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    body = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(body)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def tail_lines(text: Column, n: int) -> Column:
    return F.array_join(last_items(lines_of(text), n), "\n")


def last_items(items: Column, n: int) -> Column:
    return bind(items, lambda a: F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a))


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(lines_of(text), 1, n), "\n")


def tail_chars(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def escape_regex(token: Column) -> Column:
    """Escape every character that a pattern would read as an operator."""
    return F.regexp_replace(token, r"([\\^$.|?*+()\[\]{}\-&#~\s])", r"\\$1")


def has_letter(token: Column) -> Column:
    return token.rlike("[A-Za-z]")


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


# Characters that may not touch a number, by audit.
NUMERIC_BOUNDARIES = {"word": "A-Za-z0-9_.", "decimal": "0-9.", "digit": "0-9"}
WORD_BOUNDARY = "A-Za-z0-9_"


def bounded_pattern(token: Column, boundary: str) -> Column:
    return F.concat(F.lit(f"(?<![{boundary}])"), escape_regex(token), F.lit(f"(?![{boundary}])"))


def holds_token(text: Column, lowered: Column, token: Column, boundary: str = "word") -> Column:
    """Token in text with free ends. Tokens with letters are sought in the lowered text.

    A plain substring test runs first, so a pattern is only compiled where the token occurs at all.
    """
    number_edge = NUMERIC_BOUNDARIES[boundary]
    return (
        F.when(alnum_count(token) < 2, False)
        .when(has_letter(token), F.contains(lowered, token) & F.rlike(lowered, bounded_pattern(token, WORD_BOUNDARY)))
        .otherwise(F.contains(text, token) & F.rlike(text, bounded_pattern(token, number_edge)))
    )


def glob_regex(pattern: str) -> str:
    """Shell glob as an anchored pattern; a star crosses path separators."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 1:]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(ch if ch.isalnum() or ch in "_/ " else "\\" + ch)
    return "(?s)^" + "".join(out) + r"\z"


def any_glob(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | path.rlike(glob_regex(pattern))
    return found


def is_safe_relpath(path: Column) -> Column:
    """Not empty, not absolute, no dot-dot part. Empty and dot parts only need normalising."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    climbs = F.array_contains(F.split(plain, "/"), "..")
    return F.coalesce((plain != "") & ~plain.startswith("/") & ~climbs, F.lit(False))


def normal_relpath(path: Column) -> Column:
    """Path with forward slashes and without empty and dot parts."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/")
