"""Replacement of secrets, private literals, answers and diagnostics in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from evalmart.functions.literals import is_number, longest_first
from evalmart.functions.text import (
    NUMERIC_BOUNDARIES, WORD_BOUNDARY, alnum_count, bind, bind_all, bounded_pattern, escape_regex, has_letter, last_items,
    lines_of, rstrip, strip,
)

# Secret shapes and their replacement, in the order of application.
MASK = "<redacted>"
URL = r"(?i)(?:https?|socks5h?|tcp)://[^\s<>\"'`]+"
SENSITIVE = (
    r"(?:[A-Za-z0-9]+[_-])*(?:authorization|api[_-]?key|key|token|secret|password|passwd|credentials?)(?:[_-][A-Za-z0-9]+)*"
)
BEARER = r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]+"
QUOTED_SECRET = rf"(?i)(?<![A-Za-z0-9])([\"']?{SENSITIVE}[\"']?\s*[:=]\s*)([\"'])(.*?)\2"
BARE_SECRET = rf"(?i)(?<![A-Za-z0-9])([\"']?{SENSITIVE}[\"']?\s*[:=]\s*)([^\s,;\]}}\)]+)"
TOKEN_SHAPES = (
    r"\b(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z_-]{8,}|gh[pousr]_[0-9A-Za-z]{10,}|"
    r"xox[baprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})\b"
)
SENSITIVE_PATH = r"(?i)(?:key|token|secret|password|credential)"

# Replacements of a redacted literal by its kind.
LITERAL_NUMBER = "the task-specific numeric value"
LITERAL_PATH = "the task-specified file or path"
LITERAL_FIELD = "the task-specific field"
LITERAL_TERM = "the task-specific term"

# Ordered word substitutions for teacher texts.
TEACHER_WORDS = (
    (r"\bhidden_convention", "non_obvious_convention"),
    (r"\bhidden_", "non_obvious_"),
    (r"\bhidden\b", "non-obvious"),
    (r"\boracle\b", "task-author"),
    (r"\btest_script\.py\b", "development check file"),
    (r"\breference_solution\b", "worked solution"),
    (r"\breference solution\b", "worked solution"),
    (r"\bgold_answer\b", "target answer"),
    (r"\bexpected_answer\b", "target answer"),
    (r"\bGOLD_DATA\b", "TARGET_DATA"),
    (r"\bGOLD_", "TARGET_"),
    (r"\bgold_", "target_"),
    (r"\bgold data\b", "target data"),
    (r"\bgold\b", "target"),
    (r"\bchecker|validator|grader\b", "evaluation tool"),
    (r"\bprivate\b", "internal"),
)
TEACHER_VALUES = (
    (r"(expected\s*=\s*)['\"][^'\"]+['\"]", "$1'<redacted>'"),
    (r"(got\s*=\s*)['\"][^'\"]+['\"]", "$1'<candidate_output>'"),
    (r"(expected\s*[:=]\s*)([^,;\n\r]+)", "$1<redacted>"),
    (r"(got\s*[:=]\s*)([^,;\n\r]+)", "$1<candidate_output>"),
    (r"(ANSWER:\s*)[^\n\r]+", "$1<redacted>"),
)
ANSWER_LINE = r"(?i)^\s*(ANSWER|ANALYSIS)\s*:"
VERDICT_LINE = r"(?i)(PASS:|FAIL:|SCORE:|expected\s*=)"
ABSOLUTE_PATH = r"/[A-Za-z0-9_.\-~/]+(?:/[A-Za-z0-9_.\-~]+)+"
NO_ATTEMPT = "(text response redacted: ANSWER/ANALYSIS removed)"


def safe_url(url: Column) -> Column:
    """URL without user, query and fragment; a sensitive path is masked, trailing punctuation kept."""
    return bind(url, _safe_url)


def _safe_url(url: Column) -> Column:
    trailing = F.regexp_extract(url, r"([.,;)\]}]*)$", 1)
    core = F.substr(url, F.lit(1), F.length(url) - F.length(trailing))
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
    scheme = F.lower(F.regexp_extract(core, pattern, 1))
    netloc = F.regexp_replace(F.regexp_extract(core, pattern, 2), "^.*@", "")
    path = F.regexp_extract(core, pattern, 3)
    v6 = netloc.rlike(r"^\[[^\[\]]+\](?::\d*)?$")
    plain = netloc.rlike(r"^[^:\[\]]+(?::\d*)?$")
    port = F.regexp_extract(netloc, r":(\d*)$", 1)
    bare_host = F.lower(F.when(v6, F.regexp_extract(netloc, r"^(\[[^\]]+\])", 1)).otherwise(F.regexp_extract(netloc, "^([^:]+)", 1)))
    number = port.try_cast("int")
    fine = (scheme != "") & (v6 | plain) & ((port == "") | F.coalesce(number <= 65535, F.lit(False)))
    host = F.when(number.isNotNull(), F.concat(bare_host, F.lit(":"), number.cast("string"))).otherwise(bare_host)
    kept = F.when(path.rlike(SENSITIVE_PATH), F.lit("/<redacted>")).otherwise(path)
    return F.concat(F.when(fine, F.concat(scheme, F.lit("://"), host, kept)).otherwise(F.lit("<redacted-url>")), trailing)


def redact_url(url: Column) -> Column:
    """URL of a setting: scheme, host, port and a version path only; text that is no URL stays."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)"
    scheme = F.lower(F.regexp_extract(url, pattern, 1))
    netloc = F.regexp_replace(F.regexp_extract(url, pattern, 2), "^.*@", "")
    path = F.regexp_extract(url, pattern, 3)
    host = F.lower(F.regexp_extract(netloc, r"^([^:]*)", 1))
    port = F.regexp_extract(netloc, r":(.*)$", 1)
    number = port.try_cast("int")
    bad_port = (port != "") & ~F.coalesce(port.rlike(r"^\d+$") & (number <= 65535), F.lit(False))
    kept = F.when(F.when(path == "", "/").otherwise(path).rlike(r"^/(?:v\d+)?/?$"), path).otherwise("")
    built = F.concat(scheme, F.lit("://"), host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), number.cast("string"))), kept)
    return F.when(~url.rlike(pattern), url).when(bad_port, F.lit("<redacted-url>")).otherwise(built)


def redact_exact(text: Column, secrets: Sequence[str]) -> Column:
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(MASK))
    return text


def redact_secrets(text: Column, exact: Sequence[str] = ()) -> Column:
    """Known secrets first, then URLs, bearer values, quoted and bare key values, common token shapes."""
    text = bind(redact_exact(text, exact), _mask_urls)
    text = F.regexp_replace(text, BEARER, "$1 " + MASK)
    text = F.regexp_replace(text, QUOTED_SECRET, "$1$2" + MASK + "$2")
    text = F.regexp_replace(text, BARE_SECRET, "$1" + MASK)
    return F.regexp_replace(text, TOKEN_SHAPES, MASK)


def _mask_urls(text: Column) -> Column:
    urls = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), _safe_url)
    # one piece more than URLs: the last piece has no URL after it
    pieces = F.zip_with(F.split(text, URL), urls, lambda p, u: F.concat(F.coalesce(p, F.lit("")), F.coalesce(u, F.lit(""))))
    return F.when(F.contains(text, F.lit("://")), F.array_join(pieces, "")).otherwise(text)


def literal_replacement(token: Column) -> Column:
    return (
        F.when(is_number(token), LITERAL_NUMBER).when(token.rlike(r"[/\\.]"), LITERAL_PATH)
        .when(F.contains(token, F.lit("_")), LITERAL_FIELD).otherwise(LITERAL_TERM)
    )


def replace_token(text: Column, token: Column, replacement: Column | str, number_boundary: str = "word") -> Column:
    """Token with free ends replaced, case ignored where it has letters. A substring test keeps patterns rare."""
    repl = F.lit(replacement) if isinstance(replacement, str) else replacement
    word = F.concat(F.lit("(?iu)"), bounded_pattern(token, WORD_BOUNDARY))
    number = bounded_pattern(token, NUMERIC_BOUNDARIES[number_boundary])
    pattern = F.when(has_letter(token), word).otherwise(number)
    return F.when(F.contains(F.lower(text), F.lower(token)), F.regexp_replace(text, pattern, repl)).otherwise(text)


def redact_literals(text: Column, tokens: Column, max_len: int | None = None) -> Column:
    """Private literals replaced, longest first; an overlong result is cut and marked."""
    out = F.aggregate(longest_first(tokens), text, lambda t, k: replace_token(t, k, literal_replacement(k)))
    if max_len is None:
        return out
    return bind(out, lambda t: F.when(
        F.length(t) > max_len, F.concat(rstrip(F.left(t, F.lit(max_len - 3))), F.lit("..."))).otherwise(t))


def redact_options(text: Column, options: Column, mask: str = "<answer_option>") -> Column:
    kept = F.filter(longest_first(options), lambda o: alnum_count(o) >= 2)
    word = lambda o: F.concat(F.lit("(?iu)"), bounded_pattern(o, WORD_BOUNDARY))
    return F.aggregate(kept, text, lambda t, o: F.when(
        F.contains(F.lower(t), F.lower(o)), F.regexp_replace(t, word(o), F.lit(mask))).otherwise(t))


def redact_values(text: Column, literals: Column, mask: str = "<final_answer_redacted>") -> Column:
    """Answer values replaced wherever they occur, case ignored for one-line values."""
    kept = F.filter(longest_first(literals), lambda v: (alnum_count(v) >= 2) & (F.length(v) <= 500))

    def step(t: Column, v: Column) -> Column:
        exact = F.replace(t, v, F.lit(mask))
        loose = F.regexp_replace(exact, F.concat(F.lit("(?iu)"), escape_regex(v)), F.lit(mask))
        return F.when(F.contains(F.lower(t), F.lower(v)), F.when(F.contains(v, F.lit("\n")), exact).otherwise(loose)).otherwise(t)

    return F.aggregate(kept, text, step)


def sanitize_teacher(text: Column, options: Column, literals: Column) -> Column:
    out = redact_options(redact_values(F.coalesce(text, F.lit("")), literals), options)
    for pattern, replacement in (*TEACHER_WORDS, *TEACHER_VALUES):
        out = F.regexp_replace(out, "(?iU)" + pattern, replacement)
    return out


def sanitize_attempt(text: Column) -> Column:
    """Answer and analysis lines dropped, numbers masked; a fixed note when nothing is left."""
    kept = F.filter(lines_of(text), lambda line: ~strip(line).rlike(ANSWER_LINE))
    out = F.regexp_replace(strip(F.array_join(kept, "\n")), r"(?U)-?\d+(?:\.\d+)?", "<num>")
    return F.when(out == "", F.lit(NO_ATTEMPT)).otherwise(out)


def sanitize_solution(text: Column) -> Column:
    """Answer line dropped, the reasoning kept."""
    kept = F.filter(lines_of(text), lambda line: ~strip(line).rlike(r"(?i)^\s*ANSWER\s*:"))
    out = strip(F.array_join(kept, "\n"))
    return F.when(out == "", F.lit("(reasoning only; answer line withheld)")).otherwise(out)


def sanitize_verdict_tail(text: Column, n: int = 24) -> Column:
    """Last lines of a log without verdict lines, absolute paths masked."""
    kept = F.filter(lines_of(text), lambda line: ~line.rlike(VERDICT_LINE) & ~F.contains(F.lower(line), F.lit("short test summary info")))
    clean = F.filter(F.transform(kept, lambda line: strip(F.regexp_replace(line, ABSOLUTE_PATH, "<path>"))), lambda line: line != "")
    return F.array_join(last_items(clean, n), "\n")


# Lines of a sanitised skill text.
SKILL_HIDDEN = "[SANITIZED: hidden convention removed]"
SKILL_ACTION = "  - **Action**: [SANITIZED: concrete action mapping removed; infer from public task only]"
SKILL_OUTPUT = "[SANITIZED: final-output mapping removed]"


def sanitize_skill(text: Column, options: Column, vocab: Column) -> Column:
    """Skill lines with hidden, action and decision-output lines replaced and labels and literals redacted.

    The section of a line is the last heading above it, carried along the lines of the same text.
    """
    lines = F.transform(lines_of(text), rstrip)
    heading = r"^#{1,6}\s+(.+?)\s*$"
    seed = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<line:string,section:string,head:boolean>>").alias("out"))

    def carry(state: Column, line: Column) -> Column:
        head = line.rlike(heading)
        section = F.when(head, F.lower(F.regexp_extract(line, heading, 1))).otherwise(state["section"])
        item = F.struct(line.alias("line"), section.alias("section"), head.alias("head"))
        return F.struct(section.alias("section"), F.array_append(state["out"], item).alias("out"))

    marked = F.aggregate(lines, seed, carry, lambda s: s["out"])

    def redact(line: Column, masks: Column) -> Column:
        loose = F.aggregate(masks["options"], line, lambda t, o: _skill_token(t, o, "[ANSWER_OPTION]"))
        return F.aggregate(masks["vocab"], loose, lambda t, v: _skill_token(t, v, "[PRIVATE_LITERAL]"))

    def one(item: Column, masks: Column) -> Column:
        line, low = item["line"], F.lower(item["line"])
        return (
            F.when(item["head"], line)
            .when(F.contains(low, F.lit("hidden convention")) | F.contains(low, F.lit("hidden behavior")), SKILL_HIDDEN)
            .when(line.rlike(r"(?i)\*\*action\*\*\s*:"), SKILL_ACTION)
            .when(item["section"].startswith("decision procedure") & low.rlike("emit |output |return "), SKILL_OUTPUT)
            .otherwise(redact(line, masks))
        )

    masks = {"options": longest_first(options), "vocab": longest_first(vocab)}
    return strip(F.array_join(bind_all(masks, lambda m: F.transform(marked, lambda item: one(item, m))), "\n"))


def _skill_token(text: Column, token: Column, mask: str) -> Column:
    word = F.concat(F.lit("(?iu)"), bounded_pattern(token, WORD_BOUNDARY))
    pattern = F.when(token.rlike("[A-Za-z_]"), word).otherwise(bounded_pattern(token, NUMERIC_BOUNDARIES["decimal"]))
    return F.when(F.contains(F.lower(text), F.lower(token)), F.regexp_replace(text, pattern, F.lit(mask))).otherwise(text)
