"""Literals and tokens that an audit looks for: numbers, quoted strings, code spans, flags, options, names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalmart.functions.text import bind, lines_of, strip

# Patterns of literals.
NUMBER = r"(?U)-?\d+(?:\.\d+)?"
QUOTED_FREE = r"""(?<![A-Za-z0-9])['"]([^'"\n]{2,64})['"](?![A-Za-z0-9])"""
QUOTED_LONG = r"""['"]([^'"]{2,80})['"]"""
QUOTED_SKILL = r"""['"]([^'"]{2,64})['"]"""
CODE_SPAN = r"(?<!`)`([^`\n]{2,80})`(?!`)"
FLAG = r"--[a-z][a-z0-9_-]*[a-z0-9]"
BARE_STRUCTURED = r"(?<![A-Za-z0-9_./\\-])(?=[A-Za-z0-9-]*[0-9_./\\])[A-Za-z0-9][A-Za-z0-9_./\\-]{1,80}(?![A-Za-z0-9_./\\-])"
ONE_OF = r"(?i)ANSWER:\s*<one of:\s*([^>\n]+)>"
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
FILE_NAME = r"\b([a-z][a-z0-9_-]*\.(?:py|h5|hdf5|csv|tsv|json|jsonl|yaml|yml|nc|mat|pdf|pptx|xlsx))\b"
ENUM_TOKEN = r"^[a-z][a-z0-9_]{2,}$"

# Words that are scaffolding rather than content.
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "you",
    "are", "not", "use", "using", "must", "should", "will", "can", "may", "any",
    "all", "each", "one", "two", "given", "input", "output", "value", "values",
    "result", "results", "return", "returns", "function", "functions", "code",
    "task", "tasks", "test", "tests", "assert", "import", "def", "class", "self",
    "true", "false", "none", "print", "data", "list", "dict", "string", "str",
    "int", "float", "bool", "file", "files", "path", "line", "lines", "answer",
    "analysis", "solution", "program", "python", "run", "running", "expected",
    "actual", "case", "cases", "example", "examples", "following", "above",
    "below", "number", "numbers", "set", "get", "name", "names", "format",
    "required", "exactly", "scenario", "problem", "compute", "calculate",
)
# Names that may be public everywhere.
FILE_ALLOWED = (
    "task.md", "skill.md", "readme.md", "scenario.yaml", "manifest.json", "config.json", "results.jsonl", "cases.jsonl",
)
SNAKE_ALLOWED = (
    "max_files", "forbidden_paths", "x_train", "y_train", "x_test", "y_test", "n_samples", "n_features",
    "input_path", "output_path", "file_path",
)
# Words of a line that states a rule's numbers.
THRESHOLD_WORDS = (
    "threshold", "cutoff", "baseline", "window", "hours", "hour", "days", "day", "stipend", "rating", "tier", "band", "rule",
)
# Characters around a bare token or an option.
TOKEN_EDGE = r"^[`'\".,:;()\[\]{}<>]+|[`'\".,:;()\[\]{}<>]+$"
OPTION_EDGE = r"^[`'\" ]+|[`'\" ]+$"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def is_number(token: Column) -> Column:
    return token.rlike(r"^(?U)-?\d+(?:\.\d+)?$")


def is_trivial_number(token: Column) -> Column:
    """A one-digit integer."""
    return token.rlike(r"^(?U)-?0*\d$")


def is_structured(token: Column) -> Column:
    """More like contract data than a word: number, flag, path, identifier, upper-case label."""
    return F.when(is_number(token), ~is_trivial_number(token)).otherwise(
        token.startswith("--") | token.rlike(r"(?U)\d") | token.rlike(r"[_./\\]") | token.rlike(r"^[A-Z][A-Z0-9_-]{2,}$"))


def _low_alnum(token: Column) -> Column:
    return F.length(F.regexp_replace(token, "[^a-z0-9]", ""))


def numbers(text: Column) -> Column:
    return F.filter(_all(text, NUMBER), lambda n: ~is_trivial_number(n))


def hard_literals(text: Column, variant: str = "structured") -> Column:
    """Distinct literals whose restating would give something away.

    ``structured`` keeps quoted strings and code spans that look like contract data; ``plain`` keeps every quoted
    string with three letters or digits; ``skill`` is ``structured`` without the word list and the free ends.
    """
    if variant == "plain":
        quoted = F.filter(F.transform(_all(text, QUOTED_LONG, 1), strip),
                          lambda q: F.length(F.regexp_replace(q, "[^A-Za-z0-9]", "")) >= 3)
    else:
        pattern = QUOTED_FREE if variant == "structured" else QUOTED_SKILL
        found = F.transform(F.concat(_all(text, pattern, 1), _all(text, CODE_SPAN, 1)), lambda q: F.lower(strip(q)))
        quoted = F.filter(found, lambda q: (_low_alnum(q) >= 3) & is_structured(q))
        if variant == "structured":
            quoted = F.filter(quoted, lambda q: ~q.isin(list(STOPWORDS)))
    return F.array_distinct(F.concat(numbers(text), quoted, _all(F.lower(text), FLAG)))


def _public_form(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, TOKEN_EDGE, ""))


def _is_public_token(token: Column) -> Column:
    return (_low_alnum(token) >= 2) & ~token.isin(list(STOPWORDS)) & is_structured(token)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def public_tokens(text: Column) -> Column:
    """Literals a reader of the public text can see: quoted, bare structured, and their path and name variants."""
    bare = F.filter(F.transform(_all(text, BARE_STRUCTURED), _public_form), _is_public_token)
    percent = F.when(text.rlike(r"(?iU)%|\bpercent(?:age)?\b"), F.array(F.lit("100"))).otherwise(F.array().cast("array<string>"))
    named = bind(bare, lambda b: F.concat(b, F.filter(
        F.transform(F.filter(b, lambda t: F.contains(t, F.lit(".")) & ~is_number(t)), lambda t: _stem(_basename(t))),
        _is_public_token)))
    seen = F.array_distinct(F.concat(hard_literals(text), percent, named))

    def variants(token: Column) -> Column:
        cleaned = F.regexp_replace(token, r"^[./]+", "")
        base = _basename(F.when(cleaned == "", token).otherwise(cleaned))
        dotted = F.contains(base, F.lit(".")) & ~is_number(base)
        return F.array_compact(F.array(F.nullif(cleaned, F.lit("")), F.nullif(base, F.lit("")), F.when(dotted, _stem(base))))

    return bind(seen, lambda a: F.array_distinct(F.concat(
        a, F.filter(F.transform(F.flatten(F.transform(a, variants)), _public_form), _is_public_token))))


def private_vocab(hidden: Column, public: Column) -> Column:
    """Literals of the hidden text that the public text does not show."""
    return F.array_except(hard_literals(hidden), public_tokens(public))


def answer_options(text: Column, lower: bool = True) -> Column:
    """Decision labels: the listed options of an answer line, and code spans of a multiple-choice question line."""
    listed = F.flatten(F.transform(_all(text, ONE_OF, 1), lambda blob: F.split(blob, r"[|/,]")))
    listed = F.transform(listed, lambda o: F.regexp_replace(strip(o), OPTION_EDGE, ""))
    asked = F.filter(lines_of(text), lambda line: F.contains(F.lower(line), F.lit("which of the following")))
    spans = F.transform(F.flatten(F.transform(asked, lambda line: _all(line, "`([^`]+)`", 1))), strip)
    options = F.filter(F.concat(listed, spans), lambda o: o != "")
    return F.array_distinct(F.transform(options, F.lower) if lower else options)


def task_tokens(text: Column) -> Column:
    """Snake-case names, flags and file names of a task text, minus the names allowed everywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    snake = F.filter(_all(low, SNAKE), lambda t: ~t.isin(list(SNAKE_ALLOWED)))
    files = F.filter(_all(low, FILE_NAME, 1), lambda t: ~t.isin(list(FILE_ALLOWED)))
    return F.array_distinct(F.concat(snake, _all(low, FLAG), files))


def answer_audit(mode: Column, family: Column, expected: Column, space: Column, task_text: Column, scenario_text: Column) -> Column:
    """What must not be restated of a short-answer task: expected texts, option names, numbers.

    ``expected`` is the array of scalar leaves of the expected answer as text, ``space`` the array of options.
    """
    none = F.array().cast("array<string>")
    clean = F.filter(F.transform(F.coalesce(expected, none), strip), lambda e: e != "")
    compact = F.transform(clean, lambda e: F.regexp_replace(F.lower(e), r"(?U)\s+", ""))
    enum = F.concat(
        F.filter(F.transform(F.coalesce(space, none), lambda s: F.lower(strip(s))), lambda s: s != ""),
        F.filter(F.transform(clean, F.lower), lambda e: e.rlike(ENUM_TOKEN)))
    both = F.concat_ws("\n", task_text, scenario_text)
    lines = F.filter(lines_of(both), lambda line: F.lower(line).rlike("|".join(THRESHOLD_WORDS)))
    rule_numbers = F.when(family == "rule_following", F.flatten(F.transform(lines, lambda line: _all(line, NUMBER)))).otherwise(none)
    found = F.concat(F.flatten(F.transform(clean, lambda e: _all(e, NUMBER))), rule_numbers)
    wanted = mode == "text_short_answer"
    pick = lambda a: F.when(wanted, F.array_distinct(a)).otherwise(none)
    return F.struct(pick(compact).alias("expected_texts"), pick(enum).alias("enum_tokens"), pick(found).alias("numeric_tokens"))


def longest_first(tokens: Column) -> Column:
    """Tokens by falling length, equal lengths by text."""
    keyed = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda s: s["t"])


