"""Numeric columns: guards, intervals, exact tests, seeds."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, functions as F

from evalmart.functions.text import bind

# The 95 % normal quantile and the base of the comparison seeds.
Z95 = 1.959963984540054
SEED_BASE = 20260718
_LN_2PI = math.log(2 * math.pi)


def finite_nonneg(value: Column) -> Column:
    """True for a number that is finite and not negative; null is false."""
    number = value.try_cast("double")
    ok = ~F.isnan(number) & (number >= 0) & (number < F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))


def token_count(value: Column) -> Column:
    """Token count from text or number: missing or empty is 0; negative or unreadable is null, and so is text with a fraction.
    A number's fraction is cut off."""
    text, number = value.cast("string"), value.try_cast("double")
    written = F.when(F.rlike(text, F.lit(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$")), F.regexp_replace(text, r"[\s_+]", "").try_cast("bigint"))
    counted = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number.try_cast("bigint"))
    count = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).when(F.typeof(value) == "string", written).otherwise(counted)
    return F.when(count >= 0, count)


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


def normalize_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[,_\s]", "")


def missing_constants(text: Column, constants: Column) -> Column:
    """The constants (text array) that the text does not state, digits normalised."""
    return bind(normalize_digits(text), lambda plain: F.filter(constants, lambda c: ~F.contains(plain, normalize_digits(c))))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def exact_round(value: Column, digits: int) -> Column:
    """Round by the exact binary value, ties to even; ``round`` works on the printed decimal, ties away from 0.

    Values below the last digit are compared with the half step directly: the formatter sees only their
    shortest decimal.
    """
    unit = 10.0 ** -digits
    half = Fraction(1, 2 * 10**digits)
    size = F.abs(value)
    up = size >= float(half) if Fraction(float(half)) > half else size > float(half)
    formatted = F.call_function("format_number", value, F.lit("0." + "0" * digits)).cast("double")
    return F.when(size < unit, F.when(up, F.signum(value) * unit).otherwise(0.0)).otherwise(formatted)


def wilson(passed: Column, n: Column) -> Column:
    """Wilson 95 % interval in percent; (0, 0) for an empty group."""
    total = n.cast("double")
    p = F.try_divide(passed.cast("double"), total)
    z2 = F.lit(Z95 * Z95)
    scale = 1 + z2 / total
    center = (p + z2 / (2 * total)) / scale
    margin = F.lit(Z95) * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / scale
    return F.when(
        n > 0, F.struct((100 * (center - margin)).alias("low"), (100 * (center + margin)).alias("high"))
    ).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))


def display_percent(passed: Column, n: Column) -> Column:
    """Percent text with one decimal; null for an empty group."""
    return F.call_function("format_number", exact_round(ratio(passed, n), 4) * 100, F.lit("0.0"))


def success_rate(iterations: Column) -> Column:
    return exact_round(F.try_divide(F.lit(1.0), iterations.cast("double")), 4)


def log_gamma(x: Column) -> Column:
    """ln gamma by the Stirling series after a shift of eight."""
    y = x + 8
    series = (
        (y - 0.5) * F.ln(y) - y + 0.5 * _LN_2PI + 1 / (12 * y) - 1 / (360 * y * y * y)
        + 1 / (1260 * y * y * y * y * y)
    )
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    return series - F.ln(product)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Exact two-sided p for two discordant counts.

    The tail is summed downward from its largest term. Terms below it shrink at least like exp(-2 j^2 / d),
    so 5 sqrt(d) + 60 of them reach past double precision, whatever the size of the counts.
    """
    d = (b + c).cast("double")
    k = F.least(b, c).cast("double")
    log_top = log_gamma(d + 1) - log_gamma(k + 1) - log_gamma(d - k + 1) - d * math.log(2.0)
    steps = F.least(k, F.ceil(5 * F.sqrt(d)) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    counted = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))

    def step(state, j):
        # P(k - j) = P(k - j + 1) * (k - j + 1) / (d - k + j)
        term = state["term"] * (k - j + 1) / (d - k + j)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    tail = F.aggregate(counted, start, step, lambda state: state["total"])
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(log_top) * tail))


def stable_seed(*parts: Column, base: int = SEED_BASE) -> Column:
    """Seed of a comparison: base plus the leading four bytes of the digest of its joined parts."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + base


def seeded_digest(seed: int | Column, *parts: Column) -> Column:
    """Digest that orders rows pseudo-randomly but repeatably."""
    start = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat_ws("|", start.cast("string"), *[p.cast("string") for p in parts]), 256)
