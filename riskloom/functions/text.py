"""Text cell, number and token expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.fixed import (
    AT_LEAST_PATTERN,
    COARSE_BOUND_PATTERN,
    COARSE_RANGE_PATTERN,
    LESS_PATTERN,
    MONTH_TOKENS,
    NO_WORDS,
    RANGE_PATTERN,
    SPREADSHEET_PATTERN,
    YES_WORDS,
)

NOT_IN_NUMBERS = r"[^-+.0-9eE\s]"


def strip(value: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(F.regexp_replace(value, r"^\s+", ""), r"\s+$", "")


def blank_to_null(value: Column) -> Column:
    """Trim a text cell; an empty cell becomes missing."""
    return F.nullif(strip(value), F.lit(""))


def number(value: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes missing.

    The cast trims white space but would also take `5f`, `nan` and `Infinity`.
    """
    text = value.cast("string")
    return F.when(~text.rlike(NOT_IN_NUMBERS), text.try_cast("double"))


def looks_numeric(value: Column) -> Column:
    """Whether a filled text is a plain number; missing stays missing."""
    return F.when(value.isNotNull(), number(value).isNotNull())


def normalized_name(value: Column) -> Column:
    """Lower-case name with runs of other characters turned into one underscore."""
    joined = F.regexp_replace(F.lower(strip(value)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(joined, r"^_+|_+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a sub-expression once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_round(value: Column, digits: int, half_up: bool = False) -> Column:
    """Round on the exact binary value, as printing with a fixed number of digits does.

    The built-in `round` sees the shortest decimal text of a double, which may
    sit on a half where the double itself does not; number formatting does not.
    """
    printed = F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
    if not half_up:
        return printed
    steps = value * F.lit(float(2 ** (digits + 1)))
    return F.when(steps == F.floor(steps), F.round(value, digits)).otherwise(printed)


def general_number(value: Column) -> Column:
    """Six significant digits, as C's %g prints them."""
    scientific = F.call_function("format_number", F.abs(value), F.lit("0.00000E0"))
    parts = F.struct(
        F.replace(F.substring_index(scientific, "E", 1), F.lit("."), F.lit("")).alias("digits"),
        F.substring_index(scientific, "E", -1).cast("int").alias("exponent"),
    )

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(text, r"\.?0*$", "")

    def spelled(s: Column) -> Column:
        d, e = s["digits"], s["exponent"]
        whole = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, F.lit(6)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        wide = F.concat(
            trimmed(F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, 2, 5))),
            F.lit("e"),
            F.when(e < 0, "-").otherwise("+"),
            F.lpad(F.abs(e).cast("string"), 2, "0"),
        )
        return F.when((e >= 0) & (e < 6), trimmed(whole)).when((e >= -4) & (e < 0), trimmed(small)).otherwise(wide)

    return F.concat(F.when(value < 0, "-").otherwise(""), let(parts, spelled))


def number_text(value: Column) -> Column:
    """Whole numbers without decimals, other numbers with six digits."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("long").cast("string")).otherwise(general_number(value))


def signature(value: Column, numeric: bool) -> Column:
    """Comparable text of a cell; a missing cell stays missing."""
    return number_text(value.cast("double")) if numeric else strip(value)


def token(value: Column) -> Column:
    """Trimmed token with ASCII comparison signs and single spaces."""
    text = F.replace(F.replace(strip(value), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    return F.regexp_replace(text, r"\s+", " ")


def coarse_interval(value: Column) -> Column:
    text = strip(value)
    return text.rlike(COARSE_BOUND_PATTERN) | text.rlike(COARSE_RANGE_PATTERN)


def coarse_spreadsheet_date(value: Column) -> Column:
    """`day-month` text with a real month name."""
    months = "|".join(MONTH_TOKENS)
    return F.lower(strip(value)).rlike(rf"^\d+-({months})$")


def strict_spreadsheet_date(value: Column) -> Column:
    """`day-xxx` text with any three letters."""
    return token(value).rlike(SPREADSHEET_PATTERN)


def interval(value: Column) -> Column:
    """Struct (kind, lower, upper, canonical); missing when the token is no interval."""
    text = token(value)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("double")

    low, high = part(RANGE_PATTERN, 1), part(RANGE_PATTERN, 2)
    below, above = part(LESS_PATTERN, 1), part(AT_LEAST_PATTERN, 1)

    def entry(kind: str, lower: Column, upper: Column, canonical: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            lower.alias("lower"),
            upper.alias("upper"),
            canonical.alias("canonical"),
        )

    return (
        F.when(
            text.rlike(RANGE_PATTERN),
            entry("range", low, high, F.concat(number_text(low), F.lit(" - "), number_text(high))),
        )
        .when(
            text.rlike(LESS_PATTERN),
            entry("lt", F.lit(float("-inf")), below, F.concat(F.lit("< "), number_text(below))),
        )
        .when(
            text.rlike(AT_LEAST_PATTERN),
            entry("ge", above, F.lit(float("inf")), F.concat(F.lit(">= "), number_text(above))),
        )
    )


def yes_no(value: Column) -> Column:
    """Yes/no vocabulary; other words stay as lower-case text, blanks are missing."""
    text = F.lower(strip(value.cast("string")))
    return (
        F.when(text.isin(*YES_WORDS), "yes").when(text.isin(*NO_WORDS), "no").otherwise(F.nullif(text, F.lit("")))
    )


def within(value: Column, words: Iterable[str]) -> Column:
    return F.lower(value).isin(*words)


def reasons(*conditions: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    entries = [F.when(condition, F.lit(text) if isinstance(text, str) else text) for condition, text in conditions]
    return F.array_compact(F.array(*entries))
