"""Small column expressions shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


#: White space as Python's str.strip() sees it.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: str | Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))


def number_text(value: Column) -> Column:
    """A double as text the way Python prints it, for values that need no exponent."""
    x = value.cast("double")
    size = F.abs(x)
    fixed = F.regexp_replace(F.format_string("%.9f", x), r"(\.\d+?)0+$", "$1")
    return F.when(F.isnan(x), "nan").when((size >= 1e7) & (size < 1e16), fixed).otherwise(x.cast("string"))


def printed(pattern: str, value: Column) -> Column:
    """`pattern` with one `%.<digits>f`, rounded as C and Python round: by the exact binary value, ties to even.

    The JVM rounds the shortest decimal text of a double, half up. The product with 2 * 10**digits is taken
    without error (Veltkamp split), which tells on which side of a tie the value lies.
    """
    digits = int(re.search(r"%\.(\d)f", pattern)[1])
    x, unit = value.cast("double"), 10.0**digits
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    double = x * F.lit(2 * unit)
    rest = (high * F.lit(2 * unit) - double) + (x - high) * F.lit(2 * unit)
    tie = F.abs(double % 2) == 1
    whole = F.when(tie & (rest > 0), (double + 1) / 2).when(tie & (rest < 0), (double - 1) / 2).otherwise(F.rint(double / 2))
    return F.format_string(pattern, whole / F.lit(unit))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def clip01(value: Column) -> Column:
    return clip(value, 0.0, 1.0)


def at_least(value: Column, floor: float) -> Column:
    return F.greatest(value.cast("double"), F.lit(float(floor)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def share(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where there is no positive whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def band(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first step, highest first, that `value` reaches."""
    names = [F.when(value >= F.lit(limit), F.lit(name)) for limit, name in steps]
    return F.coalesce(*names, F.lit(otherwise))


def first_failure(rules: Iterable[tuple[Column, str | Column]]) -> Column:
    """Message of the first rule that holds, NULL if none does."""
    return F.coalesce(
        *[F.when(F.coalesce(broken, F.lit(True)), m if isinstance(m, Column) else F.lit(m)) for broken, m in rules]
    )


def is_finite(value: Column) -> Column:
    x = value.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def outside(value: Column, low: float, high: float) -> Column:
    """True for a missing, NaN or out-of-range value."""
    x = value.cast("double")
    return x.isNull() | F.isnan(x) | (x < F.lit(low)) | (x > F.lit(high))


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns in {what}: {missing}")
