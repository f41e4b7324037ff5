"""Column expressions shared by the operators. All of them stay inside codegen."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: text accepted as a plain decimal number.
NUMERIC_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(ts: str | Column) -> Column:
    """Whole microseconds since 1970 of either timestamp type (session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def order_key(ts: str | Column, ordinal: str | Column) -> Column:
    """Time and ordinal as one number. A decimal stays in a hash aggregate, where a struct forces a sort."""
    return micros(ts).cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + col(ordinal).cast("decimal(19,0)")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def finite(value: str | Column, digits: int | None = None) -> Column:
    """Non-finite becomes null (Spark orders NaN above every number), else half-even rounding."""
    v = col(value)
    kept = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)
    return kept if digits is None else F.bround(kept, digits)


def to_numeric(text: str | Column) -> Column:
    """Text to double; anything that is not a plain finite decimal number is null."""
    t = F.trim(col(text).cast("string"))
    number = F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))
    return finite(number)


def compact(text: str | Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]", "")


def natural_key(text: str | Column) -> Column:
    """Sort key in which digit runs, of any length, compare as numbers and letters ignore case.

    A run is led by its number of digits, so a longer number sorts after a shorter one.
    """
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def number(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.concat(F.lit("\u0001"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), number(p)).otherwise(F.concat(F.lit("\u0000"), p)))
    return F.array_join(padded, "")


def hash_fraction(text: str | Column) -> Column:
    """A stable position in [0, 1] from the first 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 8), 16, 10).cast("double") / F.lit(float(2**32 - 1))


def hash_rank(text: str | Column) -> Column:
    """A stable 52-bit draw, exact in a double, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(col(text)), 1, 13), 16, 10).cast("double")


def array_median(values: Column) -> Column:
    """Median of a small array; nulls are skipped, empty gives null."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(kept)
    low = F.get(kept, F.floor((n - 1) / 2).cast("int"))
    high = F.get(kept, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def number_text(value: str | Column) -> Column:
    """Six significant digits without trailing zeros; exponent form outside 1e-4 .. 1e6."""
    v = col(value).cast("double")
    sci = F.format_string("%.5e", v)
    exponent = F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(-?[0-9]+\.?[0-9]*)e", 1), r"\.?0+$", "")
    long_form = F.concat(
        mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    fixed = F.coalesce(
        *[F.when(exponent == e, F.format_string(f"%.{5 - e}f", v)) for e in range(-4, 6)])
    plain = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.when(v.isNull(), None).when(v == 0, "0").when(
        (exponent >= -4) & (exponent < 6), plain).otherwise(long_form)


def range_text(low: str | Column, high: str | Column) -> Column:
    a, b = number_text(low), number_text(high)
    return F.when(col(low) == col(high), a).otherwise(F.concat(a, F.lit("–"), b))


def counted(count: str | Column, noun: str) -> Column:
    n = col(count)
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def linspace_index(i: Column, n: Column, k: Column) -> Column:
    """Position i of k evenly spaced whole indices over 0..n-1 (truncating, end exact)."""
    step = (n - 1).cast("double") / F.greatest(k - 1, F.lit(1)).cast("double")
    return F.when((i == k - 1) & (k > 1), n - 1).otherwise(F.floor(i * step)).cast("long")
