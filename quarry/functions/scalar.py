"""Scalar functions whose null, NaN, rounding and division results differ from Spark's own.

Division by zero gives infinities and NaN for floats and an error for integers, integers divide
truncated, NaN compares false, rounding goes half to even, logarithms of zero and below give -inf
and NaN, AND and OR are null if a side is null, IN is false for null, and padding never cuts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _nan(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.isnan(c.cast("double")), F.lit(False))
    return out


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def int_divide(a: Column, b: Column) -> Column:
    """Truncated towards zero; a zero divisor is an error."""
    return F.call_function("div", a, b)


def both(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def either(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison of floats: false if a side is NaN, except for <>, which is true."""
    plain = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(_nan(a, b), F.lit(op == "<>")).otherwise(plain)


def is_in(a: Column, values: list[Column]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(a == v, F.lit(False))
    return out


def log(x: Column, base: Column | None = None) -> Column:
    """Natural, or to a base; -inf of 0, NaN below."""
    x = x.cast("double")
    plain = F.when(x > 0, F.ln(F.when(x > 0, x).otherwise(F.lit(1.0))))
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(plain)
    return out if base is None else divide(out, log(base))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(log(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(log(x))


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).otherwise(log(x + 1))


def _scaled(f, x: Column, digits: Column | None) -> Column:
    if digits is None:
        return f(x.cast("double")).cast("double")
    unit = F.pow(F.lit(10.0), digits)
    return f(x * unit).cast("double") / unit


def ceil(x: Column, digits: Column | None = None) -> Column:
    return _scaled(F.ceil, x, digits)


def floor(x: Column, digits: Column | None = None) -> Column:
    return _scaled(F.floor, x, digits)


def trunc(x: Column, digits: Column | None = None) -> Column:
    return _scaled(lambda y: F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)), x, digits)


def round_(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def is_inf(x: Column) -> Column:
    return F.abs(x) == INF


# What the classes of Unicode text mean, as regular expressions; none holds for an empty text.
TEXT_CLASSES = {
    "is_alnum": r"^[\p{L}\p{N}]+$", "is_alpha": r"^\p{L}+$", "is_decimal": r"^\p{Nd}+$", "is_digit": r"^[\p{Nd}\p{No}]+$", "is_numeric": r"^\p{N}+$",
    "is_lower": r"^[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$", "is_upper": r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$",
    "is_space": r"^[\p{Z}\s]+$", "is_printable": r"^[^\p{C}\p{Zl}\p{Zp}]*$", "is_title": r"^(?:[^\p{L}]*\p{Lu}(?:\p{Ll})*)+[^\p{L}]*$",
}


def text_class(name: str, x: Column) -> Column:
    return x.rlike(r"(?s)" + TEXT_CLASSES[name])


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def swapcase(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def title(x: Column) -> Column:
    """Each run of letters begins with an upper-case letter."""
    parts = F.regexp_extract_all(x, F.lit(r"(?s)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, capitalize), "")


def pad(x: Column, width: Column, fill: Column, side: str) -> Column:
    """``side``: left, right or center; a longer text stays whole."""
    short = F.length(x) < width
    if side == "left":
        return F.when(short, F.lpad(x, width, fill)).otherwise(x)
    if side == "right":
        return F.when(short, F.rpad(x, width, fill)).otherwise(x)
    left = F.floor((width - F.length(x)) / 2).cast("int")
    return F.when(short, F.rpad(F.concat(F.repeat(fill, left), x), width, fill)).otherwise(x)


def trim(x: Column, chars: Column | None = None, side: str = "both") -> Column:
    """One argument: white space; two: a set of characters."""
    if chars is not None:
        return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side](x, chars)
    ends = {"both": r"^[\p{Z}\s]+|[\p{Z}\s]+$", "left": r"^[\p{Z}\s]+", "right": r"[\p{Z}\s]+$"}[side]
    return F.regexp_replace(x, ends, "")


def safe_cast(x: Column, target: str, source: str) -> Column:
    """A cast that raises where a value would be changed: floats with a fraction or NaN to integers."""
    if target in ("tinyint", "smallint", "int", "bigint") and source in ("float", "double"):
        whole = (x == F.floor(x)) & ~F.isnan(x)
        return F.when(x.isNull(), F.lit(None).cast(target)).when(whole, x.cast(target)).otherwise(F.raise_error(F.concat(F.lit("lossy cast of "), x.cast("string"))).cast(target))
    return x.cast(target)
