"""Column expressions for shares, changes, bands and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_COMPARE = {
    ">": lambda c, edge: c > edge,
    ">=": lambda c, edge: c >= edge,
    "<": lambda c, edge: c < edge,
    "<=": lambda c, edge: c <= edge,
    "==": lambda c, edge: c == edge,
}


def band(c: Column, rules: Sequence[tuple], rest, keep_null: bool = False) -> Column:
    """Label of the first ``(operator, edge, label)`` rule that holds, else ``rest``.

    NULL falls through to ``rest`` unless ``keep_null``.
    """
    out = F.when(c.isNull(), F.lit(None)) if keep_null else None
    for op, edge, label in rules:
        test = _COMPARE[op](c, F.lit(edge))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return F.lit(rest) if out is None else out.otherwise(F.lit(rest))


def share(part: Column, total: Column) -> Column:
    """``part / total``; zero when the total is not positive."""
    return F.when(total > 0, part / total).when(part.isNull(), F.lit(None)).otherwise(F.lit(0.0))


def delta_fraction(base: Column, current: Column) -> Column:
    """Relative change as a fraction; NULL when the base is missing or zero."""
    return F.try_divide(current - base, base)


def safe_pct(base: Column, current: Column) -> Column:
    """Relative change in percent; NULL unless the base is positive."""
    return F.when(base > 0, (current - base) / base * 100)


def signed_label(c: Column) -> Column:
    """Signed number with up to six significant digits, as C's ``%+g`` writes it."""
    x = c.cast("double")
    scientific = F.format_string("%+.5e", x)
    exponent = F.regexp_extract(scientific, r"e([+-]\d+)$", 1).try_cast("int")
    zeros = r"(\.\d*?)0+$"
    label = F.when(x.isNull() | F.isnan(x), F.lit("NA"))
    for power in range(-4, 6):
        fixed = F.format_string(f"%+.{5 - power}f", x)
        label = label.when(exponent == power, F.regexp_replace(F.regexp_replace(fixed, zeros, "$1"), r"\.$", ""))
    mantissa = F.regexp_extract(scientific, r"^(.*)e", 1)
    mantissa = F.regexp_replace(F.regexp_replace(mantissa, zeros, "$1"), r"\.$", "")
    return label.otherwise(F.concat(mantissa, F.lit("e"), F.regexp_extract(scientific, r"e(.*)$", 1)))


def truncate_label(c: Column, width: int = 28) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
