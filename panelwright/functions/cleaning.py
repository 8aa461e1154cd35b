"""Column expressions that clean text and numbers. None of them raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_key(c: str | Column) -> Column:
    """Text key: surrounding blanks removed, inner runs of blanks made one, lower case."""
    squished = F.regexp_replace(_col(c).cast("string"), r"(?U)\s+", " ")
    return F.lower(F.trim(squished))


def blank_to_null(c: str | Column, missing: tuple[str, ...] = ("", "NA")) -> Column:
    """Trimmed text; empty text and the missing marker become NULL."""
    text = F.regexp_replace(_col(c).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(~text.isin(*missing), text)


def to_number(c: str | Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes NULL."""
    text = blank_to_null(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_int(c: str | Column) -> Column:
    """Text to int by way of double, so that ``'2025.7'`` gives 2025."""
    return to_number(c).try_cast("int")


def is_finite(c: str | Column) -> Column:
    """False for NaN, which Spark orders above infinity, and NULL for NULL."""
    return F.abs(_col(c).cast("double")) < float("inf")


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), _col(c).cast("double"))


def clip_nonneg(c: str | Column) -> Column:
    """Negative to zero. NULL stays NULL, which ``greatest`` would not give."""
    x = _col(c)
    return F.when(x < 0, F.lit(0).cast("double")).otherwise(x)
