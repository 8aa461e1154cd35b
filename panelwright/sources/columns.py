"""Column names and types: metadata work only, no job is started here."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions import blank_to_null, normalize_key, to_int, to_number
from panelwright.presets import ACTOR_ALIASES, ACTOR_PATTERNS, LONG_PATTERNS
from panelwright.sources.files import LONG_SCHEMA, ColumnsMissing

REQUIRED_LONG = ("category", "indicator", "period", "value")


def _plain_name(name: str) -> str:
    ascii_name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", ascii_name.replace("%", "_percent_"))
    snake = re.sub(r"[^a-z0-9]+", "_", words.lower()).strip("_") or "x"
    return f"x{snake}" if snake[0].isdigit() else snake


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case ASCII column names; a repeated name gets ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    names = []
    for name in map(_plain_name, df.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def resolve_columns(
    df: DataFrame,
    targets: Mapping[str, Sequence[str]],
    mode: str = "alias",
    optional: Mapping[str, str] | None = None,
) -> DataFrame:
    """Give columns their target names.

    ``alias``: the first listed name that is present wins and the other columns stay.
    ``regex``: the first column, in table order, that matches any pattern wins; only the
    targets are kept, and a target in ``optional`` (name to type) that nothing matches
    becomes a NULL column.
    """
    optional = optional or {}
    found: dict[str, str] = {}
    for target, wanted in targets.items():
        if mode == "alias":
            hit = next((name for name in wanted if name in df.columns), None)
        else:
            hit = next((name for name in df.columns if any(re.search(p, name) for p in wanted)), None)
        if hit is not None:
            found[target] = hit
    missing = [t for t in targets if t not in found and t not in optional]
    if missing:
        raise ColumnsMissing(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    if mode == "alias":
        return df.withColumnsRenamed({hit: target for target, hit in found.items() if hit != target})
    return df.select(*[
        F.col(found[t]).alias(t) if t in found else F.lit(None).cast(optional[t]).alias(t) for t in targets
    ])


def validate_schema(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job when a required column is absent."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ColumnsMissing(f"missing columns: {', '.join(missing)}")
    return df


def standardize_long(df: DataFrame, patterns: Mapping[str, Sequence[str]] = LONG_PATTERNS) -> DataFrame:
    """Raw observations to the canonical long schema, whatever the input headers are."""
    optional = {f.name: f.dataType.simpleString() for f in LONG_SCHEMA.fields if f.name not in REQUIRED_LONG}
    named = resolve_columns(clean_names(df), patterns, mode="regex", optional=optional)
    cast = {"int": to_int, "double": to_number, "string": blank_to_null}
    return named.select(*[cast[f.dataType.simpleString()](f.name).alias(f.name) for f in LONG_SCHEMA.fields])


def standardize_actor(df: DataFrame, names: Mapping[str, Sequence[str]] | None = None, mode: str = "alias") -> DataFrame:
    """Raw actor counts to (actor, period, total, armed, support), whatever the input headers are.

    ``names`` are aliases or, in mode ``regex``, patterns for actor, year and total; the markets
    ``armed`` and ``support`` are taken by name and NULL where they are absent. Actors are text keys.
    Rows without an actor, a year or a total are left out.
    """
    plain = clean_names(df)
    markets = {m: F.col(m) if m in plain.columns else F.lit(None) for m in ("armed", "support")}
    chosen = names or (ACTOR_ALIASES if mode == "alias" else ACTOR_PATTERNS)
    if mode == "regex":
        chosen = {**chosen, **{m: [f"^{m}$"] for m in markets}}
        plain = resolve_columns(plain, chosen, mode="regex", optional=dict.fromkeys(markets, "double"))
        markets = {m: F.col(m) for m in markets}
    else:
        plain = resolve_columns(plain, chosen)
    actor = normalize_key("actor")
    return plain.select(
        F.when(actor != "", actor).alias("actor"), to_int("year").alias("period"), to_number("total").alias("total"),
        *[to_number(c.cast("string")).alias(m) for m, c in markets.items()],
    ).dropna(subset=["actor", "period", "total"])
