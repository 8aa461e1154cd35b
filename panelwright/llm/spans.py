"""Spans of regular expressions as column expressions: places in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,kind_order:int,end:int,kind:string>>"


_CHUNK = 256  # matches gathered at a time


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gather(
    pieces: Column, kind: str, admit: Callable[[Column], Column], build: Callable[[Column, Column, Column], Column],
) -> Column:
    """What ``build(start, end, piece)`` makes of the admitted pieces, as an array of type ``kind``.

    A piece has the text ``before`` a ``match`` and the match, null after the last. Results are added to
    an array by copying it, so they are gathered in chunks: the work stays near the number of matches.
    """
    none = F.array().cast(kind)

    def one(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["before"])
        end = start + F.coalesce(F.length(piece["match"]), F.lit(0))
        added = F.concat(state["own"], F.array(build(start, end, piece)).cast(kind))
        admitted = piece["match"].isNotNull() & F.coalesce(admit(piece["match"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(admitted, added).otherwise(state["own"]).alias("own"))

    def chunk(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("own")), one)
        return bind(inner, lambda r: F.struct(
            r["at"].alias("at"), F.concat(state["all"], F.array(r["own"])).alias("all")))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    return bind(pieces, lambda p: F.aggregate(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int")),
                    lambda i: F.slice(p, i * _CHUNK + 1, F.lit(_CHUNK))),
        begun, chunk, lambda s: F.flatten(s["all"])))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def found(text: str, pattern: str, kind: str, order: int, check: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches in column ``text``; matches that fail ``check`` are dropped.

    The text between matches and the matches alternate, so one pass over both gives the places. Only
    matches that pass are gathered, so a text full of failing ones costs no more than its length.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    spans = gather(
        pieces, SPAN, (lambda match: F.lit(True)) if check is None else check,
        lambda start, end, _: F.struct(
            start.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(no_spans())


def written(spans: Column) -> Column:
    """``kind:start:end`` by start, then in the order of the kinds, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(spans: Column) -> Column:
    return F.sha2(written(spans).cast("binary"), 256)
