"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its parse a Boolean trigram query is derived: strings that a
match must contain, every one as the trigrams that must all occur, alternatives joined by OR, parts
in sequence by AND. The index has one posting per text and queried trigram. Intersecting the
postings leaves the texts in which a rule can match; only there its expression is run. A rule from
which no trigram follows is run on every text.

Postings name a text by the hash of its id and content. Texts that share a hash are verified once
more than needed, so a collision cannot change the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import documents, stored
from panelwright.llm.spans import count_of, digest, found, no_spans, of_kinds, written

_MOST_STRINGS = 64  # alternatives that a derivation follows before it cuts the string
_MOST_LETTERS = 8  # letters of a class that count as alternatives


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    check: Callable[[Column], Column] | None = None


# The keywords and key formats of the base rules, then public formats of further keys.
_ASSIGN = ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|"
           + _either_case("api") + "_?" + _either_case("key")
           + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (
    Rule("assign", _ASSIGN, lambda match: F.length(F.regexp_extract(match, _ASSIGN, 2)) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", lambda match: F.length(match) >= 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("code_host", "gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20[A-Za-z0-9._~+/-]{20,}"),
    Rule("login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]+@"),
)

#: AND over groups, OR over a group's sets, AND over a set's trigrams.
Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(pattern: str) -> Query:
    """Trigrams of lower-cased text that every match needs; no groups if none follow."""
    groups: list[tuple[frozenset[str], ...]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            groups.append(tuple(sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)))

    def alternatives(items) -> set[str] | None:
        """All strings of a sequence of nodes, or None if they are too many to list."""
        strings = {""}
        for name, value in items:
            own = of_node(str(name), value)
            if own is None or len(strings) * len(own) > _MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in own}
        return strings

    def of_node(name: str, value) -> set[str] | None:
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN":
            letters = {chr(v).lower() for n, v in value if str(n) == "LITERAL"}
            listed = all(str(n) == "LITERAL" for n, _ in value)
            return letters if listed and len(letters) <= _MOST_LETTERS else None
        if name == "BRANCH":
            parts = [alternatives(branch) for branch in value[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if name == "SUBPATTERN":
            return alternatives(value[-1])
        if name == "MAX_REPEAT" and value[1] == 1:
            own = alternatives(value[2])
            return own if own is None or value[0] == 1 else own | {""}
        return None

    strings = {""}
    for name, value in re._parser.parse(pattern):
        own = of_node(str(name), value)
        if own is not None and len(strings) * len(own) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
            continue
        close(strings)
        strings = own if own is not None and len(own) <= _MOST_STRINGS else {""}
    close(strings)
    return tuple(groups)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the texts of ``docs``, for the given trigrams, lower-cased."""
    lowered = docs.select(_key().alias("key"), F.lower("text").alias("lowered"))
    held = F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams])
    return lowered.select("key", F.explode(F.array_compact(held)).alias("trigram")).select("trigram", "key")


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the kinds whose query the postings of a text meet. At most one row per key."""
    def meets(query: Query) -> Column:
        whole = F.lit(True)
        for group in query:
            some = F.lit(False)
            for trigrams in group:
                some = some | (F.size(F.array_intersect("trigrams", F.array(*[F.lit(t) for t in sorted(trigrams)]))) == len(trigrams))
            whole = whole & some
        return whole

    # A text has each queried trigram at most once, so the sets are bounded by the rules.
    texts = postings.groupBy("key").agg(F.collect_set("trigram").alias("trigrams"))
    kinds = F.array_compact(F.array(*[F.when(meets(query), F.lit(kind)) for kind, query in queries.items()]))
    return texts.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``, the spans of all rules, for every row of ``docs``."""
    texts = documents(docs)
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query}
    trigrams = sorted({t for query in indexed.values() for group in query for s in group for t in s})
    keyed = texts.withColumn("key", _key())
    if indexed:
        postings = stored(trigram_index(texts, trigrams), "trigram-postings")
        keyed = keyed.join(candidates(postings, indexed), "key", "left")
    else:
        keyed = keyed.withColumn("kinds", F.array().cast("array<string>"))
    per_rule = []
    for order, rule in enumerate(rules):
        spans = found("text", rule.pattern, rule.kind, order, rule.check)
        if rule.kind in indexed:
            spans = F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), spans).otherwise(no_spans())
        per_rule.append(spans)
    return keyed.select("doc_id", F.concat(*per_rule).alias("found"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in every row of ``docs``.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as kind:start:end),
    spans (of all rules, written the same way). Places are code points, ends exclusive. A null text
    is empty. Repeated and null ids are rows of their own. No rows give no rows; other columns are
    not read.
    """
    base = [rule.kind for rule in BASE]
    return scan(docs, rules).select(
        "doc_id", *[count_of(F.col("found"), kind).alias(f"n_{kind}") for kind in base],
        digest(of_kinds(F.col("found"), base)).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _sql_spans(rule: Rule, order: int) -> str:
    """The spans of a rule in DuckDB: places from the lengths of what lies before a match."""
    pattern = rule.pattern.replace("'", "''")
    checks = {"assign": f"length(regexp_extract(m[i], '{pattern}', 2)) >= 6", "access": "length(m[i]) >= 20"}
    start = "list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""
        SELECT row, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: {checks.get(rule.kind, 'true')}), lambda i:
            {{'s': ({start})::BIGINT, 'o': {order}, 'e': ({start} + length(m[i]))::BIGINT, 'k': '{rule.kind}'}})) AS span
        FROM (SELECT row, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS b FROM texts)"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL that runs every rule on every text."""
    spans = "\n        UNION ALL".join(_sql_spans(rule, order) for order, rule in enumerate(rules))
    line = "coalesce(string_agg(span.k || ':' || span.s || ':' || span.e, ',' ORDER BY span.s, span.o){}, '')"
    base = f" FILTER (span.o < {len(BASE)})"
    counts = ", ".join(f"count(*) FILTER (span.k = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({spans})
    SELECT any_value(doc_id) AS doc_id, {counts}, sha256({line.format(base)}) AS base_sha256, {line.format('')} AS spans
    FROM texts LEFT JOIN spans USING (row) GROUP BY row"""
