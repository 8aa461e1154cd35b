"""Personal data by weak supervision.

Expressions propose candidates. Labelers look at each one and vote yes, no or nothing: by its shape, a
checksum, a gazetteer, the words before it and its borders. How reliable a labeler is, nobody says:
expectation-maximisation estimates for each the chance of every vote on personal and on other spans,
and with it how likely each combination of votes is personal. These soft labels train the final span
classifier, a logistic model over kind and votes.

The votes of all candidates are counted; the counts, at most one per kind and combination whatever
the corpus, are one row, and both fits are expressions over that row. Spans of the four base kinds
are always reported; the classifier decides over the candidates of the further kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import documents, stored
from panelwright.llm.spans import bind, count_of, digest, gather, of_kinds, written

LABELERS = 6
ROUNDS, STEPS, RATE = 20, 100, 1.0
NEAR = 48  # characters before a candidate in which cue words count
ABSTAIN, YES, NO = 0, 1, 2

# Gazetteers and cue words of the labelers.
MAIL_HOSTS = "example|gmail|googlemail|yahoo|hotmail|outlook|icloud|proton|protonmail|gmx|web|aol|live|mail"
GIVEN_NAMES = ("Anna|Carlos|David|Elena|Emma|Hans|James|Jean|John|José|Juan|Julia|Laura|Lucia|Maria|María|Marie|Mary|"
               "Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas")
CALLING_CODES = "1|7|20|27|30|31|32|33|34|39|41|43|44|45|46|47|48|49|52|54|55|61|81|82|86|91"
CUES = ("call|phone|tel|telephone|mobile|cell|fax|mail|email|contact|reach|write|card|visa|account|iban|bank|ssn|"
        "social security|passport|name|client|patient|address|server|host|user|login")
COUNTER_CUES = "version|ver|page|pages|price|total|figure|table|isbn|issue|order|section|chapter|year|score|license|code"


@dataclass(frozen=True)
class Kind:
    """``loose`` admits a match as a candidate, ``base`` makes it a span in any case."""

    name: str
    pattern: str
    shape: str
    gazetteer: str
    checksum: Callable[[Column], Column] | None = None
    loose: Callable[[Column], Column] | None = None
    base: Callable[[Column], Column] | None = None


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    turned = F.reverse(_digits(match))
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))),
        lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (1 + (i - 1) % 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _digits_between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(_digits(match)).between(low, high)


_PART = "(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"

# The base expressions, made to run in linear time: no match begins within a run that failed, except
# where the match before ended, and a run is not given back. The matches are the same.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"^[A-Za-z0-9][^@]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)++[A-Za-z]{2,24}$", rf"[@.](?:{MAIL_HOSTS})\.",
         base=lambda match: F.lit(True)),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"^(?:[1-9][0-9]{0,2}\.)(?:(?:0|[1-9][0-9]{0,2})\.){2}(?:0|[1-9][0-9]{0,2})$",
         r"^(?:10|127|172|192)\.", base=lambda match: F.regexp_like(match, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$", r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
         checksum=_luhn, loose=_digits_between(12, 19),
         base=lambda match: F.length(_digits(match)).between(12, 19) & _luhn(match)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9])[0-9 .-]+$", rf"^\+(?:{CALLING_CODES})",
         loose=_digits_between(7, 17), base=_digits_between(9, 15)),
    Kind("local_phone", r"(?<![0-9A-Za-z+()-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
         r"^(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}([.-])(?=[0-9]{3}\1))[2-9]", r"^\(?(?:212|213|312|415|617|646|718|800|888|917)"),
    Kind("id_number", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
         r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^[0-7]"),
    Kind("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
         r"^[A-Z]{2}[0-9]{2}[ ]?(?:[A-Z]{4}|[0-9]{4})[ 0-9]+$", r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT|SE)"),
    Kind("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?[\[(][ ]?at[ ]?[\])][ ]?[A-Za-z0-9-]{1,63}"
         r"(?:[ ]?(?:[\[(][ ]?dot[ ]?[\])]|\.)[ ]?[A-Za-z0-9-]{1,63}){1,4}",
         r"[A-Za-z]{2,24}$", rf"(?i)(?:{MAIL_HOSTS})"),
    Kind("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?[ ][A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:[ ][A-ZÀ-Þ][a-zß-ÿ]{1,30})?",
         r"[ ][A-ZÀ-Þ][a-zß-ÿ]+[ ][A-ZÀ-Þ]", rf"(?:^|[ ])(?:{GIVEN_NAMES})(?:[ ]|$)"),
)
BASE = ("email", "ip", "card", "phone")
_CANDIDATE = "array<struct<start:int,kind_order:int,end:int,kind:string,votes:int,base:boolean>>"


def _votes(kind: Kind, before: Column, match: Column, after: Column) -> Column:
    """The labelers' votes as one number, a digit to base three for each."""
    near = F.lower(F.right(before, F.lit(NEAR)))

    def says(yes: Column, no: Column | None = None) -> Column:
        vote = F.when(yes, YES)
        return (vote if no is None else vote.when(no, NO)).otherwise(ABSTAIN)

    shape = F.regexp_like(match, F.lit(kind.shape))
    glued = F.regexp_like(F.right(before, F.lit(1)), F.lit("[A-Za-z0-9_/#=]")) | F.regexp_like(
        F.left(after, F.lit(1)), F.lit("[A-Za-z0-9_/#=%@]"))
    checked = F.lit(ABSTAIN) if kind.checksum is None else says(kind.checksum(match), ~kind.checksum(match))
    votes = (
        says(shape, ~shape), checked, says(F.regexp_like(match, F.lit(kind.gazetteer))),
        says(F.regexp_like(near, F.lit(rf"(?:^|[^a-z])(?:{CUES})[^a-z]"))),
        says(F.lit(False), F.regexp_like(near, F.lit(rf"(?:^|[^a-z])(?:{COUNTER_CUES})[^a-z]*$"))),
        says(~glued, glued),
    )
    return sum((vote * 3 ** place for place, vote in enumerate(votes)), F.lit(0))


def _found(text: Column, kind: Kind, order: int) -> Column:
    """Candidates of one kind: leftmost non-overlapping matches that pass the loose test."""
    between = F.split(text, kind.pattern, -1)
    pieces = F.arrays_zip(
        between.alias("before"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"),
        F.slice(between, 2, 1 << 30).alias("after"))

    gathered = gather(
        pieces, _CANDIDATE, (lambda match: F.lit(True)) if kind.loose is None else kind.loose,
        lambda start, end, piece: F.struct(
            start.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind.name).alias("kind"),
            _votes(kind, piece["before"], piece["match"], F.coalesce(piece["after"], F.lit(""))).alias("votes"),
            (F.lit(False) if kind.base is None else kind.base(piece["match"])).alias("base")))
    return F.when(F.regexp_like(text, F.lit(kind.pattern)), gathered).otherwise(F.array().cast(_CANDIDATE))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of every row of ``docs``, with their votes."""
    return documents(docs).select("doc_id", _candidates(F.col("text")).alias("candidates"))


def _candidates(text: Column) -> Column:
    return F.concat(*[_found(text, kind, order) for order, kind in enumerate(KINDS)])


def _vote(votes: Column, labeler: int) -> Column:
    return F.floor(votes / 3 ** labeler).cast("int") % 3


def _logistic(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _add(total: Column, part: Column, factor: Column) -> Column:
    return bind(factor, lambda f: F.zip_with(total, part, lambda x, y: x + y * f))


def train(found: DataFrame) -> DataFrame:
    """One row: ``reliability`` and ``weights``.

    ``reliability`` has for each labeler and vote the log odds of personal, then the log odds of all;
    ``weights`` are those of the final classifier, one per kind, then one per labeler and vote.
    """
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.kind_order", "c.votes").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    each = [_vote(F.col("votes"), k) for k in range(LABELERS)]
    votes = [(vote == value).cast("double") for vote in each for value in (ABSTAIN, YES, NO)]
    kinds = [(F.col("kind_order") == k).cast("double") for k in range(len(KINDS))]
    margin = sum(F.when(v == YES, 1.0).when(v == NO, -1.0).otherwise(0.0) for v in each)
    seen = counts.select(F.struct(
        "kind_order", "votes", "n", margin.alias("margin"), F.array(*votes, F.lit(1.0)).alias("voted"),
        F.array(*kinds, *votes).alias("x")).alias("p"))
    row = seen.agg(F.array_sort(F.collect_list("p")).alias("p"))

    # Expectation-maximisation over the combinations, begun from the majority of votes.
    begun = _log_odds(lambda p: _logistic(p["margin"]))
    odds = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), begun,
        lambda odds, _: _log_odds(lambda p: _logistic(_dot(p["voted"], odds))))
    rounds = row.withColumn("odds", odds).withColumn(
        "q", F.transform("p", lambda p: _logistic(_dot(p["voted"], F.col("odds")))))
    # The classifier: logistic regression on the beliefs by gradient steps, each combination weighted by
    # the logarithm of its count, so that the frequent ones do not drown the others.
    rows = F.zip_with("p", "q", lambda p, q: F.struct(p["x"].alias("x"), F.log1p(p["n"]).alias("m"), q.alias("q")))
    ready = rounds.select("odds", rows.alias("r")).withColumn(
        "total", F.aggregate("r", F.lit(1e-9), lambda s, r: s + r["m"]))
    size = len(KINDS) + 3 * LABELERS
    zero = F.array_repeat(F.lit(0.0), size)

    def step(weights: Column, _: Column) -> Column:
        return F.aggregate("r", F.transform(weights, lambda w: w * 0.999), lambda w, r: _add(
            w, r["x"], RATE * r["m"] * (r["q"] - _logistic(_dot(weights, r["x"]))) / F.col("total")))

    weights = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step)
    return ready.select(F.col("odds").alias("reliability"), weights.alias("weights"))


def _log_odds(belief: Callable[[Column], Column]) -> Column:
    """Log odds of personal per slot, given how likely each combination is personal; those of all come last."""
    slots = 3 * LABELERS + 1
    begun = F.struct(*[F.array_repeat(F.lit(0.5), slots).alias(side) for side in ("yes", "no")])
    mass = F.aggregate("p", begun, lambda s, p: bind(belief(p), lambda q: F.struct(
        F.zip_with(s["yes"], p["voted"], lambda x, v: x + v * p["n"] * q).alias("yes"),
        F.zip_with(s["no"], p["voted"], lambda x, v: x + v * p["n"] * (1 - q)).alias("no"))),
        lambda s: F.zip_with(s["yes"], s["no"], lambda a, b: F.log(a / b)))
    return bind(mass, lambda o: bind(F.get(o, F.lit(slots - 1)), lambda every: F.concat(
        F.transform(F.slice(o, 1, slots - 1), lambda x: x - every), F.array(every))))


def personal(weights: list[float], order: Column, votes: Column) -> Column:
    """The classifier's probability of a candidate."""
    held = F.array(*[F.lit(float(w)) for w in weights])
    total = F.get(held, order)
    for k in range(LABELERS):
        total = total + F.get(held, _vote(votes, k) + F.lit(len(KINDS) + 3 * k))
    return _logistic(total)


def fit(found: DataFrame) -> list[float]:
    """The classifier's weights, one number per kind and per labeler and vote."""
    return train(found).first()["weights"]


def _accepted(weights: list[float]) -> Column:
    return F.filter("candidates", lambda c: c["base"] | (
        ~c["kind"].isin(*BASE) & (personal(weights, c["kind_order"], c["votes"]) >= 0.5)))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data written over by its kind in brackets.

    Spans that overlap count as one, named after the first. A null text stays null; all other
    columns come along, whatever their names, if Parquet can hold them. Repeated rows stay; no rows
    give no rows.
    """
    # Candidates are found once: stored beside the row, whose columns go by their places meanwhile.
    row = F.struct(*[
        F.col(f"`{c}`").alias(f"c{place}") for place, c in enumerate(docs.columns) if c != "text"
    ] or [F.lit(0).alias("none")]).alias("row")
    found = stored(docs.select(row, F.col("text").cast("string").alias("text")).withColumn(
        "candidates", _candidates(F.coalesce(F.col("text"), F.lit("")))), "pii-candidates")
    spans = found.withColumn("candidates", F.array_sort(_accepted(fit(found))))

    def step(state: Column, c: Column) -> Column:
        before = F.substring("text", state["at"] + 1, c["start"] - state["at"])
        fresh = F.concat(state["parts"], F.array(F.concat(before, F.lit("["), F.upper(c["kind"]), F.lit("]"))))
        return F.struct(
            F.greatest(state["at"], c["end"]).alias("at"),
            F.when(c["start"] >= state["at"], fresh).otherwise(state["parts"]).alias("parts"))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.aggregate("candidates", begun, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring("text", s["at"] + 1, F.length("text"))))
    written = F.when(F.size("candidates") > 0, text).otherwise(F.col("text")).alias("text")
    return spans.select(*[
        written if c == "text" else F.col("row").getField(f"c{place}").alias(c) for place, c in enumerate(docs.columns)])


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every row of ``docs``.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as
    kind:start:end), spans (with those that the classifier adds, written the same way). Places are
    code points, ends exclusive. A null text is empty. Repeated and null ids are rows of their own.
    Without candidates nothing is added. No rows give no rows; other columns are not read.
    """
    found = stored(candidates(docs), "pii-candidates")
    base = F.filter("candidates", lambda c: c["base"])
    return found.select("doc_id", base.alias("base"), _accepted(fit(found)).alias("kept")).select(
        "doc_id", *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
        digest(of_kinds(F.col("base"), BASE)).alias("base_sha256"), written(F.col("kept")).alias("spans"))
