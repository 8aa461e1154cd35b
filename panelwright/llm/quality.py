"""Quality rules: an ordered list of threshold conditions learned from labelled statistics.

Statistics of every text are column expressions. Rules for poor texts are learned one after another:
a rule grows by the condition with the largest information gain on one part of the labelled rows, is
pruned back on another part, and covers the rows it takes before the next rule is learned. The list
becomes one conditional column expression. A text that no rule takes is kept.

Learning looks at counts per statistic and bin, at most ``BINS`` of each, so what reaches the driver
does not depend on the number of rows. It uses at most about ``FIT_ROWS`` labelled rows, chosen by a
hash of the id; everything else covers all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import SPACE, documents, stored

FIT_ROWS = 50_000  # bound of the sample of labelled rows that the rules are learned from
BINS = 24
MOST_RULES, MOST_CONDITIONS = 8, 3
LEAST_PRECISION = 0.9  # of a rule, on the rows that it was not grown on
LEAST_ROWS = 5
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]+"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of every text; see ``quality_rules`` for the cases."""
    base = documents(docs).select("doc_id", "text", F.btrim("text", F.lit(_BLANKS)).alias("bare"))
    split = base.select(
        "doc_id", "text",
        F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"{SPACE}+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)) != "").alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(
        " ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<string>"))
    counted = split.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct_words"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^!?]+", "")).cast("bigint").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^0-9]+", "")).cast("bigint").alias("n_digits"),
        windows.alias("windows"),
    )
    # Windows found twice: neighbours in sorted order. Only texts that have some are sorted.
    placed = counted.withColumn("placed", F.when(
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    again = placed.withColumn("again", F.sort_array(F.filter(
        F.transform("placed", lambda p, k: F.when(
            (p["w"] == F.get("placed", k - 1)["w"]) | (p["w"] == F.get("placed", k + 1)["w"]), p["i"])),
        lambda i: i.isNotNull())))
    # Each window adds the words that the one before does not reach; the last adds three.
    covered = F.aggregate(
        "again", F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last")),
        lambda s, i: F.struct(
            (s["words"] + F.least(F.lit(3), i - s["last"])).alias("words"), i.alias("last")),
        lambda s: s["words"])
    return again.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop(
        "windows", "placed", "again")


def features() -> dict[str, Column]:
    """What rules may test, as shares, from the columns of ``statistics``."""
    def share(a, b):
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "upper_case": share("n_upper", "word_chars"),
        "marks": share("n_marks", "word_chars"),
        "digits": share("n_digits", "word_chars"),
        "line_words": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    threshold: float
    above: bool  # the statistic is over the threshold, else at most the threshold

    def column(self, tested: dict[str, Column]) -> Column:
        value = tested[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _holds(rule: Rule, tested: dict[str, Column]) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column(tested)
    return found


def _under(value: Column):
    return lambda cut: cut < value


def _gain(poor: int, good: int, poor_before: int, good_before: int) -> float:
    """Information gain of a rule that keeps ``poor`` of the poor rows and ``good`` of the others."""
    if not poor:
        return 0.0
    before = poor_before / (poor_before + good_before)
    return poor * (math.log2(poor / (poor + good)) - math.log2(before))


def _best_condition(counts: list, cuts: dict[str, list[float]], poor: int, good: int) -> tuple[float, Condition | None]:
    """``counts``: rows of feature, bin, poor, good; bin k holds the values above k thresholds."""
    best = (0.0, None)
    for name in sorted(cuts):
        below = {}
        for row in counts:
            if row["feature"] == name:
                below[row["bin"]] = (row["poor"], row["good"])
        poor_below = good_below = 0
        for place, threshold in enumerate(cuts[name]):
            p, g = below.get(place, (0, 0))
            poor_below, good_below = poor_below + p, good_below + g
            for above, a, b in ((True, poor - poor_below, good - good_below), (False, poor_below, good_below)):
                gain = _gain(a, b, poor, good)
                if gain > best[0] + 1e-9 and a >= LEAST_ROWS:
                    best = (gain, Condition(name, threshold, above))
    return best


def learn(rows: DataFrame) -> list[Rule]:
    """Rules for poor rows from ``rows``: the features, ``poor`` (0 or 1) and ``grows`` (boolean)."""
    names = sorted(features())
    tested = {name: F.col(name) for name in names}
    steps = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(name, steps, 10_000).alias(name) for name in names]).first()
    if found is None or found[0] is None:
        return []
    cuts = {name: sorted(set(found[name])) for name in names}
    binned = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.size(F.filter(
            F.array(*[F.lit(float(c)) for c in cuts[name]]), _under(F.col(name)))).alias("bin"))
        for name in names])
    rules: list[Rule] = []
    poor, good = F.sum("poor").alias("poor"), F.sum(1 - F.col("poor")).alias("good")
    for _ in range(MOST_RULES):
        left = rows
        for rule in rules:
            left = left.filter(~_holds(rule, tested))
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            inside = left.filter(F.col("grows") & _holds(rule, tested))
            counts = inside.select("poor", F.explode(binned).alias("b")).groupBy("b.feature", "b.bin").agg(poor, good).collect()
            first = [r for r in counts if r["feature"] == names[0]]
            n_poor, n_good = sum(r["poor"] for r in first), sum(r["good"] for r in first)
            if not n_poor or not n_good:
                break
            gain, condition = _best_condition(counts, cuts, n_poor, n_good)
            if condition is None or gain <= 0:
                break
            rule += (condition,)
        if not rule:
            break
        # Prune: the beginning of the rule that does best on rows it was not grown on.
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        held = left.filter(~F.col("grows")).agg(*[
            F.coalesce(F.sum(F.when(_holds(head, tested), value)), F.lit(0)).alias(f"{kind}{k}")
            for k, head in enumerate(heads) for kind, value in (("poor", F.col("poor")), ("good", 1 - F.col("poor")))]).first()

        def worth(k, held=held):
            p, g = held[f"poor{k}"], held[f"good{k}"]
            return (p - g) / (p + g) if p + g else -1.0

        best = max(range(len(heads)), key=lambda k: (worth(k), -k))
        p, g = held[f"poor{best}"], held[f"good{best}"]
        if p < LEAST_ROWS or p / (p + g) < LEAST_PRECISION:
            break
        rules.append(heads[best])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false for the first rule that holds, else true."""
    tested, column = features(), None
    for rule in rules:
        column = (F if column is None else column).when(_holds(rule, tested), F.lit(False))
    return F.lit(True) if column is None else column.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn the rules from stored statistics and ``labels`` (doc_id, quality: 0 is poor)."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg((1 - F.min("quality")).alias("poor"))
    share = min(1.0, fit_rows / max(1, marks.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = marks.filter(draw < int(share * 1_000_000))
    rows = stats.join(sample, "doc_id").select(
        "poor", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) > 0).alias("grows"),
        *[column.alias(name) for name, column in features().items()])
    return learn(stored(rows, "quality-rows"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, the base test and the learned verdict for every row of ``docs``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    Words stand between white space; a null text has none, and texts of under 50 words fail the
    base. kept is false if the base failed or a learned rule for poor texts holds. Null labels are
    left out; of several labels of an id the poor one counts; without labels there are no rules.
    Repeated or null ids are rows of their own. No rows give no rows; other columns are not read.
    """
    stats = stored(statistics(docs), "quality-statistics")
    rules = fit(stats, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
