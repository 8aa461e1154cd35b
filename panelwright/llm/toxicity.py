"""Toxicity by two class-conditional Kneser-Ney models of the characters of words.

Each class has the counts of its own characters after up to five characters of the same word; what a
class has not seen is backed off to continuation counts after three characters that both classes
share. A document's evidence is the difference of the two log-likelihoods over its length. A logistic
curve, fitted on training rows that the counts leave out, turns it into a score; the same rows choose
the discount, by their log loss.

The counts are exact: a gram is five characters before and one character, six bits each, in one long,
and Spark groups grams of all training rows. Only two things remain of the models: the log ratio of
each gram seen in a class, and that of an unseen character after each context seen, where the shared
backoff cancels out. They grow with the corpus, so they are cut by context into slices of a bounded
number of entries; each slice is broadcast alone and adds its part of every document's evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import documents, fold, package_on_workers, scratch_path, stored

KINDS = 64  # slots of characters; 0 is the end of a word
DISCOUNTS = (0.6, 0.75, 0.9)  # the calibrating rows choose one
STEADY = 100  # added to the length, so that a few characters alone decide nothing
HELD_OUT, FOLDS, CALIBRATION = 1, 3, 5
CUT = 0.7
SLICE_ENTRIES = 8_000_000  # of 12 bytes, in one broadcast
RESIDUES = 4093  # contexts are dealt to slices by their residues
_STEP = 1 / 4000  # width of a calibration bin
_CHARS_AT_ONCE = 1 << 20
_WORDS_AT_ONCE = 1 << 18
_LONGEST_REMEMBERED = 64


def _char_slots() -> np.ndarray:
    """Slot of each code point below U+0250: 0 ends a word, a-z have their own, other letters share."""
    slots = np.zeros(0x250, np.int64)
    for code in range(0x250):
        char = chr(code)
        if "a" <= char <= "z":
            slots[code] = code - ord("a") + 1
        elif char.isdigit():
            slots[code] = 27
        elif char.isalpha():
            slots[code] = 28 + code % 36
    return slots


_SLOTS = _char_slots()
_WORD = re.compile("[" + "".join(chr(c) for c in range(0x250) if _SLOTS[c]) + "\u0250-\U0010ffff]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case; every code point from U+0250 on counts as a letter."""
    return _WORD.findall(text.lower())


def grams(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gram of every character of the words and of their ends, with the word's place, in bounded arrays."""
    places = np.repeat(np.arange(len(some)), [len(word) + 1 for word in some])
    joined = " ".join([*some, ""])
    for start in range(0, len(joined), _CHARS_AT_ONCE):
        before = min(start, 5)
        codes = np.frombuffer(joined[start - before:start + _CHARS_AT_ONCE].encode("utf-32-le"), "<u4").astype(np.int64)
        slots = np.where(codes < len(_SLOTS), _SLOTS[np.minimum(codes, len(_SLOTS) - 1)], 28 + codes % 36)
        slots = np.concatenate([np.zeros(5 - before, np.int64), slots])
        n = len(slots) - 5
        out, inside = slots[5:].copy(), np.ones(n, bool)
        for back in range(1, 6):
            one = np.where(inside, slots[5 - back:5 - back + n], 0)
            inside &= one != 0
            out |= one << (6 * back)
        yield out, places[start:start + n]


def _counted(counts: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    """Grams of counted words, those of each block of characters added up."""
    for toxic, found in counts.items():
        weights = np.fromiter(found.values(), np.int64, len(found))
        for keys, places in grams(list(found)):
            distinct, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, weights[places], len(distinct)).astype(np.int64)
            none = np.zeros_like(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(none if toxic else n), pa.array(n if toxic else none)],
                ["gram", "ordinary", "toxic"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        names = batch.schema.names
        texts, marks = (batch.column(names.index(c)).to_pylist() for c in ("text", "toxic"))
        for text, toxic in zip(texts, marks):
            counts[toxic].update(words(text))
            if len(counts[toxic]) >= _WORDS_AT_ONCE:
                yield from _counted({toxic: counts[toxic]})
                counts[toxic] = Counter()
    yield from _counted(counts)


def gram_counts(training: DataFrame) -> DataFrame:
    """gram, ordinary, toxic: how often each gram occurs in the texts of each class (text, toxic)."""
    parts = training.select("text", "toxic").mapInArrow(_count, "gram bigint, ordinary bigint, toxic bigint")
    return parts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def log_ratios(counts: DataFrame, discount: float) -> DataFrame:
    """entry, ratio: the log of toxic over ordinary probability.

    ``entry`` is a gram, or -1 - context for any character not seen after that context in either
    class: there both classes back off to the same shared probability, and only the mass they leave to
    it differs. A context never seen leaves both the same mass, so its ratio is 0 and has no row.
    """
    near = F.col("gram").bitwiseAND(F.lit(KINDS ** 4 - 1))
    context = F.shiftright("gram", 6)
    grams_of = counts.select("gram", "ordinary", "toxic", context.alias("context"), near.alias("near"))
    # Shared backoff: after how many longer contexts was the character seen, of all after these three?
    seen = grams_of.groupBy("near").agg(F.count(F.lit(1)).alias("seen"))
    totals = seen.groupBy(F.shiftright("near", 6).alias("three")).agg(
        F.sum("seen").alias("total"), F.count(F.lit(1)).alias("kinds"))
    shared = seen.join(totals, F.shiftright("near", 6) == F.col("three")).select(
        "near", ((F.greatest(F.col("seen") - discount, F.lit(0.0)) + discount * F.col("kinds") / KINDS)
                 / F.col("total")).alias("shared"))

    def kept(n: str) -> Column:
        return F.greatest(F.col(n) - discount, F.lit(0.0))

    contexts = grams_of.groupBy("context").agg(*[
        made for n in ("ordinary", "toxic") for made in (
            (F.sum(n) + 0.01).alias(f"{n}_mass"), (F.sum(n) - F.sum(kept(n)) + 0.01).alias(f"{n}_left"))])

    def probability(n: str) -> Column:
        return (kept(n) + F.col(f"{n}_left") * F.col("shared")) / F.col(f"{n}_mass")

    seen_grams = grams_of.join(contexts, "context").join(shared, "near").select(
        F.col("gram").alias("entry"), F.log(probability("toxic") / probability("ordinary")).cast("float").alias("ratio"))
    left = (F.col("toxic_left") / F.col("toxic_mass")) / (F.col("ordinary_left") / F.col("ordinary_mass"))
    return seen_grams.union(contexts.select((-1 - F.col("context")).alias("entry"), F.log(left).cast("float").alias("ratio")))


def _residue() -> Column:
    return F.when(F.col("entry") < 0, -1 - F.col("entry")).otherwise(F.shiftright("entry", 6)) % RESIDUES


@dataclass
class Slice:
    """Ratios of the contexts whose residues lie from ``first`` to before ``end``; remembers short words."""

    entries: np.ndarray  # ascending
    ratios: np.ndarray
    first: int
    end: int

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def _found(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.entries):
            return np.zeros(len(entries), bool), np.zeros(len(entries))
        at = np.minimum(np.searchsorted(self.entries, entries), len(self.entries) - 1)
        return self.entries[at] == entries, self.ratios[at].astype(np.float64)

    def of_words(self, some: list[str]) -> np.ndarray:
        out = np.zeros(len(some))
        for keys, places in grams(some):
            mine = (keys >> 6) % RESIDUES
            mine = (mine >= self.first) & (mine < self.end)
            keys, places = keys[mine], places[mine]
            hit, ratio = self._found(keys)
            backed, left = self._found(-1 - (keys >> 6))
            out += np.bincount(places, np.where(hit, ratio, np.where(backed, left, 0.0)), len(some))
        return out

    def sums(self, texts: Iterable[str]) -> Iterator[tuple[float, int]]:
        """This slice's part of each text's log-likelihood difference, and the text's length in characters."""
        for text in texts:
            found = Counter(words(text))
            new = [word for word in found if word not in self.known]
            if len(self.known) + len(new) > _WORDS_AT_ONCE:
                self.known = {}
                new = list(found)
            now = dict(zip(new, self.of_words(new).tolist())) if new else {}
            # Sums in one order at every batch size and in every task.
            total = math.fsum(n * (now[word] if word in now else self.known[word]) for word, n in found.items())
            self.known.update((word, x) for word, x in now.items() if len(word) <= _LONGEST_REMEMBERED)
            yield total, sum(n * (len(word) + 1) for word, n in found.items())


def log_loss(bins: list[tuple[float, int, int]], slope: float, offset: float) -> float:
    """Total log loss of (evidence, toxic, rows) under the curve."""
    return sum(n * float(np.logaddexp(0, (-1 if toxic else 1) * (slope * x + offset))) for x, toxic, n in bins)


def logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset for (evidence, toxic, rows), by Newton steps on slightly drawn-in targets."""
    n = [sum(r for _, t, r in bins if t == k) for k in (0, 1)]
    offset = math.log((n[1] + 0.5) / (n[0] + 0.5))
    if not n[0] or not n[1]:
        return 0.0, offset
    x, t, r = (np.array(c, float) for c in zip(*bins))
    target = np.where(t == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    scale = float(np.sqrt(np.average(x ** 2, weights=r))) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weights = np.array([0.0, offset])

    def loss(w):
        s = z @ w
        return float((r * (np.logaddexp(0, s) - target * s)).sum() + 5e-3 * w[0] ** 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -60, 60)))
        gradient = z.T @ (r * (p - target)) + np.array([1e-2 * weights[0], 0])
        curve = (z * (r * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-9])
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-4 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(0.0, float(weights[0]) / scale), float(weights[1])


@dataclass
class Model:
    ratios: DataFrame  # entry, ratio; written
    borders: list[tuple[int, int]]  # residues of each slice
    slope: float = 0.0
    offset: float = 0.0

    def slice(self, first: int, end: int) -> Slice:
        rows = self.ratios.filter((_residue() >= first) & (_residue() < end)).toArrow()
        entries, ratios = (rows.column(c).to_numpy() for c in ("entry", "ratio"))
        order = entries.argsort()
        return Slice(entries[order], ratios[order], first, end)


def _borders(ratios: DataFrame) -> list[tuple[int, int]]:
    """Neighbouring residues together up to ``SLICE_ENTRIES``; at least one slice."""
    sizes = {r["residue"]: r["count"] for r in ratios.groupBy(_residue().alias("residue")).count().collect()}
    out, first, held = [], 0, 0
    for residue in range(RESIDUES):
        n = sizes.get(residue, 0)
        if held and held + n > SLICE_ENTRIES:
            out.append((first, residue))
            first, held = residue, 0
        held += n
    return [*out, (first, RESIDUES)]


def evidence(rows: DataFrame, model: Model, name: str) -> DataFrame:
    """``rows`` with the log-likelihood difference over the length plus ``STEADY`` in place of ``text``.

    One pass over the texts for each slice of the model. With several, their parts are written and
    added up by the other columns and a hash of the text, so rows that agree in all of them stay as many.
    """
    spark = rows.sparkSession
    package_on_workers(spark)
    others = [c for c in rows.columns if c != "text"]
    keyed = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)) if len(model.borders) > 1 else rows
    kept = [c for c in keyed.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text")

    def part(border: tuple[int, int]):
        shared = spark.sparkContext.broadcast(model.slice(*border))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = list(shared.value.sums(batch.column(batch.schema.get_field_index("text")).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in kept],
                     pa.array([x for x, _ in sums], pa.float64()), pa.array([n for _, n in sums], pa.int64())],
                    [*kept, "part", "length"])

        return shared, keyed.mapInArrow(run, f"{schema}, part double, length bigint")

    value = F.col("part") / (F.col("length") + STEADY)
    if len(model.borders) == 1:
        return part(model.borders[0])[1].select(*others, value.alias("evidence"))
    path = scratch_path(spark, name)
    for place, border in enumerate(model.borders):
        shared, sums = part(border)
        sums.write.parquet(f"{path}/slice={place}")
        shared.unpersist()
    added = spark.read.parquet(path).groupBy(*kept, "length").agg(
        F.sum("part").alias("part"), F.count_if(F.col("slice") == 0).alias("rows"))
    added = added.withColumn("part", F.col("part") / F.col("rows"))
    return added.select(*others, value.alias("evidence"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: text, toxic and whether they calibrate. Several labels of one id: the largest."""
    part = fold("doc_id", FOLDS * CALIBRATION)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = documents(docs).withColumn("part", part).filter(F.col("part") % FOLDS != HELD_OUT)
    # One kind of join at every size: what is moved grows with the training rows.
    return training.join(marks.hint("merge"), "doc_id").select("text", "toxic", (F.col("part") < FOLDS).alias("calibrates"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled rows outside the held-out fold. Without both classes the ratios are zero."""
    package_on_workers(docs.sparkSession)
    training = _labelled(docs, labels)
    counts = stored(gram_counts(training.filter("not calibrates")), "toxicity-grams")
    both = counts.agg(F.max("ordinary"), F.max("toxic")).first()
    known = counts if all(both) else counts.limit(0)
    calibrating = stored(training.filter("calibrates").select("toxic", "text"), "toxicity-calibrating")
    tried = []
    for discount in DISCOUNTS:
        ratios = stored(log_ratios(known, discount), "toxicity-ratios")
        model = Model(ratios, _borders(ratios))
        bins = evidence(calibrating, model, "toxicity-calibration").select(
            F.round(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), "evidence")) / _STEP).cast("int").alias("bin"), "toxic")
        rows = bins.groupBy("bin", "toxic").count().collect()  # at most 32,002 rows
        measured = sorted((r["bin"] * _STEP, r["toxic"], r["count"]) for r in rows)
        model.slope, model.offset = logistic(measured)
        tried.append((log_loss(measured, model.slope, model.offset), model))
    model = min(tried, key=lambda one: one[0])[1]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    rows = documents(docs).withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).select("doc_id", "held_out", "text")
    power = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), model.slope * F.col("evidence") + model.offset))
    scored = evidence(rows, model, "toxicity-parts").select("doc_id", "held_out", (1 / (1 + F.exp(-power))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` for toxicity, learned from ``labels`` (doc_id, toxic).

    Labels are used only of rows outside the held-out fold (crc32 of the id modulo 3 is 1). Columns:
    doc_id, held_out, score in 0 to 1, predicted (1 from 0.7 on). A null text is empty; an empty text
    gets the score of no evidence. Null labels are left out. Without labels of both classes all
    rows get the same score, the share of toxic labels. Repeated ids are rows of their own. No rows
    give no rows; other columns are not read.
    """
    return score(docs, fit(docs, labels))
