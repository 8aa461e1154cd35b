"""Language of a text, word by word: known words by their frequency, unseen words by their parts.

A word that training has in its vocabulary adds the logarithm of its frequency in every language. An
unseen word is taken apart into character n-grams, the longest ones of which any is known; their mean
log frequency stands for the word.

All training rows are counted. The model keeps the most frequent words and n-grams of each language,
at most ``WORDS`` and ``GRAMS`` strings over all languages, so its size does not follow the corpus. A
string it keeps has its true count in every language; what it leaves out backs off to shorter
n-grams like any unseen word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import documents, fold, package_on_workers, stored
from panelwright.llm.memo import Memo

WORDS = 160_000
GRAMS = 200_000
LONGEST = 5
VECTORS_HELD = 60_000  # unseen words whose vectors a task remembers, twice
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_COUNTED_AT_ONCE = 250_000
_WORD = re.compile(r"[^\W\d_]+")
#: Latin-1 in lower case, with blanks for all that is no letter.
_LATIN = bytes(ord(c) if _WORD.fullmatch(c) else 0x20 for c in (chr(b).lower() for b in range(256)))
_SMOOTH = 0.5


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    try:
        found = text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        found = _WORD.findall(text.lower())
    if found and not any(map(str.isalpha, found)) and not any(map(str.isalpha, text)):
        return []
    return found


def grams(word: str, length: int) -> list[str]:
    """Character n-grams of a word with its borders marked."""
    marked = f"_{word}_"
    return [marked[i:i + length] for i in range(len(marked) - length + 1)]


def _emit(counts: dict[str, dict[str, int]], name: str) -> pa.RecordBatch:
    langs = [lang for lang, strings in counts.items() for _ in strings]
    strings = [s for own in counts.values() for s in own]
    ns = [n for own in counts.values() for n in own.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(strings, pa.string()), pa.array(ns, pa.int64())], ["lang", name, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    for batch in batches:
        names = batch.schema.names
        langs, texts = (batch.column(names.index(c)).to_pylist() for c in ("lang", "text"))
        for lang, text in zip(langs, texts):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > _COUNTED_AT_ONCE:
                yield _emit(counts, "word")
                counts = {}
    if counts:
        yield _emit(counts, "word")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[str, int]] = {}
    for batch in batches:
        names = batch.schema.names
        columns = (batch.column(names.index(c)).to_pylist() for c in ("lang", "word", "n"))
        for at, (lang, word, n) in enumerate(zip(*columns)):
            own = counts.setdefault(lang, defaultdict(int))
            for length in range(1, LONGEST + 1):
                for gram in grams(word, length):
                    own[gram] += n
            if at % 100 == 0 and sum(map(len, counts.values())) > _COUNTED_AT_ONCE:
                yield _emit(counts, "gram")
                counts = {}
    if counts:
        yield _emit(counts, "gram")


def _most_frequent(counts: DataFrame, key: list[str], by: str, most: int) -> DataFrame:
    """All counts of the strings that are among the ``most`` frequent of any ``key``.

    The least count is the smallest that no more than ``most`` strings of the key reach, so strings of
    equal count are kept or left out together and none are ranked; only the different counts are.
    """
    together = counts.groupBy(*key, "n").agg(F.count(F.lit(1)).alias("strings"))
    reached = F.sum("strings").over(Window.partitionBy(*key).orderBy(F.desc("n")))
    least = together.withColumn("reached", reached).filter(F.col("reached") <= most).groupBy(*key).agg(
        F.min("n").alias("least"))
    chosen = counts.join(least, key).filter("n >= least").select(by).distinct()
    return counts.join(chosen, by, "left_semi")


class Model:
    """Log frequencies per language of words and n-grams."""

    def __init__(self, langs: list[str], words: Iterable, word_totals: dict, parts: Iterable, part_totals: dict):
        """``words`` and ``parts`` yield (lang, string, count); totals are per lang and (lang, length)."""
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        self.words = self._table(words, lambda lang, _: word_totals[lang], place)
        self.parts = self._table(parts, lambda lang, s: part_totals.get((lang, len(s)), 0), place)

    def _table(self, rows, total, place) -> dict[str, bytes]:
        counts: dict[str, np.ndarray] = {}
        for lang, string, n in rows:
            own = counts.get(string)
            if own is None:
                own = counts[string] = np.zeros(len(place), np.int64)
            own[place[lang]] = n
        table = {}
        for string in list(counts):
            sums = np.array([total(lang, string) for lang in place], float)
            table[string] = np.log((counts.pop(string) + _SMOOTH) / (sums + 1.0)).astype(np.float32).tobytes()
        return table

    def __getstate__(self):
        return {"langs": self.langs, "words": self.words, "parts": self.parts}

    def unseen(self, word: str) -> bytes:
        """Mean log frequency of the longest n-grams that the model knows any of; else no opinion."""
        get = self.parts.get
        for length in range(LONGEST, 0, -1):
            known = [p for p in map(get, grams(word, length)) if p is not None]
            if known:
                return np.frombuffer(b"".join(known), np.float32).reshape(len(known), -1).mean(0).tobytes()
        return bytes(4 * len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text or "")
        if not found or not self.langs:
            return UNKNOWN, 0.0
        if "vectors" not in self.__dict__:
            self.vectors = Memo(self.unseen, VECTORS_HELD)
        words, vectors = self.words.get, self.vectors
        total = np.frombuffer(
            b"".join([words(w) or vectors[w] for w in found]), np.float32).reshape(len(found), -1).sum(0, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def fit(docs: DataFrame) -> Model:
    """Count all rows with a language outside the held-out fold."""
    package_on_workers(docs.sparkSession)
    training = documents(docs, "lang").filter(
        F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select("lang", "text")
    counted = training.mapInArrow(_count_words, "lang string, word string, n bigint")
    words = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], [], {}, [], {})
    parts = words.mapInArrow(_count_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).withColumn("length", F.length("gram"))
    parts = stored(parts, "language-grams")
    part_totals = {(r.lang, r.length): r.n for r in
                   parts.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    kept_words = _most_frequent(words, ["lang"], "word", WORDS // len(langs))
    kept_parts = _most_frequent(parts, ["lang", "length"], "gram", GRAMS // (len(langs) * LONGEST))
    return Model(
        langs,
        _rows(kept_words.select("lang", "word", "n")), totals,
        _rows(kept_parts.select("lang", "gram", "n")), part_totals)


def _rows(counts: DataFrame) -> Iterator[tuple]:
    """Rows of a bounded table one by one, from Arrow columns."""
    for batch in counts.toArrow().to_batches(max_chunksize=10_000):
        yield from zip(*(column.to_pylist() for column in batch.columns))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and text_xxh64 for every row of ``docs``."""
    package_on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            found = [shared.value.predict(t) for t in batch.column(names.index("text")).to_pylist()]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("doc_id")), batch.column(names.index("held_out")),
                 pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.column(names.index("text_xxh64"))],
                ["doc_id", "held_out", "lang_pred", "score", "text_xxh64"])

    rows = documents(docs).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text", F.xxhash64("text").alias("text_xxh64"))
    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double, text_xxh64 bigint")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang`` set to the predicted language; all other columns come along."""
    package_on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("lang")
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs = pa.array([shared.value.predict(t)[0] for t in texts], pa.string())
            columns = [langs if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Predict the language of every row of ``docs`` (doc_id, text, lang).

    Learned from text and non-null lang of rows outside the held-out fold (crc32 of the id modulo 5
    is 0). Columns: doc_id, held_out, lang_pred, score (share of the predicted language), text_xxh64.
    A null text, a text without a letter, or nothing to learn from gives ``und`` with score 0. A tie
    goes to the first language in order. Repeated ids are rows of their own. No rows give no rows;
    other columns are not read.
    """
    return predict(docs, fit(docs))
