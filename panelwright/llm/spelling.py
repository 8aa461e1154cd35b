"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one
edit apart, so each word asks for its own reduced word and for the full one-edit neighbourhood of it,
and the join with the reduced vocabulary yields every pair of near words and others besides; the
original strings decide. Fewer symbols mean fewer keys to ask for and more words behind each key. The
number of symbols is the least one for which a word shares its reduced word with ``CROWD`` words in
the mean; with a symbol for each letter no two words share one, so a vocabulary of any kind, one with
a third of its words in one group too, comes to an end of it.

Keys are 64-bit hashes of reduced words. A clash of two keys costs a comparison and nothing else.
Words of ``LONG`` letters and more travel as a hash and are put back in place only for the pairs found,
so the keys of a very long word do not each carry it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import documents, package_on_workers, stored

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5  # how much more frequent a word must be to be another's form
SLIPS = 199  # one run in so many loses a letter
SYMBOLS = (3, 4, 6, 8, 12, 16, 32, 64, 128)
CROWD = 6.0
LONG = 64
_COUNTED_AT_ONCE = 300_000
_KEYS_AT_ONCE = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _count_runs(least_letters: int, slips: int) -> Callable:
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def ready():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            names = batch.schema.names
            columns = (batch.column(names.index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc_id, text in zip(*columns):
                lead = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Bytes are lower-cased from A to Z alone.
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), lead)
                    if h % slips == 0:
                        place = h % len(word)
                        word = word[:place] + word[place + 1:]
                        if len(word) < least_letters:
                            continue
                    counts[word] += n
                if len(counts) > _COUNTED_AT_ONCE:
                    yield ready()
                    counts = Counter()
        if counts:
            yield ready()

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """word and n: the runs of letters of all texts after slips, with enough letters and occurrences."""
    package_on_workers(docs.sparkSession)
    counted = documents(docs).mapInArrow(_count_runs(least_letters, slips), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def symbols_of(words: list[str], symbols: int) -> np.ndarray:
    """Reduced words of one length as a matrix, one symbol from 1 to ``symbols`` per letter.

    With 128 symbols and more every letter has its own.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
    if symbols >= 128:
        return letters + np.uint64(1)
    return (((letters * _BASE) >> np.uint64(40)) % np.uint64(symbols)) + np.uint64(1)


def _powers(most: int) -> np.ndarray:
    """Powers of the base from 0 to ``most``, modulo 2**64."""
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(most, _BASE), dtype=np.uint64)))


def _prefixes(reduced: np.ndarray) -> np.ndarray:
    """Hash of the first i symbols in column i."""
    out = np.zeros((len(reduced), reduced.shape[1] + 1), np.uint64)
    for i in range(reduced.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + reduced[:, i]
    return out


def _suffixes(reduced: np.ndarray) -> np.ndarray:
    """Hash of the symbols from i on in column i."""
    length = reduced.shape[1]
    out, power = np.zeros((len(reduced), length + 1), np.uint64), _powers(length)
    for i in range(length - 1, -1, -1):
        out[:, i] = reduced[:, i] * power[length - 1 - i] + out[:, i + 1]
    return out


def own_keys(reduced: np.ndarray) -> np.ndarray:
    return _prefixes(reduced)[:, -1]


def neighbour_keys(reduced: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every reduced word within one edit of each row of ``reduced``, the row's own too."""
    count, length = reduced.shape
    before, after = _prefixes(reduced), _suffixes(reduced)
    power = _powers(length)
    rows, rest = np.arange(count), power[length - 1::-1]
    kept_rows, kept_keys = [rows], [before[:, -1]]

    def keep(where, keys):
        kept_rows.append(where[0])
        kept_keys.append(keys[where])

    # Deleting any of a row of equal symbols gives one word, so only its first counts.
    first = np.ones((count, length), bool)
    first[:, 1:] = reduced[:, 1:] != reduced[:, :-1]
    keep(np.nonzero(first), before[:, :-1] * rest + after[:, 1:])
    for s in _alphabet(symbols):
        other = reduced != s
        keep(np.nonzero(other), (before[:, :-1] * _BASE + s) * rest + after[:, 1:])
        # Inserted before an equal symbol it is the word that has it after that symbol.
        free = np.ones((count, length + 1), bool)
        free[:, :-1] = other
        keep(np.nonzero(free), (before * _BASE + s) * power[length::-1] + after)
    return np.concatenate(kept_rows), np.concatenate(kept_keys)


def _alphabet(symbols: int) -> np.ndarray:
    if symbols >= 128:
        letters = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
        return np.array(letters, np.uint64) + np.uint64(1)
    return np.arange(1, symbols + 1, dtype=np.uint64)


def _keyed(symbols: int, whole: bool, columns: list[str]) -> Callable:
    """Rows (key, *columns) for each word's own key, or with ``whole`` for its neighbourhood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            table = pa.Table.from_batches([batch])
            words = batch.column(names.index("word")).to_pylist()
            place: dict[int, list[int]] = {}
            for i, word in enumerate(words):
                place.setdefault(len(word), []).append(i)
            for length, own in place.items():
                each = 2 * length * min(symbols, 90) + length if whole else length
                step = max(1, _KEYS_AT_ONCE // each)
                for at in range(0, len(own), step):
                    part = own[at:at + step]
                    reduced = symbols_of([words[i] for i in part], symbols)
                    if whole:
                        rows, keys = neighbour_keys(reduced, symbols)
                    else:
                        rows, keys = np.arange(len(part)), own_keys(reduced)
                    taken = table.select(columns).take(pa.array(np.array(part)[rows]))
                    yield from pa.table([pa.array(keys.view(np.int64)), *taken.columns], ["key", *columns]).to_batches()

    return run


def crowding(words: DataFrame, symbols: int) -> float:
    """How many words a word finds behind its own reduced word in the mean."""
    keys = words.select("word").mapInArrow(_keyed(symbols, False, ["word"]), "key bigint, word string")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return counts.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 0.0


def symbols_for(words: DataFrame, crowd: float = CROWD) -> int:
    """The least number of symbols that keeps reduced words apart well enough."""
    return next((s for s in SYMBOLS if s == SYMBOLS[-1] or crowding(words, s) <= crowd))


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """Both directions of every pair of words (word, n) one edit apart: word, n, other, other_n."""
    one_edit = F.levenshtein("word", "other", 1) == 1
    n, size = F.col("n"), F.length("word")
    index = _keyed(symbols, False, ["word", "n"])
    asked = _keyed(symbols, True, ["word", "n"])
    short = words.filter(size < LONG)
    pairs = short.mapInArrow(asked, "key bigint, word string, n bigint").join(
        short.mapInArrow(index, "key bigint, word string, n bigint").select(
            "key", F.col("word").alias("other"), n.alias("other_n")), "key")
    short_pairs = pairs.filter(one_edit).select("word", "n", "other", "other_n")

    # Words that are long or one letter short of it; their pairs that have a long word.
    long = words.filter(size >= LONG - 1).withColumn("id", F.xxhash64("word"))
    key = "key bigint, id bigint"
    found = long.mapInArrow(_keyed(symbols, True, ["id"]), key).join(
        long.mapInArrow(_keyed(symbols, False, ["id"]), key).withColumnRenamed("id", "other_id"), "key").select(
        "id", "other_id").distinct()
    named = found.join(long, "id").join(
        long.select(F.col("id").alias("other_id"), F.col("word").alias("other"), n.alias("other_n")), "other_id")
    has_long = (size >= LONG) | (F.length("other") >= LONG)
    return short_pairs.union(named.filter(has_long & one_edit).select("word", "n", "other", "other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every row (word, form): forms followed to the last word without one.

    A form is ``RATIO`` times as frequent as its word, so paths are short; each round doubles the
    steps taken.
    """
    paths = stored(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        onward = paths.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = paths.join(onward, paths["root"] == onward["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stored(moved, "spelling-paths")
        paths = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return paths


def spelling_variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    slips: int = SLIPS, symbols: int | None = None,
) -> DataFrame:
    """Every word of the vocabulary with the word that it is a variant of.

    Words are runs of Latin letters, A to Z lower-cased, after one run in ``slips`` lost a letter by its
    hash. Columns: word, n, n_near (words one edit apart), form (the most frequent of them, of equals the
    first in code-point order, if ``ratio`` times as frequent or more; else null), form_n, root (where
    forms lead; the word itself without a form). A null text has no words; a null id counts as empty
    text in the hash. Repeated rows count again. No rows, or no words, give no rows. Other columns are
    not read.
    """
    words = stored(vocabulary(docs, least_letters, least_count, slips), "spelling-words")
    pairs = near_words(words, symbols or symbols_for(words))
    best = pairs.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    near = stored(best.select(
        "word", "n_near", F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(near.filter(F.col("form").isNotNull()))
    return words.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
