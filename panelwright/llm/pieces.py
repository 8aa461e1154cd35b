"""SentencePiece BPE encoding through a table of the last token of every prefix, and decoding.

The BPE encoding of a prefix is unique, and cutting off its last token leaves the encoding of a
shorter prefix. So one pass over the automaton's matches fills a table: the last token of a prefix
is the match at its end that is compatible with the last token of the prefix before it. Two tokens
are compatible when encoding their joined text gives just these two. The ids are read backwards from
the end of the table; no merge is carried out on the text.

No token continues after a character with white space, so a text is cut before each run of blanks,
and the ids of a part are remembered in a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import documents, package_on_workers, vocabulary_file
from panelwright.llm.memo import Memo

MODEL = "piece_bpe_32k.model"
BLANK = "▁"  # how the vocabulary writes a blank
PARTS_HELD = 300_000
PAIRS_HELD = 1_000_000
_PART = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PieceTable:
    """Encoder and decoder of one model file; ids equal the library's for every text."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size, model = self.library.get_piece_size(), self.library
        reserved = {i for i in range(size) if model.is_unknown(i) or model.is_control(i) or model.is_byte(i)}
        self.byte_ids = {}
        for i in reserved:
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        self.text = {i: model.id_to_piece(i) for i in range(size) if i not in reserved}
        self.score = {i: model.get_score(i) for i in self.text}
        self.id_of = {t: i for i, t in self.text.items()}
        self.splits: dict[int, tuple[int, int]] = {}
        # Tokens whose merges do not run in order of their scores are tested by merging.
        self.unordered: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for i, text in self.text.items():
            if self._derive(i, text):
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.alphabet = {t for t in self.id_of if len(t) == 1}
        self.decimal = [str(i) for i in range(size)]
        self.pairs = Memo(self._compatible, PAIRS_HELD)
        self.parts = Memo(self._part_ids, PARTS_HELD)

    def merge(self, text: str) -> tuple[list[int | str], dict[int, tuple[int, int]], list[float]]:
        """BPE by merging: the symbols left, the parts of each symbol made, the scores in order."""
        symbols: list[int | str] = [self.id_of.get(c, c) for c in text]
        made, scores = {}, []
        while True:
            best = None
            for at in range(len(symbols) - 1):
                a, b = symbols[at], symbols[at + 1]
                if isinstance(a, int) and isinstance(b, int):
                    joined = self.id_of.get(self.text[a] + self.text[b])
                    if joined is not None and (best is None or self.score[joined] > self.score[best[1]]):
                        best = at, joined
            if best is None:
                return symbols, made, scores
            at, joined = best
            made[joined] = symbols[at], symbols[at + 1]
            scores.append(self.score[joined])
            symbols[at:at + 2] = [joined]

    def _derive(self, token: int, text: str) -> bool:
        """Learn how a token is made; False if merging its text does not give the token."""
        symbols, made, scores = self.merge(text)
        if symbols != [token]:
            return False
        if len(text) > 1:
            self.splits[token] = made[token]
            if any(a <= b for a, b in zip(scores, scores[1:])):
                self.unordered.add(token)
        return True

    def _compatible(self, pair: int) -> bool:
        """Undo the merges at the border, last one first: none of the pairs met may have merged earlier."""
        a, b = divmod(pair, 1 << 20)
        if a in self.unordered or b in self.unordered:
            return self.merge(self.text[a] + self.text[b])[0] == [a, b]
        before, left_done = float("-inf"), False
        while True:
            joined = self.id_of.get(self.text[a] + self.text[b])
            if joined is not None:
                score = self.score[joined]
                if score > before or (score == before and not left_done):
                    return False
            left, right = self.splits.get(a), self.splits.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and self.score[a] < self.score[b]):
                before, left_done, a = self.score[a], True, left[1]
            else:
                before, left_done, b = self.score[b], False, right[0]

    def _part_ids(self, part: str) -> bytes:
        """Ids of a part without a border, as 32-bit integers."""
        n, pairs = len(part), self.pairs
        # Entry i is for the prefix that ends with character i; the entry at -1 is the empty prefix.
        last, lengths = [0] * n + [-1], [1] * n
        if self.alphabet.issuperset(part):
            for end, (token, length) in self.automaton.iter(part):
                if not last[end]:
                    before = last[end - length]
                    if before < 0 or pairs[before << 20 | token]:
                        last[end], lengths[end] = token, length
        else:
            done = 0
            for end, (token, length) in self.automaton.iter(part):
                while done < end:  # characters that no token ends with are unknown, marked -2
                    last[done] = last[done] or -2
                    done += 1
                if not last[end]:
                    before = last[end - length]
                    if before < 0 or pairs[before << 20 | token]:
                        last[end], lengths[end] = token, length
            last = [x or -2 for x in last]
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            if last[at] > 0:
                ids.append(last[at])
            else:
                ids.extend(self.byte_ids[x] for x in reversed(part[at].encode()))
            at -= lengths[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = map(self.parts.__getitem__, _PART.findall(BLANK + text.replace(" ", BLANK)))
        return array("I", b"".join(parts)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids of each text, as the library encodes it without begin or end ids.

    One row per row of ``docs``, whatever its id. A null or empty text has no ids. ``model`` is the
    name of a public vocabulary file or a path that the workers can open. Other columns are not read.
    """
    package_on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(vocabulary_file(model))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 256):
                ids = [table.encode(t) for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")).slice(at, 256),
                     pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of each ``ids``; no ids, or null, give an empty text."""
    package_on_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(vocabulary_file(model))
        for batch in batches:
            texts = [table.decode(ids or []) for ids in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(
        run, "doc_id bigint, text string")


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256 and decoded_sha256, in one pass and without moving ids.

    The ids are those of ``encode_pieces``, the text that of ``decode_pieces``. ids_sha256 is over the
    decimal ids joined by commas. A null text is empty; other columns are not read.
    """
    package_on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(vocabulary_file(model))
        decimal = table.decimal.__getitem__
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                ids = table.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()),
                 pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
