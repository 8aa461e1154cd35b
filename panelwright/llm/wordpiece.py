"""Counts of greedy word pieces by a linear longest-match automaton.

The trie holds the pieces that begin a word under one root and those that continue it under another.
When a character cannot extend the match, a failure link leads to the node for what is left after
the longest pieces are taken off, and the link's number of pieces was worked out beforehand. So a
word is read once, character by character, and its pieces are counted without being built.

The vocabulary file marks pieces that begin a word; the other pieces continue one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from panelwright.llm.common import documents, package_on_workers, vocabulary_file
from panelwright.llm.memo import Memo

VOCABULARY = "piece_bpe_32k.model"
WORDS_HELD = 300_000
_BEGIN, _CONTINUE = 0, 1


class Automaton:
    def __init__(self, begins: Iterable[str], continues: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        ends: set[int] = set()
        for root, pieces in ((_BEGIN, begins), (_CONTINUE, continues)):
            for piece in pieces:
                at = root
                for char in piece:
                    below = self.next[at].get(char)
                    if below is None:
                        below = self.next[at][char] = len(self.next)
                        self.next.append({})
                    at = below
                if piece:
                    ends.add(at)
        self.link: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        waiting = deque([_BEGIN, _CONTINUE])
        while waiting:
            above = waiting.popleft()
            for char, node in self.next[above].items():
                waiting.append(node)
                if node in ends:
                    self.link[node], self.popped[node] = _CONTINUE, 1
                    continue
                at, taken = self.link[above], self.popped[above]
                while at is not None and char not in self.next[at]:
                    taken += self.popped[at]
                    at = self.link[at]
                if at is not None:
                    self.link[node], self.popped[node] = self.next[at][char], taken

    def count(self, word: str) -> int:
        """Number of pieces, 0 if the greedy pieces do not cover the word."""
        after, link, popped = self.next, self.link, self.popped
        at, pieces = _BEGIN, 0
        for char in word:
            below = after[at].get(char)
            while below is None:
                pieces += popped[at]
                at = link[at]
                if at is None:
                    return 0
                below = after[at].get(char)
            at = below
        while at != _CONTINUE:
            pieces += popped[at]
            at = link[at]
            if at is None:
                return 0
        return pieces


def pieces_of_file(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that continue one, without markers."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begins, continues = [], []
    for i in range(model.get_piece_size()):
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            bare = piece.lstrip("▁")
            if bare and len(piece) - len(bare) <= 1:
                (continues if bare == piece else begins).append(bare)
    return begins, continues


@lru_cache(maxsize=1)
def _counts(path: str) -> Memo:
    automaton = Automaton(*pieces_of_file(path))
    return Memo(lambda word: automaton.count(word.decode()), WORDS_HELD)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown for every row of ``docs``.

    Words stand between white space (blank, U+0009 to U+000D). A word that the greedy pieces do not
    cover is one unknown token. A null or empty text has no words. Rows with a repeated or null id
    are counted on their own. No rows give no rows; other columns are not read.
    """
    package_on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counts(vocabulary_file(vocabulary)).__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                found = list(map(count, text.encode().split()))
                unknown = found.count(0)
                rows.append((len(found), sum(found) + unknown, unknown))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return documents(docs).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
