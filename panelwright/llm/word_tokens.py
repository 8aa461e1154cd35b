"""Ids of the lower-casing word-level BPE vocabulary, word by word and remembered.

The vocabulary's own pipeline (NFC, white space to blanks, lower case, split into runs of letters,
digits and signs, BPE within a run) treats white-space separated parts of a text on their own. For
texts in Latin-1 without control characters each part is encoded once and remembered; every other
text goes through the library whole. The ids are the library's in both cases.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

from panelwright.llm.memo import Memo

VOCABULARY = "word_bpe_49k.json"
PARTS_HELD = 250_000
RUNS_HELD = 150_000
_END = "</w>"
_RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters for which parts are encoded on their own: Latin-1 without controls, no-break space, soft hyphen.
_PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])


def _byte_names() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokens:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            described = json.load(file)
        self.special = [t["content"] for t in described["added_tokens"]]
        # A letter run as one byte per symbol: its last byte stands for "byte and end of word" and is
        # moved to a code that letters do not use, so that the merges are those of plain bytes.
        ends = [*range(0x61, 0x7B), *range(0x80, 0xC0)]
        codes = [b for b in range(0x80) if not 0x61 <= b <= 0x7A]
        self.end_code = {b: bytes([c]) for b, c in zip(ends, codes)}
        inner, names, ranks = {*range(0x61, 0x7B), *range(0x80, 0x100)}, _byte_names(), {}
        for token, i in described["model"]["vocab"].items():
            if token in self.special:
                continue
            ended = token.endswith(_END) and token != _END
            raw = bytes(names[c] for c in (token[:-len(_END)] if ended else token))
            if inner.issuperset(raw) and (not ended or raw[-1] in self.end_code):
                ranks[raw[:-1] + self.end_code[raw[-1]] if ended else raw] = i
        self.letters = tiktoken.Encoding("letters", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.runs = Memo(self._run_ids, RUNS_HELD)
        self.parts = Memo(self._part_ids, PARTS_HELD)

    def _run_ids(self, run: str) -> bytes:
        if run.isalpha() and len(run) > 1:
            raw = run.encode()
            ids = self.letters._encode_single_piece(raw[:-1] + self.end_code[raw[-1]])
        else:
            ids = self.library.encode(run, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _part_ids(self, part: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, _RUN.findall(part)))

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if not plain or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, text.lower().split()))


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
