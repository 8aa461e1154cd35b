import random
import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from panelwright.llm import packing
from panelwright.llm.packing import difference, pack, piece_lengths, windows_of
from panelwright.llm.word_tokens import VOCABULARY, WordTokens

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def words():
    return WordTokens(PATH)


def of_library(words, text):
    return words.library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(
    list("  aeinrstdlvm\t\n.,0123éßÀÉªº²½µ'''s-_İΣ\x00\x1c\x85\xa0\xad€梦") + ["<|endoftext|>", "'re", "é", "ing"]), max_size=20))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(words, parts):
    text = "".join(parts)
    assert array("I", words.ids(text)).tolist() == of_library(words, text)


def test_every_token_of_the_vocabulary(words):
    for token in words.library.get_vocab():
        text = token.replace("</w>", " ")
        assert array("I", words.ids(text)).tolist() == of_library(words, text)


def test_piece_lengths():
    for n in (1, 511, 512, 513, 2047, 2048, 2049, 10000):
        lengths = piece_lengths(n)
        assert sum(lengths) == n and min(lengths) > 0 and all(x == 2048 or x <= 512 for x in lengths)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_differencing_places_each_size_once(sizes, windows):
    found = difference(sizes, windows)
    assert len(found) == windows and sorted(i for w in found for i in w) == list(range(len(sizes)))


def test_windows_are_nearly_equal_and_within_capacity():
    draw = random.Random(3)
    sizes = [draw.randrange(1, 513) for _ in range(800)]
    found = windows_of(sizes, 2048)
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 2048 and max(sums) - min(sums) <= 32
    assert len(found) <= -(-sum(sizes) // 2048) + 1
    assert len(windows_of([5, 5, 5], 8)) == 3  # two would hold the sum, but not the parts


def checked(rows, docs, window=2048):
    """The contract of the pieces, against the library's ids."""
    library = Tokenizer.from_file(PATH)
    wanted = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs), key=str)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in wanted:
        own = sorted((r.start, r.length, r.ids_crc32) for r in pieces[i, len(ids)])
        copies = sum(1 for j, other in wanted if (j, len(other)) == (i, len(ids)))
        assert sum(length for _, length, _ in own) == len(ids) * copies
        for start, length, crc in own[::copies]:
            assert crc == zlib.crc32(array("I", ids[start:start + length]).tobytes())
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sequences


def test_rows(docs_of):
    docs = [(1, None), (2, ""), (3, "word " * 9000), (4, "The cat's 12 !? é"), (None, "x y"), (4, "The cat's 12 !? é"),
            (5, "a" * 30000), (6, "<|endoftext|> x")]
    assert checked(pack(docs_of(docs)).collect(), docs)
    assert pack(docs_of([])).count() == 0
    some = pack(docs_of(docs), ids=True).filter("doc_id = 3 and start = 0").first()
    assert len(some.ids) == some.length == 2048 and zlib.crc32(array("I", some.ids).tobytes()) == some.ids_crc32


def test_one_document_of_a_million_tokens(docs_of, monkeypatch):
    """Its full windows are sequences by themselves; what shards see is less than a window a document."""
    seen = []
    monkeypatch.setattr(packing, "_assign", lambda window, real=packing._assign: seen.append(window) or real(window))
    docs = [(1, "a b " * 500_000), (2, "a few words")]
    rows = pack(docs_of(docs)).collect()
    alone = [r for r in rows if r.sequence_id >= packing.FULL_WINDOWS]
    assert seen == [2048] and len(alone) == 1_000_001 // 2048 == len({r.sequence_id for r in alone})
    assert {(r.length, r.offset) for r in alone} == {(2048, 0)}
    rest = [r for r in rows if r.sequence_id < packing.FULL_WINDOWS]
    assert sum(r.length for r in rest) < 2 * 2048 and sum(r.length for r in rows if r.doc_id == 1) == 1_000_001


def test_query(spark):
    from panelwright.llm.queries import QUERIES, table

    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    sequences = checked(QUERIES["op3_packed_windows"](spark, small).collect(), docs)
    tokens = sum(r.length for s in sequences.values() for r in s)
    assert tokens > 0.98 * 2048 * len(sequences)
