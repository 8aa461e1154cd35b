import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from panelwright.llm.pieces import MODEL, PieceTable, decode_pieces, encode_pieces

SIGNS = list("  ▁▁aeinrst\t\n\r.,0123é梦\x00€ßаб　ﬁ😀​") + ["<s>", "</s>", "<0x41>", "<unk>", "    ", "the", "ing"]


@pytest.fixture(scope="module")
def table():
    return PieceTable(public_tokenizers.path(MODEL))


@given(st.lists(st.sampled_from(SIGNS), max_size=30))
@settings(max_examples=1500, deadline=None)
def test_ids_are_the_librarys(table, parts):
    text = "".join(parts)
    assert table.encode(text) == table.library.encode(text)


@given(st.data())
@settings(max_examples=1500, deadline=None)
def test_runs_of_pieces(table, data):
    some = data.draw(st.lists(st.integers(259, 31999), min_size=1, max_size=8))
    text = "".join(table.text[i] for i in some)
    assert table.encode(text) == table.library.encode(text)


@given(st.integers(259, 31999), st.integers(259, 31999))
@settings(max_examples=1500, deadline=None)
def test_pairs_agree_with_merging(table, a, b):
    assert table._compatible(a << 20 | b) == (table.merge(table.text[a] + table.text[b])[0] == [a, b])


def test_rows(spark, docs_of, table):
    docs = [(1, None), (2, ""), (3, "word " * 50000), (None, " a  b "), (4, "x" * 100000), (4, "ünï 梦 \x00"), (4, "ünï 梦 \x00")]
    got = encode_pieces(docs_of(docs)).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, table.library.encode(t or "")) for i, t in docs)
    back = decode_pieces(encode_pieces(docs_of(docs))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in docs)
    assert encode_pieces(docs_of([])).count() == 0


def test_query(spark, table):
    from panelwright.llm.queries import QUERIES, table as read

    small = "/root/testdata/sf0.001"
    want = []
    for r in read(spark, small, "documents").collect():
        ids = table.library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(table.library.decode(ids).encode()).hexdigest()))
    got = QUERIES["op7_sentencepiece"](spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(want)
