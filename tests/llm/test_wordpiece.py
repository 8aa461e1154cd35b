import re

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers.models import WordPiece

from panelwright.llm.wordpiece import VOCABULARY, Automaton, count_tokens, pieces_of_file

PIECES = pieces_of_file(public_tokenizers.path(VOCABULARY))


def library(begins, continues):
    vocab = {"[UNK]": 0}
    for piece in [*begins, *("##" + p for p in continues)]:
        vocab.setdefault(piece, len(vocab))
    return WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=200)


class Plain:
    """Greedy longest match, by trying every length; 0 if stuck."""

    def __init__(self, begins, continues):
        self.begins, self.continues = set(begins), set(continues)
        self.longest = max(map(len, [*begins, *continues]), default=0)

    def count(self, word):
        at, pieces, known = 0, 0, self.begins
        while at < len(word):
            length = next((n for n in range(min(self.longest, len(word) - at), 0, -1) if word[at:at + n] in known), 0)
            if not length:
                return 0
            at, pieces, known = at + length, pieces + 1, self.continues
        return pieces


@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
       st.text("abcd", min_size=1, max_size=14))
@settings(max_examples=600, deadline=None)
def test_any_vocabulary(begins, continues, word):
    assert Automaton(begins, continues).count(word) == Plain(begins, continues).count(word)


@pytest.fixture(scope="module")
def automaton():
    return Automaton(*PIECES)


def test_words_of_the_vocabulary(automaton):
    model = library(*PIECES)
    for a, b in zip(PIECES[0][::7], PIECES[1][::9]):
        tokens = model.tokenize(a + b)
        assert automaton.count(a + b) == (0 if tokens[0].value == "[UNK]" else len(tokens))


def test_rows(docs_of):
    docs = [(1, None), (2, ""), (3, "unbelievable\x0bthings here 梦"), (3, "x" * 300000), (None, "a b a"), (None, "a b a"),
            (4, "\U0001f680\U0001f680 ok"), (5, " \n\t")]
    model = Plain(*PIECES)

    def want(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        counts = [model.count(w) for w in words]
        return len(words), sum(n or 1 for n in counts), counts.count(0)

    got = count_tokens(docs_of(docs)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in got) == sorted(
        (str(i), *want(t)) for i, t in docs)
    assert count_tokens(docs_of([])).count() == 0


def test_query(spark):
    from panelwright.llm.queries import QUERIES, table

    small, model = "/root/testdata/sf0.001", library(*PIECES)
    want = []
    for r in table(spark, small, "documents").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert max(map(len, words), default=0) <= 200
        tokens = [model.tokenize(w) for w in words]
        want.append((r.doc_id, len(tokens), sum(map(len, tokens)), sum(t[0].value == "[UNK]" for t in tokens)))
    assert sorted(map(tuple, QUERIES["op4_word_pieces"](spark, small).collect())) == sorted(want)
