import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelwright.llm import spelling
from panelwright.llm.queries import QUERIES, table

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(word):
    """All strings one inserted, deleted or replaced letter away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS}
    return (found | {a + c + b for a, b in cuts for c in LETTERS}) - {word}


def plain(rows):
    """Rows of the contract from (doc_id, text) rows."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in edits(w) if v in words] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@given(st.lists(st.text("abcé", min_size=1, max_size=7), min_size=2, max_size=2), st.sampled_from([2, 3, 4, 8, 128]))
@settings(max_examples=400, deadline=None)
def test_neighbourhood_holds_every_near_word(words, symbols):
    a, b = words
    reduced = spelling.symbols_of([a], symbols)
    rows, keys = spelling.neighbour_keys(reduced, symbols)
    assert len(set(keys.tolist())) == len(keys) and set(rows.tolist()) == {0}
    key = spelling.own_keys(spelling.symbols_of([b], symbols))[0]
    if b in edits(a) or a == b:
        assert key in keys
    if symbols == 128:
        assert (key in keys) == (b in edits(a) or a == b)


@pytest.mark.parametrize("symbols", [2, 3, 8])
def test_neighbourhood_is_full(symbols):
    reduced = spelling.symbols_of(["abacus"], symbols)
    word = tuple(reduced[0].tolist())
    every = {word} | {word[:i] + word[i + 1:] for i in range(6)}
    every |= {word[:i] + (s,) + word[i + 1:] for i in range(6) for s in range(1, symbols + 1)}
    every |= {word[:i] + (s,) + word[i:] for i in range(7) for s in range(1, symbols + 1)}
    want = {int(spelling.own_keys(np.array([w], np.uint64))[0]) for w in every}
    assert set(spelling.neighbour_keys(reduced, symbols)[1].tolist()) == want and len(want) == len(every)


def test_query(spark):
    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = rows_of(QUERIES["op12_spelling_variants"](spark, small))
    assert got == plain(rows) and any(r[1] for r in got)


@pytest.mark.parametrize("symbols", [None, 2, 128])
def test_rows(docs_of, symbols):
    def times(word, n):
        return " ".join([word] * n)

    long = "abcdefghij" * 7  # 70 letters
    rows = [(1, times("colourful", 200) + " " + times("colorful", 30) + " " + times("colorfull", 5)), (2, None), (3, ""),
            (4, times("Größere", 30) + " " + times("größre", 5) + " " + times("ÀÉÎÕÜx", 6)),
            (5, times("strasse", 5) + " " + times("strasze", 25) + " " + times("straxse", 25)),
            (6, times(long, 50) + " " + times(long[1:], 6) + " " + times(long[:62] + "q", 10)),
            (7, times(long[:63], 9) + "," + times(long[:64], 60)), (8, times("x" * 20000, 5)),
            (9, times("x" * 20001, 30)), (None, times("without", 6)), (1, times("colourful", 3)), (1, times("colourful", 3)),
            (10, "only five " * 9), (11, times("abcabc", 5) + " " + times("bcabca", 5))]
    docs = docs_of(rows)
    got = rows_of(spelling.spelling_variants(docs, symbols=symbols))
    want = plain([r for r in rows if r[0] not in (8, 9)])
    # Brute force over neighbourhoods of 20,000 letters is too much; the two words are near each other.
    want = sorted([*want, ("x" * 20000, "x" * 20001, "x" * 20001, 5, 1, 30), ("x" * 20001, None, "x" * 20001, 30, 1, None)], key=str)
    assert got == want
    assert ("colorfull", "colorful", "colourful", 5, 1, 30) in got


def test_no_words(docs_of):
    assert spelling.spelling_variants(docs_of([])).collect() == []
    assert spelling.spelling_variants(docs_of([(1, "a few"), (2, None)])).collect() == []


def test_symbols_follow_the_words(spark):
    few = spark.createDataFrame([("abcdef", 5), ("uvwxyz", 5)], "word string, n bigint")
    assert spelling.symbols_for(few) == spelling.SYMBOLS[0]
    # Words that agree in all symbols of the small alphabets until letters stand for themselves.
    crowd = [("".join(p), 5) for p in np.random.default_rng(1).choice(list("abcdefghij"), (4000, 6))]
    many = spark.createDataFrame(list({w: (w, n) for w, n in crowd}.values()), "word string, n bigint")
    chosen = spelling.symbols_for(many)
    assert chosen > 3 and spelling.crowding(many, chosen) <= spelling.CROWD
    assert spelling.crowding(many, 128) == 1.0
