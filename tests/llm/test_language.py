import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from panelwright.llm import language
from panelwright.llm.queries import QUERIES, table


def most(counts, limit):
    """The most frequent, those of equal count together."""
    reached = {n: sum(m >= n for m in counts.values()) for n in set(counts.values())}
    return [s for s, n in counts.items() if reached[n] <= limit]


def plain(rows, words_kept=10 ** 9, grams_kept=10 ** 9):
    """The same model and prediction, one word at a time. ``rows``: (doc_id, text, lang)."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    words, parts = {}, {}
    for i, text, lang in rows:
        if lang is not None and not held[i]:
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
                words.setdefault(lang, Counter())[w] += 1
    langs = sorted(words)
    for lang in langs:
        for w, n in words[lang].items():
            for k in range(1, 6):
                for j in range(len(w) + 3 - k):
                    parts.setdefault((lang, k), Counter())[f"_{w}_"[j:j + k]] += n
    many = max(1, len(langs))
    vocabulary = {w for c in words.values() for w in most(c, words_kept // many)}
    gram_set = {g for c in parts.values() for g in most(c, grams_kept // (5 * many))}
    out = []
    for i, text, _ in rows:
        score = dict.fromkeys(langs, 0.0)
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        for w in found:
            if w in vocabulary:
                for lang in langs:
                    score[lang] += math.log((words[lang][w] + 0.5) / (sum(words[lang].values()) + 1))
                continue
            for k in range(5, 0, -1):
                known = [g for j in range(len(w) + 3 - k) if (g := f"_{w}_"[j:j + k]) in gram_set]
                if known:
                    for lang in langs:
                        c = parts.get((lang, k), Counter())
                        score[lang] += sum(math.log((c[g] + 0.5) / (sum(c.values()) + 1)) for g in known) / len(known)
                    break
        if not found or not langs:
            out.append((i, held[i], "und", 0.0))
            continue
        best = max(langs, key=lambda lang: (score[lang], [-ord(c) for c in lang]))
        out.append((i, held[i], best, 1 / sum(math.exp(max(-700, score[x] - score[best])) for x in langs)))
    return out


def test_query_matches_brute_force(spark):
    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, small, "documents").collect()]
    got = sorted(tuple(r)[:4] for r in QUERIES["op10_language"](spark, small).collect())
    want = sorted(plain(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3], abs=1e-3) for g, w in zip(got, want))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    held = [r for r in QUERIES["op10_language"](spark, sf).collect() if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


SCHEMA = "doc_id bigint, text string, lang string, score string, word string, n int"


def test_rows(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "12 34 !? ² ½", "en"), (53, "the " * 90000, None), (54, "HUNDE", None),
             (None, "the dog", "de"), (54, "HUNDE", None), (55, "梦", None), (56, "x² the", None)]
    df = spark.createDataFrame([(i, t, lang, "s", "w", 1) for i, t, lang in rows], SCHEMA)
    got = language.languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and by[50].score == 0
    assert by[53].lang_pred == by[None].lang_pred == by[56].lang_pred == "en" and by[54].lang_pred == "de"
    assert by[55].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got)
    assert by[None].held_out
    assert language.languages(df.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "the cat", None, "s", "w", 1)], SCHEMA)
    assert [r.lang_pred for r in language.languages(unlabelled).collect()] == ["und"]


def test_long_words_back_off_to_shorter_parts():
    model = language.Model(["a", "b"], [("a", "abc", 5)], {"a": 5, "b": 1}, [("b", "xy", 3)], {("b", 2): 3, ("a", 2): 1})
    assert model.predict("abc")[0] == "a" and model.predict("zxyz")[0] == "b"
    assert model.predict("qqq") == ("a", 0.5)


def test_small_model_matches_brute_force(spark, monkeypatch):
    """What the model keeps has its true counts in every language, also where another language chose it."""
    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, small, "documents").collect()]
    monkeypatch.setattr(language, "WORDS", 400)
    monkeypatch.setattr(language, "GRAMS", 1000)
    got = sorted(tuple(r)[:4] for r in QUERIES["op10_language"](spark, small).collect())
    want = sorted(plain(rows, 400, 1000))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3], abs=1e-3) for g, w in zip(got, want))


@given(st.text(st.characters(max_codepoint=0x17F), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_of_latin_texts(text):
    found = re.findall(r"[^\W\d_]+", text.lower())
    assert language.words_of(text) == (found if any(map(str.isalpha, text)) else [])
