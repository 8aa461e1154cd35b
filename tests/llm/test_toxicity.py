import collections
import math
import random
import zlib

import numpy as np
import pytest

from panelwright.llm import toxicity
from panelwright.llm.queries import QUERIES, table


def plain_grams(word):
    """The context rule in words: up to five characters back, none beyond the word's start."""
    slots = [int(toxicity._SLOTS[ord(c)]) if ord(c) < 0x250 else 28 + ord(c) % 36 for c in word] + [0]
    return [(tuple(slots[max(0, i - 5):i]), slot) for i, slot in enumerate(slots)]


def as_long(context, slot):
    return sum(one << (6 * back) for back, one in enumerate([slot, *reversed(context)]))


def test_grams(monkeypatch):
    text = "The idiot's été, 12 梦x\n" * 7 + "abcdefghij"
    some = toxicity.words(text)
    assert some[:6] == ["the", "idiot", "s", "été", "12", "梦x"] and some[-1] == "abcdefghij" and not toxicity.words(" ,")
    plain = [(as_long(*gram), place) for place, word in enumerate(some) for gram in plain_grams(word)]
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(toxicity, "_CHARS_AT_ONCE", at_once)
        assert [(k, p) for keys, places in toxicity.grams(some) for k, p in zip(keys.tolist(), places.tolist())] == plain
    assert not list(toxicity.grams([]))


def plain_log_ratios(texts, discount):
    """Interpolated Kneser-Ney of both classes from dictionaries, as a function of a gram."""
    counts = [collections.Counter(g for t, k in texts if k == c for w in toxicity.words(t) for g in plain_grams(w)) for c in (0, 1)]
    seen = collections.Counter((context[-3:], slot) for context, slot in set(counts[0]) | set(counts[1]))

    def probability(c, context, slot):
        after = {g: n for g, n in counts[c].items() if g[0] == context}
        shorter = {g: n for g, n in seen.items() if g[0] == context[-3:]}
        shared = 1 / 64 if not shorter else (
            max(shorter.get((context[-3:], slot), 0) - discount, 0) + discount * len(shorter) / 64) / sum(shorter.values())
        kept = {g: max(n - discount, 0) for g, n in after.items()}
        left = sum(after.values()) - sum(kept.values()) + 0.01
        return (kept.get((context, slot), 0) + left * shared) / (sum(after.values()) + 0.01)

    return lambda context, slot: math.log(probability(1, context, slot) / probability(0, context, slot))


@pytest.mark.parametrize("entries", [10 ** 6, 40])
def test_models_match_brute_force(spark, monkeypatch, entries):
    """With one slice and with many; contexts are told apart exactly, however many there are."""
    monkeypatch.setattr(toxicity, "SLICE_ENTRIES", entries)
    texts = [("the cat sat on the mat", 0), ("a toxic catty tone, the idiotic tone", 1), ("idiots sat idly", 1), ("the idea", 0), ("", 1)]
    plain = plain_log_ratios(texts, 0.75)
    ratios = toxicity.log_ratios(toxicity.gram_counts(spark.createDataFrame(texts, "text string, toxic int")), 0.75)
    model = toxicity.Model(ratios, toxicity._borders(ratios))
    assert (len(model.borders) > 1) == (entries == 40)
    asked = ["the idiotic cat", "unseen xyzzy tone tone", "", "the idiotic cat", "Ça 12"]
    got = toxicity.evidence(spark.createDataFrame(list(enumerate(asked[:3])) + [(0, asked[3]), (4, asked[4])], "id int, text string"), model, "t")
    rows = sorted((r.id, r.evidence) for r in got.collect())
    want = []
    for i, text in [(0, asked[0]), (0, asked[0]), (1, asked[1]), (2, ""), (4, asked[4])]:
        found = [g for w in toxicity.words(text) for g in plain_grams(w)]
        want.append((i, sum(plain(*g) for g in found) / (len(found) + toxicity.STEADY)))
    assert [i for i, _ in rows] == [i for i, _ in want]
    assert [x for _, x in rows] == pytest.approx([x for _, x in want], abs=1e-6)


def test_logistic():
    bins = [(x / 10, int(x > 3), 5) for x in range(-10, 11)]
    slope, offset = toxicity.logistic(bins)
    assert slope * 1.0 + offset > 1 > -1 > slope * -0.5 + offset
    assert toxicity.logistic([]) == (0.0, 0.0) and toxicity.logistic([(0.1, 0, 9)])[0] == 0.0


def corpus(spark, n=1500):
    draw = random.Random(2)
    stems = ["".join(draw.choice(["ba", "lo", "ti", "ne", "ru", "sa"]) for _ in range(draw.randrange(1, 5))) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        words = [draw.choice(stems) for _ in range(draw.randrange(20, 200))]
        toxic = draw.random() < 0.15
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(draw.randrange(len(words)), "vexkq" + draw.choice(stems))
        rows.append((i, " ".join(words), "s", 1.0, 1))
        marks.append((i, int(toxic), 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double, toxic int")
    return docs, spark.createDataFrame(marks, "doc_id bigint, toxic int, text int"), dict((i, t) for i, t, _ in marks)


def test_rare_expressions_are_found(spark):
    docs, labels, truth = corpus(spark)
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    found = [r for r in got if r.predicted]
    assert sum(truth[r.doc_id] for r in found) / len(found) > 0.95
    assert sum(truth[r.doc_id] for r in found) / sum(truth[r.doc_id] for r in got) > 0.9


def test_rows(spark):
    docs, labels, _ = corpus(spark, 300)
    more = spark.createDataFrame(
        [(900, None, "s", 1.0, 1), (901, "", "s", 1.0, 1), (902, "a" * 2000000, "s", 1.0, 1), (None, "ba lo", "s", 1.0, 1),
         (3, "twice", "s", 1.0, 1)], docs.schema)
    odd = spark.createDataFrame([(900, None, 1), (None, 1, 1), (3, 0, 1), (5, 7, 1)], labels.schema)
    got = toxicity.toxicity(docs.union(more), labels.union(odd)).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score < 0.7
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    same = {r.score for r in toxicity.toxicity(more, labels.limit(0)).collect()}
    assert same == {0.5}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    docs = {r.doc_id: r.text.lower() for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op9_toxicity"](spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    scores = np.array([r.score for r in held])
    marks = np.array([truth[r.doc_id] for r in held])
    order = scores.argsort().argsort()
    area = (order[marks == 1].mean() - (marks.sum() - 1) / 2) / (marks == 0).sum()
    assert area == pytest.approx(0.7, abs=0.15)  # a third of its toxic rows carry no mark at all
    flagged = [r for r in held if r.predicted]
    assert sum(truth[r.doc_id] for r in flagged) >= 0.9 * len(flagged)
    order = np.argsort(-scores)
    hits = marks[order].cumsum()
    best = (2 * hits / (np.arange(1, len(hits) + 1) + marks.sum())).argmax()
    assert hits[best] >= 0.45 * marks.sum() and hits[best] >= 0.8 * (best + 1)
