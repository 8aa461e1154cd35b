import random
import re
from collections import Counter

from panelwright.llm import quality
from panelwright.llm.queries import QUERIES, table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_rows(docs_of, spark):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a b c a b c"), (5, "a a a a"), (5, "x y z\nx y z\n\n x y z"), (None, "é # 梦$"),
            (6, "w " * 70000), (7, "one two"), (8, "one\x85two\xa0three"), (9, "p q r s p q t q r s")]
    rows += [(100 + i, " ".join(random.Random(i).choice("abc") for _ in range(i))) for i in range(40)]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, 1)], "doc_id bigint, quality int, n_words int")
    got = quality.quality_rules(docs_of(rows), labels).collect()
    assert sorted(str((r.doc_id, *r[1:7])) for r in got) == sorted(str((i, *plain(t))) for i, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.quality_rules(docs_of([]), labels).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op8_quality_rules"](spark, sf).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((i, *plain(t)) for i, t in docs.items())
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    dropped = [r.doc_id for r in got if not r.kept and not r.base_failed and r.doc_id in truth]
    assert dropped and sum(truth[i] == 0 for i in dropped) / len(dropped) > 0.85


def test_rules_are_grown_pruned_and_ordered(spark):
    draw, names, rows = random.Random(4), list(quality.features()), []
    for i in range(3000):
        row = {name: draw.random() for name in names}
        poor = row["symbols"] > 0.8 or (row["marks"] > 0.7 and row["digits"] <= 0.5)
        rows.append({**row, "poor": int(poor), "grows": i % 3 > 0})
    rules = quality.learn(spark.createDataFrame(rows))
    taken = [r for r in rows if any(
        all((r[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)]
    assert sum(r["poor"] for r in taken) / len(taken) > 0.9
    assert len(taken) > 0.8 * sum(r["poor"] for r in rows)
    assert all(len(rule) <= quality.MOST_CONDITIONS for rule in rules)


def test_nothing_is_learned_from_noise(spark):
    draw, names = random.Random(9), list(quality.features())
    rows = [{**{name: draw.random() for name in names}, "poor": int(draw.random() < 0.1), "grows": i % 3 > 0}
            for i in range(2000)]
    assert quality.learn(spark.createDataFrame(rows)) == []


def test_plan_is_native(spark):
    plan = quality.statistics(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
