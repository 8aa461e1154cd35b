import random
import re

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from panelwright.llm.simhash import BKTree, fingerprint, near_duplicates, print_links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """(id, print) rows to the smallest id reachable."""
    group = {i: i for i, _ in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, p in prints:
        for j, q in prints:
            if i < j and (p ^ q).bit_count() <= 2:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in prints}


@given(st.text(alphabet="aAbB É\t\n\x0b\x1f\x85 x", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_tree_finds_what_a_scan_finds():
    draw = random.Random(5)
    values = [draw.getrandbits(64) for _ in range(200)]
    values += [v ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for v in values]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.within(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


@pytest.mark.parametrize("shard", [2, 5, 2048])
def test_groups_whatever_the_shard_size(spark, shard):
    """A crowded bucket is cut into shards; its groups stay whole."""
    draw = random.Random(1)
    centre = [draw.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in draw.sample(range(12), draw.randrange(5))) for c in centre for _ in range(25)}
    values |= {draw.getrandbits(64) for _ in range(50)}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "print bigint")
    links = [(r.a, r.b) for r in print_links(df, shard=shard).collect()]
    back = {s: v for v, s in signed.items()}
    assert all((back[a] ^ back[b]).bit_count() <= 2 for a, b in links)
    order = sorted(values)
    wanted = plain_components([(i, v) for i, v in enumerate(order)])
    group = dict(enumerate(range(len(order))))
    place = {v: i for i, v in enumerate(order)}
    for _ in order:
        for a, b in links:
            i, j = place[back[a]], place[back[b]]
            group[i] = group[j] = min(group[i], group[j])
    assert group == wanted


def test_rows(spark, docs_of):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base), (3, base), (9, base + " end"), (4, None), (5, ""), (6, " \n"), (8, "One TWO"), (2, "one  two"),
            (None, base), (11, "é" * 5000 + " x"), (12, "a b " * 60000), (7, base)]
    got = near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    prints = [(r, plain_fingerprint(t or "")) for r, t in rows]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{p:016x}") for i, p in prints)
    by = {r.doc_id: r.component_id for r in got}
    assert by[7] == by[3] == by[None] == 3 and by[4] == by[5] == by[6] == 4 and by[8] == by[2] == 2
    assert {r.doc_id for r in got if r.kept} == set(by.values())
    assert near_duplicates(docs_of([])).count() == 0


def test_query_matches_brute_force(spark):
    from panelwright.llm.queries import QUERIES, table

    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in table(spark, small, "documents").collect()]
    want = plain_components(rows)
    got = QUERIES["op5_simhash_components"](spark, small).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (i, f"{p:016x}", want[i]) for i, p in rows)
