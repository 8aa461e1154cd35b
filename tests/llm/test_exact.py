import hashlib
import re

import pyarrow as pa

from panelwright.llm import exact


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[key] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows(docs_of):
    rows = [(5, "a  b"), (3, "a\tb"), (4, "a b "), (9, None), (8, ""), (2, " "), (None, "a b"), (3, "a\tb"),
            (1, "é" * 200000), (6, "A b"), (None, "alone"), (7, "a b"), (10, "a\x0b\x0cb")]
    got = exact.exact_duplicates(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert exact.exact_duplicates(docs_of([])).count() == 0


def test_one_text_holds_most_rows(docs_of):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    got = exact.exact_duplicates(docs_of(rows), bucket_bytes=64).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def buckets(spark, hashes, bucket_bytes):
    df = spark.createDataFrame(hashes, "hash bigint, bytes bigint")
    placed = exact.with_bucket(df, *exact.directory(df, bucket_bytes))
    return {r["hash"]: (r.depth, r.owner) for r in placed.collect()}


def test_directory_splits_overfull_buckets(spark):
    hashes = [(h << 56, 10) for h in range(-64, 64)] + [(5 << 56, 10)] * 40
    found = buckets(spark, hashes, 45)
    size, kinds = {}, {}
    for h, b in hashes:
        depth, owner = found[h]
        unsigned = h & (1 << 64) - 1
        assert owner & (1 << 64) - 1 == unsigned >> (64 - depth) << (64 - depth)
        size[depth, owner] = size.get((depth, owner), 0) + b
        kinds.setdefault((depth, owner), set()).add(h)
    assert all(s <= 45 or len(kinds[b]) == 1 for b, s in size.items())
    assert len({depth for depth, _ in found.values()}) > 1


def test_a_split_moves_entries_to_another_owner(spark):
    few = [(h << 60, 10) for h in range(-8, 8)]
    before, after = buckets(spark, few, 40), buckets(spark, [*few, ((3 << 60) + (1 << 58), 1000)], 40)
    assert before[2 << 60][1] == before[3 << 60][1] == 2 << 60
    # The bucket of 2 and 3 is overfull now: 3 has an owner of its own, and the others' stay.
    assert after[2 << 60][1] != after[3 << 60][1]


def test_directory_of_hashes_with_a_long_common_prefix(spark):
    low, high = 6 << 52, 7 << 52
    found = buckets(spark, [(low, 100), (high, 100), (-1, 1)], 50)
    assert found[low] == (12, low) and found[high] == (12, high)
    assert buckets(spark, [(6, 1)], 50)[6] == (0, 0) and buckets(spark, [], 50) == {}


def test_equal_hashes_are_told_apart_by_bytes():
    batch = pa.RecordBatch.from_pydict({
        "hash": [1, 1, 1, 1, 2], "sha": ["x", "y", "x", "y", "x"], "doc_id": [4, 3, None, 1, 0],
        "rows": [1, 2, 3, 4, 5], "norm": ["a", "b", "a", "b", "a"]})
    got = [tuple(r.values()) for b in exact._chains(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert got == [(1, "x", 0, 4, 4), (1, "y", 1, 1, 6), (2, "x", 0, 0, 5)]


def test_entries_are_flushed(monkeypatch):
    monkeypatch.setattr(exact, "HELD_BYTES", 1)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "hash": [7, 7], "sha": ["s", "s"], "norm": ["t", "t"]})
    rows = [r for b in exact._entries(iter([batch])) for r in b.to_pylist()]
    assert [r["kind"] for r in rows].count("entry") == 2


def test_query_matches_its_sql(spark):
    from tests.llm.sql import same_as_sql

    same_as_sql(spark, "op2_exact_duplicates")
