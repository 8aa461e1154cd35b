import re

import pytest

import corpus_pipeline as pipeline
from panelwright.llm.common import stored
from tests.llm.test_exact import plain as plain_exact
from tests.llm.test_pii import plain as plain_pii
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string"


def through(spark, rows):
    """Each stage on what its predecessor kept, as (id, text) lists."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k") for i, t in rows], SCHEMA)
    kept = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, None)
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
            docs = stored(docs, name)
            kept.append([(r.doc_id, r.text) for r in docs.collect()])
    return kept, docs.collect()


def test_stages(spark):
    long_text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, "mail a@b.de now please"), (5, "mail a@b.de now please"), (3, "mail  a@b.de now\tplease"), (9, long_text),
            (2, long_text + " end"), (7, None), (8, ""), (10, "12 34 !!"), (None, "no id at all"), (11, "other text é"),
            (5, "another text of the same id")]
    (language, exact, near, masked), windows = through(spark, rows)
    order = lambda pairs: sorted(pairs, key=str)
    assert order(language) == order(r for r in rows if r[0] not in (7, 8, 10))
    assert order(exact) == order([rows[2], rows[3], rows[4], rows[8], rows[9], rows[10]])
    assert order(near) == order([rows[2], rows[4], rows[8], rows[9], rows[10]])
    assert order(masked) == order([(3, "mail  [EMAIL] now\tplease"), rows[4], rows[8], rows[9], rows[10]])
    assert {r.doc_id for r in windows} == {i for i, _ in masked}
    empty, nothing = through(spark, [])
    assert empty == [[], [], [], []] and nothing == []


@pytest.fixture(scope="module")
def whole(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return rows, pipeline.run(spark, sf).collect()


def test_run_matches_brute_force(whole):
    rows, windows = whole
    kept = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    stays = {r[0] for r in plain_exact(kept) if r[3]}
    kept = [(i, t) for i, t in kept if i in stays]
    group = plain_components([(i, plain_fingerprint(t)) for i, t in kept])
    kept = {i: t for i, t in kept if group[i] == i}
    assert {r.doc_id for r in windows} == set(kept)
    tokens, sizes = {}, {}
    for r in windows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
        assert r.doc_tokens >= r.start + r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in windows) and max(sizes.values()) <= 2048
    assert any(plain_pii(t)[1] for t in kept.values())
