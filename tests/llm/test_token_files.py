import zlib
from array import array

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import token_files
from panelwright.llm.common import scratch_path
from panelwright.llm.queries import QUERIES, table

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


def plain(rows):
    """(doc_id, start, n_tokens, crc) of (id, text) rows, as the library has them."""
    def first(i):
        return (i is not None, i or 0)

    at, found = 0, []
    ids = {t: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    for i, t in sorted(rows, key=lambda r: first(r[0])):
        found.append((i, at, len(ids[t]), zlib.crc32(array("I", ids[t]).tobytes())))
        at += len(ids[t])
    return found


def test_query(spark):
    small = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = QUERIES["op13_token_files"](spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == plain(rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_rows(docs_of, parts):
    rows = [(9, "a few words here"), (3, None), (4, ""), (2 ** 40, "é über 梦 words"), (-5, "x" * 100_000 + " y" * 50_000),
            (None, "no id"), (9, "a few words here"), (9, "other words of that id")]
    got = sorted(map(tuple, token_files.token_digests(docs_of(rows), parts=parts).collect()), key=lambda r: r[1])
    # Rows of one id lie in an order of their own; everything else is fixed.
    want = plain(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    assert [r[1] for r in got] == [sum(q[2] for q in got[:k]) for k in range(len(got))]
    assert token_files.token_digests(docs_of([])).collect() == []


def test_one_id_on_most_rows(docs_of, spark):
    docs = docs_of([(7, "the same row")] * 300 + [(8, "one after")])
    path = scratch_path(spark, "token-files")
    token_files.write(docs, path, parts=6)
    parts = spark.read.parquet(f"{path}/parts").orderBy("part").collect()
    assert len(parts) > 3 and max(p.docs for p in parts) < 150
    assert token_files.read(spark, path).agg(F.max("start")).first()[0] == 300 * 4


def test_segments(spark):
    ends = spark.createDataFrame([(p, 2 * p + 1, 1, p, p) for p in range(3000)],
                                 "part int, tokens bigint, docs bigint, first_id bigint, last_id bigint")
    got = {r.part: r.part_start for r in token_files._with_starts(ends).collect()}
    assert got == {p: p * p for p in range(3000)}


@pytest.fixture(scope="module")
def files(spark):
    path = scratch_path(spark, "token-files")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    token_files.write(docs, path, parts=2, row_group=200_000, page_rows=32)
    return path


def test_layout(files, spark):
    names = [f.split("file:")[-1] for f in spark.read.parquet(f"{files}/ids").inputFiles()]
    groups = 0
    for name in names:
        described = pq.ParquetFile(name).metadata
        groups += described.num_row_groups
        for g in range(described.num_row_groups):
            columns = {c.path_in_schema: c for c in map(described.row_group(g).column, range(described.num_columns))}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert groups > 2


def test_selective_reads(files, spark):
    plan = token_files.read(spark, files).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema: ")[1].split(">")[0]
    some = token_files.read(spark, files, 100, 109)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "LessThanOrEqual(doc_id,109)" in plan
    rows = some.orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert [r.doc_id for r in rows] == list(range(100, 110))
    assert all(r.ids == [*LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1] for r in rows)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
