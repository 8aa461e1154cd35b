"""Token ids as Parquet files in ascending order of doc_id, for selective reads.

A row is a document: doc_id, ``at`` (ids before it in its file part), n_tokens and the list of ids.
Ids are dictionary encoded, two bytes or fewer each; the ascending columns are delta encoded. Row
groups are ``ROW_GROUP`` bytes and pages ``PAGE_ROWS`` rows at most, and every page has its least and
largest doc_id in the file's page index, so a range of documents reads few pages and a query without
ids reads none of them.

A part is a range of doc_id that one task sorts, encodes and writes, through Spark's own commit, so
a task lost half-way leaves nothing behind. The ids before a part are known only when all are
written; a small table of parts next to the ids holds them, and ``start`` is made from both at
reading. Nothing is written twice.

Rows of one id are spread by the hash of their text and their place in the input, so an id that holds
a third of all rows is many parts. A task holds one batch of texts and the ids of one text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.llm.common import documents, package_on_workers, scratch_path, vocabulary_file
from panelwright.llm.word_tokens import VOCABULARY, word_tokens

END_ID = 1
ROW_GROUP = 16 << 20  # bytes
PAGE_ROWS = 256
PART_BYTES = 32 << 20  # characters of text a part holds, more or less
BATCH_IDS = 2_000_000  # ids a task collects before it hands them to the writer
SEGMENT = 1024  # parts whose running totals one task works out

_ROWS = "part int, doc_id bigint, at bigint, n_tokens bigint, ids array<int>"


def _encode(vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(vocabulary_file(vocabulary)).ids
        end, part, at = int(END_ID).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        doc_ids, starts, lengths, found, held = [], [], [], [], 0

        def ready():
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), part, np.int32)), pa.array(doc_ids, pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), ids],
                ["part", "doc_id", "at", "n_tokens", "ids"])

        for batch in batches:
            names = batch.schema.names
            columns = (batch.column(names.index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc_id, text in zip(*columns):
                ids = encode(text) + end
                doc_ids.append(doc_id)
                starts.append(at)
                lengths.append(len(ids) // 4)
                found.append(ids)
                at += lengths[-1]
                held += lengths[-1]
                if held >= BATCH_IDS:
                    yield ready()
                    doc_ids, starts, lengths, found, held = [], [], [], [], 0
        if found:
            yield ready()

    return run


def write(
    docs: DataFrame, path: str, parts: int | None = None, vocabulary: str = VOCABULARY,
    row_group: int = ROW_GROUP, page_rows: int = PAGE_ROWS, part_bytes: int = PART_BYTES,
) -> None:
    """Encode every whole text, append the end id, and write ``path``/ids and ``path``/parts.

    Documents come in ascending doc_id, null ids first, rows of one id by the hash of their text. A
    null or empty text is the end id alone. Repeated rows are documents of their own. No rows give
    files without rows. Other columns are not read. Parts follow the amount of text: about
    ``part_bytes`` characters each unless their number is given.
    """
    spark = docs.sparkSession
    package_on_workers(spark)
    rows = documents(docs)
    if parts is None:
        parts = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // part_bytes + 1
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    key = ["doc_id", "text_hash", "place"]
    ranges = keyed.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("doc_id", "text")
    writer = ranges.mapInArrow(_encode(vocabulary), _ROWS).write
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # delta encoding where there is no dictionary
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.enable.dictionary#part": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group),
        "parquet.block.size.row.check.min": "10",  # rows between looks at the size; long texts fill a group soon
        "parquet.page.row.count.limit": str(page_rows),
    }
    writer.options(**options).parquet(f"{path}/ids")
    ends = spark.read.schema(_ROWS).parquet(f"{path}/ids").groupBy("part").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    _with_starts(ends).write.parquet(f"{path}/parts")


def _with_starts(ends: DataFrame) -> DataFrame:
    """Ids before each part: running totals within segments of parts, after the totals of segments."""
    segment = ends.withColumn("segment", F.floor(F.col("part") / SEGMENT))
    totals = segment.groupBy("segment").agg(F.sum("tokens").alias("whole"))
    # One row per SEGMENT parts; the pairs below are a join on a bounded span of segment numbers.
    before = totals.select("segment", (F.sum("whole").over(Window.partitionBy(F.lit(0)).orderBy("segment")) - F.col("whole")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("segment").orderBy("part")) - F.col("tokens")
    return segment.withColumn("inside", inside).join(before, "segment").select(
        "part", (F.col("before") + F.col("inside")).alias("part_start"), "tokens", "docs", "first_id", "last_id")


def read(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files.

    Column pruning leaves out the ids where they are not asked for; a range of ids reads the row
    groups and pages whose index admits it.
    """
    rows = spark.read.schema(_ROWS).parquet(f"{path}/ids")
    if first_id is not None:
        rows = rows.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.filter(F.col("doc_id") <= last_id)
    parts = spark.read.schema("part int, part_start bigint").parquet(f"{path}/parts")
    return rows.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        lists = batch.column(names.index("ids"))
        ids = lists.flatten().to_numpy().astype("<u4", copy=False)
        ends = np.cumsum(lists.value_lengths().to_numpy()) if len(lists) else np.zeros(0, np.int64)
        begins = np.concatenate(([0], ends))[:-1]
        sums = [zlib.crc32(ids[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("part")), batch.column(names.index("doc_id")), batch.column(names.index("at")),
             pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())],
            ["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, parts: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32.

    All four come from the files: n_tokens is the length of the list read, ids_crc32 the CRC of its
    ids as little-endian unsigned 32-bit integers. Nulls, repeated rows and empty tables as in ``write``.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write(docs, path, parts=parts, vocabulary=vocabulary)
    rows = spark.read.schema(_ROWS).parquet(f"{path}/ids").select("part", "doc_id", "at", "ids")
    digests = rows.mapInArrow(_digests, "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    starts = spark.read.schema("part int, part_start bigint").parquet(f"{path}/parts")
    return digests.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
