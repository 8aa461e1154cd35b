"""Exact duplicates by an extendible-hash index on shared files.

Every task first drops the copies it meets itself: one entry per text, with the smallest id and the
number of rows. The entries and one short row per document are written to shared files. The
directory is grown over the entries' hashes: it begins with as many bits as the bytes ask for, and while
a bucket of more than one hash holds too many bytes it doubles and splits the overfull buckets by the
next bit. Every entry finds its bucket, which is a range of hashes, in the directory and goes to the
bucket's owner; the owner walks its buckets in hash order, chains entries of equal hash and compares bytes.

Bounds: the directory notes the split buckets alone, of which there are at most as many as full buckets,
``MOST_BUCKETS`` or so; an owner holds one chain, which is the different texts of one 64-bit hash; a task's first
pass holds at most ``HELD_BYTES`` of text. A text with any number of copies arrives at its owner as
one entry per flush of a first-pass task, not as one per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import SPACE, documents, package_on_workers, scratch_path, stored

BUCKET_BYTES = 4 << 20  # a bucket is split above this many bytes of text
MOST_BUCKETS = 1 << 16  # buckets are larger when there is more text than this many of them hold
HELD_BYTES = 32 << 20  # text a first-pass task keeps before it writes its entries

_ROWS = "kind string, hash bigint, sha string, doc_id bigint, rows bigint, bytes bigint, norm string"
_ARROW = pa.schema([("kind", pa.string()), ("hash", pa.int64()), ("sha", pa.string()), ("doc_id", pa.int64()),
                    ("rows", pa.int64()), ("bytes", pa.int64()), ("norm", pa.string())])
_GROUPS = "hash bigint, sha string, chain int, keep_id bigint, group_size bigint"
_GROUPS_ARROW = pa.schema([("hash", pa.int64()), ("sha", pa.string()), ("chain", pa.int32()),
                           ("keep_id", pa.int64()), ("group_size", pa.int64())])


def least(a: int | None, b: int | None) -> int | None:
    """The smaller id; a null id is larger than any."""
    return b if a is None else a if b is None else min(a, b)


def normalised(text: str = "text"):
    """Each run of white space as one blank."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, and per different text of this task one entry."""
    held: dict[tuple[int, str], list] = {}
    size = 0

    def flush():
        rows = [("entry", h, v[2], v[0], v[1], len(t.encode()), t) for (h, t), v in held.items()]
        columns = list(zip(*rows)) or [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    for batch in batches:
        n = batch.num_rows
        names = batch.schema.names
        ids, hashes, shas, texts = (batch.column(names.index(c)) for c in ("doc_id", "hash", "sha", "norm"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(["doc"] * n, pa.string()), hashes, shas, ids, pa.array([1] * n, pa.int64()),
             pa.array([0] * n, pa.int64()), pa.nulls(n, pa.string())], schema=_ARROW)
        for doc_id, h, sha, text in zip(ids.to_pylist(), hashes.to_pylist(), shas.to_pylist(), texts.to_pylist()):
            known = held.get((h, text))
            if known is None:
                held[h, text] = [doc_id, 1, sha]
                size += len(text) * 2 + 200
            else:
                known[0] = least(known[0], doc_id)
                known[1] += 1
            if size > HELD_BYTES:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def prefix(depth: int):
    """The first ``depth`` bits of column hash."""
    return F.shiftrightunsigned(F.shiftrightunsigned("hash", 1), 63 - depth)


def directory(sizes: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, list[DataFrame]]:
    """Grow the directory over (hash, bytes): its first depth, and the buckets split at each depth from there.

    A bucket is the first bits of a hash. It is split while its texts exceed ``bucket_bytes``, or what
    keeps their number near ``MOST_BUCKETS``, and it holds more than one hash.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    most = max(bucket_bytes, total // MOST_BUCKETS)
    first = depth = (total // most).bit_length()
    splits: list[DataFrame] = []
    while depth < 64:
        found = sizes.groupBy(prefix(depth).alias("bucket")).agg(
            F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        overfull = stored(found.filter((F.col("bytes") > most) & (F.col("low") != F.col("high"))).select("bucket"), "exact-directory")
        if not overfull.limit(1).count():
            break
        splits.append(overfull)
        sizes = sizes.join(F.broadcast(overfull), prefix(depth) == overfull["bucket"], "left_semi")
        depth += 1
    return first, splits


def with_bucket(entries: DataFrame, first: int, splits: list[DataFrame]) -> DataFrame:
    """Add ``depth``, the bits of an entry's bucket, and ``owner``, the least hash of the bucket's range."""
    placed = entries.withColumn("depth", F.lit(first))
    for depth, overfull in enumerate(splits, first):
        split = F.broadcast(overfull.select("bucket", F.lit(True).alias("split")))
        placed = placed.join(split, prefix(depth) == F.col("bucket"), "left").withColumn(
            "depth", F.when(F.col("split"), F.lit(depth + 1)).otherwise(F.col("depth"))).drop("bucket", "split")
    rest = F.expr("shiftrightunsigned(shiftrightunsigned(-1L, 1), depth - 1)")
    cleared = F.col("hash").bitwiseAND(F.bitwise_not(rest))
    return placed.withColumn("owner", F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(cleared))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal bytes; entries come in order of their hash within an owner."""
    at, chain, ready = None, [], []

    def close():
        ready.extend((at, sha, place, keep, rows) for place, (_, sha, keep, rows) in enumerate(chain))

    def emit():
        columns = list(zip(*ready)) or [()] * len(_GROUPS_ARROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _GROUPS_ARROW)], schema=_GROUPS_ARROW)

    for batch in batches:
        names = batch.schema.names
        columns = (batch.column(names.index(c)).to_pylist() for c in ("hash", "sha", "doc_id", "rows", "norm"))
        for h, sha, doc_id, rows, text in zip(*columns):
            if h != at:
                close()
                at, chain = h, []
            for link in chain:
                if link[0] == text:
                    link[2] = least(link[2], doc_id)
                    link[3] += rows
                    break
            else:
                chain.append([text, sha, doc_id, rows])
        if ready:
            yield emit()
            ready = []
    if at is not None:
        close()
    if ready:
        yield emit()


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(one short row per document, one row per different text), both keyed by hash and sha."""
    spark = docs.sparkSession
    package_on_workers(spark)
    norm = documents(docs).select("doc_id", normalised().alias("norm"))
    hashed = norm.select("doc_id", "norm", F.xxhash64("norm").alias("hash"),
                         F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    path = scratch_path(spark, "exact-index")
    hashed.mapInArrow(_entries, _ROWS).write.partitionBy("kind").parquet(path)
    index = spark.read.schema(_ROWS).parquet(path)
    entries = index.filter("kind = 'entry'")
    placed = with_bucket(entries.select("hash", "sha", "doc_id", "rows", "norm"), *directory(
        entries.select("hash", "bytes"), bucket_bytes))
    # A bucket goes to one owner whole; an owner has many buckets and takes them one after the other.
    owned = placed.repartition("owner").sortWithinPartitions("owner", "hash")
    groups = owned.select("hash", "sha", "doc_id", "rows", "norm").mapInArrow(_chains, _GROUPS)
    return index.filter("kind = 'doc'").select("doc_id", "hash", "sha"), groups


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For every row of ``docs`` the row that stays of its equal texts.

    Texts are equal when identical after each run of white space became one blank. Columns: doc_id,
    keep_id (smallest id of the group; null if all ids are null), group_size, kept, text_sha256.
    A null text is empty. A repeated id keeps its rows: each counts in group_size, and each row
    with the smallest id is kept. No rows give no rows. Other columns are not read.
    """
    rows, groups = exact_groups(docs, bucket_bytes)
    joined = rows.join(groups, ["hash", "sha"])
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
