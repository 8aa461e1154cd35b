"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document is cut into full windows and a rest, the rest into pieces of at most ``piece`` tokens.
Pieces are dealt at random-like but fixed places to shards of about ``shard_windows`` windows; the
number of shards follows the number of tokens. Within a shard the two partial partitions with the
largest imbalance are merged again and again, the fullest window of one with the emptiest of the
other, which leaves windows of nearly equal size. When one exceeds the capacity, the shard takes
one window more and starts again.

Full windows need no packing: each is a sequence of its own, numbered by an expression. Only rests, less
than a window a document, go to shards, so a shard's pieces are a bounded group whatever the texts are:
they are dealt by row number, and rows of one id or one source are spread over all shards.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import documents, package_on_workers, stored, vocabulary_file
from panelwright.llm.word_tokens import VOCABULARY, word_tokens

WINDOW = 2048
PIECE = 512
SHARD_WINDOWS = 128
END_ID = 1
FULL_WINDOWS = 1 << 62  # sequences of one full window are numbered from here on, those of shards below

_PIECES = "row bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def piece_lengths(tokens: int, window: int = WINDOW, piece: int = PIECE) -> list[int]:
    """Full windows, then the rest in near-equal pieces of at most ``piece``."""
    full, rest = divmod(tokens, window)
    parts = -(-rest // piece)
    return [window] * full + [rest // parts + (i < rest % parts) for i in range(parts)]


def difference(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp over ``windows``: the places of ``sizes`` in each window.

    A window's content is a node: a place, or two nodes put together, noted in ``pairs``; -1 is empty.
    """
    heap = []
    for place, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = size, place
        heap.append((-size, place, sums, nodes))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(windows)]
    count = node = len(heap)
    pairs: list[tuple[int, int]] = []
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, others, more = heapq.heappop(heap)
        # Both are in falling order; opposite ends meet.
        merged, more = sums + others[::-1], more[::-1]
        joined = np.maximum(nodes, more)
        both = np.flatnonzero((nodes >= 0) & (more >= 0))
        if len(both):
            pairs += zip(nodes[both].tolist(), more[both].tolist())
            joined[both] = np.arange(node, node + len(both))
            node += len(both)
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        count += 1
        heapq.heappush(heap, (int(merged[-1] - merged[0]), count, merged - merged[-1], joined[order]))
    found = []
    for top in heap[0][3].tolist():
        places, stack = [], [top] if top >= 0 else []
        while stack:
            at = stack.pop()
            if at < len(sizes):
                places.append(at)
            else:
                stack += pairs[at - len(sizes)]
        found.append(places)
    return found


def windows_of(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing reaches when started from the least."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, count)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        count += 1


def _cut(window: int, piece: int, vocabulary: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(vocabulary_file(vocabulary)).ids
        end = int(END_ID).to_bytes(4, "little")
        for batch in batches:
            names, out = batch.schema.names, ([], [], [], [], [], [], [])
            columns = (batch.column(names.index(c)).to_pylist() for c in ("row", "doc_id", "text"))
            for row, doc_id, text in zip(*columns):
                ids = encode(text) + end
                start, tokens = 0, len(ids) // 4
                for length in piece_lengths(tokens, window, piece):
                    own = ids[4 * start:4 * (start + length)]
                    record = (row, doc_id, start, length, zlib.crc32(own), tokens, own)
                    for column, value in zip(out, record):
                        column.append(value)
                    start += length
            arrays = [pa.array(c, pa.int64()) for c in out[:6]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in out[6]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                arrays, ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def _assign(window: int) -> Callable:
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["row", "start"], ignore_index=True)
        lengths = shard["length"].to_numpy()
        own, offset = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
        for number, group in enumerate(windows_of(lengths.tolist(), window)):
            places = np.sort(np.array(group, np.int64))
            own[places] = number
            offset[places] = np.cumsum(lengths[places]) - lengths[places]
        shard["sequence_id"] = (shard["shard"].to_numpy(np.int64) << 32) + own
        shard["offset"] = offset
        return shard.drop(columns=["shard", "row"])

    return run


def pack(
    docs: DataFrame, window: int = WINDOW, piece: int = PIECE, shard_windows: int = SHARD_WINDOWS,
    vocabulary: str = VOCABULARY, ids: bool = False,
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``window`` tokens.

    A document is the ids of its text and the end id 1; each id lies in one piece. Columns: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``ids``, the ids themselves.
    A null or empty text is the end id alone. Rows with a repeated or null id are documents of their
    own. No rows give no pieces. Other columns are not read.
    """
    package_on_workers(docs.sparkSession)
    numbered = documents(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = _PIECES + ", ids array<int>" * ids
    pieces = stored(numbered.mapInArrow(_cut(window, piece, vocabulary, ids), schema), "pieces")
    rests, full = pieces.filter(F.col("length") < window), pieces.filter(F.col("length") == window)
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / (shard_windows * window)))
    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    out = schema.removeprefix("row bigint, ").replace(", ids array", ", sequence_id bigint, offset bigint, ids array")
    if not ids:
        out += ", sequence_id bigint, offset bigint"
    columns = [c.split()[0] for c in out.split(", ")]
    assign = _assign(window)
    packed = dealt.groupBy("shard").applyInPandas(lambda shard: assign(shard)[columns], out)
    alone = full.withColumns({
        "sequence_id": F.monotonically_increasing_id() + F.lit(FULL_WINDOWS), "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(alone.select(*columns))
