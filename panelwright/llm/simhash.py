"""Near duplicates by 64-bit SimHash fingerprints, linked through BK-trees.

Two fingerprints that differ in at most two bits agree in at least two of their four 16-bit blocks.
So every distinct fingerprint is put under the six pairs of its blocks, and only fingerprints of one
bucket (equal bits in both blocks) are compared, by a BK-tree of the bucket. Buckets of more than
``SHARD`` fingerprints are cut into shards: each shard's tree is sent to the blocks of queries of its
own bucket, one task per tree and block, so that neither a tree nor a block grows with the bucket.
A task reports a spanning forest of the links it finds, not each link; the components are the same.

Copies of a text have one fingerprint and are counted once from the first shuffle on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import documents, package_on_workers, stored
from panelwright.llm.graph import components

WORDS = 3  # words of a shingle
RADIUS = 2  # differing bits of a link
SHARD = 2048  # fingerprints of a tree, about
SEED = 42
_BITS = (1 << 64) - 1


def shingles(text: str, words: int = WORDS) -> list[bytes]:
    """Shingles of the words between white space, A-Z lower-cased; a shorter text is one shingle."""
    found = text.encode().lower().split()
    if not found:
        return []
    if len(found) < words:
        return [b" ".join(found)]
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give zero."""
    parts = shingles(text, words)
    if not parts:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 15):
        some = parts[at:at + (1 << 15)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in some), "<u8", len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(parts), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            prints = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                if text not in known:
                    known[text] = _signed(fingerprint(text, words))
                prints.append(known[text])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_xxh64")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(prints, pa.int64())], ["doc_id", "text_xxh64", "print"])

    return run


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        place = len(self.values)
        at = 0
        while place:
            distance = (value ^ self.values[at]).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = place
                break
            at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Values within the radius; only edges that can lead to one are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(self.values[at])
            children = self.children[at]
            if children:
                for edge in range(max(distance - radius, 0), distance + radius + 1):
                    below = children.get(edge)
                    if below is not None:
                        stack.append(below)
        return found


def _forest(tree: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a shard's values and a block of queries."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, links = BKTree(), []
    for value in tree:
        index.add(value)
    for value in queries:
        for other in index.within(value, radius):
            a, b = root(value), root(other)
            if a != b:
                parent[a] = b
                links.append((_signed(value), _signed(other)))
    return links


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, queries = None, [], []
        for batch in batches:
            names = batch.schema.names
            ready = []
            columns = (batch.column(names.index(c)).to_pylist() for c in ("pair", "bits", "shard", "block", "indexed", "asked", "print"))
            for pair, bits, shard, block, indexed, asked, value in zip(*columns):
                key = (pair, bits, shard, block)
                if key != at:
                    ready += _forest(tree, queries, radius)
                    at, tree, queries = key, [], []
                if indexed:
                    tree.append(value & _BITS)
                if asked:
                    queries.append(value & _BITS)
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ready)], ["a", "b"])
        ready = _forest(tree, queries, radius)
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ready)], ["a", "b"])

    return run


def block_masks(radius: int) -> list[int]:
    """For each choice of two blocks of ``radius + 2`` the mask of their bits, as signed 64-bit integers."""
    count = radius + 2
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) & _BITS for i in range(count)]
    return [_signed(a | b) for a, b in combinations(blocks, 2)]


def print_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all distinct values of bigint column ``print`` within the radius."""
    keyed = prints.select("print", F.posexplode(F.array(*[
        F.col("print").bitwiseAND(F.lit(mask)) for mask in block_masks(radius)])).alias("pair", "bits"))
    crowded = keyed.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = keyed.join(crowded, ["pair", "bits"]).withColumn(
        "shards", F.ceil(F.col("n") / F.lit(shard)).cast("int"))
    own = F.pmod(F.xxhash64("print"), F.col("shards")).cast("int")
    # The tree of shard i meets the blocks i, i+1, ... of queries, so each pair of shards meets once.
    placed = sized.withColumn("own", own).select(
        "pair", "bits", "print", F.explode(F.concat(
            F.transform(F.sequence(F.col("own"), F.col("shards") - 1), lambda b: F.struct(
                F.col("own").alias("shard"), b.alias("block"),
                F.lit(True).alias("indexed"), (b == F.col("own")).alias("asked"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("own")), lambda s: s < F.col("own")), lambda s: F.struct(
                s.alias("shard"), F.col("own").alias("block"),
                F.lit(False).alias("indexed"), F.lit(True).alias("asked"))),
        )).alias("place")).select("pair", "bits", "print", "place.*")
    key = ["pair", "bits", "shard", "block"]
    return placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """For every row of ``docs`` its fingerprint and the group of near duplicates it belongs to.

    Groups are connected components over links of at most ``radius`` differing bits. Columns:
    doc_id, fingerprint (16 hex digits), component_id (smallest id of the group), text_xxh64, kept.
    ``kept`` marks the row that stays of each group: the smallest id, then the smallest text hash;
    rows equal in both are all marked. A null text is empty; texts without a word share fingerprint
    zero. A null id is larger than any id. No rows give no rows. Other columns are not read.
    """
    package_on_workers(docs.sparkSession)
    hashed = documents(docs).select("doc_id", "text", F.xxhash64("text").alias("text_xxh64"))
    rows = stored(hashed.mapInArrow(_fingerprints(words), "doc_id bigint, text_xxh64 bigint, print bigint"), "simhash")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_xxh64")
    prints = rows.groupBy("print").agg(F.min(lead).alias("lead"))
    roots = components(print_links(rows.select("print").distinct(), radius, shard))
    classed = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "lead", F.coalesce("root", "print").alias("root"))
    leads = classed.groupBy("root").agg(F.min("lead").alias("lead"))
    of_print = classed.select("print", "root").join(leads, "root").select("print", "lead")
    return rows.join(of_print, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("lead.doc_id").alias("component_id"),
        "text_xxh64",
        (F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.text_xxh64") == F.col("text_xxh64"))).alias("kept"),
    )
