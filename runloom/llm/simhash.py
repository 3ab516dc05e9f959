"""SimHash fingerprints and their groups, found with BK-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import Rows, durable, utf8
from runloom.llm.components import components

BITS = 64
ALL_BITS = (1 << BITS) - 1
# Fingerprints in one tree.
TREE_SIZE = 2048
# Hashes handled at a time.
CHUNK = 1 << 19

PRINTS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def majority_bits(hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """For consecutive runs of hashes, the 64 bits that are set in over half of each run.

    Eight counters share one integer; a block of at most 255 hashes cannot overflow them.
    """
    out = np.zeros(len(lengths), np.uint64)
    runs = [(k, n) for k, n in enumerate(lengths) if n]
    if not runs:
        return out
    sizes = np.array([n for _, n in runs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blocks = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    inside = np.arange(blocks.sum()) - np.repeat(first, blocks)
    cuts = np.repeat(starts, blocks) + 255 * inside
    counts = np.empty((len(runs), 8, 8), np.int64)
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lane, cuts)
        by_byte = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:, :, bit] = np.add.reduceat(by_byte.astype(np.int64), first, axis=0)
    set_bits = 2 * counts > sizes[:, None, None]
    out[[k for k, _ in runs]] = (
        np.packbits(set_bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    )
    return out


def _shingles(text: bytes, words: int) -> list[bytes]:
    found = text.lower().split()  # both work on ASCII only, as is wanted
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(words)))))


def _fingerprints(words: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from functools import partial

        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=seed)
        for batch in batches:
            ids, versions, hashes, lengths, pending = [], [], [], [], 0

            def give():
                joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
                prints = majority_bits(joined, lengths).view(np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(prints)],
                    schema=PRINTS,
                )

            known = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for (doc_id, version), text in zip(known, utf8(batch.column(2))):
                grams = _shingles(text, words)
                ids.append(doc_id)
                versions.append(version)
                lengths.append(len(grams))
                hashes.append(np.fromiter(map(digest, grams), np.uint64, len(grams)))
                pending += len(grams)
                if pending >= CHUNK:
                    yield give()
                    ids, versions, hashes, lengths, pending = [], [], [], [], 0
            if ids:
                yield give()

    return run


def fingerprints(
    docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, version, fp): the 64-bit SimHash of each whole text, as a signed long.

    Words are runs of non-space ASCII-wise, A-Z in lower case; repeated shingles count again; a
    text of fewer words is one shingle; a null text or one without words gives zero. ``version``,
    a hash of the text, tells rows that repeat an id apart.
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("version"),
        F.col(text).cast("string").alias("text"),
    )
    return slim.mapInArrow(_fingerprints(words, seed), "doc_id long, version long, fp long")


# --- trees ------------------------------------------------------------------


class BKTree:
    """Children are keyed by their integer distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Nodes at most ``radius`` away: only edges within the radius are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                yield at
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [kid for key, kid in kids.items() if abs(key - distance) <= radius]
            else:
                reach = range(distance - radius, distance + radius + 1)
                todo += [kids[key] for key in reach if key in kids]


def _tree_links(radius: int) -> Callable:
    """One tree per shard; gives a link from each linked fingerprint to the least of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(LINKS)
        for batch in batches:
            for members in batch.column(0).to_pylist():
                members.sort()
                tree, group = BKTree(), list(range(len(members)))

                def top(k: int) -> int:
                    while group[k] != k:
                        group[k] = group[group[k]]
                        k = group[k]
                    return k

                for k, member in enumerate(members):
                    value = member & ALL_BITS
                    for other in tree.within(value, radius):
                        one, two = sorted((top(k), top(other)))
                        group[two] = one
                    tree.add(value)
                for k, member in enumerate(members):
                    if top(k) != k:
                        yield from rows.add((members[top(k)], member))
        yield from rows.flush()

    return run


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def split_mask(mask: int, parts: int) -> list[int]:
    """``mask`` together with each of ``parts`` runs of the bits it leaves free."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _finer(shards: DataFrame, masks: list[int], parts: int) -> tuple[DataFrame, list[int]]:
    """Each row once per finer mask of its own; its shard is the bits under the mask."""
    finer = {mask: split_mask(mask, parts) for mask in masks}
    choice: Column = F.lit(None).cast("array<long>")
    for mask, found in finer.items():
        literal = F.array(*(F.lit(_signed(m)).cast("long") for m in found))
        choice = F.when(F.col("mask") == F.lit(_signed(mask)).cast("long"), literal).otherwise(choice)
    rows = shards.select("fp", F.explode(choice).alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return rows, sorted({m for found in finer.values() for m in found})


def links(prints: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a < b) that connect all distinct fingerprints at most ``radius`` bits apart.

    Two such fingerprints agree on the whole of at least one of ``radius`` + 1 runs of bits, so
    each run's value names a shard, and both lie in one shard together. A shard of more than
    ``tree_size`` fingerprints is divided anew by the bits it does not share yet; as those run
    out, every shard ends below the limit, and no pair is lost. Every shard gets a BK-tree, and
    its members are its queries, so a tree is sent to the one task that can use it.
    """
    start = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    shards, masks = _finer(start, [0], radius + 1)
    found = None
    while True:
        sizes = shards.groupBy("mask", "key").agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > tree_size).select("mask", "key")
        more = None
        if not large.isEmpty():
            large = durable(large)
            more = durable(shards.join(large, ["mask", "key"], "left_semi"))
            shards = shards.join(large, ["mask", "key"], "left_anti")
        trees = (
            shards.groupBy("mask", "key")
            .agg(F.collect_list("fp").alias("members"))
            .where(F.size("members") > 1)
            .select("members")
        )
        part = trees.mapInArrow(_tree_links(radius), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if more is None:
            return found
        shards, masks = _finer(more, masks, radius + 1)


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    radius: int = 2,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, version, fp, root, component_id) of every row; rows of one ``root`` are one group.

    ``component_id`` is the smallest doc_id that can be reached over links of at most
    ``radius`` differing bits, the row's own included. Equal fingerprints are one node, so a
    group of copies of any size shrinks to one row per task before it moves. Null ids take
    part in linking but are never the smallest; a component of null ids only has a null id.
    An empty table gives no rows. Other columns are not read.
    """
    prints = durable(fingerprints(docs, words, seed, doc_id, text))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    members = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "version", "fp", "root", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
