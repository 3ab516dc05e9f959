"""Exact top-k inner products, pruned by multi-resolution segment statistics."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, Row, Window
from pyspark.sql import functions as F

from runloom.llm.common import durable, partitions

SCALE = 256
# Segments at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
# Numbers in a block of candidates and of queries.
CANDIDATE_NUMBERS = 1 << 17
QUERY_NUMBERS = 1 << 14
# Numbers, with what a vector has besides, of the rows and of the queries that meet in a group, on average.
GROUP_NUMBERS = 1 << 24
GROUP_QUERY_NUMBERS = 1 << 23
# Multiplications that are worth a group, and bytes that may travel for the sake of more groups.
GROUP_WORK = 1 << 29
GROUP_BYTES = 256 << 20
# A block's pairs are taken one by one where at most one in so many is left.
FEW = 64
LONG = np.iinfo(np.int64)

# Whole numbers, by the bytes that each takes.
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}
BLOCKS = pa.schema(
    [("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("size", pa.int64())]
    + [(name, pa.binary()) for name in ("ids", "nulls", "values")]
)
BLOCKS_DDL = "dim int, block long, n int, size long, ids binary, nulls binary, values binary"
FOUND = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)
FOUND_DDL = "block long, place int, query_id long, vec_id long, score long"


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them all."""
    least, most = values.min(initial=0), values.max(initial=0)
    for kind in list(KINDS.values())[:-1]:
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def _blocks(numbers: int) -> Callable:
    """Vectors of one dimension as blocks of whole-number matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[int, list[tuple]] = {}

        def give(dim: int, rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            width = -(-numbers // max(dim, 1))
            if not rest and sum(len(part[0]) for part in open_[dim]) < width:
                return
            ids, nulls, values = (np.concatenate(parts) for parts in zip(*open_.pop(dim)))
            for a in range(0, len(ids), width):
                b = a + width
                if b > len(ids) and not rest:
                    open_[dim] = [(ids[a:], nulls[a:], values[a:])]
                    return
                cells = [x.tobytes() for x in (ids[a:b], nulls[a:b], _narrow(values[a:b]))]
                row = [[dim], [base + made], [len(ids[a:b])], [sum(map(len, cells))], *([x] for x in cells)]
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(row, BLOCKS)], schema=BLOCKS
                )

        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
            values = np.floor(SCALE * batch.column(1).flatten().to_numpy())
            starts = np.cumsum(lengths) - lengths
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(at):
                    dim = int(lengths[at[0]])
                    vectors = values[starts[at][:, None] + np.arange(dim)]
                    open_.setdefault(dim, []).append((ids[at], nulls[at], vectors))
                    yield from give(dim, False)
        for dim in list(open_):
            yield from give(dim, True)

    return run


def segment_statistics(values: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, each times the root of the segment's length.

    The squared distance of two rows of statistics is a lower bound of that of the rows.
    """
    dim = values.shape[1]
    cuts = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))
    parts = [values[:, a:b] for a, b in zip(cuts, cuts[1:])]
    columns = [p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    columns += [p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack(columns, axis=1) if columns else np.zeros((len(values), 0))


def _products(q: np.ndarray, c: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Whole-number inner products of one vector with rows, held at the limits of a long."""
    if exact_floats:
        return (c @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = [sum(a * int(b) for a, b in zip(whole, row)) for row in c]
    return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)


class Side:
    """Vectors of one side in floats of ``kind``, with their lengths and, at each resolution, statistics.

    The statistics' product with those of the other side bounds the inner products from above: half of
    what the lower bound of the squared distance leaves of both sides' squares stands in their last columns.
    """

    def __init__(self, values: np.ndarray, asks: bool, kind: type = np.float64):
        wide = values.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (wide * wide).sum(axis=1)
            self.lengths = np.sqrt(squares)
            self.values = wide.astype(kind, copy=False)
            self.spread = []
            for segments in RESOLUTIONS:
                found = segment_statistics(wide, segments)
                # With a margin for rounding, in the products, too.
                left = squares * (1 + (2e-9 if kind is np.float64 else 2e-5)) - (found * found).sum(axis=1) + 1e-6
                ends = [left / 2, np.ones(len(left))]
                self.spread.append(np.column_stack([found, *(ends if asks else ends[::-1])]).astype(kind))


def _best(
    k: int, rows: np.ndarray, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates are among the k best of their row, row by row in their order, and their ranks from 0."""
    # The complement orders from large to small without leaving the range of a long.
    order = np.lexsort((ids, nulls, ~scores, rows))
    sorted_ = rows[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][: len(order)])
    ranks = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[ranks < k], ranks[ranks < k]


def _pair_scores(q: Side, c: Side, rows: np.ndarray, places: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Scores of pairs in order of their rows."""
    if exact_floats:
        return np.einsum("ij,ij->i", q.values[rows], c.values[places]).astype(np.int64)
    scores = np.zeros(len(rows), np.int64)
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
        if len(part):
            row = rows[part[0]]
            small = q.lengths[row] * c.lengths[places[part]] < 2.0**52
            for some, exact in ((part[small], True), (part[~small], False)):
                scores[some] = _products(q.values[row], c.values[places[some]], exact)
    return scores


def _left_pairs(left: np.ndarray, q_at: np.ndarray, c_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = np.flatnonzero(left.any(axis=0))
    rows, places = np.nonzero(left[:, some])
    return q_at[rows], c_at[some[places]]


def _nearest(
    q_ids: np.ndarray, q: Side, c_ids: np.ndarray, c_null: np.ndarray, c: Side, k: int, best: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, of candidates, and scores, as ``best_in_block`` gives them."""
    # Floats hold whole numbers up to 2^24 or 2^53, and no partial sum is beyond the product of
    # the lengths, so well below there no sum is rounded.
    kind = q.values.dtype.type
    with np.errstate(over="ignore", invalid="ignore"):
        exact_floats = kind is np.float32 or q.lengths.max(initial=0) * c.lengths.max(initial=0) < 2.0**52
        (coarse_q, *finer_q), (coarse_c, *finer_c) = q.spread, c.spread
        bounds = coarse_q @ coarse_c.T
    # Where scores stay, lower bounds are ties.
    limit = np.where(best[:, -1] <= LONG.min, -np.inf, best[:, -1])
    fresh = np.flatnonzero(best[:, -1] == -np.inf)
    if len(fresh) and len(c_ids) >= k:
        # The k most promising candidates of the block set a score to beat.
        hopes = np.where(np.isnan(bounds[fresh]), np.inf, bounds[fresh])
        hopes[(q_ids[fresh][:, None] == c_ids[None, :]) & ~c_null[None, :]] = -np.inf
        seeds = np.argpartition(-hopes, k - 1, axis=1)[:, :k]
        whole = np.take_along_axis(hopes, seeds, axis=1).min(axis=1) > -np.inf
        asked = np.repeat(fresh[whole], k)
        scores = _pair_scores(q, c, asked, seeds[whole].ravel(), exact_floats).reshape(-1, k)
        limit[fresh[whole]] = [x if x > LONG.min else -np.inf for x in scores.min(axis=1)]
    beaten = limit.astype(kind)[:, None]
    left = ~(bounds < beaten)  # a bound that is not a number rules nothing out
    del bounds
    # The pairs left by one resolution are taken on by the next: as the queries and candidates that
    # any pair is left of, in one product, or one by one where few pairs are left.
    q_at, c_at = np.arange(len(q_ids)), np.arange(len(c_ids))
    pairs = None
    for step in range(len(finer_q) + 1):
        if pairs is None:
            some_q, some_c = left.any(axis=1), left.any(axis=0)
            if np.count_nonzero(some_q) * np.count_nonzero(some_c) < 0.75 * left.size:  # else the copy costs more
                left, q_at, c_at = left[some_q][:, some_c], q_at[some_q], c_at[some_c]
            if np.count_nonzero(left) * FEW <= left.size or (step == len(finer_q) and not exact_floats):
                pairs = _left_pairs(left, q_at, c_at)
        if step == len(finer_q):
            break
        sq, sc = finer_q[step], finer_c[step]
        with np.errstate(over="ignore", invalid="ignore"):
            if pairs is None:
                left &= ~(sq[q_at] @ sc[c_at].T < beaten[q_at])
            else:
                near = ~(np.einsum("ij,ij->i", sq[pairs[0]], sc[pairs[1]]) < beaten[pairs[0], 0])
                pairs = pairs[0][near], pairs[1][near]
    if pairs is None:
        scores = q.values[q_at] @ c.values[c_at].T
        if len(fresh) and len(c_at) > k:
            part = np.flatnonzero(np.isin(q_at, fresh))
            own = (q_ids[q_at[part]][:, None] == c_ids[c_at][None, :]) & ~c_null[c_at][None, :]
            ranked = np.where(left[part] & ~own, scores[part], -np.inf)
            kth = np.partition(ranked, len(c_at) - k, axis=1)[:, len(c_at) - k]
            limit[q_at[part]] = np.maximum(limit[q_at[part]], kth)
        left &= scores >= limit.astype(kind)[q_at][:, None]
        rows, places = _left_pairs(left, *map(np.arange, left.shape))
        rows, places, scores = q_at[rows], c_at[places], scores[rows, places].astype(np.int64)
    else:
        rows, places = pairs
        scores = _pair_scores(q, c, rows, places, exact_floats)
    near = (scores >= limit[rows]) & ((q_ids[rows] != c_ids[places]) | c_null[places])
    rows, places, scores = rows[near], places[near], scores[near]
    ranked, ranks = _best(k, rows, scores, c_null[places], c_ids[places])
    rows, places, scores = rows[ranked], places[ranked], scores[ranked]
    if len(rows):
        changed, at = np.unique(rows, return_inverse=True)
        both = np.full((len(changed), 2 * k), -np.inf)
        both[:, :k] = best[changed]
        both[at, k + ranks] = scores
        best[changed] = -np.sort(-both)[:, :k]
    return rows, places, scores


def best_in_block(
    q_ids: np.ndarray,
    q: np.ndarray,
    c_ids: np.ndarray,
    c_null: np.ndarray,
    c: np.ndarray,
    k: int,
    best: np.ndarray | None = None,
) -> Iterator[tuple[int, int, int]]:
    """(place of the query, place of the candidate, score): each query's k best in one block.

    ``best`` are the k highest scores that each query has met so far, in falling order; a candidate
    below the last of them is left out. They are brought up to date in place.
    """
    if best is None:
        best = np.full((len(q), k), -np.inf)
    found = _nearest(q_ids, Side(q, True), c_ids, c_null, Side(c, False), k, best)
    yield from zip(*(x.tolist() for x in found))


class Scores:
    """The best scores so far of the queries of a group, block by block.

    At most ``most`` queries' are kept; the blocks used longest ago start anew, which only costs time.
    """

    def __init__(self, k: int, most: int = 1 << 18):
        self.k, self.most, self.held = k, most, 0
        self.blocks: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(self, block: int, queries: int) -> np.ndarray:
        if block not in self.blocks:
            self.blocks[block] = np.full((queries, self.k), -np.inf)
            self.held += queries
        self.blocks.move_to_end(block)
        while self.held > self.most and len(self.blocks) > 1:
            self.held -= len(self.blocks.popitem(last=False)[1])
        return self.blocks[block]


def _longest(values: np.ndarray) -> float:
    """The greatest length of a vector."""
    with np.errstate(over="ignore"):
        parts = (values[a : a + 4096].astype(np.float64) for a in range(0, len(values), 4096))
        return max((math.sqrt((x * x).sum(axis=1).max()) for x in parts), default=0.0)


def _together(blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, and vectors of blocks of one dimension."""
    ids, nulls, values = ([x.as_py() for x in blocks.column(name)] for name in ("ids", "nulls", "values"))
    matrices = []
    for n, data in zip(blocks.column("n").to_pylist(), values):
        matrices.append(np.frombuffer(data, KINDS[len(data) // (n * dim) if dim else 8]).reshape(n, dim))
    return np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(nulls), bool), np.concatenate(matrices)


def _search(k: int, candidate_numbers: int, query_numbers: int) -> Callable:
    """The best among a group of rows for each of a group of queries."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        dim = asked.column("dim")[0].as_py()
        c_ids, c_null, c_values = _together(blocks, dim)
        q_ids, _, q_values = _together(asked, dim)
        counts = asked.column("n").to_pylist()
        kind = np.float32 if _longest(q_values) * _longest(c_values) < 2.0**23 else np.float64
        width = max(query_numbers // max(dim, 1), 1)
        queries = [(a, Side(q_values[a : a + width], True, kind)) for a in range(0, len(q_ids), width)]
        known, found = Scores(k, len(q_ids)), [np.zeros(0, x) for x in (np.int64, np.int64, bool, np.int64)]
        more, held, width = [], 0, max(candidate_numbers // max(dim, 1), 1)

        def cut() -> list[np.ndarray]:
            rows, scores, nulls, ids = (np.concatenate(parts) for parts in zip(found, *more))
            ranked, _ = _best(k, rows, scores, nulls, ids)
            return [x[ranked] for x in (rows, scores, nulls, ids)]

        for start in range(0, len(c_ids), width):
            part = slice(start, start + width)
            ids, nulls, c = c_ids[part], c_null[part], Side(c_values[part], False, kind)
            for a, q in queries:
                best = known.of(a, len(q.values))
                rows, places, scores = _nearest(q_ids[a : a + len(q.values)], q, ids, nulls, c, k, best)
                if len(rows):
                    more.append((a + rows, scores, nulls[places], ids[places]))
                    held += len(rows)
                if held > max(4 * k * len(q_ids), 1 << 16):
                    found, more, held = cut(), [], 0
        rows, scores, nulls, ids = cut()
        block = np.repeat(asked.column("block").to_numpy(), counts)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        columns = (block[rows], place[rows], q_ids[rows], pa.array(ids, mask=nulls), scores)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, FOUND)], schema=FOUND)

    return run


def _held(blocks: DataFrame) -> Row:
    """How many blocks, vectors, numbers and bytes there are."""
    n = F.col("n").cast("long")
    sums = {"n": n, "numbers": n * F.col("dim"), "size": F.col("size")}
    totals = [F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in sums.items()]
    return blocks.agg(F.count("*").alias("blocks"), *totals).head()


def grid(rows: Row, asked: Row, k: int, most: int) -> tuple[int, int]:
    """Into how many groups rows and queries are divided; each group of rows meets each of queries.

    So many that a group's vectors fit into a task. Beyond that, as many pairs of groups as their work is
    worth, at most ``most``, and only while the copies take at most four times the rows' bytes, or ``GROUP_BYTES``.
    """
    parts = math.ceil((rows.numbers + 8 * rows.n) / GROUP_NUMBERS)
    shares = math.ceil((asked.numbers + (8 + 4 * k) * asked.n) / GROUP_QUERY_NUMBERS)
    # A group of rows costs a copy of the queries and their answers, one of queries a copy of the rows.
    by_part, by_share = asked.size + 32 * k * asked.n, rows.size
    if not by_part or not by_share:
        return 1, 1
    copies = max(4 * rows.size, GROUP_BYTES)
    worth = min(most, rows.numbers * asked.n / GROUP_WORK, copies * copies / (4 * by_part * by_share))
    shares = max(shares, min(round(math.sqrt(worth * by_part / by_share)), asked.blocks))
    return max(parts, min(math.ceil(worth / max(shares, 1)), rows.blocks), 1), max(shares, 1)


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query.

    Components become floor(256 x). ``is_query`` is a condition on ``vec_id``; queries are held,
    in groups, against all rows, in groups, and in a group block by block. Within a pair of blocks,
    segment means and deviations bound the distances from below, first on few segments, then, for
    what these leave, on more; only candidates that may still beat the k best scores that the group
    has met are computed. No row goes through the driver. Ties go to the smaller id, a
    null id last. Rows with the query's id are its own and no candidates of it; further rows
    with equal ids are rows of their own. Vectors that are null or hold a null or non-finite
    component take no part, and vectors of different lengths do not meet. Scores beyond a long
    stay at its limit. Other columns are not read.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    valid = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.coalesce(finite, F.lit(False)))
    asked = durable(valid.where(is_query(F.col("vec_id"))).mapInArrow(_blocks(QUERY_NUMBERS), BLOCKS_DDL))
    rows = durable(valid.mapInArrow(_blocks(CANDIDATE_NUMBERS), BLOCKS_DDL))
    parts, shares = grid(_held(rows), _held(asked), k, partitions(vectors))

    def dealt(blocks: DataFrame, own: str, groups: int, other: str, copies: int) -> GroupedData:
        every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
        copied = blocks.drop("size").withColumns({own: group, other: every})
        return copied.groupBy("dim", "part", "share")

    found = (
        dealt(rows, "part", parts, "share", shares)
        .cogroup(dealt(asked, "share", shares, "part", parts))
        .applyInArrow(_search(k, CANDIDATE_NUMBERS, QUERY_NUMBERS), FOUND_DDL)
    )
    best = Window.partitionBy("block", "place").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last()
    )
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
