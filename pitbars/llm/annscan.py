"""Nearest vectors by inner product: probed lists, read with an adaptive dimension scan.

Largest inner product is least distance after each vector gets one more component, which fills
its length up to that of the longest vector; a query gets a zero there. Vectors are then
turned by one random rotation and cut into blocks of ``COLUMNS`` columns.

Lists are the cells of centroids fitted to a bounded sample; every vector is in exactly one.
A query probes its nearest lists. How many is measured on the sample: as many as hold
``PROBE_RECALL`` of the true neighbours of sampled queries.

Within a list the columns are added block by block. After a random rotation the part of a
squared distance that falls into the first ``d`` of ``D`` columns is Beta(d/2, (D-d)/2)
distributed. With ``r`` the distance of the query's last place so far, a candidate is abandoned
when its partial distance exceeds ``r^2`` times the upper ``ALPHA`` quantile: the hypothesis
that it is at most ``r`` away is then rejected. What survives all columns is scored from the
original vectors in double precision.

A query first reads its nearest list, which fixes ``r``; its other lists are read in a second
step that starts from there. Both are joins of blocks: lists are cut into chunks of at most
about ``CHUNK_ROWS`` candidates and as many queries, so no task grows with a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.llm.topk import top_rows
from pitbars.session import staged

#: The index is fitted on at most so many vectors and bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
#: Lists hold about so many vectors, until there are ``MOST_LISTS``.
LIST_ROWS, MOST_LISTS = 1024, 1024
PROBE_RECALL, PROBE_QUERIES = 0.97, 256
ALPHA = 0.001
COLUMNS = 16
CHUNK_ROWS = 4096
_STARTING_ROWS, _SEGMENT_ROWS, _QUERY_ROWS = 128, 1024, 256
_ROUNDING = 1e-9


def share_quantile(first: int, all_: int, alpha: float = ALPHA, steps: int = 20_000) -> float:
    """Upper ``alpha`` quantile of Beta(first/2, (all_-first)/2), the share of the first columns."""
    if first >= all_:
        return 1.0
    # x = sin^2(t) takes the poles of the density away.
    t = (np.arange(steps) + 0.5) * (math.pi / 2 / steps)
    log_density = (first - 1) * np.log(np.sin(t)) + (all_ - first - 1) * np.log(np.cos(t))
    mass = np.cumsum(np.exp(log_density - log_density.max()))
    at = int(np.searchsorted(mass, (1 - alpha) * mass[-1]))
    return float(np.sin(t[min(at + 1, steps - 1)]) ** 2)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of that width as a table of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class Space:
    """The turned space: ``scale`` is the longest vector's length."""

    width: int
    scale: float
    rotation: np.ndarray

    @classmethod
    def make(cls, width: int, scale: float, seed: int = 1) -> Space:
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width + 1, width + 1)))
        return cls(width, scale, turn)

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.scale
        rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", x, x), 0.0))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / self.scale) @ self.rotation[: self.width]

    def distance(self, score: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Squared distance that belongs to an inner product."""
        return 1.0 + np.einsum("ij,ij->i", query, query) - 2.0 * score / self.scale / self.scale


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two tables."""
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def fit(space: Space, sample: np.ndarray, lists: int, k: int, seed: int = 2) -> tuple[np.ndarray, int]:
    """Centroids of the sample's cells, and the number of lists a query probes."""
    rng = np.random.default_rng(seed)
    points = space.candidates(sample)
    if lists <= 1 or len(points) <= k + 1:
        return points[:1], 1
    centres = points[np.sort(rng.choice(len(points), min(lists, len(points)), replace=False))]
    for _ in range(8):
        cell = _cells(points, centres)
        order = np.argsort(cell, kind="stable")
        filled, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(points[order], first, axis=0)
        centres[filled] = sums / np.diff(np.append(first, len(points)))[:, None]
    cell = _cells(points, centres)
    asked = rng.choice(len(points), min(PROBE_QUERIES, len(points)), replace=False)
    queries = space.queries(sample[asked])
    near = _squared(queries, points)
    near[np.arange(len(asked)), asked] = np.inf
    neighbours = np.argpartition(near, k, axis=1)[:, :k]
    place = np.argsort(np.argsort(_squared(queries, centres), axis=1, kind="stable"), axis=1)
    reached = np.take_along_axis(place, cell[neighbours], axis=1).reshape(-1)
    share = np.cumsum(np.bincount(reached, minlength=len(centres))) / len(reached)
    return centres, int(np.searchsorted(share, PROBE_RECALL)) + 1


def _cells(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = range(0, len(points), _CELL_ROWS)
    return np.concatenate([_squared(points[i : i + _CELL_ROWS], centres).argmin(axis=1) for i in parts])


_CELL_ROWS = 4096


def scan(
    space: Space, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    floors: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's ``k`` best candidates of a block: query, candidate, score; and columns read.

    ``floors`` are inner products that a candidate must reach, or NaN where none is known yet.
    """
    x, q = space.candidates(vectors), space.queries(queries)
    starts = list(range(0, space.width + 1, COLUMNS))
    blocks = [np.ascontiguousarray(x[:, a : a + COLUMNS]) for a in starts]
    quantile = [share_quantile(min(a + COLUMNS, space.width + 1), space.width + 1) for a in starts]
    limits = np.where(np.isnan(floors), np.inf, space.distance(floors, q) * (1 + _ROUNDING) + _ROUNDING)
    cuts = [0, *range(min(_STARTING_ROWS, len(ids)), len(ids), _SEGMENT_ROWS), len(ids)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    read = 0
    for start in range(0, len(q), _QUERY_ROWS):
        part = q[start : start + _QUERY_ROWS]
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(part)
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            first = _squared(part[:, :COLUMNS], blocks[0][low:high])
            read += first.size
            for i in range(len(part)):
                limit = limits[start + i]
                alive = np.flatnonzero(first[i] <= limit * quantile[0])
                distance, alive = first[i][alive], alive + low
                for b in range(1, len(blocks)):
                    if not len(alive):
                        break
                    step = blocks[b][alive] - part[i, starts[b] : starts[b] + COLUMNS]
                    distance = distance + np.einsum("ij,ij->i", step, step)
                    read += len(alive)
                    keep = distance <= limit * quantile[b]
                    alive, distance = alive[keep], distance[keep]
                if not len(alive):
                    continue
                at, far = np.concatenate([held[i][0], alive]), np.concatenate([held[i][1], distance])
                if len(at) > k:
                    last = np.partition(far, k - 1)[k - 1] * (1 + _ROUNDING) + _ROUNDING
                    limits[start + i] = min(limit, last)
                    at, far = at[far <= last], far[far <= last]
                held[i] = (at, far)
        found += held
    out_query, out_id, out_score = [], [], []
    for i, (at, _) in enumerate(found):
        # Added up from the first component to the last, so equal vectors score alike.
        score = np.cumsum(vectors[at] * queries[i], axis=1)[:, -1] if len(at) else np.zeros(0)
        best = np.lexsort((ids[at], -score))[:k]
        out_query.append(np.full(len(best), query_ids[i]))
        out_id.append(ids[at][best])
        out_score.append(score[best])
    none = np.zeros(0, np.int64)
    return (np.concatenate([none, *out_query]), np.concatenate([none, *out_id]),
            np.concatenate([np.zeros(0), *out_score]), read)


def _usable(vector: Column) -> Column:
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    fine = F.forall(sizes, lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(math.inf)))
    return F.coalesce(fine & F.exists(sizes, lambda x: x > 0), F.lit(False))


def _length(vector: Column) -> Column:
    """A vector's length, without squares that overflow."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x.cast("double") / largest) * (x.cast("double") / largest))
    return largest * F.sqrt(squares)


def nearest(df: DataFrame, *, row_id: Column, embedding: Column, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest vectors of every query, nearest first.

    Nearest is the largest inner product of the original vectors in double precision; ties go
    to the smaller id. ``is_query`` depends on the row's id. A query is no candidate of its
    own. Vectors that are null, zero, or hold null or non-finite components, and rows without
    an id, take no part. Vectors meet only vectors of their own width, one search a width.
    Rows that repeat an id are one vector, of differing ones that of the smallest hash. An
    empty table gives no rows; other columns are not read. Ids are integers.

    Equal vectors are searched once. Of a class of equal vectors the ``k + 1`` smallest ids
    are candidates, which is exact: others would rank behind them in every result.
    Stores narrow tables and each list's vectors while the plan is built.
    """
    rows = df.select(
        row_id.cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), embedding.alias("embedding")
    ).where(F.col("id").isNotNull() & _usable(F.col("embedding")))
    big = F.xxhash64("embedding").cast("decimal(20,0)") * F.expr("10000000000000000000BD")
    key = (big + F.xxhash64(F.lit(1), F.col("embedding")).cast("decimal(20,0)")).cast("decimal(38,0)")
    rows = rows.withColumn("key", key)
    ids = staged(rows.groupBy("id").agg(F.min("key").alias("key"), F.max("asked").alias("asked")), "ids")
    members = staged(top_rows(ids.select("key", "id"), ["key"], [F.asc("id")], k + 1, spread=F.col("id")), "equal-vectors")
    heads = members.where("place = 1").select("key", F.col("id").alias("rep"))
    asked = ids.where("asked").select(F.col("id").alias("query_id"), "key")
    chosen = heads.join(asked.select("key").distinct().withColumn("asked", F.lit(True)), "key", "left")
    vectors = rows.select("id", "key", "embedding").join(
        chosen.select(F.col("rep").alias("id"), "key", F.coalesce("asked", F.lit(False)).alias("asked")), ["id", "key"]
    ).select("id", "asked", "embedding", F.size("embedding").alias("width"), _length(F.col("embedding")).alias("length"))
    vectors = staged(vectors, "heads")
    sizes = vectors.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length")).orderBy("width").collect()
    found = [_search(vectors.where(F.col("width") == s.width), s.width, s.n, s.length, k + 1) for s in sizes]
    hits = df.sparkSession.createDataFrame([], "query bigint, id bigint, score double") if not found else found[0]
    for other in found[1:]:
        hits = hits.unionByName(other)
    best = [F.desc("score"), F.asc("id")]
    # From classes to rows: a query class, its members, and the members of what it found.
    near = hits.withColumnRenamed("id", "rep").join(heads, "rep").join(members.select("key", F.col("id").alias("member")), "key")
    near = near.select("query", F.col("member").alias("id"), "score")
    near = staged(top_rows(near, ["query"], best, k + 1, spread=F.col("id")).drop("place"), "near-classes")
    who = asked.join(heads, "key").select("query_id", F.col("rep").alias("query"))
    pairs = who.join(near, "query").where("id <> query_id").select("query_id", "id", "score")
    ranked = top_rows(pairs, ["query_id"], best, k, spread=F.lit(0), place="rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _search(vectors: DataFrame, width: int, n: int, length: float, k: int) -> DataFrame:
    """``query, id, score`` between classes, at most ``k`` a query, for vectors of one width."""
    space = Space.make(width, length)
    take = min(SAMPLE_ROWS, max(SAMPLE_BYTES // (8 * (width + 1)), 2 * k))
    even = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) / F.lit(float(1 << 53))
    sample = vectors.where(even < F.lit(take / n)).select("id", "embedding").limit(2 * take).toArrow().sort_by("id")
    n_lists = max(1, min(MOST_LISTS, n // LIST_ROWS, len(sample) // 32))
    if len(sample):
        centres, probes = fit(space, matrix(sample.column("embedding"), width), n_lists, k)
    else:
        centres, probes = np.zeros((1, width + 1)), 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cells(space.candidates(matrix(batch.column(2), width)), centres) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), *batch.columns], names=["list", "id", "asked", "embedding"]
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = staged(
        vectors.select("id", "asked", "embedding").mapInArrow(assign, f"list int, id bigint, asked boolean, embedding {kind}"), "lists"
    )
    counts = {r.list: r.n for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    filled = np.array([counts.get(i, 0) for i in range(len(centres))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _squared(space.queries(matrix(batch.column(1), width)), centres)
            order = np.argsort(far, axis=1, kind="stable").astype(np.int32)
            order = [row[filled[row] > 0] for row in order]
            # More lists than measured, if those hold too few vectors.
            most = [max(probes, int(np.searchsorted(np.cumsum(filled[row]), k)) + 1) for row in order]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([row[:m] for row, m in zip(order, most)], pa.list_(pa.int32()))],
                names=["query", "embedding", "probes"],
            )

    routed = staged(
        placed.where("asked").select("id", "embedding").mapInArrow(route, f"query bigint, embedding {kind}, probes array<int>"), "routes"
    )
    nothing = F.lit(None).cast("double").alias("floor")
    own = staged(
        _met(space, placed, routed.select("query", "embedding", F.col("probes")[0].alias("list"), nothing), counts, k), "own-lists"
    )
    best = [F.desc("score"), F.asc("id")]
    own_best = staged(top_rows(own, ["query"], best, k, spread=F.col("id")), "own-best")
    floors = own_best.where(F.col("place") == k).select("query", F.col("score").alias("floor"))
    rest = routed.where(F.size("probes") > 1).join(floors, "query", "left").select(
        "query", "embedding", F.explode(F.slice("probes", F.lit(2), F.size("probes"))).alias("list"), "floor"
    )
    other = _met(space, placed, rest, counts, k)
    return top_rows(own_best.drop("place").unionByName(other), ["query"], best, k, spread=F.col("id")).drop("place")


def _met(space: Space, placed: DataFrame, queries: DataFrame, counts: dict[int, int], k: int) -> DataFrame:
    """Scan every block of a list's candidates and of the queries that probe it."""
    spark, width = placed.sparkSession, space.width
    queries = staged(queries, "probes")
    asked = {r.list: r.n for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most MOST_LISTS rows.
    cut = [(i, -(-n // CHUNK_ROWS), -(-asked[i] // CHUNK_ROWS)) for i, n in counts.items() if i in asked]
    cuts = F.broadcast(spark.createDataFrame(cut, "list int, chunks int, groups int"))

    def spread(ways: str) -> Column:
        return F.sequence(F.lit(0), F.col(ways) - 1)

    left = placed.select("list", "id", "embedding").join(cuts, "list").select(
        "list", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.explode(spread("groups")).alias("group"),
        "id", "embedding",
    )
    right = queries.join(cuts, "list").select(
        "list", F.explode(spread("chunks")).alias("chunk"), F.pmod(F.xxhash64("query"), "groups").cast("int").alias("group"),
        "query", "embedding", "floor",
    )

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        ids, at = np.unique(candidates.column("id").to_numpy(), return_index=True)
        query, row = np.unique(asked.column("query").to_numpy(), return_index=True)
        floors = asked.column("floor").to_numpy(zero_copy_only=False).astype(float)[row]
        hits = scan(
            space, ids, matrix(candidates.column("embedding"), width)[at], query,
            matrix(asked.column("embedding"), width)[row], floors, k,
        )
        return pa.table({"query": hits[0], "id": hits[1], "score": hits[2]})

    on = ["list", "chunk", "group"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, "query bigint, id bigint, score double")
