"""Embedding near-duplicates by a forest of random-projection trees.

A node of a tree projects unit vectors on a random direction and splits at the median; what
falls within a band around the split goes to both sides (spill). Vectors close to each other
part at a node only if they straddle its whole band, and must do so in every tree to be
missed. The band is never narrower than a linked pair's typical projected distance, so a cloud
of vectors that all link is not cut apart. Leaves are compared exactly, in double precision.

The trees are grown on a bounded sample down to leaves of the size wanted for the whole table;
leaves that turn out overfull are grown further from a sample of their own. Every row is then
routed through every tree.

A pair of vectors can meet in several leaves. Each vector carries the sorted list of its
leaves, and a pair is counted only in the first leaf both have: link counts need no table of
pairs, and each leaf emits at most one row per vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.llm.graph import components
from pitbars.llm.text import lists, salted
from pitbars.session import staged

SIMILARITY = 0.95
TREES = 6
LEAF_ROWS = 512
#: Half the band's width, as a share of the projections' standard deviation.
SPILL = 0.15
#: A node is split only if each part is left with at most this share of its rows.
SPLIT_SHARE = 0.7
SAMPLE_ROWS = 16_384
DEPTH = 48
_OVERFULL = 4
#: Overfull leaves split again in one round, and the sample rows of each.
_REGROWN, _REGROW_ROWS = 16_384, 32
_BLOCK = 1024


@dataclass
class Tree:
    """A tree as arrays; ``down[i]`` are a node's children, or ``-1`` and the leaf's number.

    Nodes of one depth share a direction, so a node is a few numbers.
    """

    directions: np.ndarray
    least_band: float = 0.0
    level: list[int] = field(default_factory=lambda: [0])
    split: list[float] = field(default_factory=lambda: [0.0])
    band: list[float] = field(default_factory=lambda: [0.0])
    down: list[tuple[int, int]] = field(default_factory=lambda: [(-1, 0)])
    leaves: int = 1

    def _node(self, level: int, leaf: int) -> int:
        self.level.append(level)
        self.split.append(0.0)
        self.band.append(0.0)
        self.down.append((-1, leaf))
        return len(self.down) - 1

    def grow(self, leaf: int, rows: np.ndarray, target: float) -> None:
        """Split a leaf by its sample ``rows`` until parts hold ``target`` of them.

        A part that no direction left to it divides stays a leaf.
        """
        at = next(i for i, d in enumerate(self.down) if d == (-1, leaf))
        todo = [(at, rows @ self.directions.T)]
        while todo:
            at, projected = todo.pop()
            if len(projected) <= max(target, 8):
                continue
            for level in range(self.level[at], len(self.directions)):
                values = projected[:, level]
                split, band = float(np.median(values)), max(SPILL * float(values.std()), self.least_band)
                left, right = values <= split + band, values > split - band
                if max(left.sum(), right.sum()) <= SPLIT_SHARE * len(values):
                    break
            else:
                continue
            first = self._node(level + 1, self.down[at][1])
            second = self._node(level + 1, self.leaves)
            self.leaves += 1
            self.level[at], self.split[at], self.band[at], self.down[at] = level, split, band, (first, second)
            todo += [(first, projected[left]), (second, projected[right])]

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and leaf."""
        projected = rows @ self.directions.T
        found_rows, found_leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(rows)))]
        while todo:
            at, index = todo.pop()
            if not len(index):
                continue
            low, high = self.down[at]
            if low < 0:
                found_rows.append(index)
                found_leaves.append(np.full(len(index), high, dtype=np.int64))
                continue
            values = projected[index, self.level[at]]
            todo.append((low, index[values <= self.split[at] + self.band[at]]))
            todo.append((high, index[values > self.split[at] - self.band[at]]))
        return np.concatenate(found_rows), np.concatenate(found_leaves)


def vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and the places of the rows that have one.

    Rows that are null, zero, of another width, or that hold null or non-finite components
    are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    values = flat[starts[at][:, None] + np.arange(width)[None, :]].reshape(len(at), width)
    largest = np.abs(values).max(axis=1, initial=0.0)
    good = np.isfinite(largest) & (largest > 0)
    values, at = values[good], at[good]
    values = values / largest[good][:, None]  # so that squares neither overflow nor vanish
    return values / np.linalg.norm(values, axis=1)[:, None], at


def _leaf_rows(rows: DataFrame, forest: list[Tree], width: int, chunks: dict[int, int]) -> DataFrame:
    """A row of ``id, copies, embedding`` for each leaf it is in, and for each block of a
    leaf that ``chunks`` cuts, with the sorted list of all its leaves."""
    bases = np.cumsum([0] + [t.leaves for t in forest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _BLOCK):
                part = batch.slice(start, _BLOCK)
                unit, at = vectors(part.column(2), width)
                routed = [t.route(unit) for t in forest]
                leaf = np.concatenate([r[1] + b for r, b in zip(routed, bases)]).astype(np.int32)
                where = np.concatenate([r[0] for r in routed])
                order = np.lexsort((leaf, where))
                where, leaf = where[order], leaf[order]
                counts = np.bincount(where, minlength=len(at))
                begin = np.cumsum(counts) - counts
                ids = part.column(0).to_numpy()[at]
                cut = np.array([chunks.get(x, 1) for x in leaf.tolist()], dtype=np.int64) if chunks else np.ones(len(leaf), np.int64)
                own = ids[where] % cut
                place = np.repeat(np.arange(len(leaf)), cut)
                beside = np.arange(len(place)) - np.repeat(np.cumsum(cut) - cut, cut)
                row = where[place]
                again = counts[row]
                pick = np.repeat(begin[row] - (np.cumsum(again) - again), again) + np.arange(again.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[place]), pa.array(np.minimum(own[place], beside)), pa.array(np.maximum(own[place], beside)),
                     pa.array(own[place]), pa.array(ids[row]), part.column(1).take(pa.array(at[row])),
                     part.column(2).take(pa.array(at[row])), lists(leaf[pick], again)],
                    names=["leaf", "i", "k", "chunk", "id", "copies", "embedding", "leaves"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("id", "copies", "embedding").mapInArrow(
        run,
        "leaf int, i bigint, k bigint, chunk bigint, id bigint, copies bigint, "
        f"embedding {kind}, leaves array<int>",
    )


def compare_leaf(
    ids: np.ndarray, unit: np.ndarray, copies: np.ndarray, leaf: int, leaves: list[np.ndarray],
    similarity: float, side: np.ndarray | None = None,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links first met in this leaf, per row, and links that span what the leaf connects.

    A link counts as often as the other row has copies. With ``side`` (booleans) only pairs
    across it are compared.
    """
    n = len(ids)
    counts, part, spans = np.zeros(n, dtype=np.int64), np.arange(n), []
    earlier = [frozenset(x[x < leaf].tolist()) for x in leaves]
    for start in range(0, n, _BLOCK):
        i, j = np.nonzero(unit[start : start + _BLOCK] @ unit.T >= similarity)
        i = i + start
        wanted = i < j
        if side is not None:
            wanted &= side[i] != side[j]
        i, j = i[wanted], j[wanted]
        first = np.fromiter((earlier[a].isdisjoint(earlier[b]) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
        np.add.at(counts, i[first], copies[j[first]])
        np.add.at(counts, j[first], copies[i[first]])
        apart = part[i] != part[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            if part[a] != part[b]:
                spans.append((int(ids[a]), int(ids[b])))
                part[part == part[b]] = part[a]
    return counts, spans


def grow_forest(
    rows: DataFrame, n_rows: int, width: int, *, similarity: float, trees: int, leaf_rows: int, seed: int = 1
) -> list[Tree]:
    """Grow the trees on a sample of about ``SAMPLE_ROWS`` rows, drawn by a hash of their id."""
    even = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    table = rows.where(even < F.lit(SAMPLE_ROWS / max(n_rows, 1))).select("id", "embedding").toArrow().sort_by("id")
    unit, _ = vectors(table.column("embedding"), width)
    # Vectors of that cosine lie so far apart; a random direction sees this share of it.
    band = 0.5 * math.sqrt(max(2 - 2 * similarity, 0.0) / max(width, 1))
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        directions = rng.standard_normal((DEPTH, width))
        tree = Tree(directions / np.maximum(np.linalg.norm(directions, axis=1), 1e-300)[:, None], band)
        tree.grow(0, unit, leaf_rows * len(unit) / max(n_rows, 1))
        forest.append(tree)
    return forest


def near_vectors(
    df: DataFrame, *, row_id: Column, embedding: Column, similarity: float = SIMILARITY,
    trees: int = TREES, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    A vector links with every other whose cosine is at least ``similarity``; links of equal
    vectors and of repeated ids count like any other. Vectors that are null, zero, or hold
    null or non-finite components link with nothing. Ids are integers; a row with a null id
    links with nothing and has a null component. Vectors meet those of their own width, in a
    forest of their own. An empty table gives no rows. Other columns
    are not read. Stores equal vectors' classes and what the leaves found while the plan is
    built.

    A leaf of up to four times ``leaf_rows`` vectors is compared in one task. One that stays
    larger because no direction divides it is compared in blocks of that size.
    """
    rows = staged(df.select(row_id.cast("bigint").alias("id"), embedding.alias("embedding")), "vectors")
    usable = rows.where(F.col("id").isNotNull() & _usable(F.col("embedding")))
    # Equal vectors are one row, named by their smallest id, with their number.
    equal = staged(
        usable.groupBy(F.xxhash64("embedding").alias("h"), "embedding").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
        ), "vector-classes",
    )
    found = None
    for r in equal.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect():
        rows_of_width = equal.where(F.size("embedding") == r.width)
        links = _links(rows_of_width, r.n, r.width, similarity=similarity, trees=trees, leaf_rows=leaf_rows)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = df.sparkSession.createDataFrame([], "id bigint, n bigint, other bigint")
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = (
        equal.select("h", "embedding", "id", "copies").join(counts, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("h", F.col("embedding").alias("same"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
                F.coalesce("root", "id").alias("root"))
    )
    keyed = rows.withColumn(
        "h", F.when(F.col("id").isNotNull() & _usable(F.col("embedding")), F.xxhash64("embedding"))
    )
    joined = keyed.join(classes, (keyed.h == classes.h) & (keyed.embedding == classes.same), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return joined.select(
        "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _links(
    rows: DataFrame, n_rows: int, width: int, *, similarity: float, trees: int, leaf_rows: int
) -> DataFrame:
    """What the leaves of one forest find among vectors of one width: ``id, n, other``."""
    forest = grow_forest(rows, n_rows, width, similarity=similarity, trees=trees, leaf_rows=leaf_rows)
    most = _OVERFULL * leaf_rows
    while True:
        sizes = _leaf_sizes(rows, forest, width).where(F.col("n") > most)
        over = {r.leaf: r.n for r in sizes.orderBy("leaf").limit(_REGROWN).collect()}
        if not over or not _regrow(rows, forest, width, over, leaf_rows):
            break
    # All leaves that stay overfull, each of more than ``most`` rows, are compared in blocks.
    chunks = {r.leaf: -(-r.n // most) for r in sizes.collect()} if over else {}
    met = _leaf_rows(rows, forest, width, chunks).groupBy("leaf", "i", "k")
    return staged(met.applyInArrow(_compare(similarity, width), "id bigint, n bigint, other bigint"), "links")


def _usable(vector: Column) -> Column:
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    fine = F.forall(sizes, lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(math.inf)))
    return F.coalesce(fine & F.exists(sizes, lambda x: x > 0), F.lit(False))


def _leaf_sizes(rows: DataFrame, forest: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = np.cumsum([0] + [t.leaves for t in forest])
        counts = np.zeros(bases[-1], dtype=np.int64)
        for batch in batches:
            unit, _ = vectors(batch.column(0), width)
            for tree, base in zip(forest, bases):
                counts[base : base + tree.leaves] += np.bincount(tree.route(unit)[1], minlength=tree.leaves)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["leaf", "n"])

    return rows.select("embedding").mapInArrow(run, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))


def _regrow(rows: DataFrame, forest: list[Tree], width: int, over: dict[int, int], leaf_rows: int) -> bool:
    """Split overfull leaves by samples of their own; false when none can be split."""
    bases = np.cumsum([0] + [t.leaves for t in forest])
    each = max(_REGROW_ROWS, SAMPLE_ROWS // len(over))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.zeros(bases[-1])
        for leaf, n in over.items():
            share[leaf] = each / n
        for batch in batches:
            unit, at = vectors(batch.column(1), width)
            ids = batch.column(0).to_numpy()[at].astype(np.uint64)
            for tree, base in zip(forest, bases):
                row, leaf = tree.route(unit)
                leaf = leaf + base
                even = (salted(ids[row], 5) >> np.uint64(11)).astype(float) * 2.0**-53
                keep = even < share[leaf]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[keep].astype(np.int32)), lists(unit[row[keep]].reshape(-1), np.full(int(keep.sum()), width))],
                    names=["leaf", "vector"],
                )

    drawn = rows.select("id", "embedding").mapInArrow(run, "leaf int, vector array<double>").toArrow()
    leaf = drawn.column("leaf").to_numpy()
    unit, _ = vectors(drawn.column("vector"), width)
    grown = False
    for number, n in over.items():
        tree = int(np.searchsorted(bases, number, "right")) - 1
        before = forest[tree].leaves
        sample = unit[leaf == number]
        forest[tree].grow(number - int(bases[tree]), sample, leaf_rows * len(sample) / n)
        grown |= forest[tree].leaves > before
    return grown


def _compare(similarity: float, width: int):
    def run(table: pa.Table) -> pa.Table:
        leaf, i, k = (table.column(c)[0].as_py() for c in ("leaf", "i", "k"))
        ids, copies, chunk = (table.column(c).to_numpy() for c in ("id", "copies", "chunk"))
        unit, _ = vectors(table.column("embedding"), width)
        held = table.column("leaves").combine_chunks()
        flat, offsets = held.flatten().to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
        leaves = [flat[offsets[r] : offsets[r + 1]] for r in range(len(ids))]
        counts, spans = compare_leaf(ids, unit, copies, leaf, leaves, similarity, None if i == k else chunk == i)
        some = np.flatnonzero(counts)
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[some], np.array([a for a, _ in spans], np.int64)])),
                "n": pa.chunked_array([pa.array(counts[some]), pa.nulls(len(spans), pa.int64())]),
                "other": pa.chunked_array([pa.nulls(len(some), pa.int64()), pa.array([b for _, b in spans], pa.int64())]),
            }
        )

    return run
