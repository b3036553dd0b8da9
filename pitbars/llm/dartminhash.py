"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

Every element of a weighted set owns the half-plane of weights and ranks. Hashed darts fall
on it as a Poisson process of density one, the same for every set that holds the element. A
set of total weight ``x`` collects the darts below its elements' weights and below a rank of
about ``t ln t / x``, so all sets collect about ``t ln t`` darts however large they are. Each
dart falls on one of ``t`` coordinates; the earliest dart of a coordinate is its signature
value. Two sets agree on a coordinate with a probability equal to their weighted Jaccard
similarity.

Bands of signature values bring candidates together. Candidates are grouped by components of
a star in every band's bucket, and the exact similarity is then computed within groups:

* copies (equal word sequences) are one class before anything is compared;
* a group whose sets hold up to ``TASK_ELEMENTS`` shingles is compared in one task;
* a larger group is cut into chunks of ``GROUP_ROWS`` classes, and some of its members, the pivots, are
  compared with all of it at once, chunk by chunk. What they link becomes one part. Members
  outside the largest part that have not been pivots yet are the next round's, until there
  are none: of two members in different parts one has then been compared with the other, so
  no pair is passed over. Copies of one text are one part after a round or two.

Tasks emit spanning links only, at most one per class and task, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.graph import components, join_checked
from pitbars.llm.rows import numbered
from pitbars.llm.text import Block, _Powers, blocks, grams, lists, mixed, salted, signed, small_batches
from pitbars.session import staged

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair at 0.8 shares one of 24 bands of 5 with probability 0.9999.
BANDS, BAND_ROWS = 24, 5
#: Shingles of a group that one task compares (32 MB of hashes); classes in a chunk of a larger one.
TASK_ELEMENTS = 4_000_000
GROUP_ROWS = 512
_CELLS = 400_000
_U = np.uint64
_HALF = 2.0**-53
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _even(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * _HALF


def _earliest(
    owner: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, t: int
) -> np.ndarray:
    """Smallest rank per ``(set, coordinate)``, infinite where no dart came below the limit.

    The plane over an element is cut into strips of weight ``[0, 1), [1, 2), [2, 4), ...`` and
    those into cells of area one, whose number of darts follows from a hash of the cell.
    """
    best = np.full(len(limit) * t, np.inf)
    low, width, strip = 0.0, 1.0, 0
    while len(element):
        over = weight > low
        owner, element, weight = owner[over], element[over], weight[over]
        cells = np.ceil(limit[owner] * width).astype(np.int64)
        index = np.repeat(np.arange(len(element)), cells)
        if len(index):
            ends = np.cumsum(cells)
            step = np.arange(len(index)) - np.repeat(ends - cells, cells)
            key = mixed(element[index] ^ mixed((step.astype(_U) << _U(6)) + _U(strip + 1)))
            darts = np.searchsorted(_POISSON, _even(key), side="right")
            which = np.repeat(np.arange(len(index)), darts)
            number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mixed(key[which] + (number.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
            rank = (step[which] + _even(salted(dart, 1))) / width
            at = index[which]
            hit = (low + width * _even(salted(dart, 2)) < weight[at]) & (rank <= limit[owner[at]])
            place = owner[at[hit]] * t + (salted(dart[hit], 3) % _U(t)).astype(np.int64)
            np.minimum.at(best, place, rank[hit])
        low, width, strip = low + width, (width if strip == 0 else width * 2), strip + 1
    return best.reshape(len(limit), t)


def signatures(bounds: np.ndarray, element: np.ndarray, weight: np.ndarray, t: int) -> np.ndarray:
    """Signatures ``[sets, t]`` of the sets ``element[bounds[i]:bounds[i + 1]]``.

    Elements of a set are distinct 64-bit hashes with positive weights. An empty set's values
    are infinite. Sets that leave a coordinate empty look again up to twice the rank.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.zeros(len(sizes))
    np.add.at(total, owner, weight)
    limit = np.where(sizes > 0, t * (math.log(t) + 3) / np.maximum(total, 1e-300), 0.0)
    out = np.full((len(sizes), t), np.inf)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):
        again = []
        # Sets are taken together up to a bounded number of cells.
        cost = np.cumsum(sizes[todo] * np.ceil(limit[todo])) // _CELLS
        for part in np.split(todo, np.flatnonzero(np.diff(cost)) + 1):
            pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in part])
            local = np.repeat(np.arange(len(part)), sizes[part])
            found = _earliest(local, element[pick], weight[pick], limit[part], t)
            out[part] = found
            again.append(part[np.isinf(found).any(axis=1)])
        todo = np.concatenate(again)
        limit[todo] *= 2
    return out


def shingles(block: Block, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ``k`` words of every text: bounds, hashes, and how often each occurs.

    Hashes are sorted within a text. A text of fewer than ``k`` words, but not none, is one
    shingle of all its words.
    """
    hashes, valid = grams(block, k)
    owner, value = block.text[: len(hashes)][valid], hashes[valid]
    words = np.diff(block.bounds)
    for i in np.flatnonzero((words > 0) & (words < k)):
        total = np.array([words[i]], dtype=_U)
        for j in range(block.bounds[i], block.bounds[i + 1]):
            total = mixed(total + block.hash[j : j + 1])
        owner, value = np.append(owner, i), np.append(value, total)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(value)))
    return np.searchsorted(owner[at], np.arange(block.count + 1)), value[at], times


def _content(block: Block, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence; of its bytes where it has no words."""
    up, down = powers.get(len(block.hash) + 1)
    out = []
    for salt in (11, 12):
        sums = np.zeros(len(block.hash) + 1, dtype=_U)
        np.cumsum(salted(block.hash, salt) * up[: len(block.hash)], out=sums[1:])
        total = (sums[block.bounds[1:]] - sums[block.bounds[:-1]]) * down[block.bounds[:-1]]
        out.append(mixed(total + np.diff(block.bounds).astype(_U)))
    for i in np.flatnonzero(np.diff(block.bounds) == 0):
        raw = hashlib.blake2b(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes(), digest_size=16).digest()
        out[0][i], out[1][i] = np.frombuffer(raw, dtype=_U)
    return out[0], out[1]


def _band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(values).view(_U).reshape(len(values), bands, rows)
    key = np.zeros(bits.shape[:2], dtype=_U) + np.arange(1, bands + 1, dtype=_U)[None, :]
    for j in range(rows):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + bits[:, :, j])
    return key


def sketch(
    df: DataFrame, doc_id: str, text: str, *, weighting: str = "set", bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """``id, d1, d2, bands`` per row: content hash and band keys of the dart signature.

    ``weighting`` is ``"set"`` (every distinct shingle weighs 1) or ``"count"`` (it weighs as
    often as it occurs). Null texts have null hashes; wordless texts have no bands.
    """
    small_batches(df.sparkSession)
    if weighting not in ("set", "count"):
        raise ValueError(f"unknown weighting {weighting!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for block in blocks(batch.column(1), powers):
                d1, d2 = _content(block, powers)
                bounds, element, times = shingles(block)
                weight = times.astype(np.float64) if weighting == "count" else np.ones(len(element))
                keys = _band_keys(signatures(bounds, element, weight, bands * rows), bands, rows)
                some = np.diff(bounds) > 0
                missing = np.asarray(batch.column(1).slice(block.first, block.count).is_null())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.count),
                     pa.array(signed(d1), mask=missing), pa.array(signed(d2), mask=missing),
                     lists(signed(keys[some].reshape(-1)), np.where(some, bands, 0))],
                    names=["id", "d1", "d2", "bands"],
                )

    narrow = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "id bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _with_sets(df: DataFrame, names: list[str]) -> DataFrame:
    """The ``text`` column replaced by ``set``, its sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for block in blocks(batch.column("text"), powers):
                bounds, element, _ = shingles(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(block.first, block.count) for n in names]
                    + [lists(signed(element), np.diff(bounds))],
                    names=[*names, "set"],
                )

    kinds = dict(df.dtypes)
    shape = ", ".join(f"{n} {kinds[n]}" for n in names)
    return df.select(*names, "text").mapInArrow(run, f"{shape}, set array<bigint>")


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what pairs of at least ``similarity`` connect, one fewer than they join.

    A pivot is compared with all others at once through an index of elements. Members that end
    up outside the largest part have all been pivots, so every pair of different parts has
    been compared.
    """
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    part, asked, links = np.arange(n), np.zeros(n, dtype=bool), []
    pivot = 0
    while pivot is not None:
        asked[pivot] = True
        low = np.searchsorted(values, sets[pivot], "left")
        high = np.searchsorted(values, sets[pivot], "right")
        lengths = high - low
        spread = np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owners[spread], minlength=n)
        # Integers decide, so that a pair exactly at the similarity is one.
        near = shared >= similarity * (sizes + sizes[pivot] - shared) - 1e-9
        near &= shared > 0
        for other in np.flatnonzero(near & (part != part[pivot])):
            if part[other] != part[pivot]:
                links.append((int(ids[pivot]), int(ids[other])))
                part[part == part[other]] = part[pivot]
        counts = np.bincount(part, minlength=n)
        left = np.flatnonzero(~asked & (part != counts.argmax()))
        pivot = int(left[0]) if len(left) else None
    return links


def _verified(grouped, similarity: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        column = table.column("set").combine_chunks()
        flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
        base = offsets[0]
        sets = [flat[offsets[i] - base : offsets[i + 1] - base] for i in first]
        links = spanning_links(ids, sets, similarity)
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
        )

    return grouped.applyInArrow(run, "a bigint, b bigint")


#: Pivots of a group in the first round, and in any later one.
_FIRST_PIVOTS, _PIVOTS = 16, 512


def pivot_links(
    pivot_ids: np.ndarray, pivots: list[np.ndarray], ids: np.ndarray, sets: list[np.ndarray], similarity: float
) -> list[tuple[int, int]]:
    """Links that join what the pivots connect among the rows, one fewer than they join."""
    sizes = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    links, names = [], np.concatenate([pivot_ids, ids])
    # A pivot may be one of the rows: both places are one member from the start.
    known = {int(x): i for i, x in enumerate(pivot_ids)}
    part = np.arange(len(names))
    for i, x in enumerate(ids.tolist()):
        if x in known:
            part[len(pivot_ids) + i] = part[known[x]]
    for at, (pivot, mine) in enumerate(zip(pivot_ids, pivots)):
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        lengths = high - low
        spread = np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owners[spread], minlength=len(sets))
        # Integers decide, so that a pair exactly at the similarity is one.
        near = (shared > 0) & (shared >= similarity * (sizes + len(mine) - shared) - 1e-9)
        for other in np.flatnonzero(near) + len(pivot_ids):
            if part[other] != part[at]:
                links.append((int(pivot), int(names[other])))
                part[part == part[other]] = part[at]
    return links


def _set_lists(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids and their sets."""
    ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
    column = table.column("set").combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    return ids, [flat[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]] for i in first]


def _pivoted(rows: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """``a, b``: links that connect the near members of large groups (``root, n, id, set``)."""
    chunks = F.ceil(F.col("n") / group_rows)
    members = rows.select("root", "n", "id").distinct()

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        links = pivot_links(*_set_lists(asked), *_set_lists(held), similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    def first_of(candidates: DataFrame, count: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("id"), "id"))
        return staged(candidates.withColumn("__n", place).where(F.col("__n") <= count).drop("__n"), "pivots")

    pivots = first_of(members, _FIRST_PIVOTS)
    asked, links, count = pivots, None, _FIRST_PIVOTS
    while not pivots.isEmpty():
        at_work = F.col("root"), F.pmod(F.xxhash64("id"), chunks).alias("chunk")
        held = rows.join(pivots.select("root").distinct(), "root", "left_semi").select(*at_work, "id", "set")
        sent = pivots.join(rows.select("id", F.col("set").alias("set")), "id").select(
            "root", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"), "id", "set"
        )
        met = held.groupBy("root", "chunk").cogroup(sent.groupBy("root", "chunk"))
        fresh = staged(met.applyInArrow(compare, "a bigint, b bigint"), "pivot-links")
        links = fresh if links is None else links.unionByName(fresh)
        parts = components(links).select(F.col("node").alias("id"), F.col("root").alias("part"))
        placed = members.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
        placed = staged(placed.join(asked.select("id", F.lit(True).alias("asked")), "id", "left"), "parts")
        sizes = placed.groupBy("root", "part").agg(F.count(F.lit(1)).alias("k"))
        largest = sizes.groupBy("root").agg(F.max(F.struct("k", "part"))["part"].alias("top"))
        left = placed.join(largest, "root").where("part <> top and asked is null").select("root", "n", "id")
        count = min(4 * count, _PIVOTS)
        pivots = first_of(left, count)
        asked = asked.unionByName(pivots)
    return rows.sparkSession.createDataFrame([], "a bigint, b bigint") if links is None else links


def near_duplicates(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", weighting: str = "set",
    similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS, task_elements: int = TASK_ELEMENTS,
) -> DataFrame:
    """``doc_id, class_id, kept`` for every row: its class of linked documents.

    Documents link when their sets of five-word shingles have a Jaccard similarity of at least
    ``similarity``; classes are what links connect, named by their smallest id, which is the
    document kept. Equal word sequences, and equal wordless texts, link. Null texts link with
    nothing, rows without an id are classes of their own (``class_id`` null, kept), and rows
    of one id share its class. An empty table gives no rows. Other columns are not read.
    ``doc_id`` is an integer. Stores narrow tables, and shingle sets of candidates, while the
    plan is being built.
    """
    rows = staged(sketch(df, doc_id, text, weighting=weighting), "sketches")
    known = rows.where("id is not null and d1 is not null")
    classes = staged(
        known.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "copies"
    )
    reps = known.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    banded = staged(reps.select("id", F.explode("bands").alias("key")).distinct(), "bands")
    heads = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = banded.join(heads, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    groups = staged(components(stars), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = staged(
        groups.join(sizes, "root").select(F.col("node").alias("id"), "root", "n"), "candidates"
    )
    texts = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    chosen = join_checked(texts, members, ["id"], "inner")
    sets = staged(_with_sets(chosen, ["id", "root", "n"]), "sets")

    heavy = sets.groupBy("root").agg(F.sum(F.size("set")).alias("e")).where(F.col("e") > task_elements)
    heavy = staged(heavy.select("root"), "large-groups")
    links = _verified(join_checked(sets, heavy, ["root"], "left_anti").groupBy("root"), similarity)
    if not heavy.isEmpty():
        large = sets.join(heavy, "root", "left_semi").select("root", "n", "id", "set")
        links = links.unionByName(_pivoted(large, similarity, group_rows))
    roots = staged(components(links), "classes")

    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("root", "rep").alias("class_id")
    )
    found = rows.select("id", "d1", "d2").join(named, ["d1", "d2"], "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return found.select(
        F.col("id").alias(doc_id), class_id.alias("class_id"),
        F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"),
    )


def drop_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one row of each class.

    Rows are told apart by their place, not by their id: of a class the row of the smallest id
    stays (one without an id only where none has one), of rows that repeat it the first. Rows
    of one id and different texts are different rows.
    """
    rows = numbered(df)
    found = near_duplicates(rows, doc_id="__row", text=text, **options).select("__row", "class_id")
    classes = staged(found.join(rows.select("__row", F.col(doc_id).alias("__id")), "__row"), "near")
    first = F.min(F.struct(F.col("__id").isNull().alias("no"), "__id", "__row"))["__row"]
    keep = classes.groupBy("class_id").agg(first.alias("__row"))
    gone = staged(classes.select("__row").join(keep.select("__row"), "__row", "left_anti"), "gone")
    return join_checked(rows, gone, ["__row"], "left_anti").drop("__row")
