"""Benchmark decontamination by winnowing.

A text is fingerprinted by the smallest hash of every ``w`` consecutive ``k``-word hashes.
Two texts that share ``w + k - 1`` words in a row then share a fingerprint inside them, so
joining fingerprints finds every shared span of that length. Hits are extended: the full
windows around a shared fingerprint are compared by a second, independent 128-bit hash.

Items of at least ``window`` words are held in windows of that many words. A shorter item is
one window of its own length, which is a guarantee length of its own: ``k`` and ``w`` follow
from the length (``k = (length + 1) // 2``), so there are at most ``window`` parameter sets.

Rows of the training side are fingerprinted where they are read. A bit table of fixed size,
made from the benchmark's fingerprints, lets pass what can join; it only saves work, since
the join decides. What passes is narrow: a fingerprint and the hashes of the windows over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.text import Block, _Powers, blocks, grams, grams_at, lists, signed, small_batches
from pitbars.session import staged

WINDOW = 13
FILTER_BITS = 22


def gram_and_frame(length: int) -> tuple[int, int]:
    """``k`` and ``w`` that guarantee every shared span of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def winnow(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of some frame of ``w`` valid hashes; ties are all kept."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # Frames lie within one text: their first and last hash are valid and so is all between.
    gaps = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.cumsum(~valid, out=gaps[1:])
    whole = gaps[w:] == gaps[:n]
    least = hashes[:n].copy()
    for j in range(1, w):
        np.minimum(least, hashes[j : j + n], out=least)
    top = np.zeros(len(hashes), dtype=np.uint64)
    framed = np.zeros(len(hashes), dtype=bool)
    chosen = np.where(whole, least, 0)
    for j in range(w):
        np.maximum(top[j : j + n], chosen, out=top[j : j + n])
        framed[j : j + n] |= whole
    return np.flatnonzero(framed & (top == hashes))


def fingerprints(
    block: Block, length: int, bits: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed positions of a block with the hashes of the windows over each.

    Returns text index, word position, fingerprint and, as arrays ``[n, 2 * frames]``, two
    hashes for each window that holds the fingerprint, 0 where a window leaves the text.
    """
    k, w = gram_and_frame(length)
    hashes, valid = grams(block, k)
    at = winnow(hashes, valid, w)
    if bits is not None and len(at):
        at = at[bits[(hashes[at] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
    frames = length - k + 1
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros((0, 2 * frames), np.uint64)
    starts = at[:, None] - np.arange(frames)[None, :]
    low = block.bounds[block.text[at]][:, None]
    high = block.bounds[block.text[at] + 1][:, None]
    inside = (starts >= low) & (starts + length <= high)
    safe = np.where(inside, starts, at.min() if len(block.hash) < length else 0)
    safe = np.minimum(safe, max(len(block.hash) - length, 0))
    windows = np.empty((len(at), 2 * frames), dtype=np.uint64)
    for j, salt in ((0, 1), (1, 2)):
        if len(block.hash) >= length:
            windows[:, j::2] = np.where(inside, grams_at(block, safe, length, salt), 0)
        else:
            windows[:, j::2] = 0
    return block.text[at], at, hashes[at], windows


def _printed(batch: pa.RecordBatch, id_name: str, text_name: str, lengths: Sequence[int],
             bits: np.ndarray | None, powers: _Powers, whole_items: bool) -> Iterator[pa.RecordBatch]:
    ids, column = batch.column(id_name), batch.column(text_name)
    for block in blocks(column, powers):
        words = np.diff(block.bounds)
        made = []
        for length in lengths:
            text, at, prints, windows = fingerprints(block, length, bits)
            if whole_items and len(text):
                # The last length serves all items of at least that many words.
                size = words[text]
                own = size >= length if length == max(lengths) else size == length
                text, at, prints, windows = text[own], at[own], prints[own], windows[own]
            made.append((length, text, at, prints, windows))
        text = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int64)
        order = np.argsort(text, kind="stable")
        counts = np.bincount(text, minlength=block.count).astype(np.int64)
        flat = np.concatenate([m[4].reshape(-1) for m in made]) if made else np.zeros(0, np.uint64)
        widths = np.concatenate([np.full(len(m[1]), m[4].shape[1]) for m in made]) if made else counts[:0]
        sizes = np.concatenate([np.full(len(m[1]), m[0]) for m in made]) if made else counts[:0]
        position = np.concatenate([m[2] for m in made]) if made else counts[:0]
        prints = np.concatenate([m[3] for m in made]) if made else np.zeros(0, np.uint64)
        place = position - block.bounds[text] if len(text) else position
        heads = np.concatenate([[0], np.cumsum(widths)])[:-1].astype(np.int64)
        pick = np.concatenate([np.arange(heads[i], heads[i] + widths[i]) for i in order]).astype(np.int64) if len(order) else order
        windows = lists(signed(flat[pick]), widths[order]) if len(order) else pa.array([], pa.list_(pa.int64()))
        structs = pa.StructArray.from_arrays(
            [pa.array(sizes[order].astype(np.int32)), pa.array(place[order].astype(np.int32)),
             pa.array(signed(prints[order])), windows],
            names=["length", "at", "print", "windows"],
        )
        ends = np.zeros(block.count + 1, dtype=np.int32)
        np.cumsum(counts, out=ends[1:])
        yield pa.RecordBatch.from_arrays(
            [ids.slice(block.first, block.count), pa.array(words.astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(ends), structs)],
            names=["id", "n_words", "prints"],
        )


def print_table(
    df: DataFrame, id_name: str, text_name: str, lengths: Sequence[int],
    bits: np.ndarray | None = None, *, whole_items: bool = False,
) -> DataFrame:
    """One row per text: ``id, n_words, prints array<struct<length, at, print, windows>>``."""
    lengths = tuple(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            yield from _printed(batch, "id", "text", lengths, bits, powers, whole_items)

    narrow = df.select(F.col(id_name).alias("id"), F.col(text_name).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"id {kind}, n_words bigint, "
        "prints array<struct<length: int, at: int, print: bigint, windows: array<bigint>>>",
    )


def _word_counts(df: DataFrame, text_name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for block in blocks(batch.column(0), powers):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(block.bounds).astype(np.int64))], names=["n"]
                )

    return df.select(F.col(text_name).alias("text")).mapInArrow(run, "n bigint")


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document, the spans that occur in the benchmark.

    Returns ``doc_id, n_words, n_hit, n_items, items array<string>, spans
    array<struct<start, end>>`` with word positions, overlapping windows merged. One row per
    document row, repeated rows and repeated ids included. Null or wordless texts have no
    words and no hits; items without words are left out; an empty benchmark hits nothing.
    Repeated items count once, and one without an id hits but is not listed. Other columns of
    either side are not read. Runs jobs while the plan is being built: the benchmark's lengths
    (at most ``window`` numbers) and its bit table go through the driver; fingerprints that
    passed it, the benchmark's windows and the hits are stored.
    """
    small_batches(documents.sparkSession)
    counts = _word_counts(benchmark, item_text)
    sizes = counts.select(F.least("n", F.lit(window)).alias("n")).where("n > 0").distinct()
    lengths = sorted(int(r.n) for r in sizes.collect())
    items = staged(
        print_table(benchmark, item_id, item_text, lengths, whole_items=True)
        .select("id", F.explode("prints").alias("p")).select("id", "p.length", "p.print", "p.windows")
        if lengths
        else benchmark.select(
            F.col(item_id).alias("id"), F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("print"),
            F.array(F.lit(0).cast("bigint")).alias("windows"),
        ).limit(0),
        "item-prints",
    )
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    mask = (1 << FILTER_BITS) - 1
    # At most 2**22 numbers, whatever the benchmark's size.
    slots = items.select(F.col("print").bitwiseAND(mask).alias("slot")).distinct().toArrow()
    bits[slots.column("slot").to_numpy()] = True
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = _Powers(), np.unpackbits(packed).astype(bool)
        for batch in batches:
            yield from _printed(batch, "id", "text", lengths, table, powers, False)

    narrow = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    printed = narrow.mapInArrow(
        run,
        f"id {kind}, n_words bigint, "
        "prints array<struct<length: int, at: int, print: bigint, windows: array<bigint>>>",
    )
    # Row numbers are fixed by storing them, so repeated ids stay apart.
    docs = staged(printed.withColumn("row", F.monotonically_increasing_id()), "doc-prints")
    hits, items_of = _extended(docs.select("row", F.explode("prints").alias("p")).select("row", "p.*"), items)
    joined = docs.select("row", "id", "n_words").join(_merged(hits), "row", "left").join(items_of, "row", "left")
    return joined.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
    )


def _windows(prints: DataFrame) -> DataFrame:
    """A row for each window over a fingerprint: its place ``frame`` and its two hashes ``a, b``."""
    rest = [c for c in prints.columns if c != "windows"]
    placed = prints.select(
        "*", F.explode(F.sequence(F.lit(0), (F.size("windows") / 2).cast("int") - 1)).alias("frame")
    )
    return placed.select(
        *rest, "frame", F.get("windows", 2 * F.col("frame")).alias("a"), F.get("windows", 2 * F.col("frame") + 1).alias("b")
    ).where("a <> 0 or b <> 0")


def _extended(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join fingerprints with the windows over them: ``row, start, end`` and ``row, items``.

    A window of the benchmark is matched once, however many items hold it. Windows held by the
    same items are one set, told by fixed-size sums over the items' hashes; a document meets a
    set once, whatever the number of windows, and only then the items of the set.
    """
    held = staged(_windows(items), "item-windows")
    known = held.select("length", "print", "frame", "a", "b").distinct()
    hits = staged(
        _windows(docs).join(known, ["length", "print", "frame", "a", "b"])
        .select("row", (F.col("at") - F.col("frame")).alias("start"), "length", "a", "b").distinct(),
        "hits",
    )
    members = held.select("length", "a", "b", "id").distinct()
    sets = members.groupBy("length", "a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    )
    sets = staged(sets, "item-sets")
    window = ["length", "a", "b"]
    of_set = members.join(sets, window).select("n", "x", "y", F.col("id").cast("string").alias("item")).distinct()
    met = hits.select("row", *window).join(sets, window).select("row", "n", "x", "y").distinct()
    items_of = met.join(of_set, ["n", "x", "y"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return hits.select("row", "start", (F.col("start") + F.col("length")).alias("end")), items_of


def _merged(hits: DataFrame) -> DataFrame:
    """``row, n_hit, spans`` with windows that overlap or touch merged, in one pass over them."""
    inside = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    runs = hits.distinct().withColumn("opens", opens).withColumn(
        "span", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    spans = runs.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )


def digest(items: list[str]) -> str:
    """What the query reports of a list of items; the same as its SQL expression."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
