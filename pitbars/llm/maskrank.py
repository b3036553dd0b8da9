"""Ranked lexical search by presence masks.

Documents become an index of the terms that items ask for: one row a document, with its
number of terms and, of each asked term it holds, how often. The index is then read in blocks
of documents. In a block every term has a bitmap of the documents that hold it. An item's
bitmaps, read across, give each document's mask of matched terms; documents of one mask form a
group. A mask's greatest possible score is the sum, over its terms, of the term's weight times
its largest share in the block. Masks are evaluated from the greatest possible score down, and
an item is finished with a block once that falls below the score of its last place. Nothing is
estimated: a mask that is passed over could not have changed the result.

Places are kept from block to block, so later blocks evaluate little. A task hands on at most
``k`` rows an item, and those are ranked again per item in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.llm.text import _IS_WORD, _LOWER, BLOCK_BYTES, lists
from pitbars.llm.topk import top_rows
from pitbars.session import staged

#: About so many (item, term) rows are looked for in one reading of the documents.
CHUNK_TERMS = 100_000
#: Cells of the table of terms by documents that a block may have.
_CELLS = 8 << 20
_BLOCK_DOCS, _STEP_DOCS = 4096, 128
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LAST = np.iinfo(np.int64).max


def tokens(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """Blocks of texts as ``first text, number of texts, text of each term, terms``.

    Terms are runs of ``0-9 a-z`` and of all non-ASCII characters, after A-Z is lower-cased.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
        stop = min(max(stop, at + 1), n)
        folded = _LOWER[data[offsets[at] : offsets[stop]]]
        borders = offsets[at : stop + 1] - offsets[at]
        word = _IS_WORD[folded]
        # The byte before and after every place, with a gap at each border between texts.
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = borders[1:-1]
        before[inner[inner < len(word)]] = False
        after[inner[inner > 0] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        edges = np.empty(2 * len(starts), dtype=np.int64)
        edges[0::2], edges[1::2] = starts, ends
        if len(starts):
            every = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(folded))
            terms = every.take(pa.array(np.arange(0, len(edges) - 1, 2)))
        else:
            terms = pa.array([], pa.large_string())
        yield at, stop - at, np.searchsorted(borders, starts, "right") - 1, terms
        at = stop


def index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``doc_id, n, terms, times`` per document with a term: its asked terms, as places in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for batch in batches:
            for first, count, text, terms in tokens(batch.column(1)):
                n = np.bincount(text, minlength=count)
                known = pc.index_in(terms, value_set=vocabulary)
                hit = np.flatnonzero(np.asarray(known.is_valid()))
                number = known.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
                cell, times = np.unique(text[hit] * size + number, return_counts=True)
                some = np.flatnonzero(n > 0)
                held = np.bincount(cell // size, minlength=count)[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, count).take(pa.array(some)), pa.array(n[some]),
                     lists((cell % size).astype(np.int32), held), lists(times.astype(np.int32), held)],
                    names=["doc_id", "n", "terms", "times"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


@dataclass
class Item:
    """An item's terms, as places in the vocabulary, their weights, and its best places so far."""

    terms: np.ndarray
    weights: np.ndarray
    scores: np.ndarray
    ids: np.ndarray

    def last(self, k: int) -> int:
        return int(self.scores[k - 1]) if len(self.scores) >= k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        good = scores >= self.last(k)
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        best = np.lexsort((ids, -scores))[:k]
        self.scores, self.ids = scores[best], ids[best]


def _masks(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of a boolean table: a document of each, and each document's group."""
    bits = np.packbits(held, axis=0)
    packed = np.zeros((held.shape[1], -(-len(bits) // 8) * 8), dtype=np.uint8)
    packed[:, : len(bits)] = bits.T
    words = packed.view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return first, group.reshape(-1)


def search_block(
    items: list[Item], ids: np.ndarray, m: np.ndarray, owner: np.ndarray, term: np.ndarray, times: np.ndarray,
    size: int, k: int,
) -> int:
    """Offer a block's documents to all items; returns how many were evaluated."""
    share = np.zeros((size, len(ids)), dtype=np.int32)
    present = np.zeros((size, len(ids)), dtype=bool)
    share[term, owner] = (1_000_000_000 * times) // (1000 * times + 8 * m[owner])
    present[term, owner] = True
    largest, evaluated = share.max(axis=1, initial=0).astype(np.int64), 0
    for item in items:
        held = present[item.terms]
        first, group = _masks(held)
        bound = (item.weights * largest[item.terms]) @ held[:, first].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        docs = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
        at = 0
        while at < len(order) and bound[order[at]] >= item.last(k):
            begin = ends[at - 1] if at else 0
            # Whole masks, until a step's worth of documents has come together.
            stop = min(int(np.searchsorted(ends, begin + _STEP_DOCS)) + 1, len(order))
            chosen = docs[begin : ends[stop - 1]]
            item.offer(item.weights @ share[np.ix_(item.terms, chosen)].astype(np.int64), ids[chosen], k)
            evaluated += len(chosen)
            at = stop
    return evaluated


def _best(indexed: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], size: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's best ``k`` documents of every item."""
    step = max(32, min(_BLOCK_DOCS, _CELLS // max(size, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        items = [Item(terms, weights, none, none) for terms, weights in asked]
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                ids = batch.column(0).fill_null(_LAST).to_numpy()
                m = 10 + (90 * batch.column(1).to_numpy() * n_docs) // n_terms
                term, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                owner = np.repeat(np.arange(len(ids)), np.asarray(batch.column(2).value_lengths()))
                search_block(items, ids, m, owner, term, times, size, k)
        number = np.repeat(np.arange(len(items)), [len(i.ids) for i in items])
        ids = np.concatenate([none] + [i.ids for i in items])
        scores = np.concatenate([none] + [i.scores for i in items])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number.astype(np.int32)), pa.array(ids, mask=ids == _LAST), pa.array(scores)],
            names=["item", "doc_id", "score"],
        )

    return indexed.mapInArrow(run, "item int, doc_id bigint, score bigint")


def rank(
    docs: DataFrame, items: DataFrame, *, doc_id: Column, text: Column, item_id: Column, item_text: Column, k: int = 10,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, best first.

    Scores are integers as laid down in the contract of the query: a term weighs
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and counts with its share
    ``10^9 tf div (1000 tf + 8 m)``, where ``m = 10 + 90 n N div L``. Documents of equal score
    come by their id, those without an id last. Every row is a document; repeated rows are
    ranked each for themselves. Rows that repeat an item's id are one item with the terms of
    all of them, and so are rows without one. Null and empty texts have no terms; items
    without a match have no rows. Other columns are not read. Ids are integers.

    Items are taken ``CHUNK_TERMS`` terms at a time; each such part reads the documents once.
    Stores the items' terms, the index and the tasks' best rows while the plan is built.
    """
    lowered = F.translate(item_text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = staged(
        items.select(
            item_id.cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")
        ).distinct(), "item-terms",
    )
    narrow = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))
    parts = max(1, -(-wanted.count() // CHUNK_TERMS))
    found = []
    for part in range(parts):
        table = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        found.append(_rank_part(narrow, table, k))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = top_rows(out, ["item_id"], order, k, spread=F.col("doc_id"), place="rank")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _rank_part(docs: DataFrame, table: pa.Table, k: int) -> DataFrame:
    spark = docs.sparkSession
    keys = pc.dictionary_encode(table.column("item_id"), null_encoding="encode").combine_chunks()
    terms = pc.dictionary_encode(table.column("term")).combine_chunks()
    if isinstance(keys, pa.ChunkedArray):
        keys, terms = keys.chunk(0), terms.chunk(0)
    names, vocabulary = keys.dictionary.to_pylist(), terms.dictionary.cast(pa.large_string())
    size = len(vocabulary)
    indexed = staged(index(docs, vocabulary), "term-index")
    n_docs, n_terms = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    weighed = held.select(
        "term", F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint").alias("w")
    ).toArrow()
    weights = np.zeros(size, dtype=np.int64)
    weights[weighed.column("term").to_numpy()] = weighed.column("w").to_numpy()
    item, term = keys.indices.to_numpy(), terms.indices.to_numpy().astype(np.int64)
    order = np.lexsort((term, item))
    item, term = item[order], term[order]
    asked = [(t, weights[t]) for t in np.split(term, np.flatnonzero(np.diff(item)) + 1)] if len(item) else []
    best = staged(_best(indexed, asked, size, int(n_docs), max(int(n_terms), 1), k), "best-rows")
    numbered = spark.createDataFrame(list(enumerate(names)), "item int, item_id bigint")
    return best.join(F.broadcast(numbered), "item").select("item_id", "doc_id", "score")
