"""Personal data by pattern, and what reveals it by information content.

Patterns find protected entities (addresses, numbers). In their documents, single words can give
an entity away although they match no pattern: a name and a phone number. How strongly a word
reveals an entity is estimated from the corpus: the pointwise mutual information of the two,
as a share of the entity's own information content,

    log2(N n_te / (n_t n_e)) / log2(N / n_e),

where ``n`` count documents of the whole corpus. It is 1 for a word that occurs nowhere but
with the entity. Words at or over the threshold are generalised, or removed, wherever they
stand in a document that holds the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.llm.graph import join_checked
from pitbars.session import staged

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information a word may give away, and the documents it takes to tell.
THRESHOLD = 0.9
SUPPORT = 3
FILTER_BITS = 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that starts within a run of digits would be one from the run's start, so looking
# behind loses none and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``local@domain`` found from each ``@``, left to right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` in code points, by kind and then start; failing matches dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _entity(kind: int, text: str) -> int:
    """One number for an entity however it is written: digits only, or lower case."""
    plain = text.lower() if kind < 2 else "".join(_DIGIT.findall(text))
    return _hash(f"{KINDS[kind]}:{plain}")


def distinct_words(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``term, start, end`` of the words outside all base spans."""
    taken = sorted((a, b) for _, a, b in spans)
    out, at, reach = [], 0, 0
    hashes: dict[str, int] = {}
    for m in _WORD.finditer(text):
        x, y = m.span()
        while at < len(taken) and taken[at][0] < y:  # spans that start before the word's end
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= x:
            word = m.group()
            if word not in hashes:
                hashes[word] = _hash(word.lower())
            out.append((hashes[word], x, y))
    return out


_FOUND = pa.schema(
    [("id", pa.int64()), ("counts", pa.list_(pa.int64())), ("base", pa.string()),
     ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())),
     ("words", pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))]
)
#: A batch of scanned rows is passed on at so many rows, or so many words.
_FULL = 2000, 20_000


def _scan(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for number, value in zip(batch.column(0), batch.column(1)):
                body = value.as_py() or ""
                spans = base_spans(body)
                counts = [0] * len(KINDS)
                for kind, _, _ in spans:
                    counts[kind] += 1
                rows.append(
                    {
                        "id": number.as_py(), "counts": counts, "base": joined(spans),
                        "entities": sorted({_entity(k, body[a:b]) for k, a, b in spans}),
                        "terms": [_hash(w) for w in distinct_words(body)] if spans else [],
                        "words": [dict(zip(("term", "start", "end"), w)) for w in free_words(body, spans)] if spans else [],
                    }
                )
                held += len(rows[-1]["words"])
                if len(rows) >= _FULL[0] or held >= _FULL[1]:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    narrow = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(
        run,
        "id bigint, counts array<bigint>, base string, entities array<bigint>, terms array<bigint>, "
        "words array<struct<term: bigint, start: int, end: int>>",
    )


def _term_documents(df: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """``term, n``: documents of the whole corpus that hold each word.

    Words are counted within a task before anything is shuffled; the table held meanwhile is
    bounded and passed on when full. Of words that ``asked`` (a ``term`` column) does not name
    most are left behind, by a bit table of fixed size; the join that follows decides.
    """
    most, mask = 300_000, (1 << FILTER_BITS) - 1
    slots = asked.select(F.col("term").bitwiseAND(mask).alias("slot")).distinct().toArrow()  # 2**22 at most
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[slots.column("slot").to_numpy()] = True
    packed = np.packbits(bits)

    def flushed(held: dict[str, int]) -> pa.RecordBatch:
        wanted = np.unpackbits(packed).astype(bool)
        terms = np.array([_hash(t) for t in held], dtype=np.int64)
        counts = np.fromiter(held.values(), np.int64, len(held))
        pick = wanted[terms & mask]
        return pa.RecordBatch.from_arrays([pa.array(terms[pick]), pa.array(counts[pick])], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for value in batch.column(0):
                for word in distinct_words(value.as_py() or ""):
                    held[word] = held.get(word, 0) + 1
                if len(held) >= most:
                    yield flushed(held)
                    held = {}
        yield flushed(held)

    return df.select(F.col(text).alias("text")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")
    )


def _score(n_rows: int, n_t: str) -> Column:
    total = F.lit(float(n_rows))
    own = F.log2(total / F.col("n_e"))
    return F.when(own > 0, F.log2(total * F.col("n_te") / (F.col(n_t) * F.col("n_e"))) / own)


def pairs(holders: DataFrame, worded: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """``row, entity, term, n_e, n_d``: who is together in a document and may disclose.

    ``holders`` are ``row, entity, n_e``; ``worded`` are ``row, term, n_d`` with the documents,
    of those that hold entities, that have the word. As ``n_te`` is at most ``n_e`` and ``n_t`` at
    least ``n_d``, a word over the bound stays under the threshold with the entity.
    """
    bound = F.pow("n_e", F.lit(float(threshold))) * F.pow(F.lit(float(n_rows)), F.lit(1.0 - threshold))
    return holders.join(worded, "row").where(F.col("n_d") <= bound * (1 + 1e-9))


def candidates(together: DataFrame, n_rows: int, threshold: float, support: int) -> DataFrame:
    """``entity, term, n_e, n_te`` of the pairs that could be at the threshold, were ``n_t`` least."""
    counted = together.groupBy("entity", "term", "n_e", "n_d").agg(F.count(F.lit(1)).alias("n_te"))
    return counted.where(F.col("n_te") >= support).where(_score(n_rows, "n_d") >= threshold - 1e-9).drop("n_d")


def disclosing(asked: DataFrame, terms: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """``entity, term, disclosure`` of the candidates at or over the threshold."""
    scored = asked.join(terms.withColumnRenamed("n", "n_t"), "term")
    return scored.select("entity", "term", _score(n_rows, "n_t").alias("disclosure")).where(F.col("disclosure") >= threshold)


def find(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT
) -> DataFrame:
    """``doc_id, counts, base, terms`` for every row.

    ``counts`` are the base spans by kind, ``base`` is their text form, and ``terms`` the
    spans ``array<struct<start, end>>`` of words that disclose an entity of their document. Null
    texts are empty. A word is looked at in lower case; words inside base spans count, but are
    no terms. Pairs of fewer than ``support`` documents tell nothing, so no word is held against
    an entity of fewer. Rows of one id are told apart, an empty table gives no rows, and other
    columns are not read. Stores what the scan found (of texts only the words' hashes and places,
    where a document holds an entity) while the plan is being built; texts are read twice.
    """
    found = staged(_scan(df, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pii")
    n_rows = found.count()
    each = found.select("row", F.explode("entities").alias("entity"))
    known = staged(
        each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support), "entities"
    )
    holders = staged(join_checked(each, known, ["entity"], "inner"), "holders")
    rows = staged(holders.select("row").distinct(), "rows")
    # Words are counted over all documents that hold any entity: a lower bound of n_t.
    worded = found.select("row", F.explode("terms").alias("term"))
    n_d = worded.groupBy("term").agg(F.count(F.lit(1)).alias("n_d"))
    n_d = staged(n_d.where(F.col("n_d") >= support), "held")
    kept = join_checked(worded, rows, ["row"], "left_semi")
    together = staged(pairs(holders, join_checked(kept, n_d, ["term"], "inner"), n_rows, threshold), "pairs")
    asked = staged(candidates(together, n_rows, threshold, support), "candidates")
    flagged = staged(disclosing(asked, _term_documents(df, text, asked), n_rows, threshold), "disclosing")
    marked = staged(
        join_checked(together, flagged.select("entity", "term"), ["entity", "term"], "inner").select("row", "term").distinct(),
        "marked",
    )
    words = join_checked(found.select("row", "words"), rows, ["row"], "left_semi").select("row", F.explode("words").alias("w"))
    terms = join_checked(words.select("row", "w.*"), marked, ["row", "term"], "inner").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("marks")
    )
    return found.join(terms, "row", "left").select(
        F.col("id").alias(doc_id), "counts", "base",
        F.coalesce("marks", F.array().cast("array<struct<start: int, end: int>>")).alias("terms"),
    )


def redact(text: str, spans: list[tuple[str, int, int]], *, remove_terms: bool = False) -> str:
    """The text with every span generalised to its kind in brackets, or terms removed.

    Of overlapping spans the one that starts first, and is longest, counts.
    """
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b) if b > at else at
            continue
        out += [text[at:a], "" if kind == TERM and remove_terms else f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def sanitise(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", remove_terms: bool = False, **options
) -> DataFrame:
    """``doc_id, text`` with base spans and disclosing terms generalised or removed.

    ``doc_id`` has to be unique here: it joins texts and spans. Rows without an id are left out.
    """
    found = find(df, doc_id=doc_id, text=text, **options).where(F.col(doc_id).isNotNull())
    body = df.select(F.col(doc_id).cast("bigint").alias(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, base, terms in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                spans += [(TERM, t["start"], t["end"]) for t in terms]
                made.append(redact(value, spans, remove_terms=remove_terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[doc_id, "text"])

    joined_rows = body.join(found, doc_id).select(doc_id, "text", "base", "terms")
    return joined_rows.mapInArrow(run, f"{doc_id} bigint, text string")
