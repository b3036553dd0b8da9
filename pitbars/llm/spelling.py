"""Spelling variants: words one edit apart, found through PartEnum signatures.

A word's letters are a binary vector: one dimension for the first ``a``, one for the second,
and so on. One inserted or deleted letter changes one dimension, one replaced letter two, so
words one edit apart lie within Hamming distance two. The dimensions are cut into ``PARTS``
parts by the letter's code point. At most two parts can differ, so two near words agree on
all of some ``PARTS - 2`` parts: for each such choice the sorted letters in them are one exact
signature, and near words share at least one.

Letters alone bring all anagrams together, far more than one edit apart. A signature therefore
also says where the edit may lie. Let ``m`` be the length of the shorter word (a word is listed
under its own length and one less). The ``m`` places are cut into ``SEGMENTS`` runs; an edit
lies in one of them, so near words agree on everything before and after that run. Both
conditions hold for every near pair: the narrower signature loses none, and signature groups
stay small whatever the vocabulary. Signatures are compared as 64-bit hashes in an equi-join
whose condition is the verification itself, so only words truly one edit apart leave the join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.session import staged

#: Parts of the letters' dimensions; near words differ in at most two of them.
PARTS = 3
#: Runs of places one of which holds the edit.
SEGMENTS = 4
HAMMING = 2
MIN_LETTERS, MIN_COUNT, NOISE = 7, 2, 31
#: A near word names a word's form if it occurs at least so many times as often.
RATIO = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(
    df: DataFrame, *, doc_id: Column, text: Column, min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT, noise: int | None = NOISE,
) -> DataFrame:
    """``word, n``: words of whole texts with at least ``min_letters`` letters and their counts.

    A run is a maximal sequence of ``A-Z a-z`` and U+00C0 to U+00FF; only A-Z is lower-cased.
    With ``noise``, a run loses one letter if ``noise`` divides the unsigned CRC-32 ``h`` of
    ``<doc_id>:<run>``: the one at ``h`` modulo its length. Words of fewer than ``min_count``
    occurrences are left out. A null text has no words; a null id counts as an empty one;
    repeated rows count again; other columns are not read.
    """
    # A run that is too short before a letter is taken from it is too short afterwards.
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{min_letters},}}+"), F.lit(0))
    found = df.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("r"))
    found = found.select("d", F.translate("r", _UPPER, _LOWER).alias("word"))
    if noise is not None:
        found = found.select("word", F.crc32(F.concat("d", F.lit(":"), "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        found = found.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
        found = found.where(F.length("word") >= min_letters)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _with_parts(words: DataFrame) -> DataFrame:
    """Adds ``parts``: the sorted letters of each part of the dimensions."""
    letters = F.split("word", "")

    def part(p: int) -> Column:
        return F.array_join(F.array_sort(F.filter(letters, lambda c: (c != "") & (F.ascii(c) % PARTS == p))), "")

    return words.withColumn("parts", F.array(*[part(p) for p in range(PARTS)]))


def _signatures() -> Column:
    """Hashes of all of a word's signatures, from ``word`` and ``parts``."""
    word, out = F.col("word"), []
    length = F.length(word)
    for number, choice in enumerate(combinations(range(PARTS), PARTS - HAMMING)):
        agreed = [F.col("parts")[p] for p in choice]
        for shorter in (length, length - 1):
            for run in range(SEGMENTS):
                start = F.floor(shorter * run / SEGMENTS).cast("int")
                end = F.floor(shorter * (run + 1) / SEGMENTS).cast("int")
                tail = length - (shorter - end) + 1
                out.append(F.xxhash64(
                    F.lit(SEGMENTS * number + run), *agreed, shorter,
                    F.substr(word, F.lit(1), start), F.substr(word, tail),
                ))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: every two different words one edit apart, once, with ``a`` before ``b``.

    ``words`` holds ``word`` and ``parts``. Both sides of the join are one shuffle.
    """
    signed = words.select(F.explode(_signatures()).alias("key"), "word")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word"))
    near = near & (F.levenshtein("x.word", "y.word", 1) == 1)
    met = signed.alias("x").join(signed.alias("y"), near)
    return met.select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).distinct()


def group_spellings(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of a table ``word, n``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. Of these the
    one of largest ``n`` (ties: the first in code-point order) is the ``form``, if its ``n`` is
    at least ``ratio`` times the word's own. ``root`` is where following forms ends, the word
    itself without one. Words are distinct and not null; an empty table gives no rows. Stores
    the words and near pairs while the plan is built.
    """
    words = staged(_with_parts(words.select("word", F.col("n").cast("bigint").alias("n"))), "words")
    pairs = staged(near_pairs(words), "near-words")
    words = words.drop("parts")
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p"))
    near = both.select("p.*").join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    joined = words.join(near, "word", "left")
    named = -F.col("best.less") >= ratio * F.col("n")
    joined = staged(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(named, F.col("best.other")).alias("form"), F.when(named, -F.col("best.less")).alias("form_n"),
        ), "forms",
    )
    roots = _roots(joined.where("form is not null").select("word", F.col("form").alias("root")))
    return joined.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def _roots(up: DataFrame) -> DataFrame:
    """``word, root`` with pointers followed to their ends, doubling the steps each round.

    A form occurs ``RATIO`` times as often as its word, so chains are short and never circular.
    """
    up = staged(up, "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return up
