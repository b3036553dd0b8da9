"""Language identification by compression.

For each language a sample of labelled texts becomes a raw-content zstandard dictionary. A
text is encoded with every dictionary, in chunks so that the dictionary counts throughout a
long text, and the language that makes it smallest is predicted. Where the best two differ by
less than ``MARGIN`` of the size the prediction is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitbars.llm.text import small_batches

#: Bytes of labelled text a dictionary holds at most, and the texts it may be made of.
DICTIONARY_BYTES = 96 * 1024
SAMPLE_TEXTS = 200
SAMPLE_CHARS = (100, 16_000)
CHUNK_BYTES = 2048
LEVEL = 5
#: A run after each chunk, cheap to encode: without it the encoder would store a short chunk
#: plainly and every language would come out alike.
TAIL = b"\n" * 256
#: The smallest lead, as a share of the second best size, that is not narrow. Labelled texts
#: lead by a tenth and more, texts of no learned language mostly by a hundredth or less.
MARGIN = 0.02

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def folded(text: str) -> bytes:
    """Lower case with single spaces, so that shouting and layout do not hide a language."""
    return " ".join(text.lower().split()).encode()


@dataclass(frozen=True)
class Model:
    dictionaries: dict[str, bytes]


def fit(df: DataFrame, text: Column, lang: Column, row_id: Column) -> Model:
    """Sample texts of each language and lay them end to end.

    The bound is ``SAMPLE_TEXTS`` texts and ``DICTIONARY_BYTES`` bytes a language; texts are
    drawn by a hash of their id among those of ``SAMPLE_CHARS`` characters, or among all texts
    of a language that has none of those. Null languages and null texts teach nothing.
    """
    rows = df.select(row_id.alias("id"), lang.alias("lang"), text.alias("text")).where(
        "lang is not null and length(text) > 0"
    )
    low, high = SAMPLE_CHARS
    size = F.length("text")
    rows = rows.withColumn("fit", size.between(low, high))
    counts = {
        (r.lang, r.fit): r["count"] for r in rows.groupBy("lang", "fit").count().collect()
    }
    wanted = F.lit(0.0)
    for lang_name in sorted({k[0] for k in counts}):
        fitting = (lang_name, True) in counts
        n = counts[(lang_name, fitting)]
        # Twice the number needed is drawn, the exact number is kept by rank.
        wanted = F.when(
            (F.col("lang") == lang_name) & (F.col("fit") == fitting), F.lit(2.0 * SAMPLE_TEXTS / n + 50.0 / n)
        ).otherwise(wanted)
    order = F.xxhash64("id", F.lit(7))
    even = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    drawn = rows.where(even < wanted).select("lang", "id", order.alias("order"), F.substring("text", 1, high).alias("text"))
    # Folding leaves a byte at least of every character that is no space, so what comes after
    # that many characters cannot reach the dictionary and stays out of the driver.
    solid = F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]", ""))
    ahead = Window.partitionBy("lang").orderBy("order", F.col("id").cast("string"), "text").rowsBetween(
        Window.unboundedPreceding, -1
    )
    drawn = drawn.withColumn("ahead", F.coalesce(F.sum(solid).over(ahead), F.lit(0))).where(
        F.col("ahead") < DICTIONARY_BYTES
    ).drop("ahead")
    parts: dict[str, list[bytes]] = {}
    for r in sorted(drawn.toArrow().to_pylist(), key=lambda r: (r["lang"], r["order"], str(r["id"]), r["text"])):
        kept = parts.setdefault(r["lang"], [])
        if len(kept) < SAMPLE_TEXTS:
            kept.append(folded(r["text"]))
    return Model({k: b"\n".join(v)[:DICTIONARY_BYTES] for k, v in parts.items()})


class Coder:
    """The compressors of a model; made once a task."""

    def __init__(self, model: Model) -> None:
        self.by_language = []
        for name in sorted(model.dictionaries):
            held = zstandard.ZstdCompressionDict(
                model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            held.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.by_language.append((name, coder.compress))

    def sizes(self, data: bytes) -> list[tuple[int, str]]:
        chunks = [data[i : i + CHUNK_BYTES] + TAIL for i in range(0, len(data), CHUNK_BYTES)]
        return sorted((sum(len(code(c)) for c in chunks), name) for name, code in self.by_language)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1 and whether the lead is narrow.

        The score is the lead over the second best as a share of its size; it is narrow under
        ``MARGIN``. Ties go to the first name. A single learned language always wins with score 1.
        """
        if text is None or not self.by_language or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        ranked = self.sizes(folded(text))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        score = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], score, score < MARGIN


def predict(df: DataFrame, row_id: Column, text: Column, model: Model, **extra: Column) -> DataFrame:
    """``id, lang_pred, score, rejected`` and the ``extra`` columns for every row.

    Null texts, texts without a letter and any text of an empty model are ``und`` with score
    0 and rejected. The model, a bounded number of bytes a language, travels with the task.
    """
    small_batches(df.sparkSession)
    inputs = df.select(row_id.alias("id"), text.alias("text"), *[c.alias(n) for n, c in extra.items()])
    names = [n for n in inputs.columns if n != "text"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for batch in batches:
            told = [coder.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    return inputs.mapInArrow(run, f"{shape}, lang_pred string, score double, rejected boolean")
