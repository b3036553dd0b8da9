"""Token ids packed into rows of equal length by best-fit decreasing.

Documents are tokenised where they are read and cut, losslessly, into segments of at most a
row's length. Segments are packed in lots of a bounded number of tokens: longest first, each
into the row that it leaves least room in. A segment tree over capacities finds that row in
logarithmic time. Packing a lot where it was made moves no tokens between tasks; a lot holds
about a thousand rows, enough for nearly no padding.

Every lot is written as numpy files: the id matrix, cumulative segment lengths with an index
of rows, and the places where positions start again. Names are new for each attempt, and the
stored manifest lists only those of attempts that succeeded.
"""

from __future__ import annotations

import base64
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitbars.session import scratch, staged

ROW_TOKENS = 2048
LOT_TOKENS = 2_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts are encoded in pieces of about so many characters.
_PIECE = 16_384

# Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Places where the pattern always begins a new part: after letters before anything but letters
#: and spaces, and before one space between two other characters.
_BORDER = r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\S)(?= \S)"


def pieces(text: str, size: int = _PIECE) -> list[str]:
    """A text cut where the pattern has a border anyway, so its ids are those of the whole.

    Only a stretch of ``2 * size`` characters without any border, one word in effect, is cut
    inside; merging such a word whole would take time quadratic in its length.
    """
    import regex

    border, out, at = regex.compile(_BORDER), [], 0
    while len(text) - at > size:
        near = [m.start() for m in border.finditer(text, at + size - size // 8, at + size)]
        if not near:
            near = [m.start() for m in border.finditer(text, at + 1, at + size)]
        ahead = None if near else border.search(text, at + size, at + 2 * size)
        cut = near[-1] if near else ahead.start() if ahead else at + size
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out


class CapacityTree:
    """Open rows by remaining capacity, with the smallest sufficient one found top-down.

    A leaf per capacity holds a stack of rows; inner nodes count the rows below them.
    """

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, step: int) -> None:
        at = self.width + capacity
        while at:
            self.counts[at] += step
            at >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, needed: int) -> tuple[int, int] | None:
        """Remove and return ``(capacity, row)`` of the tightest row, or None."""
        counts, at = self.counts, self.width + needed
        if not counts[at]:
            # Up until a right neighbour has rows, then down its left side.
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        capacity = at - self.width
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and start of every segment, and the number of rows. Lengths are 1..capacity.

    Equal lengths keep their order, so the packing follows from the lengths alone.
    """
    row, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, rows = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        room, at = found if found else (capacity, rows)
        rows += found is None
        row[i], start[i] = at, capacity - room
        if room > size:
            tree.put(room - size, at)
    return row, start, rows


class Tokeniser:
    """A public byte-level vocabulary given by its rank lines (base64 and number)."""

    def __init__(self, lines: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.coding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype(np.uint16 if len(ranks) < 1 << 16 else np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids; long texts are encoded in :func:`pieces`."""
        parts = [np.asarray(self.coding.encode_ordinary(piece), dtype=self.kind) for piece in pieces(text)]
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def text(self, ids: np.ndarray) -> str:
        return self.coding.decode_bytes(ids.tolist()).decode("utf-8")


def _save(system: fs.FileSystem, path: str, array: np.ndarray) -> None:
    buffer = io.BytesIO()
    np.save(buffer, array)
    with system.open_output_stream(path, compression=None) as out:
        out.write(buffer.getbuffer())


def load(system: fs.FileSystem, path: str) -> np.ndarray:
    with system.open_input_stream(path, compression=None) as source:
        return np.load(io.BytesIO(source.read()))


class _Lot:
    """Segments gathered until a lot is full, then packed, written and listed."""

    def __init__(self, folder: str, capacity: int, first_row: int) -> None:
        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.capacity, self.next_row = folder, capacity, first_row
        self.parts: list[np.ndarray] = []
        self.listed: list[tuple] = []
        self.tokens = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        for number, start in enumerate(range(0, len(ids), self.capacity) if len(ids) else [0]):
            part = ids[start : start + self.capacity]
            self.parts.append(part)
            self.listed.append((doc, number, start, len(part)))
            self.tokens += len(part)

    def flush(self) -> pa.RecordBatch:
        lengths = np.array([x[3] for x in self.listed], dtype=np.int64)
        some = np.flatnonzero(lengths)
        row, start, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
        path = None
        if len(some):
            row[some], start[some], n = best_fit_decreasing(lengths[some], self.capacity)
            path = self._write(lengths, some, row, start, n)
        packed = lengths > 0
        docs, numbers, starts, _ = zip(*self.listed) if self.listed else ((), (), (), ())
        made = pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
             pa.array(self.next_row + row, mask=~packed), pa.array(start.astype(np.int32), mask=~packed),
             pa.array(lengths.astype(np.int32)), pa.array([path if p else None for p in packed], pa.string()),
             pa.array(row.astype(np.int32), mask=~packed)],
            names=["doc_id", "segment", "doc_start", "pack_id", "pack_start", "length", "path", "path_row"],
        )
        self.next_row += n
        self.parts, self.listed, self.tokens = [], [], 0
        return made

    def _write(self, lengths: np.ndarray, some: np.ndarray, row: np.ndarray, start: np.ndarray, n: int) -> str:
        name = uuid.uuid4().hex
        matrix = np.zeros((n, self.capacity), dtype=self.parts[some[0]].dtype)
        for i in some:
            matrix[row[i], start[i] : start[i] + lengths[i]] = self.parts[i]
        order = some[np.lexsort((start[some], row[some]))]
        per_row = np.bincount(row[order], minlength=n)
        index = np.concatenate([[0], np.cumsum(per_row)])
        self.system.create_dir(f"{self.base}/{name}", recursive=True)
        _save(self.system, f"{self.base}/{name}/ids.npy", matrix)
        _save(self.system, f"{self.base}/{name}/cu_lengths.npy", (start[order] + lengths[order]).astype(np.int32))
        _save(self.system, f"{self.base}/{name}/resets.npy", start[order].astype(np.int32))
        _save(self.system, f"{self.base}/{name}/rows.npy", index.astype(np.int64))
        return f"{self.folder}/{name}"


def pack(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    row_tokens: int = ROW_TOKENS, lot_tokens: int = LOT_TOKENS, folder: str | None = None,
) -> DataFrame:
    """Tokenise, pack and write the texts; returns the stored manifest.

    A row per segment: ``doc_id, segment, doc_start, pack_id, pack_start, length, path,
    path_row``. A document's segments in order hold its ids from ``doc_start`` on; a text
    without tokens (null or empty) is one segment of length 0 with no pack. Under ``path`` are

    * ``ids.npy``: matrix ``[rows, row_tokens]`` of ids, 0 after a row's last segment;
    * ``cu_lengths.npy``: where each segment of a row ends, rows one after another;
    * ``resets.npy``: where positions start again at 0, that is where each segment begins;
    * ``rows.npy``: at ``i`` and ``i + 1`` the stretch of both that belongs to row ``i``.

    The vocabulary file is read by the driver and sent along; it has a fixed size. ``doc_id``
    is an integer, may be null and may repeat; other columns are not read. An empty table
    gives an empty manifest. ``folder`` must be reachable by all executors.
    """
    with open(vocabulary, "rb") as source:
        sent = df.sparkSession.sparkContext.broadcast(source.read())
    folder = folder or scratch(df.sparkSession, "packs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokeniser(sent.value)
        lot = _Lot(folder, row_tokens, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for number, value in zip(batch.column(0), batch.column(1)):
                lot.add(number.as_py(), coder.ids(value.as_py() or ""))
                if lot.tokens >= lot_tokens:
                    yield lot.flush()
        yield lot.flush()

    narrow = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    made = narrow.mapInArrow(
        run,
        "doc_id bigint, segment int, doc_start bigint, pack_id bigint, pack_start int, length int, "
        "path string, path_row int",
    )
    return staged(made, "manifest")


def read_segments(manifest: DataFrame) -> DataFrame:
    """The manifest with ``ids_crc32`` (of the ids as 32-bit little-endian numbers), read from
    the files. A segment whose row does not list its borders is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple | None = None
        for batch in batches:
            sums = []
            for path, row, start, length in zip(
                *(batch.column(c).to_pylist() for c in ("path", "path_row", "pack_start", "length"))
            ):
                if path is None:
                    sums.append(0)
                    continue
                if opened is None or opened[0] != path:
                    system, base = fs.FileSystem.from_uri(path)
                    opened = (path, *(load(system, f"{base}/{n}.npy") for n in ("ids", "cu_lengths", "resets", "rows")))
                _, ids, ends, resets, rows = opened
                low, high = rows[row], rows[row + 1]
                at = low + np.searchsorted(resets[low:high], start)
                if at >= high or resets[at] != start or ends[at] != start + length:
                    raise ValueError(f"{path}: row {row} has no segment from {start} to {start + length}")
                sums.append(zlib.crc32(ids[row, start : start + length].astype("<u4").tobytes()))
            yield batch.append_column("ids_crc32", pa.array(sums, pa.int64()))

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema.fields)
    return manifest.mapInArrow(run, f"{shape}, ids_crc32 bigint")


def vocabulary_path(spark: SparkSession) -> str:
    """The vocabulary file: ``pitbars.packing.vocabulary`` if the session names one."""
    return spark.conf.get("pitbars.packing.vocabulary", VOCABULARY)
