"""WARC archives: writing, normalising to one gzip member a record, and reading by index.

A monolithic archive is one gzip stream over many records, so a record can only be reached by
inflating all before it. The normaliser inflates the stream once, in pieces, and writes every
record as a gzip member of its own with a sidecar index of offsets. All memory is bounded by
the piece size, whatever the size of a record or an archive.

Archives go to a folder that all executors reach, under names no other attempt uses. The
table of archives is stored before it is used, so what a lost or repeated task left behind is
never listed and never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitbars.session import scratch, staged

ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 20
#: A payload is common if more than one row in so many has it.
COMMON = 1000
_GZIP = 31  # zlib's window bits for a gzip wrapper
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_head(
    kind: str, number: str, uri: str, digest: str, payload_bytes: int, refers_to: str | None, http: bytes, body: int
) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{number}>",
        "WARC-Target-URI: " + " ".join(uri.split()),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}", "", ""]
    return "\r\n".join(lines).encode()


class _Writer:
    """Rolls over to a new monolithic archive when one holds ``ARCHIVE_BYTES`` of records."""

    def __init__(self, folder: str) -> None:
        self.system, self.folder = filesystem(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.root, self.out, self.done = folder, None, []

    def add(self, parts: list[bytes]) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.path = self.system.open_output_stream(f"{self.folder}/{name}", compression=None), f"{self.root}/{name}"
            self.packer, self.records, self.held = zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0, 0
        for part in parts:
            self.out.write(self.packer.compress(part))
            self.held += len(part)
        self.records += 1
        if self.held >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(self.packer.flush())
            self.out.close()
            self.done.append((self.path, self.records))
            self.out = None


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``page_id, url, payload, digest, refers_to`` as WARC records.

    ``payload`` is binary. A row with a ``refers_to`` becomes a revisit record: HTTP headers
    that state the payload's length, and no payload. Returns ``path, records``, one row an
    archive, stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for batch in batches:
            for number, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5))):
                body = payload.as_py() or b""
                refers = refers.as_py()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                kept = body if refers is None else b""
                head = record_head(
                    "response" if refers is None else "revisit",
                    "" if number.as_py() is None else str(number.as_py()), url.as_py() or "", digest.as_py(),
                    len(body), None if refers is None else str(refers), http, len(kept),
                )
                writer.add([head, http, kept, b"\r\n\r\n"])
        writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in writer.done], pa.string()), pa.array([n for _, n in writer.done], pa.int64())],
            names=["path", "records"],
        )

    narrow = records.select("page_id", "url", "payload", "digest", "refers_to")
    return staged(narrow.mapInArrow(run, "path string, records bigint"), "archives")


class _Inflated:
    """A gzip file of one or many members as a byte stream that is read forward once."""

    def __init__(self, source) -> None:
        self.source, self.buffer, self.inflater, self.ended = source, bytearray(), zlib.decompressobj(_GZIP), False

    def _more(self) -> None:
        raw = self.inflater.unconsumed_tail or self.inflater.unused_data
        if self.inflater.eof:
            self.inflater = zlib.decompressobj(_GZIP)
        if not raw:
            raw = self.source.read(PIECE)
        if not raw:
            if not self.ended and not self.inflater.eof:
                self.buffer += self.inflater.flush()
            self.ended = True
            return
        self.buffer += self.inflater.decompress(raw, PIECE)

    def head(self) -> bytes:
        """Up to and with the next empty line; empty at the end of the file."""
        looked = 0
        while True:
            at = self.buffer.find(b"\r\n\r\n", max(0, looked - 3))
            if at >= 0:
                head = bytes(self.buffer[: at + 4])
                del self.buffer[: at + 4]
                return head
            looked = len(self.buffer)
            if self.ended:
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record's header")
                return b""
            self._more()

    def copy(self, n: int, to: Callable[[bytes], None]) -> None:
        while n:
            if not self.buffer:
                if self.ended:
                    raise ValueError("the archive ends within a record")
                self._more()
                continue
            part = bytes(self.buffer[: min(n, PIECE)])
            del self.buffer[: len(part)]
            to(part)
            n -= len(part)


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; the first line is the version."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _rewrite(system: fs.FileSystem, path: str, target: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Rewrite one archive record by record; yields the index lines."""
    with system.open_input_stream(path, compression=None) as source, system.open_output_stream(target, compression=None) as out:
        stream, offset = _Inflated(source), 0
        while head := stream.head():
            fields = headers(head)
            packer, length = zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0

            def put(data: bytes) -> None:
                nonlocal length
                made = packer.compress(data)
                out.write(made)
                length += len(made)

            put(head)
            stream.copy(int(fields.get("content-length", "0")), put)
            stream.copy(4, put)
            made = packer.flush()
            out.write(made)
            length += len(made)
            yield offset, length, fields.get("warc-record-id", ""), fields.get("warc-type", ""), fields.get("warc-target-uri", "")
            offset += length


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive of ``path`` with a member per record, and index it.

    Each archive is inflated once, as a stream, by one task; many archives make many tasks.
    The index is written beside the archive (``.idx``, tab-separated) and returned as
    ``path, offset, length, record_id, type, uri``, stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        names = ("path", "offset", "length", "record_id", "type", "uri")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                source_system, source = filesystem(path)
                if type(source_system) is not type(system):
                    raise ValueError("archives and their rewritten form must share a file system")
                held: list[tuple] = []
                with system.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for line in _rewrite(system, source, f"{base}/{name}"):
                        index.write(("\t".join(map(str, line)) + "\n").encode())
                        held.append((f"{folder}/{name}", *line))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, h)) for h in held])
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, h)) for h in held])

    count = max(1, archives.count())
    spread = archives.select("path").repartition(min(count, 100_000))
    return staged(
        spread.mapInArrow(run, "path string, offset bigint, length bigint, record_id string, type string, uri string"),
        "warc-index",
    )


def read_records(index: DataFrame) -> DataFrame:
    """Read the records an index names, each by its own offset.

    Returns ``record_id, type, uri, payload_bytes, payload_digest, refers_to``. A response's
    length and digest are computed from the payload that was read, and must agree with its
    headers; a revisit has them from its headers. Payloads are hashed in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if opened is None or opened[0] != path:
                    if opened is not None:
                        opened[1].close()
                    system, inner = filesystem(path)
                    opened = (path, system.open_input_file(inner))
                opened[1].seek(offset)
                rows.append(_parsed(_Inflated(_Slice(opened[1], length))))
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
        if opened is not None:
            opened[1].close()

    shape = "record_id string, type string, uri string, payload_bytes bigint, payload_digest string, refers_to string"
    return index.select("path", "offset", "length").mapInArrow(run, shape)


_READ = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.string())]
)


class _Slice:
    """The next ``n`` bytes of an open file."""

    def __init__(self, file, n: int) -> None:
        self.file, self.left = file, n

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


def _parsed(stream: _Inflated) -> dict:
    fields = headers(stream.head())
    body = int(fields["content-length"])
    http_head = stream.head()
    http = headers(http_head)
    sha, read = hashlib.sha1(), 0

    def take(data: bytes) -> None:
        nonlocal read
        sha.update(data)
        read += len(data)

    stream.copy(body - len(http_head), take)
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if fields["warc-type"] == "response":
        found = base64.b32encode(sha.digest()).decode()
        if (found, read) != (stated, size):
            raise ValueError(f"record {fields['warc-record-id']} does not hold what its headers state")
    return {
        "record_id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields["warc-target-uri"],
        "payload_bytes": size, "payload_digest": stated, "refers_to": fields.get("warc-refers-to"),
    }


def _hex_to_base32(hexes: Column) -> Column:
    """Bare base32 of a 40-digit hexadecimal digest: five digits are four base32 ones."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hexes, i + 1, 5), 16, 10).cast("bigint")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(letters), F.shiftright(number, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*parts)


def page_records(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Rows for :func:`write_monolithic`: payloads, digests and what each row revisits.

    Of equal payloads of at least ``min_bytes`` the row with the largest id is written in
    full; the others refer to it. A null payload is empty. Repeated rows of the largest id are
    all written in full; rows without an id refer to the largest id there is, and are written
    in full if there is none. One narrow row per payload is aggregated before the join. A
    payload of more than a thousandth of all rows is joined by broadcast, as there are fewer
    than a thousand of those; their rows spread over the shuffle of the others.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    full = staged(
        rows.select("sha", "bytes", "page_id").groupBy("sha", "bytes").agg(
            F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")
        ),
        "payloads",
    )
    total = full.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    common = F.col("copies") * COMMON > total
    repeated = full.where((F.col("copies") > 1) & (F.col("bytes") >= min_bytes))
    hot = repeated.where(common).select("sha", "bytes", F.struct("top").alias("hot"))
    rest = repeated.where(~common).select(F.col("sha").alias("rest_key"), F.col("bytes").alias("size"), F.col("top").alias("rest"))
    rows = rows.join(F.broadcast(hot), ["sha", "bytes"], "left")  # fewer than COMMON rows
    spread = F.hex(F.xxhash64("page_id", "url"))
    rows = rows.withColumn("key", F.when(F.col("hot").isNotNull(), spread).otherwise(F.col("sha")))
    rows = rows.join(rest, (F.col("key") == F.col("rest_key")) & (F.col("bytes") == F.col("size")), "left")
    top = F.when(F.col("hot").isNotNull(), F.col("hot.top")).otherwise(F.col("rest"))
    refers = F.when(F.col("page_id").eqNullSafe(top), None).otherwise(top)
    return rows.select("page_id", "url", "payload", _hex_to_base32(F.col("sha")).alias("digest"), refers.alias("refers_to"))


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write pages as monolithic archives, normalise them and read them back by the index.

    Returns what :func:`read_records` does. The archives and their index stay in fresh folders
    under the shared folder; an empty table makes none and gives no rows.
    """
    spark = pages.sparkSession
    written = write_monolithic(page_records(pages, **names), scratch(spark, "warc-whole"))
    return read_records(normalise(written, scratch(spark, "warc-members")))
