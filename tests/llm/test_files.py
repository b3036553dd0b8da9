import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from pitbars.llm import packing, warc

PAGES = "page_id bigint, url string, html string, sha string, bytes int, top string, id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "t", 2) for r in rows], PAGES)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


AWKWARD = [
    (1, "http://a", "x"), (2, "http://b", "x"), (3, None, "y\r\n\r\nWARC/1.1\r\n\r\n"), (4, "http://c\r\nEvil: 1", ""),
    (5, "http://d", None), (6, "http://ü/é", "é" * 2_000_000), (7, "http://a", "z"), (7, "http://a", "z"),
    (None, "http://n", "x"), (None, "http://n", "alone"),
]


@pytest.mark.parametrize("archive_bytes, common", [(1, 1000), (32 << 20, 1000), (32 << 20, 1), (32 << 20, 5)])
def test_pages_survive_the_round_trip(spark, monkeypatch, archive_bytes, common):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    monkeypatch.setattr(warc, "COMMON", common)
    found = warc.round_trip(pages(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    tops = {}
    for number, _, html in AWKWARD:
        tops[html or ""] = max(tops.get(html or "", -1), -1 if number is None else number)
    expected = []
    for number, _, html in AWKWARD:
        top = tops[html or ""]
        refers = None if top in (-1, number) else top
        name = f"<urn:page:{'' if number is None else number}>"
        expected.append((name, len((html or "").encode()), digest(html), "response" if refers is None else "revisit",
                         None if refers is None else f"<urn:page:{refers}>"))
    got = [(r.record_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    rows = pages(spark, [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * i) for i in range(60)])
    written = warc.write_monolithic(warc.page_records(rows), str(tmp_path / "whole"))
    index = warc.normalise(written, str(tmp_path / "members"))
    assert sum(r.records for r in written.collect()) == index.count() == 60
    whole = sorted(gzip.decompress(open(r.path, "rb").read()) for r in written.collect())
    assert sum(len(w) for w in whole) == sum(len(gzip.decompress(open(p, "rb").read())) for p in {r.path for r in index.collect()})
    for r in index.collect():
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            member = f.read(r.length)
        inflater = zlib.decompressobj(31)
        record = inflater.decompress(member)
        assert inflater.eof and not inflater.unused_data and record.startswith(b"WARC/1.1\r\n")
        assert r.record_id.encode() in record
        lines = open(r.path + ".idx").read().splitlines()
        assert f"{r.offset}\t{r.length}\t{r.record_id}\t{r.type}\t{r.uri}" in lines


def test_a_cut_archive_is_refused(tmp_path):
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(whole)
    with pytest.raises(ValueError, match="ends within"):
        list(warc._rewrite(fs.LocalFileSystem(), str(path), str(tmp_path / "out.warc.gz")))


def test_no_pages_no_records(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_base32_of_hex(spark):
    values = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "h string")
    for r in df.select("h", warc._hex_to_base32(F.col("h")).alias("b")).collect():
        assert r.b == base64.b32encode(bytes.fromhex(r.h)).decode()


def test_the_tree_finds_the_tightest_row():
    rng = random.Random(1)
    tree, held = packing.CapacityTree(100), []
    for step in range(3000):
        if rng.random() < 0.5:
            room = rng.randrange(1, 101)
            tree.put(room, step)
            held.append(room)
        else:
            need = rng.randrange(1, 101)
            fit = [h for h in held if h >= need]
            found = tree.take(need)
            assert (found and found[0]) == (min(fit) if fit else None)
            if found:
                held.remove(found[0])


def naive_rows(lengths, capacity):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= size]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def test_packing_equals_a_plain_search():
    rng = np.random.default_rng(2)
    for capacity in (7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 300)
        row, start, n = packing.best_fit_decreasing(lengths, capacity)
        used = np.zeros((n, capacity), bool)
        for r, s, size in zip(row, start, lengths):
            assert not used[r, s : s + size].any()
            used[r, s : s + size] = True
        assert sorted(capacity - used.sum(axis=1)) == naive_rows(lengths.tolist(), capacity)


def test_packs_give_back_every_text(documents, awkward, tmp_path):
    manifest = packing.pack(documents(awkward), row_tokens=64, lot_tokens=5000, folder=str(tmp_path))
    rows = packing.read_segments(manifest).collect()
    coder = packing.Tokeniser(open(packing.VOCABULARY, "rb").read())
    texts: dict = {}
    for r in rows:
        if r.path is None:
            assert r.length == 0 and r.pack_id is None
            ids = np.zeros(0, np.uint16)
        else:
            ids = np.load(f"{r.path}/ids.npy")[r.path_row, r.pack_start : r.pack_start + r.length]
            assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        if r.segment == 0:
            texts.setdefault(r.doc_id, []).append([])
        texts[r.doc_id][-1].append((r.segment, ids))
    got = sorted(
        (str(k), coder.text(np.concatenate([i for _, i in parts]))) for k, v in texts.items() for parts in v
    )
    assert got == sorted((str(k), t or "") for k, t in awkward)
    for path in {r.path for r in rows if r.path}:
        ids, ends, resets, index = (np.load(f"{path}/{n}.npy") for n in ("ids", "cu_lengths", "resets", "rows"))
        assert ids.shape[1] == 64 and len(index) == len(ids) + 1
        for i in range(len(ids)):
            low, high = index[i], index[i + 1]
            assert resets[low] == 0 and (resets[low + 1 : high] == ends[low : high - 1]).all() and ends[high - 1] <= 64
            assert not ids[i, ends[high - 1] :].any()


def test_no_documents_no_packs(empty):
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("size", [40, 300])
def test_pieces_keep_the_ids_of_the_whole_text(size):
    coder = packing.Tokeniser(open(packing.VOCABULARY, "rb").read())
    rng = random.Random(size)
    parts = ["it's", "don't", " ", "  ", "\n", "\t \n", "word", "Zürich", "漢字漢字", "。", "12,345.6", "...", "'", "'s", "e-mail", "--", "x1y2", "\u00a0"]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", ""]) for _ in range(rng.randrange(1, 400)))
        cut = packing.pieces(text, size)
        assert "".join(cut) == text and all(cut)
        ids = [i for piece in cut for i in coder.coding.encode_ordinary(piece)]
        if max(map(len, cut)) <= size and all(len(p) < size for p in text.split()):
            assert ids == coder.coding.encode_ordinary(text)


def test_a_word_without_borders_is_cut_and_stays_whole():
    assert packing.pieces("a" * 100, 16) == ["a" * 16] * 6 + ["a" * 4]
    assert packing.pieces("", 16) == [] and packing.pieces("a b", 16) == ["a b"]
