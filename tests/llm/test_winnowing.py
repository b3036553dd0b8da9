import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pitbars.llm import text as T
from pitbars.llm.winnowing import contamination, gram_and_frame, winnow


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)


def test_words_of_a_block_are_those_of_the_pattern():
    texts = ["Ab c-d É9", None, "", "x", "  ", "ÜBER über", "a" * 3000, "zz zz"]
    seen = {}
    for size in (8, 1 << 20):
        for block in T.blocks(pa.array(texts), T._Powers(), size):
            for i in range(block.count):
                found = block.hash[block.bounds[i] : block.bounds[i + 1]]
                expected = words(texts[block.first + i])
                assert len(found) == len(expected)
                for h, w in zip(found, expected):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_frame_keeps_its_minimum_and_stays_within_a_text():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 9, 400).astype(np.uint64)
    valid = rng.random(400) > 0.05
    expected = set()
    for i in range(400 - 6):
        if valid[i : i + 7].all():
            least = hashes[i : i + 7].min()
            expected |= {i + j for j in range(7) if hashes[i + j] == least}
    assert set(winnow(hashes, valid, 7).tolist()) == expected


def expected_rows(docs, items):
    windows = {}
    for number, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(number))
    out = []
    for number, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if got := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= got
        out.append((number, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(awkward):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 7, 12, 13, 14, 40])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "?!"), (3, items[4][1]), (93, items[5][1]), (94, "same same same")]
    docs = list(awkward)
    for i in range(60):
        parts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            held = (items[rng.randrange(25)][1]).split()
            low = rng.randrange(len(held))
            parts += [" ".join(held[low : low + rng.choice([5, 13, 20])]).upper()]
        docs.append((100 + i, " , ".join(parts)))
    return docs, items


def test_hits_equal_brute_force(spark, documents, case):
    docs, items = case
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, id int, doc_id string")
    found = contamination(documents(docs), table).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found], key=str)
    assert got == expected_rows(docs, items)
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit == len({p for s in r.spans for p in range(s.start, s.end)})


def test_every_shared_span_of_the_guaranteed_length_is_found(spark, documents):
    rng = random.Random(1)
    item = [f"i{rng.randrange(10_000)}" for _ in range(60)]
    docs = [(k, " ".join([f"x{rng.randrange(10_000)}" for _ in range(9)] + item[k : k + 13] + ["y"])) for k in range(48)]
    table = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert {r.n_hit for r in contamination(documents(docs), table).collect()} == {13}


def test_parameters_cover_each_length():
    assert all(sum(gram_and_frame(n)) - 1 == n for n in range(1, 14))


def test_empty_sides(spark, documents, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination(empty, some).count() == 0
    assert [r.n_hit for r in contamination(documents([(1, "a b")]), none).collect()] == [0]
    assert [r.n_hit for r in contamination(documents([(1, "x A  b")]), some).collect()] == [2]


def test_items_that_share_lines_repeat_or_lack_an_id(spark, documents):
    line = " ".join(f"c{i}" for i in range(20))
    items = [(i, f"{line} own{i} tail{i}") for i in range(40)] + [(7, f"{line} own7 tail7"), (7, "other words"), (None, f"x {line}")]
    docs = [(i, f"before {line} own{i}") for i in range(30)] + [(50, line), (51, "other words"), (52, " ".join([line] * 400))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, print string")
    found = sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in contamination(documents(docs), table).collect()], key=str)
    assert found == [(n, words, hit, [i for i in held if i != "None"]) for n, words, hit, held in expected_rows(docs, items)]
