"""Spelling variants, nearest vectors and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitbars.llm import annscan as A
from pitbars.llm import maskrank as M
from pitbars.llm import spelling as S
from pitbars.llm.topk import top_rows


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- first rows of a key ---------------------------------------------------------------------


def test_top_rows_of_a_key_that_owns_the_table(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id"), (F.col("id") % 7).alias("v"))
    df = df.unionByName(spark.range(3).select(F.lit("cold").alias("k"), "id", F.lit(1).alias("v")))
    got = top_rows(df, ["k"], [F.desc("v"), F.asc("id")], 4, spread=F.col("id"))
    found = defaultdict(list)
    for r in got.orderBy("k", "place").collect():
        found[r.k].append((r.place, r.id))
    assert found["hot"] == [(1, 6), (2, 13), (3, 20), (4, 27)]
    assert found["cold"] == [(1, 0), (2, 1), (3, 2)]


# -- spelling --------------------------------------------------------------------------------


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_groups(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root)
    return out


def grouped(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def variants(rng, word):
    i = rng.randrange(len(word) + 1)
    c = rng.choice("abcdeéÿz")
    return rng.choice([word[:i] + c + word[i:], word[: i - 1] + word[i:] if i else word, word[: i - 1] + c + word[i:] if i else c + word])


@pytest.mark.parametrize("seed", range(3))
def test_words_and_forms_equal_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghàéÿ") for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(base[:6] if rng.random() < 0.7 else base)
            while rng.random() < 0.3:
                w = variants(rng, w)
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    docs = documents(rows)
    counts = plain_words(rows)
    found = S.word_counts(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    assert {r.word: r.n for r in found.collect()} == counts
    assert grouped(S.group_spellings(found)) == plain_groups(counts)


def test_edits_at_every_place_are_found(spark):
    word = "abcdefghij"
    words = {word: 100}
    for i in range(len(word) + 1):
        words[word[:i] + "x" + word[i:]] = 2
        if i < len(word):
            words[word[:i] + word[i + 1 :]] = 3
            words[word[:i] + "é" + word[i + 1 :]] = 4
    words["jihgfedcba"] = 5
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert grouped(S.group_spellings(table)) == plain_groups(words)


def test_forms_are_followed_to_the_last(spark):
    words = {"aaaaaaa": 10_000, "aaaaaab": 900, "aaaaabb": 80, "aaaabbb": 7, "zzzzzzz": 2}
    got = grouped(S.group_spellings(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got["aaaabbb"] == (7, 1, "aaaaabb", 80, "aaaaaaa") and got["zzzzzzz"] == (2, 0, None, None, "zzzzzzz")


def test_ties_take_the_first_word(spark):
    words = {"bbbbbbb": 30, "abbbbbb": 30, "ébbbbbb": 30, "cbbbbbb": 3}
    got = grouped(S.group_spellings(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert got["cbbbbbb"] == (3, 3, "abbbbbb", 30, "abbbbbb")


def test_awkward_documents_have_the_words_they_have(documents, awkward):
    found = S.word_counts(documents(awkward), doc_id=F.col("doc_id"), text=F.col("text"), min_letters=3)
    assert {r.word for r in found.collect()} == {"same", "one"}


def test_no_documents_no_words(empty):
    words = S.word_counts(empty, doc_id=F.col("doc_id"), text=F.col("text"))
    assert S.group_spellings(words).count() == 0


# -- ranked search ---------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_ranks(docs, items, k=10):
    terms = [(number, TERM.findall(lowered(text or ""))) for number, text in docs]
    terms = [(number, Counter(t), len(t)) for number, t in terms if t]
    big_n, big_l = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall(lowered(text or "")))
    out = []
    for item, wanted in asked.items():
        scored = []
        for number, c, n in terms:
            m = 10 + (90 * n * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if t in c
            )
            if score > 0:
                scored.append((-score, number is None, number))
        out += [(item, i + 1, number, -s) for i, (s, _, number) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    items = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"doc_id": F.lit(1), "term": F.lit("x"), "n": F.lit(3)})
    got = M.rank(docs, items, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"), **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


def random_texts(rng, n, words):
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_ranks_equal_brute_force(spark, documents, seed, monkeypatch):
    monkeypatch.setattr(M, "_CELLS", 4000)  # many blocks a task
    rng = random.Random(seed)
    words = [f"{rng.choice(['W', 'w', 'é', '7'])}{i}" for i in range(150)]
    docs = random_texts(rng, 700, words)
    items = [(i, " ".join(rng.sample(words, rng.choice([1, 3, 20, 90])))) for i in range(25)]
    items += [(3, "w0 é1"), (30, None), (31, ""), (32, "nowhere"), (None, " ".join(words[:5]))]
    assert ranked(spark, documents(docs), items) == plain_ranks(docs, items)


def test_items_in_several_parts_rank_alike(spark, documents, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    docs, items = random_texts(rng, 200, words), [(i, " ".join(rng.sample(words, 12))) for i in range(20)]
    whole = ranked(spark, documents(docs), items)
    monkeypatch.setattr(M, "CHUNK_TERMS", 50)
    assert ranked(spark, documents(docs), items) == whole == plain_ranks(docs, items)


def test_masks_that_cannot_win_are_not_evaluated():
    rng = np.random.default_rng(4)
    size, docs = 12, 4000
    held = rng.random((size, docs)) < np.linspace(0.01, 0.6, size)[:, None]
    term, owner = np.nonzero(held)
    weights = np.linspace(6000, 300, size).astype(np.int64)
    none = np.zeros(0, np.int64)
    item = M.Item(np.arange(size), weights, none, none)
    ids, m = np.arange(docs), np.full(docs, 100)
    evaluated = M.search_block([item], ids, m, owner, term, np.ones(len(term), np.int64), size, 10)
    scores = weights @ (held * (10**9 // 1800))
    best = np.lexsort((ids, -scores))[:10]
    assert (item.ids == best).all() and (item.scores == scores[best]).all()
    assert evaluated < docs / 10


def test_equal_scores_rank_by_id(spark, documents):
    docs = [(9 - i, "alpha beta") for i in range(9)] + [(20, "gamma"), (None, "alpha beta"), (5, "alpha beta")]
    items = [(1, "Alpha"), (2, "beta alpha alpha")]
    got = ranked(spark, documents(docs), items, k=11)
    assert got == plain_ranks(docs, items, 11)
    assert [r[2] for r in sorted(got, key=lambda r: (r[0], r[1])) if r[0] == 1] == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, None]


def test_awkward_documents_rank_like_brute_force(spark, documents, awkward):
    items = [(1, "one two same"), (2, "w17 w18 tail"), (3, "漢字 é"), (4, "a" * 300_000)]
    assert ranked(spark, documents(awkward), items) == plain_ranks(awkward, items)


def test_empty_sides_rank_nothing(spark, documents, empty):
    assert ranked(spark, empty, [(1, "one")]) == []
    assert ranked(spark, documents([(1, "one")]), []) == []


# -- nearest vectors -------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, query bigint, rank int, list int, width int, place int"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", 1, 2, 3, 4, 5) for i, v in rows], VECTORS)


def nearest(spark, rows, k=20, every=20):
    got = A.nearest(vector_table(spark, rows), row_id=F.col("vec_id"), embedding=F.col("embedding"), is_query=F.col("vec_id") % every == 0, k=k)
    out = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.id, r.score))
    return dict(out)


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=20, every=20):
    once = dict(rows)
    good = {i: np.array(v, np.float32).astype(float) for i, v in once.items() if i is not None and usable(v)}
    out = {}
    for q in good:
        if q % every == 0:
            scored = [(-float(np.cumsum(good[q] * v)[-1]), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            if scored:
                out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(24) * rng.uniform(0.2, 3)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(90)]  # equal vectors, several of them queries
    rows += [(1000, None), (1020, [0.0] * 24), (1040, [math.nan] + [1.0] * 23), (1060, [None] + [1.0] * 23), (None, rows[0][1])]
    got, expected = nearest(spark, rows), brute(rows)
    assert got == expected
    assert {1000, 1020, 1040, 1060}.isdisjoint(got)


def test_recall_over_probed_lists(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 128)
    monkeypatch.setattr(A, "CHUNK_ROWS", 100)  # lists in chunks, queries in groups
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 40))
    rows = [(i, (centres[i % 12] + 0.7 * rng.standard_normal(40)).tolist()) for i in range(4000)]
    got, expected = nearest(spark, rows), brute(rows)
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits >= 0.93 * 20 * len(got)
    exact = {(q, i): s for q, v in brute(rows, 4000).items() for i, s in v}
    assert all(exact[q, i] == s for q, v in got.items() for i, s in v)


def test_vectors_of_another_width_do_not_disturb(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 2.0])] + [(i, rng.standard_normal(16).tolist()) for i in range(1, 200)] + [(200 + i, rng.standard_normal(2).tolist()) for i in range(30)]
    assert nearest(spark, rows) == brute(rows)


def test_few_and_no_candidates(spark):
    assert nearest(spark, []) == {}
    assert nearest(spark, [(20, [1.0, 0.0])]) == {}
    assert nearest(spark, [(20, [1.0, 0.0]), (1, [-1.0, 0.5])]) == {20: [(1, -1.0)]}
    # A repeated row is one vector.
    assert nearest(spark, [(20, [1.0, 0.0]), (1, [2.0, 0.5]), (1, [2.0, 0.5])]) == {20: [(1, 2.0)]}


def test_early_abandoning_reads_fewer_columns_and_keeps_the_neighbours():
    rng = np.random.default_rng(5)
    base, asked = rng.standard_normal((3000, 128)), rng.standard_normal((20, 128))
    base[:60] = asked[0] + 0.3 * rng.standard_normal((60, 128))
    space = A.Space.make(128, float(np.linalg.norm(base, axis=1).max()))
    exact = asked @ base.T
    floors = np.sort(exact, axis=1)[:, -20]
    query, ids, scores, read = A.scan(space, np.arange(3000), base, np.arange(20), asked, floors, 20)
    found = {(q, i) for q, i in zip(query.tolist(), ids.tolist())}
    wanted = {(q, int(i)) for q in range(20) for i in np.argsort(-exact[q])[:20]}
    assert len(found & wanted) >= 0.98 * len(wanted)
    assert np.allclose(scores, exact[query, ids])
    assert read < 0.75 * 20 * 3000 * 9


def test_share_quantile_is_a_beta_quantile():
    rng = np.random.default_rng(6)
    drawn = rng.beta(8, 24.5, 400_000)
    assert abs(A.share_quantile(16, 65, 0.01) - np.quantile(drawn, 0.99)) < 0.004
    assert A.share_quantile(65, 65) == 1.0
