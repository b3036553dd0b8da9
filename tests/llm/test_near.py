import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitbars.llm import dartminhash as D
from pitbars.llm import rpforest as R
from pitbars.llm import text as T
from pitbars.llm.graph import components
from test_winnowing import words


def roots(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = roots(121, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: expected[x] for x in touched}


def test_no_edges_no_components(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("shared", [0.2, 0.5, 0.9])
def test_darts_estimate_weighted_similarity(shared):
    rng = np.random.default_rng(1)
    keys = T.mixed(np.arange(1, 400, dtype=np.uint64))
    a = rng.integers(1, 9, 399).astype(float)
    b = np.where(rng.random(399) < shared, a, rng.integers(1, 30, 399) / 3)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    made = D.signatures(np.array([0, 399, 798]), np.concatenate([keys, keys]), np.concatenate([a, b]), 3000)
    assert not np.isinf(made).any()
    assert abs((made[0] == made[1]).mean() - exact) < 0.04


def test_signatures_do_not_depend_on_company():
    keys = T.mixed(np.arange(1, 60, dtype=np.uint64))
    alone = D.signatures(np.array([0, 59]), keys, np.ones(59), 64)
    other = D.signatures(np.array([0, 0, 5, 64]), np.concatenate([keys[:5], keys]), np.ones(64), 64)
    assert (alone[0] == other[2]).all() and np.isinf(other[0]).all()


def exact_classes(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(None if text is None else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w) or text]))
    edges = [
        (i, j)
        for i in range(len(rows)) for j in range(i)
        if sets[i] is not None and sets[j] is not None
        and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    return roots(len(rows), edges)


def near_rows(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 20, 90, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 30])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("task_elements", [10**6, 300])
def test_near_duplicates_equal_brute_force(documents, task_elements):
    """With few elements a task, most groups are compared in chunks with pivots."""
    rows = near_rows(220, 1)
    made = D.near_duplicates(documents(rows), group_rows=7, task_elements=task_elements)
    found = {r.doc_id: r for r in made.collect()}
    expected = exact_classes(rows)
    assert [found[i].class_id for i in range(220)] == expected
    assert all(found[i].kept == (expected[i] == i) for i in range(220))


def test_a_chain_of_links_is_one_class(documents):
    rng = random.Random(3)
    text = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text = text[4:] + [f"n{rng.randrange(9000)}" for _ in range(4)]
    assert {r.class_id for r in D.near_duplicates(documents(rows)).collect()} == {0}


def test_awkward_documents(documents, awkward, empty):
    found = D.near_duplicates(documents(awkward)).collect()
    assert len(found) == len(awkward)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert by[1][0].class_id == 1 and by[12][0].class_id == 12  # null texts are alone
    assert by[13][0].class_id == 2 and not by[13][0].kept  # empty texts are copies
    assert by[3][0].class_id == 3 and by[7][0].class_id == 6
    assert by[None][0].class_id is None and by[None][0].kept
    assert [r.class_id for r in by[11]] == [11, 11]
    assert D.near_duplicates(empty).count() == 0
    kept = D.drop_duplicates(documents(awkward))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 10, 11, 12, 14] and None in ids


def test_rows_are_dropped_one_by_one(documents):
    """One id with different texts, copies without an id, and an id that a copy shares."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    kept = D.drop_duplicates(documents([(1, a), (1, b), (None, c), (None, c), (2, b), (None, a), (3, None), (3, None)]))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, a), (1, b), (None, c), (3, None), (3, None)], key=str)


def test_counts_weigh_repeats(documents):
    rows = [(1, "a b c d e " * 30 + "x y z"), (2, "a b c d e " * 10 + "x y z")]
    assert {r.class_id for r in D.near_duplicates(documents(rows)).collect()} == {1}
    assert D.sketch(documents(rows), "doc_id", "text", weighting="count").count() == 2
    with pytest.raises(ValueError):
        D.sketch(documents(rows), "doc_id", "text", weighting="other")


def vectors_table(spark, rows, kind="float"):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], 7, 1, "h") for i, v in rows]
    return spark.createDataFrame(full, f"vec_id bigint, embedding array<{kind}>, id int, n int, h string")


def near(df, **kw):
    return R.near_vectors(df, row_id=F.col("vec_id"), embedding=F.col("embedding"), **kw)


def brute(rows):
    unit = np.array([np.asarray(v, dtype=np.float32).astype(float) for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    top = roots(len(rows), zip(*np.nonzero(np.triu(linked))))
    return {rows[i][0]: (int(linked[i].sum()), rows[top[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("leaf_rows", [16, 64, 512])
def test_links_equal_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = [(i, centres[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 1.0])) for i in range(900)]
    found = {r.id: (r.n_links, r.component_id) for r in near(vectors_table(spark, rows), leaf_rows=leaf_rows).collect()}
    expected = brute(rows)
    missed = sum(expected[i][0] - found[i][0] for i in expected)
    assert all(found[i][0] <= expected[i][0] for i in expected)
    assert missed <= 0.02 * sum(n for n, _ in expected.values())
    if leaf_rows == 512:
        assert found == expected


def test_a_tight_cluster_is_compared_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, np.ones(8) + rng.standard_normal(8) * 1e-4) for i in range(300)]
    found = near(vectors_table(spark, rows), leaf_rows=4).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(299, 0)}


def test_vectors_of_another_width_do_not_disturb(spark):
    rows = [(0, [1.0, 2.0])] + [(i, [1.0, 2.0, 3.0 + i * 1e-3]) for i in range(1, 6)] + [(7, [2.0, 4.1])]
    found = {r.id: (r.n_links, r.component_id) for r in near(vectors_table(spark, rows)).collect()}
    assert found == {0: (1, 0), 7: (1, 0), **{i: (4, 1) for i in range(1, 6)}}


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0, 3.0]
    rows = [(1, good), (2, good), (3, None), (4, [0, 0, 0]), (5, [nan, 1, 2]), (6, [inf, 1, 2]), (7, [None, 1, 2]), (8, []),
            (9, [2.0, 4.0, 6.0]), (9, good), (None, good), (10, [1e-30, 2e-30, 3e-30]), (11, [0, 0, 0]), (12, [-1, -2, -3])]
    found = near(vectors_table(spark, rows)).collect()
    assert len(found) == len(rows)
    got = sorted(((r.id or -1), r.n_links, r.component_id, r.kept) for r in found)
    linked = {1, 2, 9, 10}
    for number, n, component, kept in got:
        if number in linked:
            assert (n, component) == (4, 1) and kept == (number == 1)
        elif number == -1:
            assert (n, component, kept) == (0, None, True)
        else:
            assert (n, component, kept) == (0, number, True)
    assert near(vectors_table(spark, [])).count() == 0
    assert [r.n_links for r in near(vectors_table(spark, [(1, None)])).collect()] == [0]


def test_a_pair_counts_in_its_first_common_leaf_only():
    unit = np.eye(3)[[0, 0, 1]]
    leaves = [np.array([1, 4]), np.array([1, 4]), np.array([4])]
    one, _ = R.compare_leaf(np.arange(3), unit, np.array([2, 3, 1]), 1, leaves, 0.95)
    four, spans = R.compare_leaf(np.arange(3), unit, np.array([2, 3, 1]), 4, leaves, 0.95)
    assert one.tolist() == [3, 2, 0] and four.tolist() == [0, 0, 0] and spans == [(0, 1)]


def test_spanning_links_connect_what_pairs_connect():
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(30), rng.randrange(5, 12)))) for _ in range(80)]
    links = D.spanning_links(np.arange(80), sets, 0.5)
    pairs = [
        (i, j) for i in range(80) for j in range(i)
        if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
    ]
    assert roots(80, links) == roots(80, pairs)
    assert len(links) == 80 - len(set(roots(80, pairs)))


def test_pivots_outside_the_largest_part_connect_what_pairs_connect():
    """One round with every member as pivot, rows in chunks, joins all that pairs join."""
    rng = random.Random(10)
    sets = [np.array(sorted(rng.sample(range(30), rng.randrange(5, 12)))) for _ in range(60)]
    ids, links = np.arange(60), []
    for chunk in range(4):
        mine = ids[ids % 4 == chunk]
        links += D.pivot_links(ids, sets, mine, [sets[i] for i in mine], 0.5)
    pairs = [
        (i, j) for i in range(60) for j in range(i)
        if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
    ]
    assert roots(60, links) == roots(60, pairs)


def test_shingles_of_short_and_long_texts():
    block = next(T.blocks(pa.array(["a b c d e f", "a b", "", None, "a b c d e a b c d e"]), T._Powers()))
    bounds, _, times = D.shingles(block)
    assert np.diff(bounds).tolist() == [2, 1, 0, 0, 5] and times.tolist()[-5:].count(2) == 1
