import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitbars.llm import mixing, sharding


def place(df, shards=8):
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.assign_shards(df, F.col("doc_id"), F.md5(text), F.octet_length(text) + 1, shards=shards)


def check(rows, n, shards=8):
    assert len(rows) == n
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 2 * largest


def test_shards_are_even_and_slots_gapless(documents, awkward):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(2000)) for i in range(3000)]
    check(place(documents(rows)).collect(), 3000)
    check(place(documents(awkward)).collect(), len(awkward))


def test_a_hot_key_is_parted_and_stays_in_order(documents, monkeypatch):
    monkeypatch.setattr(sharding, "MIN_RANGES", 32)
    rows = [(i, "hot") for i in range(4000)] + [(i, f"t{i}") for i in range(4000, 6000)]
    found = place(documents(rows)).collect()
    check(found, 6000)
    hot = sorted((r.shard, r.slot, r.id) for r in found if r.id < 4000)
    assert [x[2] for x in hot] == sorted(x[2] for x in hot)


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    monkeypatch.setattr(sharding, "MIN_RANGES", 8)
    rows = spark.createDataFrame([(f"{i:05d}", 1) for i in range(4000)], "key string, size bigint")
    points = sharding.split_points(rows, 4000, 4000)
    assert points == sorted(set(points))
    edges = [0] + [int(p) for p in points] + [4000]
    assert max(b - a for a, b in zip(edges, edges[1:])) <= 1000


def test_range_of_counts_splitters(spark):
    points = sorted({f"{random.Random(i).randrange(1000):03d}" for i in range(60)})
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(1000)], "key string")
    for r in df.select("key", sharding.range_of(F.col("key"), points).alias("r")).collect():
        assert r.r == sum(p <= r.key for p in points)


def test_numbers_sort_as_text(spark):
    numbers = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    assert [r.n for r in df.orderBy(sharding.sortable(F.col("n"))).collect()] == numbers


def test_no_rows_no_shards(empty):
    assert place(empty).count() == 0


def test_shards_are_written_in_order(documents, tmp_path):
    df = documents([(i, f"text {i}") for i in range(50)])
    path = str(tmp_path / "shards")
    sharding.write_shards(df, place(df), path, id_name="doc_id", files=2)
    back = df.sparkSession.read.parquet(path)
    assert back.count() == 50 and set(back.columns) >= {"doc_id", "text", "shard", "slot"}


def mixed(df, **kw):
    return mixing.mix(df, F.col("doc_id"), F.col("source"), mixing.word_count(F.col("text")), **kw)


def test_targets_fill_up_to_twice_a_source():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.fill_targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert mixing.fill_targets([10, 1000, 1000], [5, 2, 1])[0] == 20.0
    assert mixing.fill_targets([], []) == []
    for seed in range(20):
        rng = random.Random(seed)
        sizes = [rng.randrange(0, 1000) for _ in range(9)]
        targets = mixing.fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(9)])
        assert sum(targets) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * s for t, s in zip(targets, sizes))


def test_a_mix_meets_its_targets(documents):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(200))), None,
             rng.choice(["a", "b", None, "é", "a", "a"])) for i in range(500)]
    made = mixed(documents(rows))
    docs = made.docs.collect()
    assert len(docs) == 500
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in docs:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    for size, taken, target in by.values():
        assert abs(taken - target) < 1
    assert [s[0] for s in made.sources] == ["a", "b", "é", None]
    again = {r.id: r.taken for r in mixed(documents(rows)).docs.collect()}
    assert again == {r.id: r.taken for r in docs}


def test_pieces_fill_blocks_and_cover_what_is_taken(documents):
    rows = [(i, " ".join(["w"] * (i % 37)), None, f"s{i % 4}") for i in range(400)]
    made = mixed(documents(rows))
    pieces = made.pieces.collect()
    filled = Counter()
    for p in pieces:
        filled[(p.src, p.rank)] += p.words
    assert max(filled.values()) <= made.block_words
    full = sum(n == made.block_words for n in filled.values())
    assert full >= len(filled) - 4  # a source's last block may be short
    slots = made.slots.collect()
    assert len({(s.src, s.rank) for s in slots}) == len(slots) == len({s.slot for s in slots})
    # Any stretch of the schedule is close to the shares.
    slots.sort(key=lambda s: s.slot)
    share = Counter(s.src for s in slots)
    half = Counter(s.src for s in slots[: len(slots) // 2])
    assert all(abs(half[k] - share[k] / 2) <= 12 for k in share)


def test_awkward_rows_are_mixed(documents, awkward, empty):
    docs = mixed(documents(awkward)).docs.collect()
    assert len(docs) == len(awkward)
    assert all(r.taken == 0 for r in docs if r["size"] == 0)
    assert mixed(empty).docs.count() == 0
    assert mixed(documents([(1, None), (2, "")])).docs.count() == 2


def test_repeated_ids_do_not_depend_on_the_layout(documents):
    rows = [(i % 5, " ".join(["w"] * (1 + i * 7 % 50)), None, "ab"[i % 2]) for i in range(60)]
    one = sorted((r.id, r["size"], r.taken) for r in mixed(documents(rows).coalesce(1)).docs.collect())
    other = sorted((r.id, r["size"], r.taken) for r in mixed(documents(rows[::-1]).repartition(7)).docs.collect())
    assert one == other


def test_a_key_is_no_catalogue(documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="4 sources"):
        mixed(documents([(i, "w", None, f"s{i}") for i in range(4)]))
