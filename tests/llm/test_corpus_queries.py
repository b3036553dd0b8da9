"""Registered corpus queries against their SQL twins, and the pipeline against plain Python."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from pitbars.llm import langid, mixing
from pitbars.llm.queries import ORACLES, QUERIES, taught
from test_near import exact_classes
from test_winnowing import expected_rows

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_a_row_for_every_document(spark, name):
    table = "embeddings" if name.startswith("op1_") else "documents"
    key = "vec_id" if name.startswith("op1_") else "doc_id"
    found = QUERIES[name](spark, SF).select(key).distinct().count()
    assert found == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_sharding_stays_in_the_jvm(spark):
    plan = QUERIES["op5_sampled_splitters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def corpus(seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["ba", "ko", "ti", "lu"], "bb": ["schr", "ung", "keit", "zw"]}
    item = " ".join(f"bench{rng.randrange(1000)}" for _ in range(30))
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(8, 120)))
        rows.append([i, text, lang, rng.choice(["s1", "s2", "s2", "s2", None])])
    for i in range(20):
        rows.append([300 + i, rows[i][1], rows[i][2], "s1"])
        rows.append([330 + i, rows[i + 20][1] + " tail", rows[i + 20][2], "s3"])
        rows.append([360 + i, rows[i + 40][1] + " " + " ".join(item.split()[i % 9 : i % 9 + 20]), rows[i + 40][2], "s2"])
    rows += [[400, None, "aa", "s1"], [401, "", "aa", "s1"], [402, "12 34 !", "bb", "s1"]]
    return [tuple(r) for r in rows], [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    rows, items = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_pipeline(spark, documents):
    """The pipeline's documents and how often each is in its result."""
    rows, items = corpus()
    frame = documents(rows)
    coder = langid.Coder(langid.fit(taught(frame), F.col("text"), F.col("lang"), F.col("doc_id")))
    rows = [r for r in rows if not coder.predict(r[1])[2]]
    classes = exact_classes([(r[0], r[1]) for r in rows])
    rows = [r for i, r in enumerate(rows) if classes[i] == i]
    clean = {n for n, size, hit, _ in expected_rows([(r[0], r[1]) for r in rows], items) if hit == 0 or 20 * hit < size}
    rows = [r for r in rows if r[0] in clean]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in names}
    targets = dict(zip(names, mixing.fill_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    from hashlib import md5

    copies = Counter()
    for s in names:
        quota = int(targets[s])
        for lap in (0, 1):
            at = lap * sizes[s]
            for r in sorted((r for r in rows if r[3] == s), key=lambda r: md5(f"{r[0]}:{lap}".encode()).hexdigest()):
                n = len(r[1].split())
                copies[r[0]] += max(0, min(n, quota - at)) / n
                at += n
    return Counter({k: int(v + 0.5) for k, v in copies.items() if int(v + 0.5)})


def test_pipeline_equals_plain_python(spark, documents, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in found) == plain_pipeline(spark, documents)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in found)


def test_every_stage_takes_awkward_and_empty_tables(spark, documents, awkward, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        given = documents([*awkward, (50, "plain text of some words", "aa", "s"), (51, "other text entirely here", "bb", None)])
        out = stage(spark, given, folder)
        if name != "sharding":
            assert out.columns == given.columns
            assert out.count() > 0
        assert stage(spark, empty, folder).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None
