import random
import re

import pytest

import numpy as np
from pyspark.sql import functions as F

from quire.llm import bitmap, graph, jaccard
from quire.llm.graph import components
from quire.llm.jaccard import jaccard_components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, words, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_copies(seed, groups=12, size=8, ids=None):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    rows, boiler = [], [rng.choice(vocab) for _ in range(25)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 150))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.4:
                t = t + boiler
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    return rows


@pytest.mark.parametrize(("words", "num", "den"), [(3, 9, 10), (5, 8, 10), (2, 1, 2)])
def test_components_equal_brute_force(spark, words, num, den):
    rows = near_copies(words)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), words, num, den).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, words, num, den)


def test_blocks_of_a_hot_token(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "MANY", 3)
    monkeypatch.setattr(jaccard, "HELD_KEYS", 500)
    monkeypatch.setattr(jaccard, "FREQUENT_MAX", 1)
    monkeypatch.setattr(jaccard, "BEFORE", 1)
    rows = near_copies(9, groups=3, size=30)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 9, 10).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 9, 10)


def test_keys_of_one_component_are_left_out(spark, monkeypatch):
    """A large group of near copies: once all are joined, the second pass has no key and writes no row."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MANY", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(60, 120)] = f"x{i}"
        rows.append((i, " ".join(t)))
    left = []
    keys = jaccard.Candidates.apart_keys

    def spy(self, groups):
        out = keys(self, groups)
        left.append((out.count(), self.count.count()))
        return out

    monkeypatch.setattr(jaccard.Candidates, "apart_keys", spy)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 9, 10).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 9, 10)
    assert left and left[0][0] == 0 < left[0][1]


def test_odd_rows(spark, odd, none, clashing):
    got = jaccard_components(odd, 3, 9, 10).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in odd.collect()], 3, 9, 10)
    assert sorted(map(str, jaccard_components(clashing, 3, 9, 10).collect())) == sorted(map(str, got))
    assert jaccard_components(none, 3, 9, 10).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130))


def joined(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("one_task", [0, 1 << 21])
@pytest.mark.parametrize("forest", [5, 1 << 20])
def test_components_of_forests(spark, monkeypatch, one_task, forest):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    monkeypatch.setattr(graph, "FOREST_EDGES", forest)
    rng = random.Random(one_task + forest)
    edges = [(a, b) for a, b in ((rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(80)) if a != b] + [(i + 1, i) for i in range(200, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)).collect()))
    assert got == joined(edges)


def test_components_need_no_round_for_each_step_of_a_chain(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "stored", lambda *a, f=graph.stored: kept.append(a[1]) or f(*a))
    assert components(spark.range(1, 400).selectExpr("id as a", "id - 1 as b")).filter("component = 0").count() == 400
    assert len(kept) == 1


def test_a_bitmap_takes_one_job_whatever_the_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(0, 3000, numPartitions=2).select(F.xxhash64("id").alias("h"))
    want = rows.toPandas()["h"].to_numpy()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("bitmap", "bitmap")
        got = bitmap.build(rows, 3000)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert bitmap.contains(got, want).all() and int(np.bitwise_count(got).sum()) == len(set(bitmap.slots(want, 17).tolist()))
    assert len(jobs) <= 3
