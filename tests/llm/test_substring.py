import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import substring
from quire.llm.substring import FMIndex, WaveletMatrix, code_lengths, dedup_substrings, op4_substring_dedup


def brute(rows, k=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_symbols", [1, 2, 40, 3000])
def test_wavelet_rank(n_symbols):
    rng = np.random.default_rng(3)
    seq = np.minimum(rng.geometric(0.05, 3000), n_symbols) - 1 if n_symbols < 3000 else rng.permutation(3000)
    w = WaveletMatrix(seq, n_symbols - 1)
    for c in sorted({int(seq[0]), int(seq.max()), int(np.bincount(seq).argmax()), int(seq[77])}):
        zero = w.descend(np.array([c]), np.array([0]))[0]
        at = np.array([0, 1, 63, 64, 65, 511, 512, 513, 1000, 2999, 3000])
        assert (w.descend(np.full(len(at), c), at) - zero).tolist() == [(seq[:x] == c).sum() for x in at]


def test_codes_are_huffmans():
    """A prefix code of the least total length, and the matrix holds that many bits."""
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 200):
        count = rng.integers(1, 1000, n)
        size = code_lengths(count)
        heap = count.tolist()
        least = 0
        while len(heap) > 1:
            heap.sort()
            least += heap[0] + heap[1]
            heap = [heap[0] + heap[1], *heap[2:]]
        assert (count * size).sum() == least and np.isclose((0.5**size).sum(), 1)
        w = WaveletMatrix(rng.permutation(np.repeat(np.arange(n), count)), n - 1)
        words = {format(int(c), f"0{k}b") for c, k in zip(w.code, w.length, strict=True)}
        assert len(words) == n and not any(x != y and y.startswith(x) for x in words for y in words)
        assert sum(len(b) for b in w.bits) * 64 < least + 512 * w.levels + 64


def test_matching_statistics_equal_plain_search():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 4, rng.integers(5, 21)).astype(np.uint64) for _ in range(50)]
    value = rng.permutation(50) * 10
    index = FMIndex(np.concatenate(texts), np.array([len(t) for t in texts]), value)
    k = 4
    syms = index.symbols(np.concatenate(texts))
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row = np.concatenate([np.full(len(t) - k + 1, i) for i, t in enumerate(texts)])
    end = np.concatenate([base[i] + np.arange(k - 1, len(t)) for i, t in enumerate(texts)])
    limit = value[row]
    got, least = index.matching(syms, base[row], end, limit, k, -1)

    def holders(p):
        return [int(value[i]) for i, x in enumerate(texts) if any((x[j : j + len(p)] == p).all() for j in range(len(x) - len(p) + 1))]

    for r, e, n, v in zip(row.tolist(), end.tolist(), got.tolist(), least.tolist(), strict=True):
        t, at = texts[r], e - int(base[r]) + 1
        want = max((m for m in range(k, at + 1) if min(holders(t[at - m : at])) < value[r]), default=0)
        assert n == want
        if want:
            assert v == min(holders(t[at - k : at]))


def passages(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(12, 60))] for _ in range(5)]
    rows = []
    for i in range(n):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(shared)
        rows.append((i * 7 % 101, rng.choice([" ", "\n", "  "]).join(t)))
    return rows


def plain(got):
    for r in got:
        assert sum(x.end - x.start for x in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted((tuple(r)[:4] for r in got), key=str)


@pytest.mark.parametrize("shard", [20_000, 6, 2])
def test_dedup_equals_brute_force(spark, monkeypatch, shard):
    """Few segments a shard: anchors are dealt by window, segments of several batches are merged."""
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", shard)
    monkeypatch.setattr(substring, "MERGE_ABOVE", 1)
    rows = passages(1) + [(200 + i, "a b " * 40) for i in range(8)]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    assert plain(got) == brute(rows)


def test_a_segment_of_many_batches_is_one_row(spark, monkeypatch):
    """Boilerplate in a batch for each row: before its shard it has few rows however many batches there are."""
    rng = random.Random(6)
    line = " ".join(f"b{i}" for i in range(30))
    rows = [(i, " ".join(f"u{rng.random()}" for _ in range(13)) + " " + line) for i in range(400)]
    monkeypatch.setattr(substring, "by_bytes", lambda batches, column, limit: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    seen = []
    search = substring.search_shards
    monkeypatch.setattr(substring, "_in_bitmap", spy(substring._in_bitmap, seen))
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert plain(got) == brute(rows) and search is substring.search_shards
    assert seen and max(seen) <= substring.MERGE_ABOVE


def spy(f, seen):
    def run(rows, column, bits, wanted):
        out = f(rows, column, bits, wanted)
        if column == "seg" and not wanted:
            seen.append(out.groupBy("seg").count().agg({"count": "max"}).first()[0] or 0)
        return out

    return run


def most_python_nodes(plan):
    """Of a physical plan, the most Python nodes on a way without an exchange: each is a worker for each task."""
    most = 0

    def walk(node):
        nonlocal most
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        below = max([0, *(walk(node.children().apply(i)) for i in range(node.children().size()))])
        here = 0 if "Exchange" in name else below + bool(re.search("Python|Pandas|Arrow", name))
        most = max(most, here)
        return here

    walk(plan)
    return most


def test_a_task_takes_one_worker(spark, monkeypatch):
    """Where segments are merged and anchors dealt by window, too: no stage has two Python nodes."""
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", 2)
    monkeypatch.setattr(substring, "MERGE_ABOVE", 1)
    workers = {}
    stored = substring.stored

    def seen(df, tag):
        workers[tag] = most_python_nodes(df._jdf.queryExecution().executedPlan())
        return stored(df, tag)

    monkeypatch.setattr(substring, "stored", seen)
    rows = passages(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of large tables
    try:
        out = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
        workers["out"] = most_python_nodes(out._jdf.queryExecution().executedPlan())
        assert plain(out.collect()) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "windows" in workers and set(workers.values()) <= {0, 1} and workers["out"] == 1


def test_the_last_join_has_an_exchange(spark):
    """However few rows lose words, the pass before the join and the one after it are in stages of their own."""
    rows = passages(3)
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert most_python_nodes(out._jdf.queryExecution().executedPlan()) == 1
    assert plain(out.collect()) == brute(rows)


def test_odd_rows(spark, odd, none, clashing, write):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert plain(dedup_substrings(odd).collect()) == want
    assert plain(dedup_substrings(clashing).collect()) == want
    assert dedup_substrings(none).collect() == []
    got = op4_substring_dedup(spark, write(documents=odd)).collect()
    assert sorted((r.n_removed, r.kept_sha256) for r in got) == sorted((n, hashlib.sha256(k.encode()).hexdigest()) for _, _, n, k in want)
