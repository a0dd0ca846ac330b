import random
import re

from quire.llm import decontam
from quire.llm.decontam import drop_leaks, find_leaks

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, items):
    out = []
    for d, t in docs:
        s = grams(t)
        for i, x in items:
            g = grams(x)
            if g and i is not None and 10 * len(s & g) >= 8 * len(g):
                out.append((d, i, len(g), len(s & g)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 9, 30, 70])))) for i in range(30)] + [(30, None), (31, ""), (None, "a b c d e f"), (3, "x y z q r s t u")]
    docs = []
    for d in range(80):
        t = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 50, 3000]))]
        if d % 3 == 0:
            leak = (items[rng.randrange(30)][1] or "").upper().split()
            if d % 2 and len(leak) > 20:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = leak
        docs.append((d, " ".join(t)))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = cases(5)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 15
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in find_leaks(d, i).collect()), key=str) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)  # many blocks
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in find_leaks(d, i).collect()), key=str) == want
    left = {r.doc_id for r in drop_leaks(d, i).collect()}
    assert left == {x for x, _ in docs} - {x[0] for x in want}


def test_items_scattered_through_a_long_document(spark):
    """The words of an item's shingles stand in pieces, far from each other, and a fifth is missing."""
    rng = random.Random(8)
    vocab = [f"u{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([12, 18, 20, 35, 37, 40, 70, 75, 140, 150] * 4)]
    docs = []
    for d, (i, x) in enumerate(items):
        w = x.split()
        pieces = [w[k : k + 14] for k in range(0, len(w) - 4, 10)]  # each shingle stays whole in some piece
        pieces = pieces[:-1] if len(pieces) > 5 else pieces
        rng.shuffle(pieces)
        docs.append((d, " ".join(y for p in pieces for y in [*p, *(rng.choice(vocab) for _ in range(rng.randint(50, 400)))])))
    want = brute(docs, items)
    assert len(want) >= 36
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in find_leaks(d, i).collect()), key=str) == want


def test_items_without_an_id_leak_too(spark, odd):
    items = spark.createDataFrame([(None, "quick brown fox jumps over the lazy dog")], "item_id bigint, text string")
    assert find_leaks(odd, items).collect() == [] and drop_leaks(odd, items).filter("doc_id in (1, 5)").isEmpty()


def test_classes_are_finer_than_a_quarter():
    assert all(n <= decontam.class_size(n) <= max(n, 1.25 * n) for n in range(1, 5000))


def test_odd_rows(spark, odd, none, clashing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in find_leaks(odd, items).collect()) == [1, 5, 5]
    assert find_leaks(none, items).collect() == [] and find_leaks(odd, items.limit(0)).collect() == []
    assert find_leaks(clashing, items).count() == 3
    assert drop_leaks(clashing, items).count() == 11
