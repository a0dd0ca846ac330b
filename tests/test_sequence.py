import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import sequence as S

random.seed(3)


def test_greedy_packing_equals_a_loop(spark):
    rows = [(k, i, random.choice([1, 400, 900, 6000, 6001, 2500])) for k in range(12) for i in range(random.randint(1, 40))]
    got = {(r.k, r.i): r.grp for r in S.pack_greedy(spark.createDataFrame(rows, "k int, i bigint, n bigint"), ["k"], "i", "n").collect()}
    for k in range(12):
        group, size, count = 0, 0, 0
        for _, i, n in sorted(r for r in rows if r[0] == k):
            if count and (size + n > 6000 or count >= 10):
                group, size, count = group + 1, 0, 0
            size, count = size + n, count + 1
            assert got[k, i] == group


def test_rate_limit_equals_a_loop(spark):
    rows = [(c, i, random.randint(0, 20_000)) for c in range(5) for i in range(120)]
    df = spark.createDataFrame(rows, "c int, i bigint, s int").select("c", "i", F.timestamp_seconds("s").alias("t"))
    got = {(r.c, r.i): r.accepted for r in S.rate_limit(df, "c", "t", "i", 7, 3600).collect()}
    for c in range(5):
        log = []
        for _, i, s in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            log = [x for x in log if x >= s - 3600]
            assert got[c, i] == (len(log) < 7)
            if len(log) < 7:
                log.append(s)


def test_rate_limit_counts_only_accepted(spark):
    """31 requests in an hour, one exactly an hour after the first: it is still within the log."""
    rows = [(1, i, i) for i in range(31)] + [(1, 31, 3600), (1, 32, 3601)]
    df = spark.createDataFrame(rows, "c int, i bigint, s int").select("c", "i", F.timestamp_seconds("s").alias("t"))
    got = {r.i: r.accepted for r in S.rate_limit(df, "c", "t", "i").collect()}
    assert [i for i in range(31) if not got[i]] == [30] and got[31] is False and got[32] is True


def plain_continues(p, n):
    t, h = p.rstrip(), n.lstrip()
    if not t or not h:
        return False
    if t.endswith("-"):
        return True
    if re.sub(r"[\s\d,–\-]+$", "", t)[-1:] in tuple(".!?。:;") and re.sub(r"[\s\d,–\-]+$", "", t):
        return False
    if h[0].islower() or h[0] in "(‘’\"'" or h[0].isdigit():
        return True
    return len(t) >= 80


@given(st.lists(st.tuples(st.text("ab. -9A", max_size=6), st.text("ab(9A ", max_size=4)), min_size=1, max_size=40))
@settings(max_examples=10, deadline=None)
def test_continuation_equals_plain_rules(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, n string")
    got = df.select(T.continues(F.col("p"), F.col("n"), F.lit("body")).alias("c")).collect()
    assert [r.c for r in got] == [plain_continues(p, n) for p, n in pairs]


@pytest.mark.parametrize(
    ("prev", "nxt", "kind", "want"),
    [
        ("ends with hyph-", "enated word", "body", True), ("see https://a.b/c", "and more", "body", False), ("as shown before.4", "next one", "body", False),
        ("x" * 79, "Capital", "body", False), ("x" * 80, "Capital", "body", True), ("goes on", "in lower", "body", True), ("goes on", "in lower", "heading", False),
        ("© 2020 all", "in lower", "body", False), ("", "a", "body", False),
    ],
)
def test_continuation_cases(spark, prev, nxt, kind, want):
    assert spark.range(1).select(T.continues(F.lit(prev), F.lit(nxt), F.lit(kind)).alias("c")).first().c is want


def test_stitching_breaks_and_joins(spark):
    rows = [
        (1, 0, "An introduction to", "heading"), (1, 1, "the body begins and goes", "body"), (1, 2, "on in the next block and inter-", "body"), (1, 3, "rupted words join up.", "body"),
        (1, 4, "A new sentence starts", "body"), (1, 5, "• item one goes", "body"), (1, 6, "label text here", "label"), (1, 7, "after the label", "body"), (2, 0, "another document", "body"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, ord int, text string, type string")
    units = {(r.doc_id, r.unit): r.source for r in B.unit_texts(B.stitch_units(df, ["doc_id"], ["ord"]), ["doc_id"], "ord").collect()}
    assert units[1, 1] == "the body begins and goes on in the next block and interrupted words join up."
    assert len(units) == 7 and units[2, 0] == "another document"


def test_stitching_on_landscape_pages(spark):
    cols = "doc_id int, ord int, page int, text string, type string, width double, height double, x0 double, x1 double, top double, bottom double, nlines int"
    rows = [(1, 0, 0, "an island of text", "body", 800.0, 600.0, 10.0, 100.0, 10.0, 20.0, 1), (1, 1, 0, "right below it", "body", 800.0, 600.0, 10.0, 100.0, 22.0, 32.0, 1), (1, 2, 0, "far away from it", "body", 800.0, 600.0, 500.0, 600.0, 300.0, 310.0, 1), (1, 3, 1, "next page of it", "body", 800.0, 600.0, 500.0, 600.0, 10.0, 20.0, 1)]
    got = B.stitch_units(spark.createDataFrame(rows, cols), ["doc_id"], ["ord"]).orderBy("ord").collect()
    assert [r.unit for r in got] == [0, 0, 1, 2]


def test_reading_order_by_bands(spark):
    rows = [("t", 0, 0.0, 10.0), ("l1", 1, 20.0, 30.0), ("l2", 1, 40.0, 50.0), ("r1", 2, 15.0, 25.0), ("f", 0, 60.0, 70.0), ("l3", 1, 80.0, 90.0), ("e", 0, 60.0, 70.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "page int, rid string, col int, top double, bottom double")
    got = [r.rid for r in B.reading_order(df, ["page"]).orderBy("ord").collect()]
    assert got == ["t", "l1", "l2", "r1", "e", "f", "l3"]


def test_ambiguous_and_chain(spark):
    rows = [(1, "dropped text", True, False), (2, "•", False, False), (3, "maybe", True, True), (4, "kept text", False, False), (5, "maybe", True, True), (6, "kept too", False, False)]
    df = spark.createDataFrame([(1, *r, "Tj") for r in rows], "page int, seq int, text string, dropped boolean, ambiguous boolean, op string")
    got = {r.seq: r.dropped for r in S.resolve_ambiguous(df, ["page"], "seq").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    chain = spark.createDataFrame([(1, 1, "BT", "", False), (1, 2, "Tj", "gone", True), (1, 3, "Tj", "slides", False), (1, 4, "Td", "", False), (1, 5, "Tj", "stays", False)], "page int, seq int, op string, text string, dropped boolean")
    assert [r.seq for r in S.advance_chain(chain, ["page"], "seq").filter("displaced").collect()] == [3]


def test_chunks_keep_sentences():
    text = "One two. " * 100
    parts = S.chunk_sentences(text, 100)
    assert all(len(p) <= 100 for p in parts) and " ".join(parts).split() == text.split()
    assert S.chunk_sentences(None) == [""] and S.chunk_sentences("short") == ["short"]


def test_sandwich_sweep_and_zone(spark):
    ops = spark.createDataFrame([(1, 1, "long gone", True), (1, 2, "a", False), (1, 3, "b", False), (1, 4, "also gone", True), (1, 5, "c", False), (1, 6, "kept text", False)], "page int, seq int, text string, dropped boolean")
    assert [r.seq for r in S.sandwiched(ops, ["page"], "seq").filter("dropped").orderBy("seq").collect()] == [1, 2, 3, 4]
    chars = spark.createDataFrame([(1, i, c, False, "xxhelloworldyy", "") for i, c in enumerate("helloworld")] + [(1, 20, "zz", False, "xxhelloworldyy", "")], "page int, seq int, text string, dropped boolean, blob string, keep string")
    assert S.sweep_runs(chars, ["page"], "seq").filter("dropped").count() == 10
    cols = "doc_id int, page int, col int, top double, type string, text string, n_pages int"
    rows = [(1, 0, 0, 10.0, "body", "1. Not a reference", 4), (1, 2, 1, 10.0, "heading", "References", 4), (1, 2, 1, 20.0, "body", "1. Smith, J. A paper", 4), (1, 2, 1, 30.0, "body", "goes on here", 4), (1, 2, 2, 5.0, "data", "kept", 4), (1, 3, 0, 10.0, "body", "Appendix text", 4)]
    got = [r.type for r in S.reference_zone(spark.createDataFrame(rows, cols)).orderBy("page", "col", "top").collect()]
    assert got == ["body", "heading", "reference", "reference", "data", "body"]


def test_merge_and_chars_and_chains(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 20.0, 0.0, 30.0, 10.0), (1, 100.0, 100.0, 110.0, 110.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert sorted(r.n for r in S.merge_boxes(boxes, ["page"]).collect()) == [1, 2]
    chars = spark.createDataFrame([(1, "a", 0.0, 0.0), (1, "a", 0.2, 0.1), (1, "a", 9.0, 0.0), (1, "b", 0.0, 0.0)], "page int, text string, x0 double, top double")
    assert S.dedupe_chars(chars, ["page"]).count() == 3
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "uid int, next_uid int")
    assert all(r.head == (0 if r.uid < 10 else r.uid) for r in S.chain_units(links, spark.range(12).select(F.col("id").cast("int").alias("uid"))).collect())
    line = spark.createDataFrame([(1, 0, "a", 0.0, 5.0), (1, 1, "b", 5.0, 10.0), (1, 2, "c", 13.0, 18.0)], "line int, pos int, text string, x0 double, x1 double")
    assert S.insert_spaces(line, ["line"], "pos").first().text == "ab c"
