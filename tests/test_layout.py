import datetime

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import geometry_joins as J
from quire.operators import layout as L
from quire.operators import quality as Q
from quire.operators import stats as A
from quire.plans import layout_queries
from quire.streaming import jobs as ST

BOX = "page int, rid string, x0 double, top double, x1 double, bottom double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], BOX)


def test_touching_edges_at_each_pad(spark):
    b = boxes(spark, [("a", 0.0, 0.0, 10.0, 10.0), ("b", 10.0, 0.0, 20.0, 10.0), ("c", 9.0, 0.0, 12.0, 10.0)])
    assert {(r.rid_a, r.rid_b) for r in J.overlap_pairs(b, 0.0).collect()} == {("a", "c"), ("b", "c")}
    assert {(r.rid_a, r.rid_b) for r in J.overlap_pairs(b, -2.0).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {(r.rid_a, r.rid_b) for r in J.overlap_pairs(b, 1.0).collect()} == {("b", "c")}


def test_containment_and_nearest(spark):
    b = boxes(spark, [("big", 0.0, 0.0, 100.0, 100.0), ("in", 10.0, 10.0, 20.0, 20.0), ("half", 95.0, 0.0, 115.0, 10.0), ("low", 0.0, 120.0, 50.0, 130.0)])
    assert {(r.rid, r.zone) for r in J.contained(b, b).collect()} == {("in", "big")}
    assert {r.rid for r in J.uncovered(b, b).collect()} == {"big", "half", "low"}
    near = {r.rid: (r.below, r.gap) for r in J.nearest_below(b).collect()}
    assert near["big"] == ("low", 20.0) and near["in"] == ("low", 100.0) and "half" not in near
    assert sorted((r.top, r.bottom) for r in J.merged_bands(b).collect()) == [(0.0, 100.0), (120.0, 130.0)]


def test_first_unused(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "key string, seq int")
    b = spark.createDataFrame([("k", 7), ("k", 9)], "key string, seq int")
    assert sorted((r.displaced, r.kept) for r in J.first_unused(a, b, ["key"], "seq").collect()) == [(1, 7), (2, 9)]


def test_medians_and_modes(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 4.0, 1), ("a", 8.0, 1), ("b", None, 1)], "k string, v double, w int")
    assert df.filter("k = 'a'").agg(A.upper_median(F.col("v")).alias("m")).first().m == 4.0
    assert {r.k: r.body_size for r in A.weighted_mode(df, ["k"], F.col("v"), F.col("w")).collect()} == {"a": 1.0, "b": 10.0}
    first = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, "x", 5), (1, "y", 9)], "k int, c string, p int")
    assert A.modal(first, ["k"], "c", "p").first().c == "y"


def test_scalars(spark):
    r = spark.range(1).select(
        G.rgb(F.array(F.lit(0.5))).alias("gray"), G.rgb(F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0)))).alias("cmyk"), G.quarter_size(F.lit(9.0), 0.93).alias("q"),
        G.token_budget(F.lit(100)).alias("low"), G.token_budget(F.lit(100000)).alias("high"), G.justify_gap(F.lit(100.0), F.lit(95.0), F.lit(5), F.lit(10.0)).alias("j"), G.justify_gap(F.lit(100.0), F.lit(50.0), F.lit(5), F.lit(10.0)).alias("n"),
    ).first()
    assert r.gray == [0.5] * 3 and r.cmyk == [1.0, 0.0, 0.0] and r.q == 8.25 and (r.low, r.high) == (1024, 16000) and r.j == 1.0 and r.n is None


def test_placing_drops_nothing(spark):
    units = spark.createDataFrame([("d", 0, 1, 10.0, 100.0, 10.0, 20.0, 10.0, "日本語の長い文章です。" * 8), ("d", 0, 2, 10.0, 100.0, 60.0, 70.0, 10.0, "short")], "doc_id string, page int, uid int, x0 double, x1 double, top double, bottom double, size double, target string")
    boxed = L.region_boxes(units, units.limit(0))
    assert {r.uid: r.limit for r in boxed.collect()} == {1: 58.0, 2: 800.0}
    placed = L.place_units(boxed)
    drawn = {r.uid: r.n for r in placed.groupBy("uid").agg(F.sum("nch").alias("n")).collect()}
    assert drawn == {1: 88, 2: 5}
    assert Q.unit_drawn(units.withColumn("source", F.lit("x")), placed).count() == 0
    flow = L.reflow(units.withColumn("ord", F.col("uid")), columns=2, height=60.0)
    assert flow.agg(F.sum(F.length("text")).alias("n")).first().n == 93


def test_quality_checks(spark):
    units = spark.createDataFrame([("d", 1, "source text here", None), ("d", 2, "b", "⟦T3⟧ leaked"), ("d", 3, "Same", "same!"), ("e", 1, "x", "日本")], "doc_id string, uid int, source string, target string")
    assert {(r.doc_id, r.detail) for r in Q.untranslated(units).collect()} == {("d", "1")}
    assert Q.placeholder_leak(units).count() == 1
    placed = spark.createDataFrame([("d", 1, "日本語", 60), ("e", 1, "日" * 60, 60)], "doc_id string, uid int, text string, nch int")
    assert {r.doc_id for r in Q.empty_output(units, placed).collect()} == {"d", "e"}
    assert Q.missing_glyph(placed, spark.createDataFrame([("日",)], "ch string")).first().detail == "本語"
    words = spark.createDataFrame([("d", w) for w in ("leftover", "allowed", "abc")], "doc_id string, word string")
    assert [r.word for r in Q.residual_words(words, spark.createDataFrame([("d", "xxallowedyy")], "doc_id string, blob string")).collect()] == ["leftover"]
    all_ = Q.review([Q.untranslated(units), Q.placeholder_leak(units), Q.empty_output(units, placed)])
    assert all_.count() == 3


def test_jobs(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "queued", t, 7), (2, "done", t, 7), (3, "done", t + datetime.timedelta(days=9), 8), (4, "running", t, 8)]
    jobs = spark.createDataFrame(rows, "id int, status string, created timestamp, client int")
    assert [r.id for r in ST.expired(jobs, t + datetime.timedelta(days=10)).collect()] == [2]
    assert {r.client: r.id for r in ST.latest_state(jobs).collect()} == {7: 2, 8: 3}
    assert ST.restart(jobs).filter("status = 'running'").count() == 0
    assert [r.id for r in ST.recent_jobs(jobs, 2).collect()] == [3, 1]
    lines = spark.createDataFrame([(1, 1, "[producer] start"), (1, 2, "[editor] translated 2/4 units"), (1, 3, "noise")], "job int, ts int, line string")
    assert ST.progress(lines).first().done == 2


def test_placed_lines_draw_every_line_of_every_document(spark, tmp_path):
    texts = {1: "first line\nsecond line\n\nfourth line", 2: "\n".join(f"line {k} " + "word " * (k % 90) for k in range(95)), 3: None, 4: ""}
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.uid): r for r in layout_queries.placed_lines(spark, str(tmp_path)).collect()}
    want = {(i, k): len(line) for i, t in texts.items() if t is not None for k, line in enumerate(t.split("\n"))}
    assert {k: r.drawn for k, r in got.items()} == want
    assert got[2, 0].n_lines == 1 and got[2, 0].size == 10.0 and got[2, 89].n_lines > 1 and got[1, 2].n_lines == 0


def test_skipped_sizes_would_not_have_fitted():
    for n in (0, 3, 71, 72, 73, 140, 219, 230, 900):
        for text in ("x" * n, ("ab, " * n)[:n], ("日本。" * n)[:n], ("one two\n" * n)[:n]):
            for width in (5.0, 60.0, 360.0):
                s, lines = 10.0, L.wrap(text, 10.0, width)
                while s > 4.5 and len(lines) * s * 1.35 > 18.0:
                    s -= 0.25
                    lines = L.wrap(text, s, width)
                assert L.fit_size(text, 10.0, width, 18.0) == (s, lines)
