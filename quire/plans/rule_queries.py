"""Queries that call one rule each on constructed cases over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import geometry_joins as J
from quire.operators import quality as Q
from quire.operators import stats as A
from quire.plans.registry import query
from quire.sources.views import V_BLOCK_SQL, V_RECT_SQL, table, v_block, v_rect

_DEFECT = "{0} AS doc_id, '{1}' AS role, '{2}' AS kind, {3} AS detail, '{4}' AS param"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units whose target is their text behind a character of their own."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("uid"), F.col("text").alias("source"), F.concat(F.lit("訳"), "text").alias("target"))


@query(
    "units_drawn",
    f"""SELECT {_DEFECT.format("conv_id", "editor", "unit_dropped", "CAST(turn AS VARCHAR)", "shrink")} FROM conversations WHERE turn % 3 = 2
    UNION ALL SELECT {_DEFECT.format("conv_id", "editor", "unit_truncated", "CAST(turn AS VARCHAR)", "shrink")} FROM conversations WHERE turn % 3 = 1 AND 1 < length(text) + 1 - 2""",
)
def units_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three turns the first is drawn whole, of the second one character, the third not at all."""
    units = _units(spark, sf_dir)
    placed = units.filter("uid % 3 <> 2").select("doc_id", "uid", F.when(F.col("uid") % 3 == 0, F.length("target")).otherwise(1).alias("nch"))
    return Q.unit_drawn(units, placed)


@query("drifted_boxes", f"WITH {V_RECT_SQL} SELECT {_DEFECT.format('page', 'editor', 'layout_drift', 'rid', 'shrink')} FROM v_rect WHERE abs(x0 + 4 * n - x0) > 14 OR top + 12 * n - 22 - top < -8 OR top + 12 * n - 22 - top > 42")
def drifted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes drawn the farther off, the higher their number. Lines that share all four numbers are boxes of their own."""
    copy = F.row_number().over(Window.partitionBy("page", "rid").orderBy("x0", "top"))
    source = v_rect(spark, sf_dir).select(F.col("page").alias("doc_id"), F.col("rid").alias("uid"), copy.alias("copy"), "x0", "top", "n")
    drawn = source.withColumn("x0", F.col("x0") + 4 * F.col("n")).withColumn("top", F.col("top") + 12 * F.col("n") - 22)
    return Q.layout_drift(source, drawn, ("doc_id", "copy", "uid"))


@query(
    "small_titles",
    f"""WITH {V_RECT_SQL}, p AS (SELECT page, col, median(x0) AS ignored, list_sort(list(x0))[CAST(count(*) // 2 AS BIGINT) + 1] AS body_size FROM v_rect GROUP BY page, col),
    d AS (SELECT page, list_sort(list(body_size))[CAST(count(*) // 2 AS BIGINT) + 1] AS body FROM p GROUP BY page)
    SELECT {_DEFECT.format("page", "editor", "size_fidelity", "rid", "shrink")} FROM v_rect JOIN d USING (page) WHERE x0 >= 1.3 * body AND x0 * (0.3 + 0.1 * n) < 0.55 * x0""",
)
def small_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an order stand for a document's pages, left edges for sizes; the lower a number, the smaller it is drawn."""
    r = v_rect(spark, sf_dir).select(F.col("page").alias("doc_id"), "col", F.col("rid").alias("uid"), F.col("x0").alias("size"), "n")
    pages = r.groupBy("doc_id", "col").agg(A.upper_median(F.col("size")).alias("body_size"))
    return Q.size_fidelity(r, r.select("doc_id", "uid", (F.col("size") * (0.3 + 0.1 * F.col("n"))).alias("size")), pages)


@query("overflowing", f"SELECT {_DEFECT.format('o_orderkey', 'editor', 'overflow', chr(39) + 'overflow' + chr(39), 'shrink')} FROM orders WHERE o_totalprice > 100000")
def overflowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: orders stand for reports, dear ones overflow."""
    return Q.overflow(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") > 100000).alias("overflow")))


_BOTH = "greatest(0, least(e.x1, j.x1) - greatest(e.x0, j.x0)) AS ix, greatest(0, least(e.bottom, j.bottom) - greatest(e.top, j.top)) AS iy"


@query(
    "overprinted",
    f"""WITH {V_RECT_SQL}, h AS (SELECT e.page, e.rid, {_BOTH} FROM v_rect e JOIN v_rect j ON e.page = j.page WHERE e.kind = 'R' AND j.kind = 'N')
    SELECT {_DEFECT.format("page", "producer", "text_overlap", "CAST(count(DISTINCT rid) AS VARCHAR)", "restrip")} FROM h WHERE least(ix, iy) >= 2.5 AND ix * iy > 8 GROUP BY page""",
)
def overprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines stand for English words, new ones for Japanese."""
    r = v_rect(spark, sf_dir).withColumn("doc_id", F.col("page"))
    return Q.text_overlap(r.filter("kind = 'N'"), r.filter("kind = 'R'"))


@query(
    "missing_glyphs",
    f"""WITH c AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS ch FROM documents), f AS (SELECT DISTINCT ch FROM c JOIN documents USING (doc_id) WHERE lang = 'en')
    SELECT {_DEFECT.format("doc_id", "editor", "missing_glyph", "substring(array_to_string(list_sort(list(ch)), ''), 1, 40)", "restrip")} FROM c WHERE ch <> '' AND unicode(ch) > 127 AND ch NOT IN (SELECT ch FROM f) GROUP BY doc_id""",
)
def missing_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q03: a font with the characters of the English documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return Q.missing_glyph(docs, A.charset(docs.filter("lang = 'en'")))


@query(
    "reviewed",
    f"""WITH {V_RECT_SQL}, d AS (SELECT {_DEFECT.format("o_orderkey", "editor", "overflow", chr(39) + "overflow" + chr(39), "shrink")} FROM orders WHERE o_totalprice > 100000
      UNION ALL SELECT {_DEFECT.format("page", "editor", "layout_drift", "rid", "shrink")} FROM v_rect WHERE abs(x0 + 4 * n - x0) > 14 OR top + 12 * n - 22 - top < -8 OR top + 12 * n - 22 - top > 42)
    SELECT doc_id, role, kind, detail, param FROM (SELECT *, row_number() OVER (PARTITION BY role, kind ORDER BY doc_id, detail) AS r FROM d) WHERE r = 1""",
)
def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each kind of defect."""
    return Q.review([overflowing(spark, sf_dir), drifted_boxes(spark, sf_dir)])


@query(
    "admission",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'password' WHEN n_chars < 10 THEN 'no pages' WHEN n_chars // 10 > 300 THEN 'too long' WHEN n_chars < 50 THEN 'no text'
      WHEN doc_id % 5 >= greatest(2, ceil(4 * 0.5)) THEN 'scan' END AS reason FROM documents""",
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of a page for each ten characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 10).alias("pages"), F.col("n_chars").alias("chars"), (F.col("doc_id") % 7 == 0).alias("encrypted"), (F.col("doc_id") % 11 != 0).alias("readable"), (F.col("doc_id") % 5).alias("scanned_pages"), F.lit(4).alias("seen_pages"))
    return B.reject_reason(docs).select("doc_id", "reason")


@query("weighted_means", f"WITH {V_RECT_SQL} SELECT page, round(sum(x0 * n) / sum(n), 3) AS mean FROM v_rect GROUP BY page")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07."""
    return v_rect(spark, sf_dir).groupBy("page").agg(A.weighted_mean(F.col("x0"), F.col("n")).alias("mean"))


@query(
    "first_unused",
    f"""WITH {V_RECT_SQL}, a AS (SELECT page, col, rid, row_number() OVER (PARTITION BY page, col ORDER BY rid) AS r FROM v_rect WHERE kind = 'R'), b AS (SELECT page, col, rid, row_number() OVER (PARTITION BY page, col ORDER BY rid) AS r FROM v_rect WHERE kind <> 'R')
    SELECT page, col, a.rid AS displaced, b.rid AS kept FROM a JOIN b USING (page, col, r)""",
)
def first_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines stand for displaced texts, the others for kept ones; page and column for their key."""
    r = v_rect(spark, sf_dir)
    return J.first_unused(r.filter("kind = 'R'"), r.filter("kind <> 'R'"), ["page", "col"], "rid")


@query(
    "flowing_documents",
    f"""WITH {V_BLOCK_SQL}, s AS (SELECT doc_id, median((ord % 10) / 10.0) AS figures FROM v_block GROUP BY doc_id),
    t AS (SELECT doc_id, sum(CASE WHEN length(text) >= 60 THEN length(text) ELSE 0 END) / nullif(sum(length(text)), 0) AS long FROM v_block GROUP BY doc_id)
    SELECT doc_id, round(figures, 6) AS figures, figures < 0.3 AND coalesce(long >= 0.5, FALSE) AS flowing FROM s JOIN t USING (doc_id)""",
)
def flowing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line stands for a page, its place for its figures' share; lines of 60 characters count as long blocks."""
    rows = v_block(spark, sf_dir)
    pages = rows.select("doc_id", ((F.col("ord") % 10) / 10.0).alias("figure_share"))
    blocks = rows.select("doc_id", "text", F.when(F.length("text") >= 60, 3).otherwise(1).alias("nlines"))
    return A.flowing(blocks, pages).select("doc_id", F.round("figures", 6).alias("figures"), "flowing")


@query(
    "charted",
    f"""WITH {V_RECT_SQL}, m AS (SELECT page, rid, x0 + 1 AS x0, x0 + 2 AS x1, top + 1 AS top, top + 2 AS bottom FROM v_rect)
    SELECT m.page, b.rid AS zone, count(*) AS n_marks FROM m JOIN v_rect b ON m.page = b.page AND m.rid <> b.rid AND m.x0 >= b.x0 AND m.x1 <= b.x1 AND m.top >= b.top AND m.bottom <= b.bottom GROUP BY m.page, b.rid HAVING count(*) >= 2""",
)
def charted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 without its tests of size: boxes with two marks or more, a mark standing in the corner of each other box."""
    r = v_rect(spark, sf_dir)
    marks = r.select("page", "rid", (F.col("x0") + 1).alias("x0"), (F.col("x0") + 2).alias("x1"), (F.col("top") + 1).alias("top"), (F.col("top") + 2).alias("bottom"))
    return J.chart_boxes(r, marks, least=2)


@query("body_characters", f"WITH {V_RECT_SQL} SELECT page, count(*) AS n FROM v_rect WHERE kind <> 'A' AND abs(round_even(x0, 0) - 20) <= 1 GROUP BY page")
def body_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes stand for characters, those of kind A don't stand upright."""
    chars = v_rect(spark, sf_dir).select("page", F.col("rid").alias("text"), (F.col("kind") != "A").alias("upright"), F.col("x0").alias("size"), F.lit(20).alias("body_size"))
    return A.body_chars(chars).groupBy("page").agg(F.count("*").alias("n"))


@query(
    "report_counters",
    f"""WITH {V_BLOCK_SQL}, u AS (SELECT conv_id AS doc_id, count(*) AS units, count(*) FILTER (turn % 2 = 1) AS joins FROM conversations GROUP BY 1), b AS (SELECT doc_id, count(*) AS blocks FROM v_block GROUP BY 1)
    SELECT doc_id, 1 AS pages, coalesce(blocks, 0) AS blocks, coalesce(units, 0) AS units, coalesce(joins, 0) AS joins FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN u USING (doc_id)""",
)
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one page; turns stand for units, odd ones over two blocks."""
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 2 + 1).alias("n_blocks"))
    return A.report_counters(table(spark, sf_dir, "documents").select("doc_id"), v_block(spark, sf_dir).select("doc_id"), units)


_PAIR = "a.page = b.page AND a.rid < b.rid AND a.x0 < b.x1 - {0} AND b.x0 < a.x1 - {0} AND a.top < b.bottom - {0} AND b.top < a.bottom - {0}"


@query(
    "new_overlaps",
    f"WITH {V_RECT_SQL}, n AS (SELECT a.page, a.rid AS rid_a, b.rid AS rid_b FROM v_rect a JOIN v_rect b ON {_PAIR.format('0.5')}), k AS (SELECT a.page, a.rid AS rid_a, b.rid AS rid_b FROM v_rect a JOIN v_rect b ON {_PAIR.format('3.0')}) SELECT page, rid_a, rid_b FROM n ANTI JOIN k USING (page, rid_a, rid_b)",
)
def new_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by 0.5 beyond the known ones, those by 3."""
    r = v_rect(spark, sf_dir)
    return A.new_pairs(J.overlap_pairs(r, 0.5), J.overlap_pairs(r, 3.0))


@query("largest_boxes", f"WITH {V_RECT_SQL}, a AS (SELECT page, rid, (x1 - x0) * (bottom - top) AS area FROM v_rect), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY area DESC, rid) AS INTEGER) AS place FROM a) SELECT page, rid, round(area, 6) AS area, place FROM r WHERE place <= 3")
def largest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest boxes of each page."""
    return A.largest(v_rect(spark, sf_dir), 3).withColumn("area", F.round("area", 6))
