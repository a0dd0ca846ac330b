"""Classification of blocks, stitching into units, reading order, running furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

TRANSLATABLE = ("body", "heading", "caption", "title", "label")
KEPT = ("data", "reference", "running_head", "pagenum")


def block_type(t: Column, *, size: Column, body: Column, top: Column, bottom: Column, page: Column, page_height: Column, bold: Column, nlines: Column, num_lines: Column, math: Column, ref_zone: Column) -> Column:
    """P10: the type of a block; the first rule that fits decides."""
    low, trim = F.lower(t), F.trim(t)
    bare_number = trim.rlike("^[0-9]{1,4}$")
    head = (F.length(t) < 120) & (t.contains("/") | t.contains("Journal") | t.contains("et al") | (size < body))
    foot = low.contains("doi") | t.contains("©") | low.contains("rights reserved") | low.contains("front matter") | t.rlike(r"[0-9]{4}-[0-9]{3,4}")
    caps = (T.caps_ratio(t) >= 0.7) & (nlines <= 3) & (F.length(t) < 70 * F.greatest(nlines, F.lit(1)))
    return (
        F.when(T.is_mathish(t, math), "data")
        .when(T.is_caption(t), "caption")
        .when(T.is_number_row(t), "data")
        .when(T.is_numericish(t) | ((nlines >= 2) & (num_lines / nlines >= 0.6)), "data")
        .when((top < page_height * 0.07) & bare_number, "pagenum")
        .when((top < page_height * 0.07) & head, "running_head")
        .when((bottom > page_height * 0.90) & bare_number, "pagenum")
        .when((bottom > page_height * 0.90) & foot, "running_head")
        .when(bare_number, "pagenum")
        .when(ref_zone & T.is_reference(t), "reference")
        .when((page == 0) & (size >= body * 1.5), "title")
        .when(T.is_heading(t) | (bold & (size >= body * 1.05) & (F.length(t) < 60)), "heading")
        .when(T.is_badge(t, size, nlines), "data")
        .when(F.coalesce(caps, F.lit(False)), "heading")
        .when((nlines == 1) & trim.rlike("^[A-Z][A-Za-z]{2,15}$"), "heading")
        .otherwise("body")
    )


def text_block_type(t: Column) -> Column:
    """P10 for a line of body size in the middle of a page, where only the text decides."""
    one, zero = F.lit(1), F.lit(0.0)
    return block_type(t, size=F.lit(10.0), body=F.lit(10.0), top=F.lit(400.0), bottom=F.lit(410.0), page=F.lit(1), page_height=F.lit(800.0), bold=F.lit(False), nlines=one, num_lines=F.lit(0), math=zero, ref_zone=F.lit(False))


def stitch_units(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Blocks (text, type) of each key in order, with unit, the running number of the unit that each is part of.

    A unit begins where the pair of neighbours doesn't continue (P15), at list items, and on both sides
    of headings, captions, titles and labels. Optional columns: page, width, height, x0, x1, top, bottom,
    nlines, size, body_size, is_list, is_cell, cont_next, cont_prev.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    cols = set(blocks.columns)
    alone = F.col("type").isin("heading", "caption", "title")
    if {"size", "body_size"} <= cols:
        alone = alone | F.coalesce(F.col("size") >= 1.3 * F.col("body_size"), F.lit(False))
    rows = blocks.filter(F.col("type").isin(*TRANSLATABLE) & T.has_real_word(F.col("text"))).withColumn("_alone", alone)

    def before(c: str) -> Column:
        return F.lag(c).over(w)

    rows = rows.withColumn("_ptext", before("text")).withColumn("_palone", before("_alone")).withColumn("_ptype", before("type"))
    cut = F.col("_ptext").isNull() | F.col("_alone") | F.col("_palone") | T.is_list_item(F.col("text")) | (F.col("type") == "label") | (F.col("_ptype") == "label")
    for flag in ("is_list", "is_cell"):
        if flag in cols:
            cut = cut | F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(before(flag), F.lit(False))
    if {"page", "width", "height"} <= cols:
        wide = (F.col("width") > F.col("height")) | F.coalesce(before("width") > before("height"), F.lit(False))
        cut = cut | (wide & (F.col("page") != before("page")))
        if {"x0", "x1", "top", "bottom", "nlines"} <= cols:
            line = F.greatest((F.col("bottom") - F.col("top")) / F.greatest(F.col("nlines"), F.lit(1)), F.lit(1.0))
            gap = F.col("top") - before("bottom")
            share = F.least(before("x1"), F.col("x1")) - F.greatest(before("x0"), F.col("x0"))
            least = F.least(before("x1") - before("x0"), F.col("x1") - F.col("x0"))
            near = (gap >= -4) & (gap <= F.greatest(2.0 * line, F.lit(16.0))) & (share >= 0.45 * F.when(least == 0, 1.0).otherwise(least))
            cut = cut | (wide & ~F.coalesce(near, F.lit(False)))
    go_on = T.continues(F.col("_ptext"), F.col("text"), F.col("type"))
    if {"cont_next", "cont_prev"} <= cols:
        go_on = go_on | (F.coalesce(before("cont_next"), F.lit(False)) & F.coalesce(F.col("cont_prev"), F.lit(False)))
    rows = rows.withColumn("_new", F.when(F.coalesce(cut, F.lit(True)) | ~go_on, 1).otherwise(0))
    unit = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("unit", unit).drop("_ptext", "_palone", "_ptype", "_alone", "_new")


def unit_texts(stitched: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each unit: its joined text and number of blocks."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s["t"])
    return stitched.groupBy(*keys, "unit").agg(T.join_unit(parts).alias("source"), F.count("*").alias("n_blocks"))


def reading_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Ord for blocks (rid, col, top, bottom): bands between full-width blocks (col 0); in a band the left column, the right one, then the full-width block."""
    # the band is the number of full-width centres strictly above the own centre: a running count, not a join
    center = (F.col("top") + F.col("bottom")) / 2
    rows = blocks.withColumn("_center", center)
    w = Window.partitionBy(*keys).orderBy("_center").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*keys, "_center")
    full = F.when(F.col("col") == 0, 1).otherwise(0)
    rows = rows.withColumn("band", F.sum(full).over(w) - F.sum(full).over(same))
    rank = F.when(F.col("col") == 0, 3).otherwise(F.col("col"))
    order = Window.partitionBy(*keys).orderBy("band", rank, "top", "rid")
    return rows.withColumn("ord", F.row_number().over(order) - 1).drop("_center")


def furniture(lines: DataFrame, least: int = 3) -> DataFrame:
    """A10: keys of lines that return at least `least` times, and how often."""
    keyed = lines.select(T.furniture_key(F.col("text")).alias("key")).filter(F.length("key") > 6)
    return keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def page_join(blocks: DataFrame) -> DataFrame:
    """For each (doc_id, page) the last body block that goes on in the first one of the next page.

    Blocks of 25 characters and more come first; of one page, only those above its first data block count.
    """
    body = blocks.filter(F.col("type") == "body")
    data = blocks.filter(F.col("type") == "data").groupBy("doc_id", "page").agg(F.min("top").alias("_limit"))
    body = body.join(data, ["doc_id", "page"], "left").filter(F.col("_limit").isNull() | (F.col("top") < F.col("_limit")))
    w = Window.partitionBy("doc_id", "page")
    last = body.withColumn("_r", F.row_number().over(w.orderBy((F.length("text") >= 25).desc(), F.col("ord").desc()))).filter("_r = 1")
    first = body.withColumn("_r", F.row_number().over(w.orderBy((F.length("text") >= 25).desc(), F.col("ord")))).filter("_r = 1")
    a = last.select("doc_id", "page", F.col("ord").alias("from_ord"), F.col("text").alias("tail"))
    b = first.select("doc_id", (F.col("page") - 1).alias("page"), F.col("ord").alias("to_ord"), F.col("text").alias("head"))
    return a.join(b, ["doc_id", "page"]).filter(T.continues(F.col("tail"), F.col("head"), F.lit("body"))).select("doc_id", F.col("page").alias("from_page"), (F.col("page") + 1).alias("to_page"), "from_ord", "to_ord", F.substring(F.reverse(F.substring(F.reverse("tail"), 1, 70)), 1, 70).alias("tail"), F.substring("head", 1, 70).alias("head"))


def reject_reason(docs: DataFrame) -> DataFrame:
    """Docs (pages, chars, encrypted, readable, scanned_pages, seen_pages) with reason, null if admitted."""
    return docs.withColumn(
        "reason",
        F.when(~F.col("readable"), "unreadable").when(F.col("encrypted"), "password").when(F.col("pages") == 0, "no pages").when(F.col("pages") > 300, "too long")
        .when(F.col("chars") < 50, "no text").when(F.col("scanned_pages") >= F.greatest(F.lit(2), F.ceil(F.col("seen_pages") * 0.5)), "scan"),
    )
