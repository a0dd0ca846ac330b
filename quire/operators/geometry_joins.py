"""Joins of boxes. Every one carries the page as an equality key, so the range test is a residual of a hash join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G


def overlap_pairs(rects: DataFrame, pad: float = 0.5, key: str = "page") -> DataFrame:
    """Pairs of boxes of one page that overlap; a < b by rid."""
    a, b = rects.alias("a"), rects.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rid") < F.col("b.rid")) & G.overlaps("a", "b", pad)
    return a.join(b, hit).select(F.col(f"a.{key}").alias(key), F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b"))


def overlap_between(rects: DataFrame, others: DataFrame, pad: float, key: str = "page") -> DataFrame:
    """Boxes and the boxes of another table that they overlap."""
    a, b = rects.alias("a"), others.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & G.overlaps("a", "b", pad)
    return a.join(b, hit).select(F.col(f"a.{key}").alias(key), F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b"))


def contained(rects: DataFrame, zones: DataFrame, share: float = 0.7, key: str = "page") -> DataFrame:
    """Boxes with at least `share` of their area in a zone, and that zone."""
    a, b = rects.alias("a"), zones.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rid") != F.col("b.rid")) & (G.inside_share("a", "b") >= share)
    return a.join(b, hit).select(F.col(f"a.{key}").alias(key), F.col("a.rid").alias("rid"), F.col("b.rid").alias("zone"))


def uncovered(rects: DataFrame, zones: DataFrame, share: float = 0.7, key: str = "page") -> DataFrame:
    """Boxes that lie in no zone."""
    a, b = rects.alias("a"), zones.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rid") != F.col("b.rid")) & (G.inside_share("a", "b") >= share)
    return a.join(b, hit, "left_anti")


def nearest_below(rects: DataFrame, key: str = "page") -> DataFrame:
    """For each box the next one below that shares some width: its rid and the gap; ties go to the least rid."""
    a, b = rects.alias("a"), rects.alias("b")
    hit = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.top") >= F.col("a.bottom")) & (G.x_overlap("a", "b") > 0)
    near = a.join(b, hit).groupBy(F.col(f"a.{key}").alias(key), F.col("a.rid").alias("rid"))
    best = near.agg(F.min(F.struct((F.col("b.top") - F.col("a.bottom")).alias("gap"), F.col("b.rid").alias("below"))).alias("m"))
    return best.select(key, "rid", F.col("m.below").alias("below"), F.col("m.gap").alias("gap"))


def row_mates(lines: DataFrame, key: str = "page", share: float = 0.5) -> DataFrame:
    """Lines with another line of the page at half their height or more: record "cell" beside numbers, else "list" (both short, 12 apart)."""
    a, b = lines.alias("a"), lines.alias("b")
    least = F.least(F.col("a.bottom") - F.col("a.top"), F.col("b.bottom") - F.col("b.top"))
    apart = F.greatest(F.col("b.x0") - F.col("a.x1"), F.col("a.x0") - F.col("b.x1"))
    rows = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rid") != F.col("b.rid")) & (G.y_overlap("a", "b") >= share * least) & (apart >= 0))
    kind = F.when(F.col("b.kind") == "N", 2).when((F.length("a.rid") <= 32) & (F.length("b.rid") <= 32) & (apart >= 12), 1).otherwise(0)
    return rows.groupBy(F.col(f"a.{key}").alias(key), F.col("a.rid").alias("rid")).agg(F.max(kind).alias("p")).filter("p > 0").select(key, "rid", F.when(F.col("p") == 2, "cell").otherwise("list").alias("record"))


def merged_bands(rects: DataFrame, key: str = "page") -> DataFrame:
    """Vertical bands that the boxes cover, touching ones merged."""
    w = Window.partitionBy(key).orderBy("top", "bottom", "rid")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rects.withColumn("_new", F.when(reach.isNull() | (F.col("top") > reach), 1).otherwise(0))
    rows = rows.withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("n"))


def chart_boxes(boxes: DataFrame, marks: DataFrame, least: int = 8, key: str = "page") -> DataFrame:
    """Boxes that hold at least `least` small marks."""
    inside = contained(marks, boxes, 1.0, key)
    return inside.groupBy(key, "zone").agg(F.count("*").alias("n_marks")).filter(F.col("n_marks") >= least)


def first_unused(displaced: DataFrame, kept: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each displaced text meets the first unused kept block with the same key: ranks on both sides are joined."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = displaced.withColumn("_r", F.row_number().over(w)).select(*keys, "_r", F.col(order).alias("displaced"))
    b = kept.withColumn("_r", F.row_number().over(w)).select(*keys, "_r", F.col(order).alias("kept"))
    return a.join(b, [*keys, "_r"]).select(*keys, "displaced", "kept")
