"""Aggregates: modes, medians, histograms, votes, coverage, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, default: float = 10.0) -> DataFrame:
    """The value with the greatest weight for each key; ties go to the least value."""
    by = df.select(*keys, value.alias("v"), weight.alias("w")).filter("v is not null").groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    best = by.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("v"))).alias("m"))
    return df.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce(F.col("m.v"), F.lit(default)).alias("body_size"))


def upper_median(c: Column) -> Column:
    """The element at half the count, rounded up."""
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def majority(c: Column) -> Column:
    """More than half."""
    return F.avg(c.cast("int")) > 0.5


def modal(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The commonest value; ties go to the one seen first."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    return by.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, value)


def weighted_mean(value: Column, weight: Column) -> Column:
    """A07."""
    return F.round(F.try_divide(F.sum(value * weight), F.sum(weight)), 3)


def x_histogram(rects: DataFrame, low: float, high: float, buckets: int = 120, key: str = "page") -> DataFrame:
    """Boxes over each of the buckets that equal parts of [low, high] make."""
    size = (high - low) / buckets
    a = F.greatest(F.lit(0), F.floor((F.col("x0") - low) / size)).cast("int")
    b = F.least(F.lit(buckets - 1), F.floor((F.col("x1") - low) / size)).cast("int")
    return rects.filter((F.col("x1") >= low) & (F.col("x0") < high)).select(key, F.explode(F.sequence(a, b)).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))


def widest_gap(rects: DataFrame, low: float, high: float, buckets: int = 120, central: tuple[float, float] = (0.3, 0.7), least: int = 2, key: str = "page") -> DataFrame:
    """The widest run of empty buckets in the central part, at least `least` wide; ties go to the left."""
    used = x_histogram(rects, low, high, buckets, key).select(key, "bucket")
    every = rects.select(key).distinct().select(key, F.explode(F.sequence(F.lit(int(central[0] * buckets)), F.lit(int(central[1] * buckets)))).alias("bucket"))
    empty = every.join(used, [key, "bucket"], "left_anti")
    run = F.col("bucket") - F.row_number().over(Window.partitionBy(key).orderBy("bucket"))
    runs = empty.withColumn("run", run).groupBy(key, "run").agg(F.min("bucket").alias("first"), F.count("*").alias("width")).filter(F.col("width") >= least)
    best = runs.groupBy(key).agg(F.min(F.struct((-F.col("width")).alias("w"), F.col("first").alias("f"))).alias("m"))
    return best.select(key, F.col("m.f").cast("bigint").alias("first"), (-F.col("m.w")).cast("bigint").alias("width"))


def column_vote(rects: DataFrame, mid: float, key: str = "page") -> DataFrame:
    """Whether a page has two columns: 8 boxes, a quarter each side, at most a quarter across the middle."""
    left, right = F.col("x1") <= mid, F.col("x0") >= mid
    by = rects.groupBy(key).agg(F.count("*").alias("total"), F.count_if(left).alias("left"), F.count_if(right).alias("right"), F.count_if(~left & ~right).alias("crossing"))
    vote = (F.col("total") >= 8) & (F.col("left") >= 0.25 * F.col("total")) & (F.col("right") >= 0.25 * F.col("total")) & (F.col("crossing") <= 0.25 * F.col("total"))
    return by.withColumn("columns", F.when(vote, 2).otherwise(1))


def left_edges(rects: DataFrame, least: int = 3, key: str = "page") -> DataFrame:
    """Left edges, rounded half to even, that at least `least` boxes share."""
    return rects.groupBy(key, F.bround("x0").alias("edge")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def coverage(blocks: DataFrame, done: Column, key: str) -> DataFrame:
    """Share of characters in translated blocks; pages under one half are skipped."""
    n = F.length("text")
    out = blocks.groupBy(key).agg(F.sum(F.when(done, n).otherwise(0)).alias("covered"), F.sum(n).alias("chars"))
    return out.withColumn("share", F.round(F.coalesce(F.try_divide("covered", "chars"), F.lit(0.0)), 6)).withColumn("skip", F.coalesce(F.try_divide("covered", "chars"), F.lit(0.0)) < 0.5)


def cost_estimate(units: DataFrame, prices: DataFrame, keys: list[str], chars: str = "chars", max_chars: int = 6000, max_units: int = 10) -> DataFrame:
    """Requests, tokens and money for each key and model of prices (model, usd_in, usd_out); batch costs half."""
    by = units.groupBy(*keys).agg(F.count("*").alias("units"), F.sum(chars).alias("chars"))
    by = by.withColumn("requests", F.greatest(F.lit(1), F.ceil(F.col("units") / max_units), F.ceil(F.col("chars") / max_chars)).cast("bigint"))
    by = by.withColumn("tokens_in", F.col("chars") / 4 + F.col("requests") * 280 + F.col("units") * 12).withColumn("tokens_out", F.col("chars") / 2)
    usd = F.col("tokens_in") / 1e6 * F.col("usd_in") + F.col("tokens_out") / 1e6 * F.col("usd_out")
    return by.crossJoin(F.broadcast(prices)).withColumn("usd", F.round(usd, 4)).withColumn("usd_batch", F.round(usd / 2, 4)).drop("usd_in", "usd_out")


def charset(docs: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """The distinct characters in use, by key; distinct in each row before the shuffle."""
    chars = F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("ch")
    return docs.select(*(keys or []), chars).filter("ch <> ''").distinct()


def missing_chars(used: DataFrame, covered: DataFrame) -> DataFrame:
    """Characters in use that a font lacks."""
    return used.join(covered, "ch", "left_anti")


def proportional_split(parts: DataFrame, key: str, order: str, n: str, total: Column) -> DataFrame:
    """Cuts a text of `total` characters: each part but the last gets its own share of n, half to even; the last takes the rest."""
    w = Window.partitionBy(key).orderBy(order)
    everything = F.sum(n).over(Window.partitionBy(key))
    rows = parts.withColumn("_share", F.coalesce(F.bround(F.try_divide(total * F.col(n), everything)).cast("bigint"), F.lit(0))).withColumn("_last", F.lead(order).over(w).isNull())
    run = F.least(F.sum("_share").over(w.rowsBetween(Window.unboundedPreceding, 0)), total)
    rows = rows.withColumn("_run", run).withColumn("cut_start", F.coalesce(F.lag("_run").over(w), F.lit(0).cast("bigint")))
    return rows.withColumn("cut_end", F.when(F.col("_last"), total).otherwise(F.col("_run"))).drop("_share", "_last", "_run")


def zone_rows(lines: DataFrame, key: str = "page", height: float = 6.0) -> DataFrame:
    """Rows of a zone that hold two lines or more; zones with two such rows."""
    rows = lines.groupBy(key, F.bround(F.col("top") / height).alias("row")).agg(F.count("*").alias("n")).filter("n >= 2")
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows >= 2")


def flowing(blocks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose median figure share is under 0.3 and half of whose text stands in blocks of three lines."""
    share = pages.groupBy(key).agg(F.percentile("figure_share", F.lit(0.5)).alias("figures"))
    n = F.length("text")
    text = blocks.groupBy(key).agg(F.try_divide(F.sum(F.when(F.col("nlines") >= 3, n).otherwise(0)), F.sum(n)).alias("long"))
    return share.join(text, key, "left").withColumn("flowing", (F.col("figures") < 0.3) & F.coalesce(F.col("long") >= 0.5, F.lit(False)))


def first_defects(defects: DataFrame) -> DataFrame:
    """Of each role and kind the defect of the least document and detail; an aggregate, so no task sees all of one kind."""
    rest = [c for c in defects.columns if c not in ("role", "kind", "doc_id", "detail")]
    by = defects.groupBy("role", "kind").agg(F.min(F.struct("doc_id", "detail", *rest)).alias("_m"))
    return by.select(*[F.col(c) if c in ("role", "kind") else F.col(f"_m.{c}").alias(c) for c in defects.columns])


def body_chars(chars: DataFrame) -> DataFrame:
    """Characters that aren't blank, stand upright and whose rounded size is within 1 of the body's."""
    return chars.filter((F.trim("text") != "") & F.col("upright") & (F.abs(F.bround("size") - F.col("body_size")) <= 1))


def report_counters(pages: DataFrame, blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Pages, blocks, units and units over several blocks of each document (doc_id)."""
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    u = units.groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if(F.col("n_blocks") > 1).alias("joins"))
    none = F.lit(0).cast("bigint")
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).join(b, "doc_id", "left").join(u, "doc_id", "left")
    return out.select("doc_id", "pages", *[F.coalesce(c, none).alias(c) for c in ("blocks", "units", "joins")])


def new_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Overlaps (page, rid_a, rid_b) that a known set lacks."""
    return pairs.join(known, ["page", "rid_a", "rid_b"], "left_anti")


def largest(rects: DataFrame, most: int, key: str = "page") -> DataFrame:
    """The `most` largest boxes of each page in falling order of area; the limit is the feature. Ties go by rid."""
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    rows = rects.withColumn("area", area).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("area").desc(), "rid")))
    return rows.filter(F.col("place") <= most).select(key, "rid", "area", "place")
