"""Text flow: line breaking by width, flowing units into boxes, and size search. Grouped maps by page."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that must not begin a line.
NO_START = set("、。，．・：；)]｝」』〕）〉》！？!?,.;:%％…‥ー々ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ")


def char_width(ch: str, size: float) -> float:
    """Half a size for ASCII, a whole one for the rest; stands in for a font's table."""
    return size * (0.5 if ch.isascii() else 1.0)


def _inside_word(a: str, b: str) -> bool:
    return all(c.isascii() and (c.isalnum() or c in "'’") for c in (a, b))


def wrap(text: str, size: float, width: float, measure=char_width) -> list[str]:
    """lines of at most `width`. ASCII words stay whole where a break before them exists, no line starts with
    closing marks, and the lines together are the text without its line feeds."""
    lines: list[str] = []
    for part in text.split("\n"):
        start, at = 0, 0
        while at < len(part):
            end, used = at, 0.0
            while end < len(part) and (end == at or used + measure(part[end], size) <= width):
                used += measure(part[end], size)
                end += 1
            if end < len(part):
                if part[end] in NO_START:
                    end = end - 1 if end - at >= 2 else end + 1
                elif _inside_word(part[end - 1], part[end]):
                    cut = end - 1
                    while cut > at and _inside_word(part[cut - 1], part[cut]):
                        cut -= 1
                    end = cut if cut > at else end
            lines.append(part[at:end])
            at = end
        if not part and start == 0 and "\n" in text:
            lines.append("")
    while lines and lines[-1] == "" and text.endswith("\n"):
        lines.pop()
    return lines


def wrapped(df: DataFrame, text: str = "text", size: str = "size", width: str = "width") -> DataFrame:
    """F25 over Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(t: pd.Series, s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([wrap(a or "", b, c) for a, b, c in zip(t, s, w, strict=True)])

    return df.withColumn("lines", run(text, size, width))


def overflow_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that the undrawn rests would take."""
    return wrapped(df, "rest").groupBy(*keys).agg(F.sum(F.size("lines")).alias("overflow"))


def lanes(blocks: DataFrame) -> DataFrame:
    """The x-range of each lane of a page from its wide blocks (0.45 of the widest and more); lanes 1 and 2 keep 3 off the middle."""
    w = Window.partitionBy("doc_id", "page", "col")
    width = F.col("x1") - F.col("x0")
    rows = blocks.withColumn("_w", width).withColumn("_most", F.max(width).over(w)).filter("_w >= 0.45 * _most")
    by = rows.groupBy("doc_id", "page", "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    page = Window.partitionBy("doc_id", "page")
    mid = (F.max(F.when(F.col("col") == 1, F.col("x1"))).over(page) + F.min(F.when(F.col("col") == 2, F.col("x0"))).over(page)) / 2
    by = by.withColumn("_m", mid)
    left: Column = F.when((F.col("col") == 2) & F.col("_m").isNotNull(), F.greatest("x0", F.col("_m") + 3)).otherwise(F.col("x0"))
    right: Column = F.when((F.col("col") == 1) & F.col("_m").isNotNull(), F.least("x1", F.col("_m") - 3)).otherwise(F.col("x1"))
    return by.select("doc_id", "page", "col", left.alias("x0"), right.alias("x1"))


def region_boxes(units: DataFrame, obstacles: DataFrame, page_bottom: float = 800.0) -> DataFrame:
    """A unit's box ends at the next unit or obstacle below that shares width, 2 off, else at the page's end."""
    u = units.select("doc_id", "page", "uid", "x0", "x1", "top", "bottom").alias("u")
    o = units.select("doc_id", "page", "x0", "x1", "top").unionByName(obstacles.select("doc_id", "page", "x0", "x1", "top")).alias("o")
    hit = (F.col("u.doc_id") == F.col("o.doc_id")) & (F.col("u.page") == F.col("o.page")) & (F.col("o.top") >= F.col("u.bottom")) & (F.col("o.x0") < F.col("u.x1")) & (F.col("u.x0") < F.col("o.x1"))
    low = u.join(o, hit, "left").groupBy("u.doc_id", "u.page", "u.uid").agg(F.coalesce(F.min("o.top") - 2, F.lit(page_bottom)).alias("limit"))
    return units.join(low, ["doc_id", "page", "uid"])


def fit_size(text: str, size: float, width: float, height: float, floor: float = 4.5, step: float = 0.25, leading: float = 1.35) -> tuple[float, list[str]]:
    """The greatest size, in quarters from `size` down to the floor, whose lines fit; the floor's lines if none does."""
    s = round(size * 4) / 4
    whole = sum(char_width(c, 1.0) for c in text if c != "\n")
    while s > floor:
        # lines of at most `width` can't be fewer than this; a lane under two characters has wider lines
        if width >= 2 * s and math.ceil(whole * s / width - 1e-9) * s * leading > height:
            s -= step
            continue
        lines = wrap(text, s, width)
        if len(lines) * s * leading <= height:
            return s, lines
        s -= step
    return floor, wrap(text, floor, width)


def place_units(units: DataFrame, floor: float = 4.5, leading: float = 1.35) -> DataFrame:
    """Each unit (doc_id, page, uid, x0, x1, top, limit, size, target) in its own box: one row for each drawn line. No unit is dropped."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part.sort_values(["top", "x0", "uid"], kind="stable").itertuples():
            s, lines = fit_size(r.target or "", r.size, max(1.0, r.x1 - r.x0), r.limit - r.top, floor, leading=leading)
            for k, line in enumerate(lines):
                y = r.top + k * s * leading
                out.append((r.doc_id, r.page, k, r.uid, r.x0, y, r.x0 + sum(char_width(c, s) for c in line), y + s, line[:40], s, len(line)))
        return pd.DataFrame(out, columns=["doc_id", "page", "line_no", "uid", "x0", "top", "x1", "bottom", "text", "size", "nch"])

    kinds = dict(units.dtypes)
    return units.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kinds['doc_id']}, page int, line_no int, uid {kinds['uid']}, x0 double, top double, x1 double, bottom double, text string, size double, nch int")


def reflow(units: DataFrame, columns: int = 1, width: float = 500.0, height: float = 760.0, body: float = 10.0, floor: float = 4.5, leading: float = 1.35) -> DataFrame:
    """Units (doc_id, page, uid, ord, size, target) of each page poured through its columns, at the first factor of 1, .93, .86, ... that holds them all, down to .34.

    Columns doc_id, page, uid, col, line_no, top, text, size, factor; overflow is true where even that is too long.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ord", "uid"], kind="stable")
        lane = (width - 12 * (columns - 1)) / columns
        least = max(0.45, floor / body)
        factors = []
        f = 1.0
        while f > least:
            factors.append(f)
            f = round(f - 0.07, 2)
        factors += [least, max(0.34, least - 0.07), 0.34]
        for f in factors:
            out, col, y = [], 0, 0.0
            for r in part.itertuples():
                s = min(42.0, max(4.0, r.size * f))
                for k, line in enumerate(wrap(r.target or "", s, lane)):
                    if y + s * leading > height:
                        col, y = col + 1, 0.0
                    out.append((r.doc_id, r.page, r.uid, col, k, y, line, s, f, col >= columns))
                    y += s * leading
                y += s * 0.4
            if not out or not out[-1][-1]:
                break
        return pd.DataFrame(out, columns=["doc_id", "page", "uid", "col", "line_no", "top", "text", "size", "factor", "overflow"])

    kinds = dict(units.dtypes)
    return units.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kinds['doc_id']}, page int, uid {kinds['uid']}, col int, line_no int, top double, text string, size double, factor double, overflow boolean")


def kill_set(ops: DataFrame, blobs: DataFrame, key: str = "page") -> DataFrame:
    """Texts (key, seq, text) whose normal form is part of their page's blob (key, blob): ligatures expanded or
    dropped, or without digits if the text has none and five characters; three characters at least."""
    from quire.functions import text as T

    t = F.col("text")
    rows = ops.withColumn("n1", T.match_key(t)).withColumn("n2", T.match_key_drop(t))
    b = blobs.select(F.col(key).alias("_k"), T.match_key(F.col("blob")).alias("b1"), T.match_key_drop(F.col("blob")).alias("b2"))
    hit = (F.col(key) == F.col("_k")) & (
        ((F.length("n1") >= 3) & F.col("b1").contains(F.col("n1")))
        | ((F.length("n2") >= 3) & F.col("b2").contains(F.col("n2")))
        | ((F.length("n1") >= 5) & ~F.col("n1").rlike("[0-9]") & T.strip_digits(F.col("b1")).contains(F.col("n1")))
    )
    return rows.join(b, hit, "left_semi").drop("n1", "n2")
