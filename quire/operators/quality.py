"""Data-quality checks: each gives rows of (doc_id, role, kind, detail, param)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.geometry_joins import overlap_between, overlap_pairs
from quire.operators.stats import first_defects, upper_median

# Role, kind and parameter of each check.
CHECKS = {
    "untranslated": ("translator", "reengine"),
    "placeholder_leak": ("translator", "reengine"),
    "missing_glyph": ("editor", "restrip"),
    "residual_english": ("editor", "restrip"),
    "text_overlap": ("producer", "restrip"),
    "empty_output": ("editor", "restrip"),
    "line_overlap": ("editor", "shrink"),
    "figure_overlap": ("editor", "shrink"),
    "rule_overlap": ("producer", "shrink"),
    "unit_dropped": ("editor", "shrink"),
    "unit_truncated": ("editor", "shrink"),
    "layout_drift": ("editor", "shrink"),
    "size_fidelity": ("editor", "shrink"),
    "overflow": ("editor", "shrink"),
}


def _defects(df: DataFrame, kind: str, detail: Column, key: str = "doc_id") -> DataFrame:
    role, param = CHECKS[kind]
    return df.select(F.col(key).alias("doc_id"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), F.lit(param).alias("param"))


def untranslated(units: DataFrame) -> DataFrame:
    """Q01."""
    by = units.filter(F.coalesce("target", F.lit("")) == "").groupBy("doc_id").agg(F.count("*").alias("n"))
    return _defects(by, "untranslated", F.col("n"))


def placeholder_leak(units: DataFrame) -> DataFrame:
    """Q02."""
    by = units.filter(F.col("target").rlike(r"⟦T[0-9]+⟧|⟦\?⟧")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return _defects(by, "placeholder_leak", F.col("n"))


def missing_glyph(placed: DataFrame, font: DataFrame) -> DataFrame:
    """Q03: drawn characters beyond ASCII that the font (ch) lacks."""
    drawn = placed.select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter(F.ascii("ch") > 127).distinct()
    by = drawn.join(font.select("ch"), "ch", "left_anti").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("ch")), "").alias("chars"))
    return _defects(by, "missing_glyph", F.substring("chars", 1, 40))


def residual_words(words: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The words (key, word) of at least four letters that are part of no allowed text (key, blob) of their key."""
    norm = T.wide_key(F.col("word"))
    w = words.filter(F.length("word") >= 4).select(key, "word", norm.alias("norm"))
    return w.join(allowed, (w[key] == allowed[key]) & allowed["blob"].contains(F.col("norm")), "left_anti").select(key, "word")


def residual_english(words: DataFrame, allowed: DataFrame, most: int = 8) -> DataFrame:
    """Q04."""
    by = residual_words(words, allowed).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return _defects(by, "residual_english", F.col("n"))


def text_overlap(japanese: DataFrame, english: DataFrame) -> DataFrame:
    """English words under Japanese ones, by 2.5 both ways and over 8 of area; boxes keyed by doc_id and page."""
    e, j = english.alias("e"), japanese.alias("j")
    ix, iy = G.x_overlap("e", "j"), G.y_overlap("e", "j")
    hit = (F.col("e.doc_id") == F.col("j.doc_id")) & (F.col("e.page") == F.col("j.page")) & (F.least(ix, iy) >= 2.5) & (ix * iy > 8)
    by = e.join(j, hit, "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return _defects(by, "text_overlap", F.col("n"))


def empty_output(units: DataFrame, placed: DataFrame) -> DataFrame:
    """Q06: translated units, and under 50 drawn characters (40 a line at most)."""
    some = units.filter((F.coalesce("target", F.lit("")) != "") & ~F.coalesce(T.is_unit_echo(F.col("target"), F.col("source")), F.lit(False))).select("doc_id").distinct()
    drawn = placed.groupBy("doc_id").agg(F.sum(F.least(F.length("text"), F.lit(40))).alias("n"))
    by = some.join(drawn, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < 50")
    return _defects(by, "empty_output", F.col("n"))


def line_overlap(lines: DataFrame, key: str = "page") -> DataFrame:
    """Q07: pages with a pair of overlapping lines."""
    by = overlap_pairs(lines, 0.5, key).groupBy(key).agg(F.count("*").alias("n"))
    return _defects(by, "line_overlap", F.col("n"), key)


def figure_overlap(lines: DataFrame, figures: DataFrame, exempt: DataFrame | None = None, key: str = "page") -> DataFrame:
    """Lines over figures, but for pairs (rid_a, rid_b) whose source already lay there."""
    hits = overlap_between(lines, figures, -2.0, key)
    if exempt is not None:
        hits = hits.join(exempt, ["rid_a", "rid_b"], "left_anti")
    return _defects(hits.groupBy(key).agg(F.count("*").alias("n")), "figure_overlap", F.col("n"), key)


def rule_overlap(lines: DataFrame, rules: DataFrame, key: str = "page") -> DataFrame:
    """Lines across the middle of a rule."""
    mid = (F.col("top") + F.col("bottom")) / 2
    bands = rules.withColumn("_m", mid).withColumn("top", F.col("_m") - 0.5).withColumn("bottom", F.col("_m") + 0.5).drop("_m")
    return _defects(overlap_between(lines, bands, 0.0, key).groupBy(key).agg(F.count("*").alias("n")), "rule_overlap", F.col("n"), key)


def unit_drawn(units: DataFrame, placed: DataFrame) -> DataFrame:
    """Units whose drawn characters are none, or over two short."""
    drawn = placed.groupBy("doc_id", "uid").agg(F.sum("nch").alias("drawn"))
    rows = units.filter((F.coalesce("target", F.lit("")) != "") & ~F.coalesce(T.is_unit_echo(F.col("target"), F.col("source")), F.lit(False)))
    rows = rows.join(drawn, ["doc_id", "uid"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    lost = _defects(rows.filter("drawn = 0"), "unit_dropped", F.col("uid"))
    return lost.unionByName(_defects(rows.filter((F.col("drawn") > 0) & (F.col("drawn") < F.length("target") - 2)), "unit_truncated", F.col("uid")))


def layout_drift(source: DataFrame, drawn: DataFrame, keys: tuple[str, ...] = ("doc_id", "uid")) -> DataFrame:
    """Units drawn over 14 aside, or more than 8 above or 42 below their source."""
    s, d = source.alias("s"), drawn.alias("d")
    rows = s.join(d, [F.col(f"s.{k}") == F.col(f"d.{k}") for k in keys])
    dx, dy = F.abs(F.col("d.x0") - F.col("s.x0")), F.col("d.top") - F.col("s.top")
    far = rows.filter((dx > 14) | (dy < -8) | (dy > 42)).select(*[F.col(f"s.{k}").alias(k) for k in keys])
    return _defects(far, "layout_drift", F.col(keys[-1]), keys[0])


def size_fidelity(source: DataFrame, drawn: DataFrame, pages: DataFrame) -> DataFrame:
    """Q12: large source text (1.3 of the document's body size and more) drawn under 0.55 of its size. The body size is A03 over
    all of the document's pages (doc_id, body_size), 10 where that is missing or nothing."""
    body = pages.groupBy("doc_id").agg(upper_median(F.coalesce("body_size", F.lit(0.0))).alias("body"))
    rows = source.join(body, "doc_id", "left").withColumn("body", F.when(F.col("body") > 0, F.col("body")).otherwise(10.0)).filter(F.col("size") >= 1.3 * F.col("body"))
    rows = rows.join(drawn.groupBy("doc_id", "uid").agg(F.max("size").alias("drawn_size")), ["doc_id", "uid"])
    return _defects(rows.filter(F.col("drawn_size") < 0.55 * F.col("size")), "size_fidelity", F.col("uid"))


def overflow(reports: DataFrame) -> DataFrame:
    """Q13."""
    return _defects(reports.filter("overflow"), "overflow", F.lit("overflow"))


def review(defects: list[DataFrame]) -> DataFrame:
    """Q15: the first defect of each role and kind; none left means that the output is good."""
    out = defects[0]
    for d in defects[1:]:
        out = out.unionByName(d)
    return first_defects(out)
