"""Which drawn texts of a page belong to translated blocks and go, and which are displaced by that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import sequence as S
from quire.operators.blocks import TRANSLATABLE

KEYS = ["doc_id", "page"]


def page_blobs(blocks: DataFrame) -> DataFrame:
    """The normal text of a page's translated blocks, by columns, then by rows: doc_id, page, blob."""

    def joined(*order: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("_n").alias("t")))), lambda s: s["t"]), "")

    rows = blocks.filter(F.col("type").isin(*TRANSLATABLE)).withColumn("_n", T.match_key(F.col("text")))
    by = rows.groupBy(*KEYS).agg(joined(F.col("col"), F.col("top"), F.col("x0")).alias("c"), joined(F.bround(F.col("top") / 4), F.col("x0"), F.col("col")).alias("r"))
    return by.select(*KEYS, F.concat_ws("|", "c", "r").alias("blob"))


def kept_blobs(blocks: DataFrame) -> DataFrame:
    """The normal text of the blocks that stay, and its tokens: doc_id, page, keep, tokens."""
    rows = blocks.filter(~F.col("type").isin(*TRANSLATABLE))
    words = F.flatten(F.collect_list(F.transform(F.split(F.trim("text"), r"\s+"), T.match_key)))
    return rows.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list(T.match_key(F.col("text")))), "|").alias("keep"), F.array_distinct(words).alias("tokens"))


def removed_texts(ops: DataFrame, blocks: DataFrame) -> DataFrame:
    """ops (doc_id, page, seq, op, text) with dropped and displaced.

    A text goes if its normal form is part of the page's blob (J06); doubtful where the kept text has it too,
    then its neighbours decide (W10). Runs of fragments follow (W11, W09), and kept texts behind dropped ones
    are displaced (W12).
    """
    rows = ops.join(page_blobs(blocks), KEYS, "left").join(kept_blobs(blocks), KEYS, "left").withColumn("blob", F.coalesce("blob", F.lit(""))).withColumn("keep", F.coalesce("keep", F.lit("")))
    n1, n2 = T.match_key(F.col("text")), T.match_key_drop(F.col("text"))
    hit = ((F.length(n1) >= 3) & F.col("blob").contains(n1)) | ((F.length(n2) >= 3) & F.col("blob").contains(n2)) | ((F.length(n1) >= 5) & ~n1.rlike("[0-9]") & T.strip_digits(F.col("blob")).contains(n1))
    rows = rows.withColumn("dropped", F.coalesce(hit & F.col("op").isin("Tj", "TJ", "'", '"'), F.lit(False)))
    rows = rows.withColumn("ambiguous", F.col("dropped") & F.col("keep").contains(n1))
    shown = F.col("op").isin("Tj", "TJ", "'", '"')
    text = S.resolve_ambiguous(rows.filter(shown), KEYS, "seq").drop("ambiguous", "tokens")
    text = S.sandwiched(S.sweep_runs(text, KEYS, "seq"), KEYS, "seq").select(*KEYS, "seq", "dropped")
    out = ops.join(text, [*KEYS, "seq"], "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))
    return S.advance_chain(out, KEYS, "seq")
