"""Driver tables and the layout views that stand in for page data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered text blocks: the lines of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ord", "text"))


def v_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on pages: an order is a page, its lines are boxes."""
    li = table(spark, sf_dir, "lineitem")
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return li.select(
        F.col("l_orderkey").alias("page"),
        rid.alias("rid"),
        F.col("l_quantity").alias("x0"),
        (F.col("l_quantity") + F.lit(12.0) + F.lit(100.0) * F.col("l_discount")).alias("x1"),
        (F.lit(10.0) + F.lit(500.0) * F.col("l_tax")).alias("top"),
        (F.lit(18.0) + F.lit(500.0) * F.col("l_tax")).alias("bottom"),
        (F.col("l_linenumber") % 3).alias("col"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linenumber").alias("n"),
    )


def v_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job log: events as submissions of clients."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created"), F.col("user_id").alias("client"), "value")


V_BLOCK_SQL = """v_block AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord
  FROM documents)"""

V_RECT_SQL = """v_rect AS (
  SELECT l_orderkey AS page, concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS rid,
         l_quantity AS x0, l_quantity + 12e0 + 100e0 * l_discount AS x1, 10e0 + 500e0 * l_tax AS top, 18e0 + 500e0 * l_tax AS bottom,
         l_linenumber % 3 AS col, l_returnflag AS kind, l_linenumber AS n
  FROM lineitem)"""
