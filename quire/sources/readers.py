"""Readers and writers of layout, unit, cache, memo and job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the JSON documents, as columns.
BLOCK = "col int, type string, text string, `order` int, x0 double, top double, x1 double, bottom double, size double, bold boolean, nlines int, num_lines int, math double, record boolean, list boolean, cell boolean, label boolean, continues_to_next_page boolean, continues_from_prev_page boolean, color array<double>"
BOX = "x0 double, top double, x1 double, bottom double"
LAYOUT = f"file string, pages array<struct<page:int,width:double,height:double,columns:int,body_size:double,blocks:array<struct<{', '.join(x.replace(' ', ':', 1) for x in BLOCK.split(', '))}>>,figures:array<struct<{', '.join(x.replace(' ', ':') for x in BOX.split(', '))},vector:boolean>>,rules:array<struct<{', '.join(x.replace(' ', ':') for x in BOX.split(', '))}>>>>"
UNITS = "uid int, type string, spans array<string>, page int, pages array<int>, cross_page boolean, multi_block boolean, source string, masked string, tokens map<string,string>, glossary map<string,string>, target_masked string, target string"
JOBS = "id string, status string, stage string, error string, filename string, engine string, created double, note string"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """One row for each layout document, with its file's name as doc_id."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_layout)?\.json$", 1)
    return spark.read.schema(LAYOUT).json(path, multiLine=True).withColumn("doc_id", name)


def pages(layout: DataFrame) -> DataFrame:
    p = layout.select("doc_id", F.posexplode("pages").alias("page", "p"))
    return p.select("doc_id", "page", "p.width", "p.height", F.col("p.columns").alias("columns"), "p.body_size")


def layout_blocks(layout: DataFrame) -> DataFrame:
    """The blocks of all pages: page and block number from 0, flags never null."""
    b = layout.select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", "p.width", "p.height", F.posexplode("p.blocks").alias("block", "b"))
    flags = {"record": "is_record", "list": "is_list", "cell": "is_cell", "label": "is_label", "continues_to_next_page": "cont_next", "continues_from_prev_page": "cont_prev"}
    plain = ["col", "type", "text", "x0", "top", "x1", "bottom", "size", "bold", "nlines", "num_lines", "math", "color"]
    return b.select("doc_id", "page", "block", "width", "height", F.col("b.order").alias("ord"), *[F.col(f"b.{c}").alias(c) for c in plain], *[F.coalesce(F.col(f"b.{k}"), F.lit(False)).alias(v) for k, v in flags.items()])


def layout_boxes(layout: DataFrame, kind: str) -> DataFrame:
    """Figures or rules."""
    f = layout.select("doc_id", F.posexplode("pages").alias("page", "p"))
    return f.select("doc_id", "page", F.posexplode(f"p.{kind}").alias("rid", "f")).select("doc_id", "page", "rid", "f.*")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units; spans as page and block numbers, empty targets as null."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_units|_bilingual)?\.json$", 1)
    df = spark.read.schema(UNITS).json(path, multiLine=True).withColumn("doc_id", name)
    pair = F.transform("spans", lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).cast("int").alias("page"), F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("block")))
    return df.withColumn("spans", pair).withColumn("target", F.nullif("target", F.lit(""))).withColumn("target_masked", F.nullif("target_masked", F.lit("")))


def unit_blocks(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of each unit, in order."""
    s = units.select("doc_id", "uid", F.posexplode("spans").alias("part", "s")).select("doc_id", "uid", "part", F.col("s.page").alias("page"), F.col("s.block").alias("block"))
    return s.join(blocks, ["doc_id", "page", "block"])


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    """S07."""
    return spark.read.schema("prefix string, ja string").json(path, multiLine=True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A missing cache is empty."""
    schema = "key string, target_masked string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_cache(cache: DataFrame, path: str, version: int) -> str:
    """A new version beside the old one, which a running read may still hold."""
    at = f"{path}/v{version}"
    cache.dropDuplicates(["key"]).write.mode("overwrite").parquet(at)
    return at


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs; those that were running are errors after a restart."""
    df = spark.read.schema(JOBS).json(path).withColumn("created", F.timestamp_seconds("created"))
    return df.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Only the named fields are kept."""
    names = [c.split(" ")[0] for c in JOBS.split(", ")]
    jobs.select(*[c for c in names if c in jobs.columns]).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: str = "doc_id") -> None:
    """Tables partitioned by document."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def preview_rows(units: DataFrame) -> DataFrame:
    """Rows of the bilingual preview; units without target are left out."""
    from quire.functions.text import html_escape

    row = F.format_string("<tr><td>%s</td><td>%s</td></tr>", html_escape(F.col("source")), html_escape(F.col("target")))
    return units.filter("target is not null").select("doc_id", "uid", row.alias("html"))
