"""Stages of the corpus pipeline, each around one operator; all but the last keep the columns of their input.

They need the columns doc_id (an integer), text, lang (strings) and n_chars of documents; others travel along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quire.llm._shared import slices, stored, table
from quire.llm.decontam import drop_leaks
from quire.llm.jaccard import jaccard_components
from quire.llm.langid import UNKNOWN, fit_language_model, tokens
from quire.llm.packing import pack_documents
from quire.llm.secrets import redact
from quire.llm.tokens import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows in no learned language: null texts, texts without a letter, and texts in which no word or n-gram is known.

    A missing language label is filled in; a given one stays. If nothing could be learned, only rows
    without letters go.
    """
    model = fit_language_model(docs)
    shared = spark.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            words = [tokens(t) for t in b.column(text).to_pylist()]
            found = own.predict(words)
            keep = [bool(w) and (not own.langs or known) for w, (_, _, known) in zip(words, found, strict=True)]
            filled = [given if given is not None or got == UNKNOWN else got for given, (got, _, _) in zip(b.column(lang).to_pylist(), found, strict=True)]
            cols = list(b.columns)
            cols[lang] = pa.array(filled, b.schema.field(lang).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of 0.8 and more) keep the text with the least id.

    Rows with a null id stay. Several texts of one id count as documents of their own, so none goes for another's
    sake; of equal ones and of near copies among them the one with the least hash stays. Of rows with one id and one
    text one stays: that with the least hash of its columns (maps left out). Other columns can be of any kind and name.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    seen = docs.filter("doc_id is not null").groupBy("doc_id", h.alias("h")).agg(F.count("*").alias("n"))
    seen = stored(seen.groupBy("doc_id").agg(F.collect_list("h").alias("h"), F.sum("n").alias("n")).filter("n > 1"), "repeated-ids")
    if seen.isEmpty():
        gone = jaccard_components(docs, words=5, num=8, den=10).filter("doc_id is not null and component_id <> doc_id")
        return docs.join(stored(gone.select("doc_id").distinct(), "near-copies"), "doc_id", "left_anti").select(*docs.columns)
    # repeated ids: each of their texts gets a number of its own below all ids
    low = docs.agg(F.min("doc_id")).first()[0]
    own = stored(seen.select("doc_id", F.explode("h").alias("_h")).withColumn("_own", F.lit(low - 1) - F.monotonically_increasing_id()), "texts-of-repeated-ids")
    named = docs.withColumn("_h", h).join(own, ["doc_id", "_h"], "left").withColumn("_key", F.coalesce("_own", "doc_id"))
    found = jaccard_components(named, words=5, num=8, den=10, id_col="_key").filter("_key is not null").select("_key", "component_id").distinct()
    groups = stored(found.join(found.filter("_key <> component_id").select("component_id").distinct(), "component_id", "left_semi"), "groups")
    ids = groups.join(named.filter("_key is not null").select("_key", "doc_id", "_h").distinct(), "_key")
    heads = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "_h", "_key")).alias("head"))
    gone = stored(groups.join(heads, "component_id").filter("_key <> head._key").select("_key"), "near-copies")
    left = named.join(gone, "_key", "left_anti")
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    # columns by place, so that no name of theirs can clash; the hash decides, as not every kind of column can be ordered
    first = left.filter("_own is not null").groupBy("_own").agg(F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), F.xxhash64(*plain)).alias("_row"))
    first = first.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return left.filter("_own is null").select(*docs.columns).unionByName(first)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text contains 0.8 or more of a benchmark item's five-word shingles."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text. No row goes."""
    text, size = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            old = b.column(text).to_pylist()
            new = [redact(t) for t in old]
            cols = list(b.columns)
            cols[text] = pa.array(new, b.schema.field(text).type)
            cols[size] = pa.array([n if x == y else len(y) for x, y, n in zip(old, new, cols[size].to_pylist(), strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2,048 tokens. Workers forget their words after each task: other stages need the memory."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 1, keep_words=False)
