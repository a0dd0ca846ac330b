"""Helpers that the training-data operators share: inputs, batches and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


def unit_hash(*cols: str) -> Column:
    """A stable number in [0, 1) for each row's key."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one of its own
    that goes when the process ends (tests, benchmarks); on a cluster that is an error, as executors couldn't read it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def stored(df: DataFrame, tag: str, compression: str | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder, with the writer's options, and read it back: the lineage ends there, so a lost executor repeats nothing before it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(at, compression=compression)
    out = spark.read.schema(df.schema).parquet(at)
    out._quire_at = at
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables whose every reader has run."""
    for df in tables:
        at = getattr(df, "_quire_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose text column holds about `limit` bytes; a longer text comes alone and whole."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        a = b.column(b.schema.get_field_index(column))
        width = np.int64 if pa.types.is_large_string(a.type) else np.int32
        off = np.frombuffer(a.buffers()[1], dtype=width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
