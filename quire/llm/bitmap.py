"""Bitmaps of hashed keys: a filter of bounded size that lets every key through, and some others.

They are built in pieces on the executors; only the bits reach the driver, never the keys. A set too
large for the bound fills the bitmap, and then it lets more through; results don't change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.wordhash import mix

MAX_BITS = 28
REGIONS = 6  # log2 of the pieces


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def contains(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    s = slots(h, int(len(bitmap)).bit_length() + 2)
    return ((bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)


def build(hashes: DataFrame, n: int, bits_per_key: int = 32, mixed: bool = True) -> np.ndarray:
    """The bitmap of a column of n 64-bit hashes; those that aren't well mixed yet (mixed=False) are, in the same pass."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n * bits_per_key))), 16, MAX_BITS))
    low = bits - REGIONS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            s = np.unique(slots(h if mixed else mix(h.view(np.uint64)), bits))
            at = np.searchsorted(s >> low, np.arange((1 << REGIONS) + 1))
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([(s[at[i] : at[i + 1]] & ((1 << low) - 1)).astype(np.int32).tobytes() for i in some], pa.binary())], ["region", "part"])

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << low, dtype=bool)
        for x in part["part"]:
            own[np.frombuffer(x, dtype=np.int32)] = True
        return pd.DataFrame({"region": [int(part["region"].iloc[0])], "part": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = 1 << (low - 3)
    named = hashes.toDF("h").filter(F.col("h").isNotNull())
    # one job: a local iterator would run one for each shuffle partition, though at most 2**REGIONS of them hold a row
    got = named.mapInArrow(cut, "region int, part binary").groupBy("region").applyInPandas(draw, "region int, part binary").toArrow()
    for b in got.to_batches():
        for region, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            out[region * width : (region + 1) * width] = np.frombuffer(part.as_buffer(), dtype=np.uint8)
    return out
