"""Packing into windows of equal size by Karmarkar-Karp multiway differencing.

Each document is cut into whole windows and a rest, and a long rest into shorter pieces. A group of pieces is
parted into m windows: two partial partitions with the greatest spreads merge so that the full windows
of one meet the empty ones of the other, until one is left. m starts at the least that could hold the
tokens and rises while a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._shared import by_bytes, table
from quire.llm.tokens import CACHE_WORDS, loaded, tokenizer_path

CAPACITY = 2048
#: A rest longer than this is cut: small pieces difference to nearly equal windows.
PIECE = 512
#: Documents whose pieces are packed together, about.
GROUP_DOCS = 800
#: Words that a worker holds where it doesn't keep them.
FEW_WORDS = 150_000
#: Sequence ids of a group start at its number times this: more than the windows of a group, whose texts have 2 GB each at most.
GROUP_SPAN = 1 << 31


def cut_document(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, then a rest in near-equal pieces of at most `piece`."""
    out = [(a, capacity) for a in range(0, n - capacity + 1, capacity)]
    rest = n % capacity
    if rest:
        k = -(-rest // piece)
        base, more = divmod(rest, k)
        at = n - rest
        for i in range(k):
            size = base + (i < more)
            out.append((at, size))
            at += size
    return out


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Part items 0..len-1 into m windows by multiway differencing; ties go by item number."""
    # a partial partition: (-spread, tie, sums ascending, members in the same order); only its occupied windows are held
    heap: list[tuple[int, int, list[int], list[list[int]]]] = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, s1, g1 = heapq.heappop(heap)
        _, _, s2, g2 = heapq.heappop(heap)
        if len(s1) + len(s2) <= m:
            sums, groups = s1 + s2, g1 + g2
        else:  # pad both to m windows; the fullest of one meets the emptiest of the other
            s1, g1 = [0] * (m - len(s1)) + s1, [[] for _ in range(m - len(g1))] + g1
            s2, g2 = [0] * (m - len(s2)) + s2, [[] for _ in range(m - len(g2))] + g2
            sums = [a + b for a, b in zip(s1, reversed(s2), strict=True)]
            groups = [a + b for a, b in zip(g1, reversed(g2), strict=True)]
        order = sorted(range(len(sums)), key=sums.__getitem__)
        sums, groups = [sums[i] for i in order], [groups[i] for i in order]
        low = sums[0] if len(sums) == m else 0
        if low and len(heap):
            sums_rel = [x - low for x in sums]
        else:
            sums_rel = sums
        heapq.heappush(heap, (-(sums_rel[-1]), tie, sums, groups))
        tie += 1
    return heap[0][3] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of items, none over capacity; each item must fit. The count rises by steps while one is exceeded."""
    if not sizes:
        return []
    m = -(-sum(sizes) // capacity)
    while True:
        got = difference(sizes, m)
        if max(sum(sizes[i] for i in g) for g in got) <= capacity:
            return [sorted(g) for g in got if g]
        m += max(1, m // 256)


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens of each piece; whole texts (null: empty) with end_id behind them.

    keep_words: a worker keeps many words that it has learned, for its next task too; else few, and none after a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        tok.most = CACHE_WORDS if keep_words else FEW_WORDS
        last = np.array([end_id], dtype="<u4").tobytes()
        for b in by_bytes(batches, "text"):
            ids, rows = b.column(0).to_pylist(), []
            for doc, raw in zip(ids, tok.encode_all(b.column(1).to_pylist()), strict=True):
                raw += last
                n = len(raw) // 4
                rows += [(doc, a, k, zlib.crc32(raw[4 * a : 4 * (a + k)]), n) for a, k in cut_document(n, capacity, piece)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens"])
        if not keep_words:
            tok.memo.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, piece: int = PIECE, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are dealt evenly to groups by a hash of their place in the scan, so repeated rows spread too;
    a group holds about group_docs documents whatever the table's size, and each is packed by itself,
    whole windows as sequences of their own. The result is the same at every run, and for a repeated task, over
    the same files with the same split sizes; other splits deal the same pieces to other groups. Null texts give the end id alone. Repeated rows are packed as often as they come. An empty table
    gives an empty one.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = pieces_of(docs, path, end_id, capacity, piece, id_col, text_col, keep_words).withColumnRenamed(id_col, "id")
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key: tuple, part: pa.Table) -> pa.Table:
        # ids stay in Arrow: a null beside them must not turn them into floats
        keys = [(c, "ascending") for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
        part = part.take(pc.sort_indices(part, sort_keys=keys, null_placement="at_start"))
        size = part["length"].to_numpy()
        whole = np.flatnonzero(size == capacity)
        rest = np.flatnonzero(size < capacity)
        seq, off = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        seq[whole] = np.arange(len(whole))
        for w, items in enumerate(pack(size[rest].tolist(), capacity)):
            at = 0
            for i in items:
                seq[rest[i]], off[rest[i]] = len(whole) + w, at
                at += int(size[rest[i]])
        cols = [part[c] for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.table([*cols, pa.array(seq + key[0].as_py() * GROUP_SPAN), pa.array(off)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = rows.groupBy("grp").applyInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)
