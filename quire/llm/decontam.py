"""Benchmark decontamination: size-partitioned MinHash containment search.

Items fall into classes by the number of their shingles. A document is seen through overlapping windows
of twice a class's size, so a passage of an item's length lies whole in one and their Jaccard stays high
however long the document is. A window is a candidate for an item if one of their MinHash values is
equal. Such a value belongs to a shingle that both hold, so only windows around such shingles are
hashed. The whole document's shingles then decide by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._shared import by_bytes, forget, stored, table
from quire.llm.wordhash import grams, mix, shingle_sets, words

WORDS, THRESHOLD = 5, (8, 10)
#: Values of a signature, and the growth of the size classes: a window then holds at most 2.5 times an item's shingles, each value
#: of the signature agrees with a chance of 0.23 at least, and all 64 miss a true match with one of 6e-8.
HASHES, GROWTH = 64, 1.25
#: Items are broadcast in blocks of at most so many bytes of shingles (8 bytes each); each block is one pass.
BLOCK_BYTES = 32 << 20
_SEEDS = np.random.default_rng(5).integers(1, 2**63, HASHES, dtype=np.uint64)


def class_size(n: int) -> int:
    """The upper size of the class of items with n shingles."""
    u = 1
    while u < n:
        u = max(u + 1, int(u * GROWTH))
    return u


@dataclass
class ItemIndex:
    ids: list[int | None]
    sets: list[np.ndarray]
    span: np.ndarray  # upper size of each item's class
    signature: np.ndarray  # item x hash
    keys: np.ndarray  # sorted shingles that give some signature value
    key_items: list[np.ndarray]
    sieve: np.ndarray

    @classmethod
    def build(cls, ids: list[int | None], sets: list[np.ndarray]) -> ItemIndex:
        sig = np.zeros((len(ids), HASHES), dtype=np.uint64)
        pairs: dict[int, set[int]] = {}
        for i, s in enumerate(sets):
            h = mix(s[:, None] ^ _SEEDS[None, :])
            at = np.argmin(h, axis=0)
            sig[i] = h[at, np.arange(HASHES)]
            for k in s[at].tolist():
                pairs.setdefault(k, set()).add(i)
        keys = np.array(sorted(pairs), dtype=np.uint64)
        bits = max(16, int(np.ceil(np.log2(max(1, len(keys)) * 64))))
        sieve = np.zeros(1 << bits, dtype=bool)
        sieve[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(ids, sets, np.array([class_size(len(s)) for s in sets], dtype=np.int64), sig, keys, [np.array(sorted(pairs[k]), dtype=np.int64) for k in keys.tolist()], sieve)

    def candidates(self, g: np.ndarray, hits: np.ndarray) -> list[int]:
        """Items with an equal MinHash value in some window of the shingle sequence g around its hits (places of keys)."""
        windows: set[tuple[int, int]] = set()
        for p, k in zip(hits.tolist(), np.searchsorted(self.keys, g[hits]).tolist(), strict=True):
            for i in self.key_items[k].tolist():
                u = int(self.span[i])
                windows.add((i, max(0, p // u - 1)))
                windows.add((i, p // u))
        out: set[int] = set()
        for i, w in sorted(windows):
            if i not in out:
                u = int(self.span[i])
                part = g[w * u : w * u + 2 * u]
                if len(part) and (mix(part[:, None] ^ _SEEDS[None, :]).min(axis=0) == self.signature[i]).any():
                    out.add(i)
        return sorted(out)

    def matches(self, g: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        """(item place, shared shingles) of the items that the sequence contains to num/den or more."""
        some = np.flatnonzero(self.sieve[(g >> np.uint64(64 - int(np.log2(len(self.sieve))))).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, g[some]), len(self.keys) - 1)
            some = some[self.keys[at] == g[some]]
        if not len(some):
            return []
        whole, out = None, []
        for i in self.candidates(g, some):
            whole = np.unique(g) if whole is None else whole
            s = self.sets[i]
            n = int(np.count_nonzero(whole[np.minimum(np.searchsorted(whole, s), len(whole) - 1)] == s))
            if den * n >= num * len(s):
                out.append((i, n))
        return out


def item_blocks(items: DataFrame, n_words: int = WORDS, id_col: str = "item_id", text_col: str = "text", null_ids: bool = False) -> Iterator[tuple[ItemIndex, bool]]:
    """Indexes over bounded blocks of the items, and whether it is the only one; items without words are left out, those without id unless null_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), n_words, True)], pa.binary())], ["id", "set"])

    rows = items.select(items[id_col].cast("bigint").alias("id"), items[text_col].alias("text")).filter("text is not null")
    if not null_ids:
        rows = rows.filter("id is not null")
    ids: list[int | None] = []
    sets: list[np.ndarray] = []
    size, many = 0, False
    for r in rows.mapInArrow(run, "id bigint, set binary").filter(F.length("set") > 0).distinct().orderBy("id", "set").toLocalIterator():
        if size >= BLOCK_BYTES:
            many = True
            yield ItemIndex.build(ids, sets), False
            ids, sets, size = [], [], 0
        ids.append(r.id)
        sets.append(np.frombuffer(bytes(r.set), dtype=np.uint64))
        size += len(r.set)
    if ids:
        yield ItemIndex.build(ids, sets), not many


def _sequences(texts: pa.Array, n_words: int) -> Iterator[np.ndarray]:
    """The shingles of each text in their order; the whole sequence as one where it is shorter."""
    h, doc, _, _ = words(texts, lower=True)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    g = grams(h, n_words)
    for k in range(len(texts)):
        a, c = int(first[k]), int(count[k])
        yield g[a : a + c - n_words + 1] if c >= n_words else (grams(h[a : a + c], c) if c else g[:0])


def find_leaks(docs: DataFrame, items: DataFrame, n_words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item that it contains to the threshold: id, item_id, n_item, n_shared, containment.

    Containment is the share of the item's distinct shingles (A-Z lower-cased) that the whole text
    holds. An item with fewer words than a shingle is one shingle, which only a text of just these
    words holds. Null or empty texts and items match nothing; a document with a null id is reported
    with it; repeated rows are reported as often as they come, repeated items once for each item_id.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id bigint, n_item bigint, n_shared bigint, containment double"
    out: DataFrame | None = None
    for index, only in item_blocks(items, n_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in by_bytes(batches, "text"):
                place, item, n = [], [], []
                for k, g in enumerate(_sequences(b.column(1), n_words)):
                    for i, c in own.matches(g, *threshold):
                        place.append(k), item.append(i), n.append(c)
                size = [len(own.sets[i]) for i in item]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int64())), pa.array([own.ids[i] for i in item], pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([c / s for c, s in zip(n, size, strict=True)], pa.float64())], ["id", "item_id", "n_item", "n_shared", "containment"])

        got = rows.mapInArrow(run, schema)
        if not only:  # one block of items at a time lives in the executors and on the driver
            got = stored(got, "leaks")
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, items: DataFrame, n_words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no item (items without an id too); one pass for each block of items and no join."""
    before = None
    for index, only in item_blocks(items, n_words, null_ids=True):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in by_bytes(batches, text_col):
                yield b.filter(pa.array([not own.matches(g, *threshold) for g in _sequences(b.column(b.schema.get_field_index(text_col)), n_words)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = stored(docs, "clean")
            forget(before)
            before = docs
            shared.destroy()
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, containment of 0.8 and more, over all documents and all benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"list_filter(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: w <> '')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents),
     i AS (SELECT item_id, {_SPLIT.format("text")} AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda k: array_to_string(w[k:k + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
     iss AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda k: array_to_string(w[k:k + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
     n AS (SELECT item_id, count(*) AS n_item FROM iss GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN iss USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment
FROM m JOIN n USING (item_id) WHERE {THRESHOLD[1]} * n_shared >= {THRESHOLD[0]} * n_item
"""
