"""Substring deduplication with compressed FM-indexes.

Of equal texts only the one with the least id is looked at; the others' windows all repeat it.
A window of k words is anchored at its least m-word gram, so equal windows anywhere have equal anchors.
Consecutive windows with one anchor form a segment. Anchors that only one document holds can't repeat
and are dropped by a bitmap of bounded size (too full a bitmap only lets more through). The segments
left go to shards by anchor. A shard builds an FM-index over its distinct segments, a wavelet matrix
over their Burrows-Wheeler transform, compressed by Huffman codes, and streams the segments through it: backward search
gives the matching statistics, the longest match that ends at each word, and where it reaches a window's words, the interval's
least document decides. No document meets a shard that can't hold its
windows, so work grows with the input, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bitmap
from quire.llm._shared import by_bytes, forget, stored, table
from quire.llm.wordhash import buffer_of, grams, mix, sequence_hash, words

WINDOW, GRAM = 13, 5
#: Segments of one shard, about; the windows of an anchor with more are dealt one by one. Segments in more batches are merged first.
SHARD_SEGMENTS, MERGE_ABOVE = 20_000, 32
DOCS_PER_BUCKET = 4_000
FLUSH = 1 << 20


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's Huffman code (0 for symbols that don't occur): two queues, one of symbols and one of joined nodes, both ascending."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = [*counts[order].tolist(), *[0] * (n - 1)]
    parent = [0] * (2 * n - 1)
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, node = node, node + 1
            weight[new] += weight[pick]
            parent[pick] = new
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out[order] = depth[:n]
    return out


class WaveletMatrix:
    """Rank of any symbol in a sequence, compressed by Huffman codes: a level holds a bit for each symbol whose code goes on, so
    that all take about the sequence's entropy.

    Codes are dealt so that of the nodes of a level, zeros first, those that end come last: what goes on is a front part
    and keeps its places. Ones are counted before each 512 bits, and within these before each 64.
    """

    def __init__(self, seq: np.ndarray, sigma: int):
        self.length = code_lengths(np.bincount(seq, minlength=sigma + 1))
        self.code = np.zeros(sigma + 1, dtype=np.int64)
        nodes = np.zeros(1, dtype=np.int64)
        for size in range(1, int(self.length.max()) + 1):
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            own = np.flatnonzero(self.length == size)
            self.code[own] = nodes[len(nodes) - len(own) :]
            nodes = nodes[: len(nodes) - len(own)]
        self.levels = int(self.length.max())
        self.bits: list[np.ndarray] = []
        self.far: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        self.zeros: list[int] = []
        code, length = self.code[seq], self.length[seq]
        for level in range(self.levels):
            bit = ((code >> (length - 1 - level)) & 1).astype(bool)
            padded = np.zeros((len(bit) // 512 + 1) * 512, dtype=bool)
            padded[: len(bit)] = bit
            word = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(word).astype(np.int32).reshape(-1, 8)
            self.bits.append(word)
            self.far.append(np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int32))[:-1]]).astype(np.int32))
            self.near.append((np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel())
            self.zeros.append(int(len(bit) - bit.sum()))
            on = len(bit) - int((length == level + 1).sum())
            order = np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])[:on]
            code, length = code[order], length[order]

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place `at` of the sequence lies after the levels of `symbol`, followed as if it held that."""
        code, length, at = self.code[symbol], self.length[symbol], at.copy()
        for i in range(self.levels):
            own = np.flatnonzero(length > i)
            here = at[own]
            w = here >> 6
            mask = (np.uint64(1) << (here & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.far[i][w >> 3] + self.near[i][w] + np.bitwise_count(self.bits[i][w] & mask)
            at[own] = np.where((code[own] >> (length[own] - 1 - i)) & 1, self.zeros[i] + ones, here - ones)
        return at


class FMIndex:
    """Backward search over texts of word hashes, joined with a separator; rows are ordered by 32 words, so patterns may have that many."""

    DEPTH = 32

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, values: np.ndarray):
        """texts: the words of all texts in one array. values: a number for each text; least() gives the least over an interval."""
        self.alphabet, inv = np.unique(texts, return_inverse=True)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        seq = np.zeros(int(first[-1]), dtype=np.int64)
        at = np.arange(len(texts)) + np.repeat(np.arange(len(lengths)), lengths)
        seq[at] = inv + 1
        rank, step = seq, 1
        while step < min(self.DEPTH, int(lengths.max(initial=1)) + 1):  # a longer order than a text has words changes nothing
            ahead = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64)])
            _, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        sigma = len(self.alphabet)
        self.wavelet = WaveletMatrix(seq[order - 1], sigma)
        count = np.bincount(seq, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.origin = self.wavelet.descend(np.arange(sigma + 1), np.zeros(sigma + 1, dtype=np.int64))
        self.known, of = np.unique(values, return_inverse=True)
        self.values = np.repeat(of.astype(np.int32), lengths + 1)[order]  # each row's place among the distinct values
        self.size = len(seq)

    def symbols(self, text: np.ndarray) -> np.ndarray:
        """The index's symbol of each word; 0 for a word that it lacks."""
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == text, at + 1, 0)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows that start with c and go on as the rows [lo, hi) begin."""
        both = np.concatenate([c, c])
        at = self.first[both] + self.wavelet.descend(both, np.concatenate([lo, hi])) - self.origin[both]
        return at[: len(c)], at[len(c) :]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value in each interval, of patterns of one length; none may be empty. Equal patterns share one interval, so
        the work is linear in the rows."""
        start, inv = np.unique(lo, return_inverse=True)
        end = np.zeros(len(start), dtype=np.int64)
        end[inv] = hi
        cut = np.column_stack([start, end]).ravel()
        padded = np.append(self.values, np.iinfo(np.int32).max)
        return self.known[np.minimum.reduceat(padded, cut)[::2][inv]]

    def matching(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray, k: int, none: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the places end of the symbols text, each looked at back to begin: the words of the longest
        match that ends there with a text whose value is below limit, as far as it has k words or more (0: it has fewer),
        and the least value that k words are found with (none: they aren't). Every place takes a step of backward search at
        a time and is left out once its interval is empty, or holds one row and that isn't below limit."""
        words, least = np.zeros(len(end), dtype=np.int64), np.full(len(end), none, dtype=np.int64)
        live, lo, hi = np.arange(len(end)), np.zeros(len(end), dtype=np.int64), np.full(len(end), self.size, dtype=np.int64)
        step = 0
        while len(live):
            at = end[live] - step
            go = at >= begin[live]
            go[go] = text[at[go]] > 0
            live, lo, hi, at = live[go], lo[go], hi[go], at[go]
            lo, hi = self.extend(text[at], lo, hi)
            step += 1
            go = hi > lo
            if step < k:
                go &= (hi - lo > 1) | (self.known[self.values[np.minimum(lo, self.size - 1)]] < limit[live])
                live, lo, hi = live[go], lo[go], hi[go]
                continue
            live, lo, hi = live[go], lo[go], hi[go]
            value = self.least(lo, hi) if len(live) else lo
            if step == k:
                least[live] = value
            go = value < limit[live]
            live, lo, hi = live[go], lo[go], hi[go]
            words[live] = step
        return words, least


def segments(texts: pa.Array, k: int = WINDOW, m: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of each word, and words before each text; then anchor, text, first word and number of windows of each segment."""
    h, doc, begin, end = words(texts)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    base = np.concatenate([[0], np.cumsum(count)])
    none = np.zeros(0, np.int64)
    n = len(h) - k + 1
    if n <= 0:
        return h, begin, end, base, np.zeros(0, np.uint64), none, none, none
    g = grams(h, m)
    best, arg = g[:n].copy(), np.arange(n)
    place = np.arange(n + k)
    for s in range(1, k - m + 1):
        less = g[s : s + n] < best
        np.copyto(best, g[s : s + n], where=less)
        np.copyto(arg, place[s : s + n], where=less)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    if not len(whole):
        return h, begin, end, base, np.zeros(0, np.uint64), none, none, none
    a = arg[whole]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (whole[1:] != whole[:-1] + 1)])
    first = np.flatnonzero(new)
    return h, begin, end, base, best[whole[first]], doc[whole[first]], whole[first], np.diff(np.append(first, len(whole)))


def kept_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of batches (id, key, text) the rows whose key is in the bitmap."""
    for b in batches:
        yield b.filter(pa.array(bitmap.contains(bits, b.column(1).to_numpy())))


def shared_anchors(docs: DataFrame, reps: np.ndarray, k: int, m: int, n_docs: int) -> np.ndarray:
    """A bitmap that holds the mix of each anchor of more than one of the rows (id, key, text) in reps. They travel packed, by their leading bits."""
    r = max(8, int(np.ceil(np.log2(max(1, n_docs / DOCS_PER_BUCKET)))))
    own = docs.sparkSession.sparkContext.broadcast(reps)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            a = np.sort(mix(np.concatenate(held)))  # anchors are least hashes: mixed, they spread evenly again
            if len(a) > 2:  # more than two of one anchor tell no more than two
                a = a[np.concatenate([[True, True], a[2:] != a[:-2]])]
            cut = np.searchsorted(a >> np.uint64(64 - r), np.arange((1 << r) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([a[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], ["bucket", "anchors"])

        for b in by_bytes(kept_rows(batches, own.value), "text", 1 << 20):
            _, _, _, _, anchor, doc, _, _ = segments(b.column(2), k, m)
            if len(anchor):
                o = np.lexsort((anchor, doc))  # each anchor once for each text
                x, d = anchor[o], doc[o]
                held.append(x[np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])])
                n += len(held[-1])
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def join(part: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in part["anchors"]]))
        return pd.DataFrame({"h": np.unique(a[1:][a[1:] == a[:-1]]).view(np.int64)})

    both = docs.mapInArrow(pack, "bucket int, anchors binary").groupBy("bucket").applyInPandas(join, "h bigint")
    both = stored(both, "anchors")
    out = bitmap.build(both, both.count())
    own.destroy()
    forget(both)
    return out


def repeated_segments(docs: DataFrame, reps: np.ndarray, anchors: np.ndarray, k: int, m: int) -> DataFrame:
    """Of rows (id, key, text): kind 0, the distinct segments of a batch (seg, anchor, lo and hi id, words as text); kind 1, their places (seg, lo = id, hi = key, pos)."""
    shared, own = docs.sparkSession.sparkContext.broadcast(anchors), docs.sparkSession.sparkContext.broadcast(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "seg", "anchor", "lo", "hi", "pos", "words"]
        for b in by_bytes(kept_rows(batches, own.value), "text", 1 << 20):
            h, begin, end, base, anchor, doc, first, n = segments(b.column(2), k, m)
            hit = bitmap.contains(shared.value, mix(anchor))
            anchor, doc, first, n = anchor[hit], doc[hit], first[hit], n[hit]
            if not len(anchor):
                continue
            seg = np.zeros(len(anchor), dtype=np.uint64)
            for size in np.unique(n):
                same = n == size
                seg[same] = sequence_hash(h[first[same][:, None] + np.arange(int(size) + k - 1)])
            ids, key = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            o = np.lexsort((ids, seg))
            at = np.flatnonzero(np.concatenate([[True], seg[o][1:] != seg[o][:-1]]))
            lo, hi = ids[o][at], ids[o][np.append(at[1:], len(o)) - 1]
            pick = o[at]
            raw = buffer_of(b.column(2))[0]
            text = [raw[x:y].tobytes() for x, y in zip(begin[first[pick]].tolist(), end[first[pick] + n[pick] + k - 2].tolist(), strict=True)]
            z = np.zeros(len(pick), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int8()), pa.array(seg[pick].view(np.int64)), pa.array(anchor[pick].view(np.int64)), pa.array(lo), pa.array(hi), pa.array(z), pa.array(text, pa.binary())], names)
            pos = (first - base[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(seg), dtype=np.int8)), pa.array(seg.view(np.int64)), pa.nulls(len(seg), pa.int64()), pa.array(ids), pa.array(key), pa.array(pos), pa.nulls(len(seg), pa.binary())], names)

    out = stored(docs.mapInArrow(run, "kind tinyint, seg bigint, anchor bigint, lo bigint, hi bigint, pos int, words binary"), "segments")
    shared.destroy(), own.destroy()
    return out


def _search(k: int):
    """applyInPandas over a shard's rows (seg, lo, hi, words): seg, first (0), mins."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seg", kind="stable")
        seg = part["seg"].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        lo, hi = np.minimum.reduceat(part["lo"].to_numpy(), at), np.maximum.reduceat(part["hi"].to_numpy(), at)
        seg = seg[at]
        text, of, _, _ = words(pa.array(part["words"].to_numpy()[at], pa.binary()))
        size = np.bincount(of, minlength=len(seg))
        index = FMIndex(text, size, lo)
        place = np.concatenate([[0], np.cumsum(size)])
        syms = index.symbols(text)
        keep_seg, keep_mins = [seg[:0]], []
        for a in range(0, len(seg), 8_192):  # streamed
            e = min(a + 8_192, len(seg))
            wins = size[a:e] - k + 1
            cut = np.concatenate([[0], np.cumsum(wins)])
            end = np.arange(cut[-1]) + np.repeat(place[a:e] - cut[:-1], wins) + k - 1
            found, mins = index.matching(syms, np.repeat(place[a:e], wins), end, np.repeat(hi[a:e], wins), k, np.iinfo(np.int64).max)
            useful = np.maximum.reduceat(found, cut[:-1]) >= k
            keep_seg.append(seg[a:e][useful])
            keep_mins += [mins[cut[i] : cut[i + 1]].tobytes() for i in np.flatnonzero(useful)]
        return pd.DataFrame({"seg": np.concatenate(keep_seg), "first": np.int32(0), "mins": keep_mins})

    return run


def _in_bitmap(rows: DataFrame, column: str, bits: np.ndarray, wanted: bool) -> DataFrame:
    """The rows whose column is in the bitmap, or isn't. Rows that come from here are tested in the same pass: a second pass in
    one stage would take a Python worker more for each task."""
    source, tests = getattr(rows, "_quire_tests", (rows, ()))
    tests = (*tests, (rows.columns.index(column), rows.sparkSession.sparkContext.broadcast(bits), wanted))
    out = source.mapInArrow(lambda batches: _passing(batches, tests), rows.schema)
    out._quire_tests = (source, tests)
    return out


def _passing(batches: Iterator[pa.RecordBatch], tests: tuple) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, shared, there in tests:
            b = b.filter(pa.array(bitmap.contains(shared.value, mix(b.column(at).to_numpy().view(np.uint64))) == there))
        if b.num_rows:
            yield b


def _mapped(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str) -> DataFrame:
    """rows.mapInArrow(f, shape); tests that rows come from run in the same pass."""
    source, tests = getattr(rows, "_quire_tests", (rows, ()))
    return source.mapInArrow(lambda batches: f(_passing(batches, tests)), shape)


def _frequent(rows: DataFrame, column: str, most: int) -> np.ndarray | None:
    """A bitmap of the column's values in more than `most` rows (and some others); None if there are none."""
    many = stored(rows.groupBy(column).count().filter(F.col("count") > most).select(column), "frequent-values")
    n = many.count()
    out = bitmap.build(many, n, 256, mixed=False) if n else None
    forget(many)
    return out


def search_shards(found: DataFrame, k: int) -> DataFrame:
    """seg, first, mins: for the windows of each distinct segment from number `first` on, the least document with each, by
    backward search in its shard.

    A segment that many batches hold is merged into one row first, whatever the number of batches. An anchor of more
    segments than a shard takes is looked at by window: the windows of its segments are merged into distinct ones and
    dealt to shards by their own hash, as equal windows have equal hashes, so work grows with the segments there too.
    """
    rows = found.filter("kind = 0").select("seg", "anchor", "lo", "hi", "words")
    common = _frequent(rows, "seg", MERGE_ABOVE)
    parts = [rows]
    if common is not None:
        merged = _in_bitmap(rows, "seg", common, True).groupBy("seg", "anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words"))
        parts = [_in_bitmap(rows, "seg", common, False), merged]
    hot = _frequent(reduce(DataFrame.unionByName, parts), "anchor", SHARD_SEGMENTS)
    plain = reduce(DataFrame.unionByName, parts if hot is None else [_in_bitmap(x, "anchor", hot, False) for x in parts])
    shards = max(1, -(-found.filter("kind = 0").count() // SHARD_SEGMENTS))
    shape = "seg bigint, first int, mins binary"
    out = plain.withColumn("shard", F.pmod("anchor", F.lit(shards))).select("shard", "seg", "lo", "hi", "words").groupBy("shard").applyInPandas(_search(k), shape)
    if hot is None:
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, of, begin, end = words(b.column(4))
            raw = buffer_of(b.column(4))[0]
            n = np.bincount(of, minlength=b.num_rows) - k + 1
            base = np.concatenate([[0], np.cumsum(n + k - 1)[:-1]])
            row = np.repeat(np.arange(b.num_rows), n)
            number = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            at = base[row] + number
            text = [raw[x:y].tobytes() for x, y in zip(begin[at].tolist(), end[at + k - 1].tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(grams(h, k)[at].view(np.int64)), b.column(2).take(pa.array(row)), b.column(3).take(pa.array(row)), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["seg", "first", "window", "lo", "hi", "words"])

    wide = "seg bigint, first int, window bigint, lo bigint, hi bigint, words binary"
    every = stored(reduce(DataFrame.unionByName, [_mapped(_in_bitmap(x, "anchor", hot, True), windows, wide) for x in parts]), "windows")
    own = every.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words")).withColumnRenamed("window", "seg")
    shards = max(1, -(-every.count() // SHARD_SEGMENTS))
    mins = own.withColumn("shard", F.pmod("seg", F.lit(shards))).select("shard", "seg", "lo", "hi", "words").groupBy("shard").applyInPandas(_search(k), shape)
    return out.unionByName(every.select("seg", "first", "window").join(mins.select(F.col("seg").alias("window"), "mins"), "window").select("seg", "first", "mins"))


def repeated_windows(docs: DataFrame, reps: np.ndarray, n_docs: int, k: int = WINDOW, m: int = GRAM) -> DataFrame:
    """Of rows (id, key, text) in reps: for each id and key with any, the first words of the windows that a smaller id also has (list of int32 arrays)."""
    found = repeated_segments(docs, reps, shared_anchors(docs, reps, k, m, n_docs), k, m)
    places = found.filter("kind = 1").select("seg", F.col("lo").alias("id"), F.col("hi").alias("key"), "pos")
    joined = places.join(search_shards(found, k), "seg").withColumn("pos", F.col("pos") + F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, key, pos = (b.column(i).to_numpy() for i in range(3))
            raw = b.column(3).to_pylist()
            n = np.array([len(x) // 8 for x in raw], dtype=np.int64)
            if not len(n):
                continue
            cut = np.concatenate([[0], np.cumsum(n)])
            old = np.frombuffer(b"".join(raw), dtype=np.int64) < np.repeat(ids, n)
            start = (np.repeat(pos - cut[:-1], n) + np.arange(cut[-1])).astype(np.int32)
            some = np.flatnonzero(np.logical_or.reduceat(old, cut[:-1]))
            out = [start[cut[i] : cut[i + 1]][old[cut[i] : cut[i + 1]]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(key[some]), pa.array(out, pa.binary())], ["id", "key", "starts"])

    flagged = joined.select("id", "key", "pos", "mins").mapInArrow(run, "id bigint, key bigint, starts binary")
    out = stored(flagged.groupBy("id", "key").agg(F.collect_list("starts").alias("starts")), "starts")
    forget(found)
    return out


def dedup_substrings(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept (the kept words joined by one space), spans (first word and end
    of each longest run of removed words).

    A word goes if a window of k words over it also starts in a row with a smaller id. Null and
    empty texts have no words. Rows with a null id are left as they are and remove nothing. Rows with
    one id don't remove from each other; repeated rows give repeated results. Ids must be integers.
    Only texts that lose words are shuffled. Whole texts are compared by 128 bits of hash, windows by 64 bits of each
    word and 64 of their segment: with 1e12 distinct segments some ten thousand would be taken for another.
    """
    # two hashes that start from different seeds
    th = [F.xxhash64(docs[text_col]).alias("th"), F.xxhash64(F.lit(1), docs[text_col]).alias("th2")]
    key = F.xxhash64(docs[id_col].cast("bigint"), F.xxhash64(docs[text_col])).alias("key")
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), key, docs[text_col].alias("text"))
    usable = rows.filter("id is not null and text is not null")
    ids = docs.select(docs[id_col].cast("bigint").alias("id"), *th, key).filter(docs[id_col].isNotNull() & docs[text_col].isNotNull())
    firsts = stored(ids.groupBy("th", "th2").agg(F.min("id").alias("first"), F.max("id").alias("last")), "firsts")
    n = firsts.count()
    reps = bitmap.build(firsts.select(F.xxhash64("first", "th")), n)
    copies = ids.join(firsts.filter("first < last"), ["th", "th2"]).filter("id > first").select("id", "key").distinct()
    part = repeated_windows(usable, reps, n, k)
    none = F.lit(None).cast("array<binary>")
    covers = stored(part.join(copies, ["id", "key"], "left_anti").select("id", "key", "starts", F.lit(False).alias("whole")).unionByName(copies.select("id", "key", none.alias("starts"), F.lit(True).alias("whole"))), "covers")
    forget(part, firsts)
    touched = docs.sparkSession.sparkContext.broadcast(bitmap.build(covers.select("key"), covers.count()))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 1 << 20):
            n, gone, kept, spans = [], [], [], []
            for text, starts, whole in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                parts = (text or b"").split()
                n.append(len(parts))
                runs: list[tuple[int, int]] = []
                if whole and len(parts) >= k:
                    runs, parts = [(0, len(parts))], []
                elif starts:
                    s = np.frombuffer(b"".join(starts), dtype=np.int32)
                    edge = np.bincount(s, minlength=len(parts) + 1) - np.bincount(s + k, minlength=len(parts) + 1)
                    cover = np.concatenate([[False], np.cumsum(edge)[: len(parts)] > 0, [False]])
                    turns = np.flatnonzero(cover[1:] != cover[:-1])
                    runs = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
                    parts = [p for p, c in zip(parts, cover[1:-1].tolist(), strict=True) if not c]
                gone.append(sum(e - a for a, e in runs))
                kept.append(b" ".join(parts))
                spans.append([{"start": a, "end": e} for a, e in runs])
            shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, shape)], ["id", "n_words", "n_removed", "kept", "spans"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~bitmap.contains(touched.value, b.column(1).to_numpy())))
            yield from cut_out(iter([pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.nulls(b.num_rows), pa.array(np.zeros(b.num_rows, dtype=bool))], ["id", "text", "starts", "whole"])]))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kept_rows(batches, touched.value)

    schema = "id bigint, n_words bigint, n_removed bigint, kept binary, spans array<struct<start: bigint, end: bigint>>"
    rows = rows.withColumn("text", F.col("text").cast("binary"))
    # a broadcast would put both passes into one stage
    wide = rows.mapInArrow(some, rows.schema).join(covers.hint("merge"), ["id", "key"], "left").select("id", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    out = rows.mapInArrow(untouched, schema).unionByName(wide.mapInArrow(cut_out, schema))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))
