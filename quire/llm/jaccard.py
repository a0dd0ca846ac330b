"""N-gram Jaccard join: exact components of documents whose word shingles overlap.

Filters, all exact: with the tokens of every set in one global order, two sets over the threshold share
a token among the first few of each; this holds in every order, so candidates must share such a prefix
token in several. Linked sets have sizes near each other: a prefix token counts together with a class of
sizes, and each set stands in its own class and, as a low one, in the next. Orders put frequent tokens last (their classes come from counts over all documents)
and differ in the hash that orders a class. A parity bitmap bounds the difference of two sets from
below. What is left is verified on whole sets: first a star of links for each document, then only the
candidates whose ends are still apart. A prefix token of many documents is gone through twice: at first
each document takes one candidate in each block there, and once those are joined, only pairs still apart are made, at the
tokens whose documents are not all in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bitmap
from quire.llm._shared import by_bytes, forget, slices, stored, table
from quire.llm.graph import components
from quire.llm.wordhash import mix, shingle_sets

ORDERS = 3
#: Tokens that a task counts at a time, and the least count there and in all that makes a token frequent.
COUNT_AT_ONCE, TASK_COUNT, TOTAL_COUNT = 1 << 21, 2, 4
#: The most tokens in the broadcast table of frequent ones (9 bytes each); beyond it the least frequent count as rare, which only costs time.
FREQUENT_MAX = 1 << 20
#: Bits of a set's parity bitmap, and of its folded form that travels with every prefix token.
BITS, FOLDED = 1024, 256
#: Rows of one block of a prefix token; more are split into blocks, and each pair of blocks is its own key.
BLOCK = 512
#: A prefix token of more rows than this is one of many documents.
MANY = 24
#: Leading bits of a prefix token's hash that name its bucket are chosen for about so many rows in each.
ROWS_PER_BUCKET = 1 << 18
#: Earlier keys that a row bears, by which pairs made before are known; those known by later keys only are made again, and once each in the end.
BEFORE = 256
#: Rows with lists of keys that a worker turns into Python objects at a time.
LIST_ROWS = 1024
#: Keys that a task holds before it passes them on.
HELD_KEYS = 1 << 18
_SEEDS = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64)


def frequent_tokens(docs: DataFrame, words: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens in many documents and the class of each (log2 of its count), over all documents of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            tok, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= TASK_COUNT
            return pa.RecordBatch.from_arrays([pa.array(tok[many].view(np.int64)), pa.array(c[many].astype(np.int64))], ["tok", "n"])

        for b in by_bytes(batches, "text"):
            for s in shingle_sets(b.column(1), words, lower):
                held.append(s)
                n += len(s)
            if n >= COUNT_AT_ONCE:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counted = docs.mapInArrow(run, "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("n")).filter(F.col("n") >= TOTAL_COUNT)
    counted = stored(counted.select("tok", F.least(F.floor(F.log2("n")) - 1, F.lit(31)).cast("tinyint").alias("cls")), "frequent")
    sizes = sorted(((r.cls, r["count"]) for r in counted.groupBy("cls").count().collect()), reverse=True)
    least, total = 32, 0
    for c, n in sizes:
        if total + n > FREQUENT_MAX:
            break
        least, total = c, total + n
    got = counted.filter(F.col("cls") >= least).toArrow()
    forget(counted)
    tok, cls = got["tok"].to_numpy().view(np.uint64), got["cls"].to_numpy().astype(np.uint8)
    order = np.argsort(tok)
    return tok[order], cls[order]


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens at the front of a set of n, of which any set at num/den or more must share one."""
    return n - -(-num * n // den) + 1


def order_keys(tokens: np.ndarray, frequent: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """The place of each token in the k-th global order: its class, then a hash of that order."""
    cls = np.zeros(len(tokens), dtype=np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        cls = np.where(frequent[at] == tokens, classes[at], 0).astype(np.uint64)
    return (cls << np.uint64(58)) | (mix(tokens ^ _SEEDS[k]) >> np.uint64(6))


def prefix_of(s: np.ndarray, keys: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of a set in the order of its keys, in that order."""
    p = prefix_length(len(s), num, den)
    first = np.argpartition(keys, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[first[np.argsort(keys[first], kind="stable")]]


def profiles(docs: DataFrame, frequent, words: int, lower: bool, num: int, den: int) -> DataFrame:
    """For each row of (id, text): n, digest d1 d2 of its set, parity bitmap, and its prefix in the first order as packed tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            sets = shingle_sets(b.column(1), words, lower)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            keys = order_keys(flat, *frequent.value, 0)
            other = mix(flat + _SEEDS[15])
            n, d1, d2, maps, prefixes, at = [], [], [], [], [], 0
            for s in sets:
                m = len(s)
                n.append(m)
                if not m:
                    d1.append(None), d2.append(None), maps.append(None), prefixes.append(None)
                    continue
                d1.append(int(np.add.reduce(mix(s)).view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(other[at : at + m]).view(np.int64)))
                maps.append(np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes())
                prefixes.append(prefix_of(s, keys[at : at + m], num, den).tobytes())
                at += m
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.binary())], ["id", "n", "d1", "d2", "bitmap", "prefix"])

    return stored(docs.mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, bitmap binary, prefix binary"), "profiles")


def size_bounds(num: int, den: int) -> np.ndarray:
    """Least size of each class: sets at num/den or more are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return np.array(out, dtype=np.int64)


def class_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The key of each token within a class of sizes."""
    return mix(tokens + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def shared_prefix_tokens(prof: DataFrame, bounds: np.ndarray) -> np.ndarray:
    """A bitmap of the keys of prefix tokens that two different sets hold. Keys travel packed with 4 bytes of their set's digest,
    those of about HELD_KEYS at a time with two sets each at most: more tell no more. So a bucket holds few rows of any key."""
    total = prof.agg(F.sum(F.length("prefix"))).first()[0] or 0
    r = max(8, int(np.ceil(np.log2(max(1, total / 4 / ROWS_PER_BUCKET)))))
    kind = np.dtype([("key", "<u8"), ("set", "<u4")])

    def tidy(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by key, then set; each once, and two sets of a key at most."""
        o = np.lexsort((of, key))
        key, of = key[o], of[o]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.zeros(0, dtype=bool)
        key, of = key[new], of[new]
        third = np.zeros(len(key), dtype=bool)
        third[2:] = key[2:] == key[:-2]
        return key[~third], of[~third]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            key, of = tidy(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows = np.empty(len(key), dtype=kind)
            rows["key"], rows["set"] = key, of
            cut = np.searchsorted(key >> np.uint64(64 - r), np.arange((1 << r) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], ["bucket", "rows"])

        for b in slices(batches, LIST_ROWS):
            raw = b.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in raw], dtype=np.int64)
            tok, of = np.frombuffer(b"".join(raw), dtype=np.uint64), np.repeat(b.column(1).to_numpy().view(np.uint64), size).astype(np.uint32)
            cls = np.repeat(np.searchsorted(bounds, b.column(0).to_numpy(), side="right"), size)
            held += [(class_keys(tok, cls), of), (class_keys(tok, cls + 1), of)]
            n += 2 * len(tok)
            if n >= HELD_KEYS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def join(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, dtype=kind) for x in part["rows"]])
        key, _ = tidy(rows["key"], rows["set"])
        return pd.DataFrame({"h": np.unique(key[1:][key[1:] == key[:-1]]).view(np.int64)})

    packed = prof.filter("id is not null and n > 0").select("n", "d1", "prefix").mapInArrow(pack, "bucket int, rows binary")
    both = stored(packed.groupBy("bucket").applyInPandas(join, "h bigint"), "shared-tokens")
    out = bitmap.build(both, both.count(), 128)
    forget(both)
    return out


def _pairs_in_runs(num: int, den: int, star: bool):
    """mapInArrow over rows sorted by (key, bi, bj, n, id): pairs of each run that pass the tests of size and bitmap.

    Two low rows don't pair: they meet in their own class.

    star: in runs of keys of many documents a row takes its first partner only. Otherwise the rows bear
    components and the keys before, and a pair of two components is made at its first common key (again only beyond BEFORE keys).
    """

    def close(rows: list[tuple], out_a: list[int], out_b: list[int]) -> None:
        if len(rows) < 2:
            return
        ids = [r[6] for r in rows]
        n = np.array([r[5] for r in rows])
        block = np.array([r[4] for r in rows])
        group = np.array([r[9] for r in rows])
        low = np.array([r[10] for r in rows])
        cross, one = rows[0][1] != rows[0][2], star and rows[0][3]
        maps = np.frombuffer(b"".join(r[7] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
        before: dict[int, frozenset] = {}
        last = np.searchsorted(n, n * den // num, side="right")  # sorted by n: a partner's size is at most n * den / num
        for i in range(len(rows) - 1):
            e = int(last[i])
            if e <= i + 1:
                continue
            differ = np.bitwise_count(maps[i + 1 : e] ^ maps[i]).sum(axis=1, dtype=np.int64)
            both = n[i + 1 : e] + n[i]
            ok = differ <= both - 2 * -(-num * both // (num + den))
            if low[i]:
                ok &= ~low[i + 1 : e]
            if cross:
                ok &= block[i + 1 : e] != block[i]
            if not star:
                ok &= group[i + 1 : e] != group[i]
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                if ids[i] == ids[j]:
                    continue
                for k in () if star else (i, j):
                    if k not in before:
                        before[k] = frozenset(np.frombuffer(rows[k][8], dtype=np.int64).tolist())
                if star or before[i].isdisjoint(before[j]):
                    out_a.append(min(ids[i], ids[j]))
                    out_b.append(max(ids[i], ids[j]))
                    if one:
                        break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        a: list[int] = []
        b: list[int] = []
        for batch in slices(batches, 1024):
            for r in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if r[:3] != key:
                    close(rows, a, b)
                    key, rows = r[:3], []
                rows.append(r)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        close(rows, a, b)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Candidates:
    """Documents that share keys of prefix tokens, behind the least id of their equal sets, and the pairs among them."""

    def __init__(self, prof: DataFrame, num: int, den: int):
        self.num, self.den, self.spark = num, den, prof.sparkSession
        bounds = size_bounds(num, den)
        shared = self.spark.sparkContext.broadcast(shared_prefix_tokens(prof, bounds))

        def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, LIST_ROWS):
                keep, high, low = [], [], []
                for raw, n in zip(b.column(5).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t = np.frombuffer(raw, dtype=np.uint64)
                    cls = np.full(len(t), np.searchsorted(bounds, n, side="right"))
                    lists = [k[bitmap.contains(shared.value, k)].view(np.int64) for k in (class_keys(t, cls), class_keys(t, cls + 1))]
                    keep.append(len(lists[0]) + len(lists[1]) > 0)
                    high.append(lists[0].tolist())
                    low.append(lists[1].tolist())
                mask = pa.array(keep, pa.bool_())
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).filter(mask) for i in range(5)), pa.array(high, kind).filter(mask), pa.array(low, kind).filter(mask)], ["id", "n", "d1", "d2", "bitmap", "high", "low"])

        named = prof.filter("id is not null and n > 0").select("id", "n", "d1", "d2", "bitmap", "prefix")
        some = named.mapInArrow(own_keys, "id bigint, n bigint, d1 bigint, d2 bigint, bitmap binary, high array<bigint>, low array<bigint>")
        reps = some.groupBy("d1", "d2").agg(F.min_by(F.struct("id", "n", "bitmap", "high", "low"), "id").alias("r"))
        self.reps = stored(reps.select("r.*"), "representatives")
        shared.destroy()
        rows = self.reps.select(F.explode("high").alias("key"), F.lit(1).alias("h")).unionByName(self.reps.select(F.explode("low").alias("key"), F.lit(0).alias("h")))
        self.count = stored(rows.groupBy("key").agg(F.count("*").alias("m"), F.max("h").alias("h")).filter("m > 1 and h > 0").select("key", "m"), "prefix-keys")

    def forget(self) -> None:
        forget(self.reps, self.count)

    def apart_keys(self, groups: DataFrame) -> DataFrame:
        """key, m of the keys of many documents that are not all in one component."""
        rows = self.reps.select("id", F.explode(F.concat("high", "low")).alias("key")).join(self.count.filter(F.col("m") > MANY), "key")
        rows = rows.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "m", F.coalesce("component", "id").alias("component"))
        return stored(rows.groupBy("key", "m").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key", "m"), "apart-keys")

    def pairs(self, groups: DataFrame | None = None) -> DataFrame:
        """Stored pairs a < b. groups (node, component): only pairs apart, at keys of many documents in several components; else one
        partner for each document in each block there, and all pairs elsewhere."""
        count = self.count if groups is None else self.apart_keys(groups)
        rows = self.reps.select("id", F.explode(F.concat("high", "low")).alias("key")).join(count, "key")
        mine = rows.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("key", "m"))).alias("m"))
        wide = self.reps.join(mine, "id")
        wide = wide.withColumn("component", F.lit(0).cast("bigint")) if groups is None else wide.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        apart = groups is not None  # a pair is then made at its first common key, and seldom at others
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        names = ["key", "bi", "bj", "many", "own", "n", "id", "bitmap", "before", "component", "low"]

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in kinds]

            def flush() -> pa.RecordBatch:
                got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                for c in out:
                    c.clear()
                return got

            for b in slices(batches):
                for doc, n, bits, high, low, m, comp in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                    m = dict(m)
                    bits = np.bitwise_xor.reduce(np.frombuffer(bits, dtype=np.uint64).reshape(BITS // FOLDED, -1), axis=0).tobytes()
                    for is_low, keys in ((False, high), (True, low)):
                        keys = [k for k in keys if k in m]
                        packed = np.array(keys, dtype=np.int64)
                        for at, key in enumerate(keys):
                            blocks = max(1, -(-m[key] // BLOCK))
                            own = int(mix(np.array([doc], dtype=np.int64).view(np.uint64))[0] % np.uint64(blocks)) if blocks > 1 else 0
                            before = packed[: min(at, BEFORE)].tobytes() if apart else b""
                            for other in range(blocks):
                                for col, v in zip(out, (key, min(own, other), max(own, other), m[key] > MANY, own, n, doc, bits, before, comp, is_low), strict=True):
                                    col.append(v)
                                if len(out[0]) >= 4096:
                                    yield flush()
            if out[0]:
                yield flush()

        keyed = wide.select("id", "n", "bitmap", "high", "low", "m", "component").mapInArrow(spread, "key bigint, bi int, bj int, many boolean, own int, n bigint, id bigint, bitmap binary, before binary, component bigint, low boolean")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        runs = keyed.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "n", "id")
        pairs = stored(runs.mapInArrow(_pairs_in_runs(self.num, self.den, groups is None), "a bigint, b bigint").distinct(), "pairs")
        num, den = self.num, self.den

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for i in (2, 3))
                both = b.column(4).to_numpy()
                ok = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= both - 2 * -(-num * both // (num + den)))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

        own = self.reps.select("id", "bitmap", "n")
        both = pairs.join(own.toDF("a", "xa", "na"), "a").join(own.toDF("b", "xb", "nb"), "b").select("a", "b", "xa", "xb", (F.col("na") + F.col("nb")).alias("n"))
        out = stored(both.mapInArrow(close, "a bigint, b bigint").distinct(), "pairs")
        forget(pairs, None if groups is None else count)
        return out


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets (id, set array<bigint>) reach the threshold."""
    wide = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return stored(wide.filter(den * both >= num * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, lower: bool = True, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, the least id reachable by links at num/den or more.

    A set holds the distinct `words`-word shingles of the whole text, A-Z lower-cased if `lower`; a
    shorter text is one shingle, and a null text or one without words has none and is its own
    component. Rows with one id are one document to the links: each of its texts can link it. Rows
    with a null id link with nothing and have a null component. Only the two columns are read. An
    empty table gives an empty one. Ids must be integers.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(rows, words, lower))
    prof = profiles(rows, frequent, words, lower, num, den)
    copies = prof.filter("id is not null and n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    found = Candidates(prof, num, den)
    usable = rows.filter("id is not null and text is not null").withColumn("h", F.xxhash64("id"))
    done: list[DataFrame] = []  # stored tables to delete in the end

    def kept(df: DataFrame, tag: str) -> DataFrame:
        done.append(stored(df, tag))
        return done[-1]

    def checked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that share a prefix token in each further order too, and the whole sets of their documents."""
        ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        wanted = docs.sparkSession.sparkContext.broadcast(bitmap.build(ids.select(F.xxhash64("id")), ids.count(), 256))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_bytes((x.filter(pa.array(bitmap.contains(wanted.value, x.column(2).to_numpy()))) for x in batches), "text"):
                sets = shingle_sets(b.column(1), words, lower)
                prefixes = [[prefix_of(s, order_keys(s, *frequent.value, k), num, den).view(np.int64).tolist() for k in range(1, orders)] if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.list_(pa.int64())))], ["id", "set", "prefixes"])

        sets = usable.mapInArrow(whole, "id bigint, set array<bigint>, prefixes array<array<bigint>>").filter(F.size("set") > 0)
        sets = kept(sets.join(ids, "id", "left_semi"), "sets")
        wanted.destroy()
        p = sets.select("id", "prefixes")
        both = pairs.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b")
        for k in range(orders - 1):
            both = both.filter(F.arrays_overlap(F.col("pa")[k], F.col("pb")[k]))
        return kept(both.select("a", "b").distinct(), "pairs"), sets.select("id", "set")

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        done.append(_linked(pairs, sets, num, den))
        return done[-1]

    done.append(found.pairs())
    pairs, sets = checked(done[-1])
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    star = both.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = kept(components(linked(star, sets)), "components")
    apart = pairs.join(now.toDF("a", "ca"), "a", "left").join(now.toDF("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = now.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked(apart, sets))
    if not found.count.filter(F.col("m") > MANY).isEmpty():
        done.append(found.pairs(kept(components(links), "components")))
        if not done[-1].isEmpty():
            links = links.unionByName(linked(*checked(done[-1])))
    same = prof.filter("id is not null and n > 0").join(copies, ["d1", "d2"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # a copy's id links to its least id; only ids that carry several texts make that more than a star
    final = stored(components(links.unionByName(same)), "components")
    frequent.destroy()
    found.forget()
    forget(*done)
    out = prof.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: 3-word shingles, links at 0.9 and more."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=9, den=10)
