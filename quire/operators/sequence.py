"""Sequential operators: windows where neighbours decide, grouped maps where earlier results feed later tests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from quire.functions import text as T


def pack_greedy(df: DataFrame, keys: list[str], order: str, size: str, max_size: int = 6000, max_items: int = 10) -> DataFrame:
    """Contiguous groups of each key's items, at most max_items and max_size together; a larger item stands alone.

    State is the open group's number, size and count; one fold over the sizes of a key.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("c"), F.array().cast("array<struct<o:bigint,g:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["c"] > 0) & ((a["s"] + x["n"] > max_size) | (a["c"] >= max_items))
        g = F.when(new, a["g"] + 1).otherwise(a["g"])
        one = F.array(F.struct(x["o"].cast("bigint").alias("o"), g.alias("g")))
        return F.struct(g.alias("g"), F.when(new, x["n"]).otherwise(a["s"] + x["n"]).alias("s"), F.when(new, F.lit(1).cast("bigint")).otherwise(a["c"] + 1).alias("c"), F.concat(a["out"], one).alias("out"))

    packed = df.groupBy(*keys).agg(F.aggregate(items, start, step, lambda a: a["out"]).alias("p"))
    return packed.select(*keys, F.explode("p").alias("p")).select(*keys, F.col("p.o").alias(order), F.col("p.g").alias("grp"))


def _by_batch(df: DataFrame, fn, column: str, out: str, kind: TT.DataType) -> DataFrame:
    """Append fn(text) to the rows, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return df.withColumn(out, run(F.col(column)))


def chunk_sentences(text: str | None, limit: int = 4500) -> list[str]:
    """Whole sentences packed into pieces of at most `limit`; a longer sentence stands alone."""
    if not text or len(text) <= limit:
        return [text or ""]
    out: list[str] = []
    for s in re.split(r"(?<=[.!?。])\s+", text):
        if out and len(out[-1]) + len(s) + 1 <= limit:
            out[-1] = f"{out[-1]} {s}".strip()
        else:
            out.append(s)
    return [x for x in out if x]


def chunks(df: DataFrame, column: str = "text", limit: int = 4500) -> DataFrame:
    """W15."""
    return _by_batch(df, lambda t: chunk_sentences(t, limit), column, "chunks", TT.ArrayType(TT.StringType()))


def rate_limit(df: DataFrame, client: str, created: str, tie: str, limit: int = 30, seconds: float = 3600.0) -> DataFrame:
    """Whether each request is accepted by a sliding log; rejected ones leave no trace in it.

    Only the last `limit` accepted times of a client matter, so the log of one is bounded. Rows of a client
    come sorted and stream through a task; they are never held as one group.
    """
    parts = df.select(client, tie, F.unix_micros(F.col(created).cast("timestamp")).alias("us"))
    parts = parts.repartition(client).sortWithinPartitions(client, "us", tie)
    span = int(seconds * 1e6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, log = None, []
        for f in frames:
            out = []
            for c, t in zip(f[client], f["us"], strict=True):
                if c != who:
                    who, log = c, []
                while log and log[0] < t - span:
                    log.pop(0)
                out.append(len(log) < limit)
                if out[-1]:
                    log.append(t)
            yield pd.DataFrame({client: f[client], tie: f[tie], "accepted": out})

    kinds = dict(df.dtypes)
    return parts.mapInPandas(run, f"{client} {kinds[client]}, {tie} {kinds[tie]}, accepted boolean")


def resolve_ambiguous(ops: DataFrame, keys: list[str], order: str, hops: int = 3) -> DataFrame:
    """A doubtful drop stays only if, at most `hops` insubstantial texts away, the first substantial one is surely dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = ops.withColumn("_n", F.length(T.match_key(F.col("text")))).withColumn("_sure", F.col("dropped") & ~F.col("ambiguous"))

    def near(move) -> Column:
        out = F.lit(False)
        for k in reversed(range(1, hops + 1)):
            out = F.when(move("_n", k).over(w).isNull(), False).when(move("_n", k).over(w) >= 3, move("_sure", k).over(w)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    keep = F.col("ambiguous") & F.col("dropped") & ~(near(F.lag) | near(F.lead))
    return rows.withColumn("dropped", F.col("dropped") & ~keep).drop("_n", "_sure")


def advance_chain(ops: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A kept text behind a dropped one is displaced until the position is set anew."""
    w = Window.partitionBy(*keys).orderBy(order)
    reset = F.col("op").isin("BT", "ET", "Tm", "Td", "TD", "T*", "'", '"')
    rows = ops.withColumn("_g", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("dropped").cast("int")).over(own), F.lit(0)) == 1
    text = F.coalesce(F.trim("text") != "", F.lit(False))
    return rows.withColumn("displaced", ~reset & ~F.col("dropped") & before & text).drop("_g")


def lane_bands(units: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Full-width units (lane 0) are bands of their own; neighbours in lanes 1 and 2 share one."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag("lane").over(w)
    new = F.when(prev.isNull() | (F.col("lane") == 0) | (prev == 0), 1).otherwise(0)
    return units.withColumn("_new", new).withColumn("band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def insert_spaces(chars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The text of each line of characters, with a space where the gap passes 0.4 of the lesser median width."""
    w = Window.partitionBy(*keys).orderBy(order)
    width = chars.groupBy(*keys).agg(F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)).alias("_mw"))
    rows = chars.join(width, keys).withColumn("_gap", F.col("x0") - F.lag("x1").over(w))
    piece = F.when(F.col("_gap") > 0.4 * F.col("_mw"), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))), lambda s: s["t"])
    return rows.groupBy(*keys).agg(F.array_join(parts, "").alias("text"))


def reference_zone(blocks: DataFrame) -> DataFrame:
    """Retypes the bibliography of each document (doc_id, page, col, top, type, text, n_pages).

    Opens at a reference or numbered line in the back half, goes on over columns and pages, and closes
    on a page without a strict entry. A document is one group: its pages are few and bounded (S03).
    """
    number, strict = re.compile(r"^\[?\d+[.\]]"), re.compile(T.BIBLIOGRAPHY)

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values(["page", "col", "top"], kind="stable").reset_index(drop=True)
        kinds, open_ = doc["type"].tolist(), False
        headings = set(doc.index[doc["text"].str.strip().str.lower().isin(["references", "bibliography", "literature cited"])])
        for page, rows in doc.groupby("page", sort=True):
            if page < 0.5 * doc["n_pages"].iloc[0]:
                continue
            entries = sum(bool(strict.match(doc["text"][i].strip())) for i in rows.index)
            head = [i for i in rows.index if i in headings]
            if not head and entries < 4 and not (open_ and entries):
                open_ = False
                continue
            limit = doc["top"][head[0]] - 2 if head else -3
            for i in rows.index:
                if doc["top"][i] < limit and not open_:
                    continue
                if kinds[i] == "reference" or number.match(doc["text"][i].strip()):
                    kinds[i], open_ = "reference", True
                elif open_ and kinds[i] in ("body", "heading"):
                    kinds[i] = "reference"
        return doc.assign(type=kinds)

    return blocks.groupBy("doc_id").applyInPandas(run, blocks.schema)


def sweep_runs(ops: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs of kept fragments whose joined text is part of the page's blob (8 characters and more) are dropped; columns text, dropped, blob, keep."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable").reset_index(drop=True)
        key = [re.sub("[^0-9A-Za-z]", "", t or "").lower() for t in part["text"]]
        gone, n, at = part["dropped"].tolist(), len(part), 0
        while at < n:
            text, hit, j = "", None, at
            while j < n and not gone[j] and len(key[j]) <= 3:
                text += key[j]
                if len(text) >= 8:
                    if text not in part["blob"][j]:
                        break
                    hit = j
                j += 1
            if hit is not None:
                joined = "".join(key[at : hit + 1])
                if joined not in (part["keep"][at] or ""):
                    gone[at : hit + 1] = [True] * (hit + 1 - at)
                at = hit + 1
            else:
                at += 1
        return part.assign(dropped=gone)

    return ops.groupBy(*keys).applyInPandas(run, ops.schema)


def sandwiched(ops: DataFrame, keys: list[str], order: str, longest: int = 12) -> DataFrame:
    """Fragments between two dropped texts, in a run of at most `longest`, are dropped too; base rule, by windows."""
    w = Window.partitionBy(*keys).orderBy(order)
    frag = T.is_fragment(F.coalesce(F.col("text"), F.lit("")))
    rows = ops.withColumn("_frag", frag).withColumn("_solid", F.when(~frag, F.col("dropped")))
    rows = rows.withColumn("_run", F.sum((~frag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(frag.cast("int")).over(Window.partitionBy(*keys, "_run"))
    before = F.last("_solid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_solid", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    hit = F.col("_frag") & F.coalesce(before & after, F.lit(False)) & (size <= longest)
    return rows.withColumn("dropped", F.col("dropped") | hit).drop("_frag", "_solid", "_run")


def _merged(boxes: list[tuple[float, float, float, float]], reach: float) -> list[list[float]]:
    """x0, top, x1, bottom, n of the boxes that are left when those within reach of each other have merged."""
    got: list[list[float]] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0], b[2], b[3])):
        new = [*b, 1]
        near = True
        while near:
            near = [g for g in got if new[0] <= g[2] + reach and g[0] <= new[2] + reach and new[1] <= g[3] + reach and g[1] <= new[3] + reach]
            for g in near:
                new = [min(new[0], g[0]), min(new[1], g[1]), max(new[2], g[2]), max(new[3], g[3]), new[4] + g[4]]
                got.remove(g)
        got.append(new)
    return got


def merge_boxes(boxes: DataFrame, keys: list[str], reach: float = 12.0) -> DataFrame:
    """Boxes within `reach` of a growing box merge, until none does; keys, x0, top, x1, bottom, n.

    Rows come sorted by key and stream through a task, so that small pages cost no call each.
    """
    size = len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: list[tuple] = []

        def close() -> list[tuple]:
            return [(*key, *m) for m in _merged(held, reach)] if held else []

        for f in frames:
            out: list[tuple] = []
            for r in f.itertuples(index=False, name=None):
                if r[:size] != key:
                    out += close()
                    key, held = r[:size], []
                held.append(r[size:])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(close(), columns=names)

    kinds = dict(boxes.dtypes)
    names = [*keys, "x0", "top", "x1", "bottom", "n"]
    rows = boxes.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")]).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x0 double, top double, x1 double, bottom double, n bigint"]))


def dedupe_chars(chars: DataFrame, keys: list[str], bucket: float = 3.0) -> DataFrame:
    """Of characters drawn twice (same text, neighbouring thirds of a point) the first stays, by ord where there is one, then by top and x0."""

    order = [c for c in ("ord", "top", "x0", "text") if c in chars.columns]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        seen: set[tuple[str, int, int]] = set()
        keep = []
        for t, x, y in zip(part["text"], (part["x0"] * bucket).round(), (part["top"] * bucket).round(), strict=True):
            x, y = int(x), int(y)
            dup = any((t, x + dx, y + dy) in seen for dx in (-1, 0, 1) for dy in (-1, 0, 1))
            keep.append(not dup)
            if not dup:
                seen.add((t, x, y))
        return part[keep]

    return chars.groupBy(*keys).applyInPandas(run, chars.schema)


def chain_units(links: DataFrame, units: DataFrame) -> DataFrame:
    """Units that links (uid, next_uid) chain become one: each unit with its chain's first. Pointers double, so rounds grow with the log of the longest chain."""
    cur = units.select("uid").join(links.select(F.col("next_uid").alias("uid"), F.col("uid").alias("head")), "uid", "left").withColumn("head", F.coalesce("head", "uid"))
    while True:  # until no head changes, however long the chains
        step = cur.join(cur.select(F.col("uid").alias("head"), F.col("head").alias("_h")), "head").select("uid", F.col("_h").alias("head")).persist()
        same = step.join(cur.withColumnRenamed("head", "_o"), "uid").filter(F.col("head") != F.col("_o")).isEmpty()
        cur = step
        if same:
            break
    return cur
