"""The translation path as joins over shrinking sets of misses. Engines are adapters; memo and identity come built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: A table of at most so many rows is broadcast for a join without equality; a larger one is cut into blocks.
SMALL_ROWS = 20_000


def _blocks(small: DataFrame, key: str) -> Iterator[DataFrame]:
    n = small.count()
    k = max(1, -(-n // SMALL_ROWS))
    for i in range(k):
        yield small if k == 1 else small.filter(F.pmod(F.xxhash64(key), F.lit(k)) == i)


def glossary_hits(units: DataFrame, glossary: DataFrame, key: str = "uid", source: str = "source", strict: bool = False) -> DataFrame:
    """(key, term, ja) for glossary (term, ja) rows whose term the lower-cased source holds; strict asks for word ends."""
    out = None
    for part in _blocks(glossary, "term"):
        low = F.lower(F.col(source))
        hit = low.contains(F.col("term")) if not strict else F.regexp_like(low, F.concat(F.lit(r"\b\Q"), F.col("term"), F.lit(r"\E\b")))
        got = units.select(key, source).join(F.broadcast(part), hit).select(key, "term", "ja")
        out = got if out is None else out.unionByName(got)
    return out


def glossary_maps(hits: DataFrame, key: str = "uid") -> DataFrame:
    return hits.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "ja")))).alias("glossary"))


def merged_glossary(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """The user's terms over the built-in ones."""
    return builtin.alias("b").join(user.alias("u"), "term", "full_outer").select("term", F.coalesce("u.ja", "b.ja").alias("ja"))


def memo_prefix(units: DataFrame, memo: DataFrame, key: str = "uid", source: str = "source") -> DataFrame:
    """For each unit the ja of the memo (prefix, ja) with the longest prefix, white space aside; '' without one.

    Prefixes are looked up by equality for each prefix length in use, so nothing is compared pairwise.
    """
    m = memo.select(T.strip_spaces(F.col("prefix")).alias("p"), "ja").filter("p <> ''").groupBy("p").agg(F.min("ja").alias("ja"))
    lengths = [r.n for r in m.select(F.length("p").alias("n")).distinct().collect()]
    u = units.select(key, T.strip_spaces(F.col(source)).alias("s"))
    if not lengths:
        return u.select(key, F.lit("").alias("ja"))
    cut = u.select(key, F.explode(F.filter(F.array(*[F.when(F.length("s") >= n, F.substring("s", 1, n)) for n in sorted(lengths)]), lambda x: x.isNotNull())).alias("p"))
    best = cut.join(m, "p").groupBy(key).agg(F.max_by("ja", F.length("p")).alias("ja"))
    return u.select(key).join(best, key, "left").select(key, F.coalesce("ja", F.lit("")).alias("ja"))


def cached(units: DataFrame, cache: DataFrame, engine: str, model: str = "", text: str = "masked") -> DataFrame:
    """Units with key and target_masked, null for misses; cached echoes of text with words count as misses."""
    keyed = units.withColumn("key", T.content_key(F.lit(engine), F.lit(model), F.col(text)))
    got = keyed.join(cache.select("key", "target_masked").dropDuplicates(["key"]), "key", "left")
    stale = T.is_echo(F.col("target_masked")) & T.has_real_word(F.col(text))
    return got.withColumn("target_masked", F.when(~F.coalesce(stale, F.lit(False)), F.col("target_masked")))


def updated_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh translations over old ones."""
    new = fresh.filter("target_masked is not null").select("key", "target_masked").dropDuplicates(["key"])
    return cache.join(new, "key", "left_anti").select("key", "target_masked").unionByName(new)


class Engine:
    """An adapter. translate() gets texts and returns as many results in their order; '' or None says that one failed."""

    name = "engine"
    fine: bool = False
    unmasked: bool = False

    def translate(self, texts: list[str]) -> list[str | None]:
        raise NotImplementedError


class IdentityEngine(Engine):
    name = "identity"

    def translate(self, texts: list[str]) -> list[str | None]:
        return list(texts)


class MemoEngine(Engine):
    name = "memo"

    def __init__(self, memo: dict[str, str]):
        self.memo = sorted((("".join(k.split()), v) for k, v in memo.items()), key=lambda x: -len(x[0]))

    def translate(self, texts: list[str]) -> list[str | None]:
        return [next((v for k, v in self.memo if "".join(t.split()).startswith(k)), "") for t in texts]


ENGINES: dict[str, Callable[..., Engine]] = {"identity": IdentityEngine, "memo": MemoEngine}


def run_engine(misses: DataFrame, engine: Engine, text: str = "masked", key: str = "uid") -> DataFrame:
    """(key, result) by Arrow batches; an engine's exception gives nulls for its batch, never a failed task."""
    kind = dict(misses.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                got = engine.translate(f[text].fillna("").tolist())
            except Exception:
                got = [None] * len(f)
            yield pd.DataFrame({key: f[key], "result": [x or None for x in got]})

    return misses.select(key, text).mapInPandas(run, f"{key} {kind}, result string")


def translate_units(units: DataFrame, cache: DataFrame, engine: Engine, retries: int = 2, validate: bool = True, text: str = "masked", key: str = "uid") -> DataFrame:
    """Units with target_masked: cache, then units of tokens alone, then the engine on what is left, `retries` more times.

    A result counts if it keeps the placeholders (P19) and is no echo (P18) of words. Failures stay null.
    """
    state = cached(units, cache, engine.name, text=text)
    if validate:
        state = state.withColumn("target_masked", F.coalesce("target_masked", F.when(T.is_token_only(F.col(text)) & (F.trim(text) != ""), F.col(text))))
    for _ in range(1 + retries):
        fresh = run_engine(state.filter(F.col("target_masked").isNull() & (F.trim(text) != "")), engine, text, key)
        ok = F.col("result").isNotNull()
        state = state.join(fresh, key, "left")
        if validate:
            ok = ok & T.placeholders_equal(F.col(text), F.col("result")) & ~(T.is_echo(F.col("result")) & T.has_real_word(F.col(text)))
        state = state.withColumn("target_masked", F.coalesce("target_masked", F.when(ok, F.col("result")))).drop("result")
        if engine.name in ENGINES:  # these answer alike every time
            break
    return state


def request_text(texts: list[str]) -> str:
    """the segments of one request, each behind its mark."""
    return "\n\n".join(f"⟪SEG{i}⟫\n{t}" for i, t in enumerate(texts, 1))


def split_response(response: str, n: int) -> list[str] | None:
    """the segments of a response in order; None unless each of 1..n comes once."""
    import re

    parts = re.split(r"⟪SEG(\d+)⟫", response)
    numbers = [int(x) for x in parts[1::2]]
    if sorted(numbers) != list(range(1, n + 1)):
        return None
    got = {i: re.sub(r"^\(type:[^)]*\)\s*", "", t.strip()) for i, t in zip(numbers, parts[2::2], strict=True)}
    return [got[i] for i in range(1, n + 1)]
