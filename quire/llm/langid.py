"""Language identification, word first.

A known word is scored by its log frequency in each language. An unseen word is covered from the left
by the longest known character n-gram at each place, falling back to ever shorter ones, and scored by
the mean of their log frequencies. Frequencies come from a bounded sample of labelled documents; they
are counted on the executors, and the driver gets a hash and the counts of each word and n-gram.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import wordhash
from quire.llm._shared import crc_mod, slices, table, unit_hash

WORD = re.compile(r"[^\W\d_]+")
#: About so many labelled documents of each language are learned from.
SAMPLE_PER_LANG = 1_500
#: Lengths of the character n-grams, longest first; a word's edges are marked by "^" and "$".
ORDERS = (5, 4, 3, 2, 1)
#: A word or n-gram that the sample holds fewer times counts as unseen.
MIN_COUNT = 2
UNKNOWN = "und"
#: Words whose scores one worker remembers; the memory is emptied when full.
MEMO_WORDS = 80_000
#: The order that stands for whole words in the tables.
WHOLE = 0


def tokens(text: str | None) -> list[str]:
    """The runs of letters (str.isalpha), lower case."""
    got = WORD.findall(text.lower()) if text else []
    if got and not "".join(got).isalpha():  # numbers such as "½" are word characters, but no letters
        got = [x for w in got for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return got


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word; none may be empty or hold a space."""
    return wordhash.words(pa.array(words, pa.large_string()))[0]


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The words, each between its marks, as one run of characters: first place of each word, end of each, and for each
    order the hash of the characters from each place on (0 where they leave the word)."""
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    end = np.cumsum(size)
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    room = np.repeat(end, size) - np.arange(len(chars))
    out, h = {}, np.zeros(len(chars), dtype=np.uint64)
    for k in range(1, max(ORDERS) + 1):
        h[: len(chars) - k + 1] = wordhash.mix(h[: len(chars) - k + 1] * np.uint64(0x9FB21C651E98DF25) + chars[k - 1 :] + np.uint64(k))
        if k in ORDERS:
            out[k] = np.where(room >= k, h, np.uint64(0))
    return end - size, end, out


@dataclass
class LanguageModel:
    """For each order (WHOLE: words) the sorted hashes and the log frequencies in each language; a bounded memo of words."""

    langs: list[str]
    hashes: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    place: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    learned: np.ndarray | None = None

    @classmethod
    def fit(cls, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        """counts: for each order the hashes and their counts, a column for each language."""
        hashes, logp = {}, {}
        for k in (WHOLE, *ORDERS):
            h, c = counts.get(k, (np.zeros(0, np.uint64), np.zeros((0, len(langs)))))
            order = np.argsort(h)
            hashes[k] = h[order]
            logp[k] = np.log((c[order] + 0.1) / (c.sum(axis=0) + 0.1 * len(c))).astype(np.float32)
        return cls(langs, hashes, logp)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": {}, "rows": None, "learned": None}

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """The row of each hash in the table of order k, or -1."""
        own = self.hashes[k]
        if not len(own):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        return np.where(own[at] == h, at, -1)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of distinct words: log frequencies of known ones, else the mean over the n-grams that cover the word, zeros
        without any. And whether the word, or an n-gram that holds one of its letters, was learned: its edges alone, which all
        words share, don't count. A learned n-gram's letters were learned too, as often at least, so single letters decide."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        at = self.find(WHOLE, word_hashes(words))
        out[at >= 0] = self.logp[WHOLE][at[at >= 0]]
        learned = at >= 0
        new = np.flatnonzero(at < 0)
        if len(new):
            place, end, grams = gram_hashes([words[i] for i in new])
            longest, row = np.zeros(int(end[-1]), dtype=np.int64), np.zeros(int(end[-1]), dtype=np.int64)
            for k in sorted(ORDERS):
                got = self.find(k, grams[k])
                got[grams[k] == 0] = -1
                longest[got >= 0], row[got >= 0] = k, got[got >= 0]
                if k == 1:
                    letter = got >= 0
                    letter[place], letter[end - 1] = False, False
                    learned[new] = np.add.reduceat(letter.astype(np.int64), place) > 0
            total, found = np.zeros((len(new), len(self.langs))), np.zeros(len(new))
            going = np.arange(len(new))
            while len(going):  # every word goes on by its longest n-gram, or past one character that none begins with
                here = place[going]
                for k in ORDERS:
                    some = longest[here] == k
                    total[going[some]] += self.logp[k][row[here[some]]]
                found[going] += longest[here] > 0
                place[going] = here + np.maximum(longest[here], 1)
                going = going[place[going] < end[going]]
            out[new] = total / np.maximum(found, 1)[:, None]
        return out, learned

    def remember(self, words: list[str]) -> np.ndarray:
        """The place of each word in the memo, which is emptied first if its new words don't fit."""
        at = list(map(self.place.get, words))
        if None in at:
            new = list({w for w, i in zip(words, at, strict=True) if i is None})
            if self.rows is None or len(self.place) + len(new) > MEMO_WORDS:
                new = list(set(words))
                self.place, self.rows, self.learned = {}, np.zeros((0, len(self.langs)), dtype=np.float32), np.zeros(0, dtype=bool)
            n = len(self.place)
            if n + len(new) > len(self.rows):  # grows by doubling
                more = max(4_096, 2 * (n + len(new))) - len(self.rows)
                self.rows = np.concatenate([self.rows, np.zeros((more, len(self.langs)), dtype=np.float32)])
                self.learned = np.concatenate([self.learned, np.zeros(more, dtype=bool)])
            self.rows[n : n + len(new)], self.learned[n : n + len(new)] = self.score(new)
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            at = list(map(self.place.__getitem__, words))
        return np.array(at, dtype=np.int64)

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float, bool]]:
        """For each list of words: the language, its share of the evidence, and whether anything in it was learned."""
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        some = np.flatnonzero(size)
        if self.langs and len(some):
            at = self.remember([w for t in texts for w in t])
            first = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            s = np.add.reduceat(self.rows[at], first, axis=0, dtype=np.float64)
            p = np.exp((s - s.max(axis=1, keepdims=True)) / np.sqrt(size[some])[:, None])
            best = p.argmax(axis=1)
            share = p[np.arange(len(some)), best] / p.sum(axis=1)
            for i, j, x, known in zip(some.tolist(), best.tolist(), share.tolist(), np.logical_or.reduceat(self.learned[at], first).tolist(), strict=True):
                out[i] = (self.langs[j], x, known)
        return out


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, n of all rows of docs, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter[str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])
            by.clear()

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, by.values())) > MEMO_WORDS:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, word string, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def key_counts(words: DataFrame) -> DataFrame:
    """order, h, lang, n of word counts (lang, word, n): the words (order WHOLE) and their n-grams by hash, added up in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, word, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            names, of = np.unique(np.array(lang, dtype=object).astype(str), return_inverse=True) if lang else (np.array([]), np.zeros(0, np.int64))
            for i, name in enumerate(names.tolist()):
                own = np.flatnonzero(of == i)
                mine = [word[j] for j in own]
                first, end, grams = gram_hashes(mine)
                by = {WHOLE: (word_hashes(mine), n[own])} | {k: (h, np.repeat(n[own], end - first)) for k, h in grams.items()}
                for k, (h, c) in by.items():
                    some = np.flatnonzero((h != 0) | (k == WHOLE))
                    u, inv = np.unique(h[some], return_inverse=True)
                    total = np.bincount(inv, weights=c[some], minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, dtype=np.int32)), pa.array(u.view(np.int64)), pa.array([name] * len(u), pa.string()), pa.array(total)], ["order", "h", "lang", "n"])

    return words.mapInArrow(run, "order int, h bigint, lang string, n bigint")


def class_shares(docs: DataFrame, per_class: int, class_col: str) -> dict:
    """For each class the share of its rows that leaves about per_class of them."""
    return {c: min(1.0, per_class / n) for c, n in docs.groupBy(class_col).count().collect() if c is not None}


def sampled(docs: DataFrame, share: dict, class_col: str, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id hashes below their class's share; the same rows at every run."""
    keep = F.lit(False)
    for c, s in sorted(share.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(class_col) == F.lit(c)) & (unit_hash(id_col) < F.lit(s)))
    return docs.filter(keep)


def fit_language_model(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from about per_lang documents of each language (that bound is the only limit); rows without language or text teach nothing."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter("lang is not null and text is not null and doc_id is not null")
    share = class_shares(rows, per_lang, "lang")
    langs = sorted(share)
    counted = key_counts(word_counts(sampled(rows, share, "lang")))
    by = counted.groupBy("order", "h").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("float").alias(f"c{i}") for i, x in enumerate(langs)])
    got = by.filter(F.col("n") >= MIN_COUNT).drop("n").toArrow()
    order, h = got["order"].to_numpy(), got["h"].to_numpy().view(np.uint64)
    counts = np.stack([got[f"c{i}"].to_numpy() for i in range(len(langs))], axis=1) if langs else np.zeros((0, 0), np.float32)
    some = counts.sum(axis=0) > 0  # a language without a word teaches nothing
    return LanguageModel.fit([x for x, k in zip(langs, some, strict=True) if k], {k: (h[order == k], counts[order == k][:, some]) for k in (WHOLE, *ORDERS)})


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row; `und` and 0 for null texts and texts without a letter, or if nothing was learned.

    The model is broadcast; its size is bounded by the sample it was learned from. Whole texts are
    read, however long. Repeated rows give repeated results; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            got = own.predict([tokens(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fold: learns from rows whose crc32 remainder by 4 is not 2; a null id is never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(crc_mod("doc_id", 4) != 2))
    out = identify_languages(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
