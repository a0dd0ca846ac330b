"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to rows of an embedding table; filters over one, two and three words slide along the
whole text, each keeps its greatest response, and a logistic unit reads those. Training is Adagrad on
minibatches; only the places that won the pooling get a gradient. The threshold is calibrated for each
language, shrunk toward the general one by the number of documents it rests on; the language is
guessed from the text's own hashed words, and the score is bent so that 0.5 is that threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._shared import by_bytes, crc_mod, table
from quire.llm.langid import class_shares, sampled
from quire.llm.wordhash import words

BUCKETS = 1 << 22
#: Buckets in a smaller share of the sample's texts share one row of zeros: what is that rare can't be told from label noise.
MIN_SHARE, MIN_TEXTS = 0.003, 4
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
#: About so many labelled documents of each label are learned from.
SAMPLE_PER_LABEL = 3_000
EPOCHS, BATCH, RATE = 12, 48, 0.08
#: A language's own threshold counts as much as the general one where it rests on so many validation documents of its rarer label.
CALIBRATION_PRIOR = 15
PAD = 0  # also the row of rare buckets


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (1..BUCKETS-1; 0 pads), and the number of words of each text."""
    h, doc, _, _ = words(texts, lower=True, split=True)
    return (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1, np.bincount(doc, minlength=len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64)


def padded(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another, each with pads behind it so that no window spans two; first place and places of each (one at least)."""
    places = np.maximum(count, 1)
    first = np.concatenate([[0], np.cumsum(places + max(WIDTHS) - 1)])
    out = np.full(int(first[-1]), PAD, dtype=np.int32)
    at = np.arange(len(ids)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    out[at] = ids
    return out, first[:-1], places


@dataclass
class ToxicityModel:
    rows: np.ndarray  # bucket to row of the tables; 0 for rare ones
    tables: list[list[np.ndarray]]  # for each width and offset: response of each filter to each row
    bias: list[np.ndarray]
    out_w: np.ndarray
    out_b: float
    langs: list[str]
    lang_logp: np.ndarray
    thresholds: np.ndarray  # by language, then one for texts without words

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(inside, first, 1)
        np.add.at(inside, first + places, -1)
        outside = np.cumsum(inside[:-1]) == 0
        parts = []
        for own, b in zip(self.tables, self.bias, strict=True):
            r = own[0][ids]
            for j in range(1, len(own)):
                r[: len(ids) - j] += own[j][ids[j:]]
            r[outside] = -np.inf
            parts.append(np.maximum.reduceat(r, first, axis=0) + b)
        return np.maximum(np.concatenate(parts, axis=1), 0)

    def raw(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability before calibration, and the place of the guessed language, for each text."""
        if not len(count):
            return np.zeros(0), np.zeros(0, np.int64)
        ids = self.rows[ids]
        p = padded(ids, count)
        z = self.pooled(*p) @ self.out_w + self.out_b
        lang = np.full(len(count), len(self.langs))
        if len(self.langs):
            has = count > 0
            if has.any():
                first = np.concatenate([[0], np.cumsum(count)[:-1]])[has]
                lang[has] = np.argmax(np.add.reduceat(self.lang_logp[ids], first, axis=0), axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), lang

    def score(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated score (0.5 is the language's threshold) and the guessed language's place."""
        p, lang = self.raw(ids, count)
        t = self.thresholds[lang]
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)), lang


def _log_odds(docs: list[np.ndarray], y: np.ndarray, n_rows: int) -> np.ndarray:
    """How much oftener each row occurs in texts of label 1: the signed root of the likelihood ratio, within -3 and 3."""
    pos, neg = np.zeros(n_rows), np.zeros(n_rows)
    for d, label in zip(docs, y, strict=True):
        (pos if label else neg)[np.unique(d)] += 1
    share = y.mean() if len(y) else 0.5
    want1, want0 = np.maximum((pos + neg) * share, 1e-9), np.maximum((pos + neg) * (1 - share), 1e-9)
    g = 2 * (pos * np.log(np.maximum(pos, 1e-9) / want1) + neg * np.log(np.maximum(neg, 1e-9) / want0))
    return np.clip(np.sign(pos - want1) * np.sqrt(np.maximum(g, 0)) / 8, -3, 3).astype(np.float32)


def fit(docs: list[np.ndarray], y: np.ndarray, lang: list[str], seed: int = 7) -> ToxicityModel:
    """Train on bucket ids, labels and languages (for the calibration only); a fifth is held back to calibrate."""
    rng = np.random.default_rng(seed)
    langs = sorted({x for x in lang if x is not None})
    place = {x: i for i, x in enumerate(langs)}
    freq = np.zeros(BUCKETS, dtype=np.int32)
    for d in docs:
        freq[np.unique(d)] += 1
    kept = np.flatnonzero(freq >= max(MIN_TEXTS, MIN_SHARE * len(docs)))
    kept = kept[kept != PAD]
    rows = np.zeros(BUCKETS, dtype=np.int32)
    rows[kept] = np.arange(1, len(kept) + 1)
    n_rows = len(kept) + 1
    docs = [rows[d] for d in docs]
    logp = np.ones((n_rows, len(langs)))
    for d, x in zip(docs, lang, strict=True):
        if x is not None:
            logp[:, place[x]] += np.bincount(d, minlength=n_rows)
    logp[PAD] = 1
    logp = np.log(logp / logp.sum(axis=0)).astype(np.float32) if langs else logp.astype(np.float32)

    held = rng.permutation(len(docs)) % 5 == 0
    train = np.flatnonzero(~held)
    emb = rng.normal(0, 0.1, (n_rows, DIM)).astype(np.float32)
    if len(train):
        emb[:, 0] = _log_odds([docs[i] for i in train], y[train], n_rows)
    emb[PAD] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    bias = [np.full(FILTERS, 0.1, dtype=np.float32) for _ in WIDTHS]
    out_w = rng.normal(0.1, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    out_b = np.zeros(1, dtype=np.float32)
    seen = [np.full_like(x, 1e-2) for x in (emb, *filters, *bias, out_w, out_b)]
    n_pos = max(1, int(y[train].sum()) if len(train) else 1)
    weight = {1: len(train) / (2 * n_pos), 0: len(train) / (2 * max(1, len(train) - n_pos))}

    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.2 * epoch)
        order = rng.permutation(train)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            count = np.array([len(docs[i]) for i in part])
            ids, first, places = padded(np.concatenate([docs[i] for i in part]), count)
            vec = emb[ids]
            wins, hidden = [], []
            for f, b in zip(filters, bias, strict=True):
                r = vec @ f[0]
                for j in range(1, len(f)):
                    r[: len(ids) - j] += vec[j:] @ f[j]
                win = np.stack([a + np.argmax(r[a : a + n], axis=0) for a, n in zip(first, places, strict=True)])
                wins.append(win)
                hidden.append(np.take_along_axis(r, win, axis=0) + b)
            h = np.maximum(np.concatenate(hidden, axis=1), 0)
            keep = rng.random(h.shape) > 0.2  # dropout
            hd = h * keep / 0.8
            t = y[part]
            g = (1 / (1 + np.exp(-np.clip(hd @ out_w + out_b[0], -30, 30))) - t) * np.where(t == 1, weight[1], weight[0]) / len(part)
            grads = [np.zeros(0)] + [None] * (2 * len(WIDTHS)) + [hd.T @ g + 1e-4 * out_w, np.array([g.sum()])]
            gh = (g[:, None] * out_w[None, :]) * keep / 0.8 * (h > 0)
            touched, row_grads = [], []
            for w, (f, win) in enumerate(zip(filters, wins, strict=True)):
                own = gh[:, w * FILTERS : (w + 1) * FILTERS]
                gf = np.zeros_like(f)
                for j in range(len(f)):
                    at = np.minimum(win + j, len(ids) - 1)
                    gf[j] = np.einsum("dk,dke->ek", own, vec[at])
                    touched.append(ids[at].ravel())
                    row_grads.append((own[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                grads[1 + w], grads[1 + len(WIDTHS) + w] = gf + 1e-4 * f, own.sum(axis=0)
            for x, s, gr in zip((*filters, *bias, out_w, out_b), seen[1:], grads[1:], strict=True):
                s += gr * gr
                x -= rate * gr / np.sqrt(s)
            u, inv = np.unique(np.concatenate(touched), return_inverse=True)
            ge = np.zeros((len(u), DIM), dtype=np.float32)
            np.add.at(ge, inv, np.concatenate(row_grads))
            ge[u == PAD] = 0
            seen[0][u] += ge * ge
            emb[u] -= 0.2 * rate * ge / np.sqrt(seen[0][u])

    model = ToxicityModel(rows, [[emb @ f[j] for j in range(len(f))] for f in filters], bias, out_w, float(out_b[0]), langs, logp, np.full(len(langs) + 1, 0.5))
    check = np.flatnonzero(held)
    if len(check):
        model.rows = np.arange(n_rows, dtype=np.int32)  # docs hold rows here
        p, guess = model.raw(np.concatenate([docs[i] for i in check]), np.array([len(docs[i]) for i in check]))
        model.rows = rows
        whole = _threshold(p, y[check])
        model.thresholds[:] = whole
        for i in range(len(langs)):
            own = guess == i
            n = min(y[check][own].sum(), (1 - y[check][own]).sum())
            if n:  # shrunk toward the general one, the more the less it rests on; without documents of both labels there is no own one
                model.thresholds[i] = (n * _threshold(p[own], y[check][own]) + CALIBRATION_PRIOR * whole) / (n + CALIBRATION_PRIOR)
    return model


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut in the widest gap between scores, of those whose mean of both classes' recalls is within 0.01 of the best."""
    order = np.argsort(p, kind="stable")
    q, t = p[order], y[order]
    n1, n0 = max(1, t.sum()), max(1, (1 - t).sum())
    below1, below0 = np.concatenate([[0], np.cumsum(t)]), np.concatenate([[0], np.cumsum(1 - t)])
    value = (n1 - below1) / n1 + below0 / n0
    edges = np.concatenate([[0.0], q, [1.0]])
    mid = (edges[:-1] + edges[1:]) / 2
    best = np.flatnonzero(value >= value.max() - 0.02)
    return float(np.clip(mid[best[np.argmax((edges[1:] - edges[:-1])[best])]], 0.02, 0.98))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Learn from about per_label documents of each label (the only bound; the driver gets their word buckets, 4 bytes a word).

    labels: doc_id, toxic. A document labelled more than once counts as toxic if one label says so.
    Rows without id, label or text teach nothing. docs: doc_id, text, lang.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic")).alias("toxic"))
    marks = sampled(marks, class_shares(marks, per_label, "toxic"), "toxic")
    rows = docs.select("doc_id", "text", "lang").filter("text is not null").join(F.broadcast(marks), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            ids, count = word_ids(b.column(1))
            cut = np.concatenate([[0], np.cumsum(count)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([ids[cut[i] : cut[i + 1]].tobytes() for i in range(len(count))], pa.binary())], ["doc_id", "lang", "toxic", "ids"])

    got = rows.mapInArrow(run, "doc_id bigint, lang string, toxic int, ids binary").toPandas().sort_values(["doc_id", "ids"], kind="stable")
    got = got.drop_duplicates("ids")  # copies would count as evidence
    ids = [np.frombuffer(x, dtype=np.int32) for x in got["ids"]]
    return fit(ids, (got["toxic"].to_numpy() > 0).astype(np.float64), [x if isinstance(x, str) else None for x in got["lang"]])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, lang_guess, threshold for each row. Scores depend on the text alone.

    Null and empty texts get the score of a text of pads and the general threshold. Whole texts are
    read, however long; repeated rows get repeated results; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.langs, "und"], dtype=object)
        for b in by_bytes(batches, "text", 1 << 20):
            s, lang = own.score(*word_ids(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(names[lang], pa.string()), pa.array(own.thresholds[lang], pa.float64())], ["id", "score", "predicted", "lang_guess", "threshold"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, lang_guess string, threshold double").withColumnRenamed("id", id_col)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fold: labels only of rows whose crc32 remainder by 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "lang_guess", "threshold")
