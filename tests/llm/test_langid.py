import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import langid
from quire.llm.langid import MIN_COUNT, ORDERS, LanguageModel, fit_language_model, identify_languages, op3_language_id, tokens


def plain_model(rows):
    """Word and n-gram counts by plain loops: order -> key -> counts by language."""
    langs = sorted({lang for lang, t in rows if tokens(t)})
    by = {k: {} for k in (0, *ORDERS)}
    for lang, t in rows:
        for w in tokens(t):
            by[0].setdefault(w, Counter())[lang] += 1
            m = f"^{w}$"
            for k in ORDERS:
                for i in range(len(m) - k + 1):
                    by[k].setdefault(m[i : i + k], Counter())[lang] += 1
    by = {k: {g: c for g, c in own.items() if sum(c.values()) >= MIN_COUNT} for k, own in by.items()}
    out = {}
    for k, own in by.items():
        total = np.array([sum(c[x] for c in own.values()) for x in langs]) + 0.1 * len(own)
        out[k] = {g: np.log((np.array([c[x] for x in langs]) + 0.1) / total) for g, c in own.items()}
    return langs, out


def plain_score(model, w):
    langs, by = model
    if w in by[0]:
        return by[0][w]
    m, at, found = f"^{w}$", 0, []
    while at < len(m):
        k = next((k for k in ORDERS if at + k <= len(m) and m[at : at + k] in by[k]), 0)
        if k:
            found.append(by[k][m[at : at + k]])
        at += max(k, 1)
    return np.mean(found, axis=0) if found else np.zeros(len(langs))


ROWS = [
    ("en", "the running fox and the lazy dog were running and running away, the end"),
    ("en", "the dog and a fox; running the other way, other dogs"),
    ("de", "der laufende Hund und der faule Fuchs laufen, der laufende Fuchs"),
    ("de", "ein Hund und ein Fuchs und der laufende Wolf über über Öl"),
    ("fr", "le chien et le renard, le renard et la forêt, une forêt noire"),
]


@pytest.fixture
def model(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(ROWS)]
    return fit_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_scores_equal_plain_loops(model):
    plain = plain_model(ROWS)
    assert model.langs == plain[0]
    words = sorted({w for _, t in ROWS for w in tokens(t)}) + ["runnings", "laufender", "forêts", "öle", "zzz", "ωωω", "a", "日本", "x" * 3000, "𝒳y"]
    got, _ = model.score(words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, plain_score(plain, w), atol=1e-4), w


def test_backoff_and_empty_models(model):
    best = [x[0] for x in model.predict([["the"], ["der"], ["runnings"], ["laufender"], ["forêts"], []])]
    assert best == ["en", "de", "en", "de", "fr", "und"]
    assert LanguageModel.fit([], {}).predict([["a"]]) == [("und", 0.0, False)]
    assert model.score(["the", "ωωω", "zωz", "tωt", "日"])[1].tolist() == [True, False, False, True, False]


def test_the_memo_is_emptied_when_full(model, monkeypatch):
    texts = [[f"w{chr(97 + i)}{chr(97 + j)}", "the", "der"] for i in range(6) for j in range(6)]
    texts = [[w for w in t if w.isalpha()] for t in texts]
    want = [model.predict([t])[0] for t in texts]
    monkeypatch.setattr(langid, "MEMO_WORDS", 5)
    model.place, model.rows = {}, None
    assert [model.predict([t])[0] for t in texts] == want and len(model.place) <= 5


def test_tokens():
    assert tokens("Über 12 x_y!") == ["über", "x", "y"] and tokens(None) == []
    assert tokens("½ ² ①") == [] and tokens("a½b ②c") == ["a", "b", "c"] and tokens("Ⅷ") == []


def test_odd_rows(spark, odd, none, clashing):
    model = fit_language_model(odd.filter("doc_id <> 8"))
    got = {r.doc_id: r for r in identify_languages(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 6))
    assert got[1].lang_pred == "en" and got[7].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify_languages(none, fit_language_model(none)).collect() == []
    assert identify_languages(clashing, model).count() == 14


def test_numbers_that_are_no_letters_have_no_language(spark, odd):
    rows = odd.filter("doc_id in (1, 7)").unionByName(spark.createDataFrame([(30, "½ ² ①", "en", "a", 5), (31, "Ⅷ 12", "en", "a", 4)], odd.schema))
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(rows, fit_language_model(rows)).collect()}
    assert got[30] == got[31] == ("und", 0.0)


def test_held_out_accuracy_and_fold(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
