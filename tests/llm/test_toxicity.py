import zlib

import numpy as np
import pyarrow as pa

from quire.llm.toxicity import fit, fit_toxicity, op1_toxicity, score_toxicity, word_ids


def planted(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(n):
        t = [words[k] for k in rng.integers(0, 300, rng.integers(5, 200))]
        y.append(int(i % 4 == 0))
        if y[-1]:
            for b in rng.choice(["vile", "rotten", "scummy"], 3):
                t.insert(int(rng.integers(0, len(t))), b)
        texts.append(" ".join(t))
    return texts, np.array(y, dtype=np.float64)


def ids_of(texts):
    ids, n = word_ids(pa.array(texts))
    cut = np.concatenate([[0], np.cumsum(n)])
    return [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]


def test_learns_a_planted_signal():
    texts, y = planted(600, 1)
    model = fit(ids_of(texts), y, ["en"] * len(texts))
    new, truth = planted(200, 2)
    s, _ = model.score(*word_ids(pa.array(new)))
    assert ((s >= 0.5) == truth).mean() > 0.95
    one, _ = model.score(*word_ids(pa.array([new[3]])))
    assert abs(one[0] - s[3]) < 1e-6  # neighbours in a batch don't matter


def test_word_ids_fold_case_and_marks():
    a, b = ids_of(["Trash! you", "trash, YOU"])
    assert a.tolist() == b.tolist() and 0 not in a


def test_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (7, 0, 0), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    model = fit_toxicity(odd, labels)
    got = score_toxicity(odd, model).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert score_toxicity(none, model).collect() == [] and score_toxicity(clashing, model).count() == 14
    empty = fit_toxicity(none, labels.limit(0))
    assert score_toxicity(odd, empty).count() == 14


def test_fold(spark, sf_dir):
    got = op1_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
