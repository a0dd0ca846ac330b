import itertools
import random

import numpy as np
import pytest

from quire.llm import chat
from quire.llm.chat import N_STATES, SIZES, STYLES, TurnModel, conversation_parts, fit_turn_model, line_features, op2_chat_format, parse_conversations, parse_transcripts, render, write_transcript

CONV = "conv_id bigint, turn bigint, role string, text string"


def some_model(seed):
    rng = random.Random(seed)
    examples = []
    for _ in range(30):
        states = [2 * rng.randrange(3)]
        for _ in range(rng.randrange(8)):
            states.append(states[-1] // 2 * 2 + 1 if rng.random() < 0.5 else 2 * rng.randrange(3))
        examples.append(([tuple((s + rng.randrange(2)) % n for n in SIZES) for s in states], states))
    return TurnModel.fit(TurnModel.tally(examples))


def path_score(model, features, states):
    score = model.start[states[0]]
    for k, (f, s) in enumerate(zip(features, states, strict=True)):
        score += sum(e[s, x] for e, x in zip(model.emit, f, strict=True)) + (model.step[states[k - 1], s] if k else 0)
    return score


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_finds_the_best_of_all_paths(seed):
    model, rng = some_model(seed), random.Random(seed + 100)
    features = [tuple(rng.randrange(n) for n in SIZES) for _ in range(5)]
    best = max(path_score(model, features, p) for p in itertools.product(range(N_STATES), repeat=5))
    assert np.isclose(path_score(model, features, model.viterbi(features)), best)


def test_transfer_is_the_best_score_to_each_last_state():
    model, rng = some_model(9), random.Random(4)
    features = [tuple(rng.randrange(n) for n in SIZES) for _ in range(4)]
    first, way = model.transfer(features)
    for last in range(N_STATES):
        paths = [(*p, last) for p in itertools.product(range(N_STATES), repeat=3)]
        assert np.isclose(first[last], max(path_score(model, features, p) for p in paths))
        for before in range(N_STATES):
            want = max(path_score(model, features, p) - model.start[p[0]] + model.step[before, p[0]] if np.isfinite(model.start[p[0]]) else -np.inf for p in paths)
            assert way[before, last] >= want - 1e-9


def test_parse_recovers_turns(spark, sf_dir):
    model = fit_turn_model(conversation_parts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    turns = [("system", "Be kind."), ("user", "Hello there?\nSecond line."), ("assistant", "Hi."), ("user", "Bye."), ("assistant", "See you.")]
    for style in range(STYLES):
        text, states, owner = write_transcript([(k, r, t) for k, (r, t) in enumerate(turns)], style)
        assert len(line_features(text)[1]) == len(states) == len(owner)
        assert model.parse(text) == turns, style
    assert model.parse(None) == [] and model.parse(" \n ") == []


def test_held_out_conversations_of_the_whole_table(spark, sf_dir):
    got = op2_chat_format(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/conversations.parquet").distinct().count()
    held = [r for r in got if r.held_out]
    assert held and sum(r.exact for r in held) >= 0.97 * len(held) and sum(r.exact for r in got) >= 0.97 * len(got)


def test_parts_find_the_path_of_the_whole(spark, monkeypatch):
    """A conversation in parts of three turns gets the states that Viterbi gives its whole transcript."""
    rng = random.Random(2)
    rows = []
    for c in range(8):
        for k in range(rng.choice([2, 3, 10, 40])):
            role = rng.choice(["user", "assistant", "system", None])
            rows.append((c, k, role, "\n".join(rng.choice(["what is it?", "Sure.", "You are kind", "note: x", "A: b", "word " * 30]) for _ in range(rng.randrange(4)))))
    df = spark.createDataFrame(rows, CONV)
    model = some_model(3)
    whole = {}
    for p in conversation_parts(df).collect():
        lines, features, cut, true, owner = chat._written([t.asDict() for t in p.turns], p.style)
        states = model.viterbi(features)
        assert p.conv_id not in whole
        whole[p.conv_id] = [states[i] // 2 for i, o in enumerate(owner) if i == 0 or owner[i - 1] != o]
    monkeypatch.setattr(chat, "TURNS", 3)
    parts = conversation_parts(df)
    assert max(len(p.turns) for p in parts.collect()) == 3
    got = {}
    for r in parse_conversations(parts, model).collect():
        got.setdefault(r.conv_id, {})[r.turn] = chat.ROLES.index(r.role_pred)
    assert {c: [own[k] for k in sorted(own)] for c, own in got.items()} == whole


def test_odd_rows(spark, write):
    sep = "a\x1eb\x1fc"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "robot", ""), (4, 5, "assistant", "b"), (4, 5, "assistant", "c"), (6, 0, "user", sep), (6, 1, "assistant", "word " * 60_000), (7, 0, "user", "x\n<|im_end|>\ny <|end|>")]
    rows += [(5, k, ("user", "assistant")[k % 2], "long\ntext") for k in range(200)] + [(8, 0, "user", f"t{k}") for k in range(150)]
    df = spark.createDataFrame(rows, CONV)
    got = op2_chat_format(spark, write(conversations=df)).collect()
    assert len(got) == len({r for r in rows if r[0] is not None and r[1] is not None})
    assert sum(r.exact for r in got) > 0.6 * len(got), [r for r in got if not r.exact]
    assert next(r for r in got if (r.conv_id, r.turn) == (6, 0)).n_turns == 1


def test_empty_table(spark, write):
    assert op2_chat_format(spark, write(conversations=spark.createDataFrame([], CONV))).collect() == []


def test_clashing_columns_of_the_query(spark, write):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], CONV).withColumns({c: F.lit("x") for c in ("h", "pid", "seq", "style", "turns", "before", "last", "held_out")})
    assert len(op2_chat_format(spark, write(conversations=df)).collect()) == 2


def test_render_and_clashing_columns(spark):
    assert render([("user", "a")]) == "<|user|>\na\n<|end|>\n"
    df = spark.createDataFrame([("User: hi\nAI: yo", "x", "y")], "transcript string, parts string, style string")
    assert len(parse_transcripts(df, some_model(1)).first().parsed) >= 1
