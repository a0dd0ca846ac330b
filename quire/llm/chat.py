"""Chat formatting: transcripts to turns by a hidden Markov model.

Each line of a transcript gives features: the class of its speaker marker, whether a blank line stands before it, its
length, its end and its first word. States are a role and whether the line opens a turn; a state's features are taken as
independent. Probabilities are counted on labelled transcripts and smoothed; Viterbi recovers the states, and the turns
are rendered in one canonical form.

A long conversation is worked on in parts. What a part does to the scores of the states is a small matrix of greatest sums;
scanning these forward gives the scores before each part, scanning back the states at its ends, and with them each part
finds its piece of the one best path over the whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quire.llm._shared import crc_mod, slices, stored, table

ROLES = ("system", "user", "assistant")
#: States: role * 2 + (0 opens a turn, 1 goes on).
N_STATES = 2 * len(ROLES)
#: Turns of one part of a conversation; parts only bound what is held at a time.
TURNS = 64

# How speakers are commonly marked.
NAMES = (
    ("system", "system|instructions?|context"),
    ("user", "user|human|question|q|customer|client|prompter|instruction|inst"),
    ("assistant", "assistant|ai|bot|answer|a|model|agent|response|output|gpt"),
)
_FORMS = (r"<\|im_start\|>[ \t]*(?:{0})\b[ \t]*", r"<\|(?:{0})\|>[ \t]*", r"#{{2,4}}[ \t]*(?:{0})[ \t]*:?[ \t]*", r"\[/?(?:{0})\][ \t]*", r"\*\*(?:{0}):?\*\*:?[ \t]*", r"(?:{0})[ \t]*[:>][ \t]*")
MARKERS = [(role, re.compile("|".join(f"(?:{f.format(names)})" for f in _FORMS), re.I)) for role, names in NAMES]
OTHER_NAME = re.compile(r"[^\W\d_][\w .'-]{0,23}:[ \t]")
END = re.compile(r"[ \t]*<\|(?:im_end|end)\|>[ \t]*$")
# Words that often open a question or request, a reply, an instruction.
FIRST_WORDS = (
    frozenset("what why how when where who which can could would please is are do does should explain write give tell list".split()),
    frozenset("sure yes no certainly of here sorry thanks great i it the there as".split()),
    frozenset("you your always never be act answer respond use follow".split()),
)
FIRST = re.compile(r"[^\W\d_]+")
#: Values of each feature: marker (a role's, another name, none), blank before, length, end, first word.
SIZES = (len(ROLES) + 2, 2, 3, 4, len(FIRST_WORDS) + 1)
ENDS = {"?": 0, ".": 1, "!": 1, ":": 2}

Features = tuple[int, ...]


def line_features(transcript: str) -> tuple[list[str], list[Features], list[int]]:
    """The lines without blank ones, the features of each, and the length of each marker."""
    lines, found, cut = [], [], []
    blank = True
    for line in transcript.split("\n"):
        line = END.sub("", line)
        if not line.strip():
            blank = True
            continue
        mark, size = len(ROLES) + 1, 0
        for i, (_, pattern) in enumerate(MARKERS):
            m = pattern.match(line)
            if m:
                mark, size = i, m.end()
                break
        else:
            if OTHER_NAME.match(line):
                mark = len(ROLES)
        body = line[size:].strip()
        word = FIRST.search(body)
        first = next((i for i, w in enumerate(FIRST_WORDS) if word and word.group().lower() in w), len(FIRST_WORDS))
        lines.append(line)
        found.append((mark, int(blank), 0 if len(body) < 25 else 1 if len(body) < 120 else 2, ENDS.get(body[-1:], 3), first))
        cut.append(size)
        blank = False
    return lines, found, cut


@dataclass
class TurnModel:
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]  # for each feature: state x value

    @staticmethod
    def tally(examples: list[tuple[list[Features], list[int]]]) -> np.ndarray:
        """The counts that fit() takes, of starts, steps and features by state, in one row; counts of several calls add up."""
        start, step, emit = np.zeros(N_STATES), np.zeros((N_STATES, N_STATES)), [np.zeros((N_STATES, n)) for n in SIZES]
        for features, states in examples:
            if states:
                start[states[0]] += 1
            for a, b in zip(states[:-1], states[1:], strict=True):
                step[a, b] += 1
            for s, f in zip(states, features, strict=True):
                for own, x in zip(emit, f, strict=True):
                    own[s, x] += 1
        return np.concatenate([start, step.ravel(), *(e.ravel() for e in emit)])

    @classmethod
    def fit(cls, counts: np.ndarray) -> TurnModel:
        """Smoothed by a half, features by a tenth; a turn can't go on in another role, and none goes on at the start."""
        cut = np.cumsum([N_STATES, N_STATES * N_STATES, *(N_STATES * n for n in SIZES)])
        start, step, *emit = np.split(counts, cut[:-1])
        start, step = start + 0.5, step.reshape(N_STATES, N_STATES) + 0.5
        emit = [e.reshape(N_STATES, -1) + 0.1 for e in emit]
        for a in range(N_STATES):
            for r in range(len(ROLES)):
                if r != a // 2:
                    step[a, 2 * r + 1] = 0
        start[1::2] = 0
        with np.errstate(divide="ignore"):
            return cls(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])

    def emissions(self, features: list[Features]) -> np.ndarray:
        """Log probability of each line's features, line x state."""
        f = np.array(features, dtype=np.int64).reshape(-1, len(SIZES))
        return sum((own[:, f[:, i]].T for i, own in enumerate(self.emit)), start=np.zeros((len(f), N_STATES)))

    def transfer(self, features: list[Features]) -> tuple[np.ndarray, np.ndarray]:
        """The greatest score of a path through the lines to each last state: from a start, and from each state before them."""
        first, way = self.start, self.step
        for k, e in enumerate(self.emissions(features)):
            if k:
                first = (first[:, None] + self.step).max(axis=0)
                way = (way[:, :, None] + self.step[None]).max(axis=1)
            first, way = first + e, way + e
        return first, way

    def viterbi(self, features: list[Features], before: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states, given the state before the lines and the last one where known; ties go to the lower state."""
        if not features:
            return []
        e = self.emissions(features)
        score = (self.start if before is None else self.step[before]) + e[0]
        back = np.zeros((len(e), N_STATES), dtype=np.int8)
        for t in range(1, len(e)):
            way = score[:, None] + self.step
            back[t] = np.argmax(way, axis=0)
            score = way.max(axis=0) + e[t]
        at = int(np.argmax(score)) if last is None else last
        out = [at]
        for t in range(len(e) - 1, 0, -1):
            at = int(back[t, at])
            out.append(at)
        return out[::-1]

    def parse(self, transcript: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn, markers removed."""
        lines, features, cut = line_features(transcript or "")
        return turns_of(lines, cut, self.viterbi(features))


def turns_of(lines: list[str], cut: list[int], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) of each turn that the states make of the lines; a line that goes on without a turn before it opens one."""
    turns: list[tuple[str, list[str]]] = []
    for line, size, state in zip(lines, cut, states, strict=True):
        body = line[size:] if size else line
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [body] if body.strip() else []))
        else:
            turns[-1][1].append(body)
    return [(role, "\n".join(part)) for role, part in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: a tag with the role, the text, an end tag, for each turn."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


STYLES = 6


def body_lines(text: str | None) -> list[str]:
    """The lines of a turn that aren't blank, without end tags."""
    return [x for x in (END.sub("", y) for y in (text or "").split("\n")) if x.strip()]


def write_transcript(turns: list[tuple[int, str | None, str | None]], style: int) -> tuple[str, list[int], list[int]]:
    """A transcript of turns (number, role, text) in one of several manners, and the state and turn of each line that is not
    blank. The last manner leaves every third marker out. Unknown roles count as the user's."""
    names = ({"user": "User", "assistant": "Assistant", "system": "System"}, {"user": "Human", "assistant": "AI", "system": "Context"}, {"user": "Q", "assistant": "A", "system": "Instructions"})
    out, states, owner = [], [], []
    for k, (number, role, text) in enumerate(turns):
        role = role if role in ROLES else "user"
        body = body_lines(text)
        r = ROLES.index(role)
        if style < 3:
            head, body = f"{names[style][role]}: {body[0] if body else ''}", body[1:]
        elif style == 3:
            head = {"user": "### Instruction:", "assistant": "### Response:", "system": "### System:"}[role]
        elif style == 4:
            head = f"<|im_start|>{role}"
        else:
            out.append("")
            head = None if number % 3 == 2 and body else f"[{role}]"
        if head is not None:
            out.append(head)
            states.append(2 * r)
        out += body
        states += [2 * r + (head is not None or j > 0) for j in range(len(body))]
        owner += [k] * (len(states) - len(owner))
        if style == 4:
            out.append("<|im_end|>")
    return "\n".join(out), states, owner


def conversation_parts(conversations: DataFrame) -> DataFrame:
    """Stored: conv_id, pid, seq, style, turns (turn, role, text) of conversations(conv_id, turn, role, text).

    Repeated rows count once; turns with one number stand in the order of role and text hash. Rows without conv_id or turn
    are left out. Rows are dealt by ranges of conversation and turn, so a conversation of any length spreads over tasks, and
    a part of at most TURNS turns is all that one holds. (pid, seq) order the parts of a conversation.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").filter("conv_id is not null and turn is not null").distinct()
    order = ["conv_id", "turn", "role", "h"]
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    named = ordered.select("conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(STYLES)).cast("int").alias("style"), "turn", "role", "text")
    turn = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, held, key = TaskContext.get().partitionId(), 0, [], None
        for b in batches:
            done = []
            for conv, style, number, role, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (conv != key[0] or len(held) >= TURNS):
                    done.append((*key, seq, held))
                    seq, held = seq + 1, []
                key = (conv, style)
                held.append({"turn": number, "role": role, "text": text})
            yield from emit(done, pid, b.schema.field(0).type)
        if held:
            yield from emit([(*key, seq, held)], pid, pa.int64() if not isinstance(key[0], str) else pa.string())

    def emit(done: list, pid: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if done:
            conv, style, seq, turns = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(conv, id_type), pa.array([pid] * len(conv), pa.int64()), pa.array(seq, pa.int64()), pa.array(style, pa.int32()), pa.array(turns, turn)], ["conv_id", "pid", "seq", "style", "turns"])

    return stored(named.mapInArrow(run, f"conv_id {kind}, pid bigint, seq bigint, style int, turns array<struct<turn: bigint, role: string, text: string>>"), "conversation-parts")


def _written(turns: list[dict], style: int) -> tuple[list[str], list[Features], list[int], list[int], list[int]]:
    """Lines, features, markers' lengths, true states and turns of a part's transcript."""
    text, states, owner = write_transcript([(t["turn"], t["role"], t["text"]) for t in turns], style)
    return *line_features(text), states, owner


def fit_turn_model(parts: DataFrame) -> TurnModel:
    """Learn from all the given parts; only counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TurnModel.tally([])))
        for b in slices(batches):
            written = [_written(t, s) for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            total += TurnModel.tally([(w[1], w[3]) for w in written])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "n"])

    counts = np.zeros(len(TurnModel.tally([])))
    for r in parts.select("turns", "style").mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r.i] = r.n
    return TurnModel.fit(counts)


def part_bounds(parts: DataFrame, model: TurnModel) -> DataFrame:
    """Stored: conv_id, pid, seq, before, last of the parts of conversations that have several: the state before a part (null
    for the first) and its last state on the best path. Rows of one conversation pass through one task in order, one small
    matrix for a part; nothing of them is held."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    kind = parts.schema["conv_id"].dataType.simpleString()
    many = parts.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    floats = pa.list_(pa.float64())

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [shared.value.transfer(_written(t, s)[1]) for t, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x.tolist() for x, _ in got], floats), pa.array([m.ravel().tolist() for _, m in got], floats)], ["conv_id", "pid", "seq", "first", "way"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, score = None, None
        for b in batches:
            entering = []
            for conv, first, way in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if conv != key:
                    key, old, score = conv, None, np.array(first)
                else:
                    old, score = score, (score[:, None] + np.array(way).reshape(N_STATES, N_STATES)).max(axis=0)
                score = score - score.max()
                entering.append(None if old is None else old.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(entering, floats)], ["conv_id", "pid", "seq", "first", "way", "entering"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            before, last = [], []
            for conv, first, way, entering in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                score = np.array(first) if entering is None else np.array(entering)[:, None] + np.array(way).reshape(N_STATES, N_STATES)
                if conv != key:
                    key, state = conv, int(np.argmax(score if entering is None else score.max(axis=0)))
                last.append(state)
                state = None if entering is None else int(np.argmax(score[:, state]))
                before.append(state)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(before, pa.int32()), pa.array(last, pa.int32())], ["conv_id", "pid", "seq", "before", "last"])

    base = f"conv_id {kind}, pid bigint, seq bigint, first array<double>, way array<double>"
    rows = parts.join(many, "conv_id", "left_semi").select("conv_id", "pid", "seq", "turns", "style").mapInArrow(moves, base)
    ahead = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq").mapInArrow(forward, base + ", entering array<double>")
    order = [F.col("conv_id"), F.col("pid").desc(), F.col("seq").desc()]
    return stored(ahead.sortWithinPartitions(*order).mapInArrow(back, f"conv_id {kind}, pid bigint, seq bigint, before int, last int"), "part-bounds")


def parse_transcripts(rows: DataFrame, model: TurnModel, text_col: str = "transcript") -> DataFrame:
    """rows with parsed array<struct<role, text>> and canonical text behind their columns; a null or blank transcript has no turns."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in slices(batches):
            got = [shared.value.parse(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([[{"role": r, "text": x} for r, x in t] for t in got], kind), pa.array([render(t) for t in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "parsed", "canonical"])

    turn = StructType().add("role", "string").add("text", "string")
    schema = StructType(list(rows.schema.fields)).add("parsed", ArrayType(turn)).add("canonical", "string")
    return rows.mapInArrow(run, schema)


def parse_conversations(parts: DataFrame, model: TurnModel) -> DataFrame:
    """For each turn of the parts, written as one transcript a conversation and parsed: conv_id, turn, role, and what the parse
    makes of its lines: role_pred (of the first), n_turns that begin there (1 is right), exact (one turn of the right role that
    goes on to the end, with the turn's own text), canonical (the lines' turns rendered)."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    kind = parts.schema["conv_id"].dataType.simpleString()
    rows = parts.join(part_bounds(parts, model), ["conv_id", "pid", "seq"], "left").select("conv_id", "style", "turns", "before", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            conv, out = [], []
            for c, style, turns, before, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                lines, features, cut, true, owner = _written(turns, style)
                states = shared.value.viterbi(features, before, last)
                at = np.searchsorted(owner, np.arange(len(turns) + 1)).tolist()
                for k, t in enumerate(turns):
                    own = slice(at[k], at[k + 1])
                    role = t["role"] if t["role"] in ROLES else "user"
                    made = turns_of(lines[own], cut[own], states[own])
                    exact = states[own] == true[own] and made == [(role, "\n".join(body_lines(t["text"])))]
                    conv.append(c)
                    out.append((t["turn"], role, ROLES[states[at[k]] // 2], sum(s % 2 == 0 for s in states[own]), exact, render(made)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(conv, b.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "turn", "role", "role_pred", "n_turns", "exact", "canonical"])

    return rows.mapInArrow(run, f"conv_id {kind}, turn bigint, role string, role_pred string, n_turns int, exact boolean, canonical string")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as a transcript in one of several manners, parsed and rendered. One row for each of its turns.

    The model learns from conversations whose crc32(conv_id as text) mod 5 is not 0; the others are held_out. Repeated rows
    count once, rows without conv_id or turn not at all; a null text is an empty turn; an empty table gives an empty one.
    """
    parts = conversation_parts(table(spark, sf_dir, "conversations"))
    model = fit_turn_model(parts.filter(crc_mod("conv_id", 5) != 0))
    out = parse_conversations(parts, model)
    return out.select("conv_id", "turn", (crc_mod("conv_id", 5) == 0).alias("held_out"), "role", "role_pred", "n_turns", "exact", F.sha2("canonical", 256).alias("canonical_sha256"))
