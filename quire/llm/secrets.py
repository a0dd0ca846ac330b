"""Secret scans: fixed patterns, and a guess-cost estimate of values in credential contexts.

The estimate is the least cost, in log2 guesses, of cutting a value into dictionary words, dates,
repeats, keyboard walks, sequences and brute-force spans; a dynamic program over prefixes finds it.
A value that stays costly is random enough to be a real secret.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm._shared import slices, table
from quire.llm.tokens import tokenizer_path

# The base patterns of the contract and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs [0-9a-f]+ of 16 and more
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: Contexts whose value is judged by its guess cost; wider than the base pattern. A keyword may end or begin a longer name
#: (DB_PASSWORD, clientSecret, secret_key), and a scheme may stand between it and its value or be the keyword itself.
CONTEXT = re.compile(r"""(?:(?:password|passwd|passphrase|passcode|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key)(?:[_-][A-Za-z0-9_-]{0,128})?["']?\x20*(?:[:=]|\bis\b)\x20*["']?(?:(?:bearer|basic|token)\x20+)?|\bbearer\x20+)([^\s"',;<>]+)""", re.I | re.A)
#: A value of at most so many characters may itself be the keyword of the next value ("bearer token: ...").
MAX_NAME = 64
HINT = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential", re.I | re.A)

#: Values of at least this many characters and log2 guesses are reported.
MIN_VALUE, MIN_BITS = 8, 36.0
#: Longest piece that a word, date or block can be; longer values are still cut whole, piece by piece.
MAX_PIECE = 32
#: A keyboard walk costs so much, and one bit for each key; a sequence of neighbouring characters has at most so many.
WALK_BITS, MAX_SEQUENCE = math.log2(47), 128

#: Tokenizer files whose merges, in order of frequency, rank the words beyond COMMON; how each marks a whole word.
RANKED_FILES = (("word_bpe_49k.json", re.compile(r"(.+)</w>")), ("byte_bpe_50k.json", re.compile(r"Ġ(.+)")))
#: Shorter words of the files are left out, and those of just so many letters count only where no letter is beside them:
#: a random value holds one often, and would look cheap.
MIN_WORD = 4

# Common words in guessing order (rank = place), and the rows of a keyboard.
COMMON = """password secret token admin user login welcome changeme change letmein example test default guest
root master qwerty dragon monkey football baseball shadow sunshine princess hello summer winter spring autumn
company public private access key value your this that with from have will would there their about which when
the and for are but not you all any can had her was one our out day get has him his how man new now old see
two way who boy did its let put say she too use none null true false enter here redacted placeholder sample
demo dummy temp string number name data file system server client house world love money happy freedom""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d")

_COMMON = frozenset(COMMON)


@lru_cache(maxsize=1)
def ranked_words() -> dict[str, float]:
    """log2 of the guessing rank of each word: COMMON first, then the whole words of the tokenizer files by their best place in one."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    byte_of = {chr(256 + i): b for i, b in enumerate(odd)} | {chr(b): b for b in range(256) if b not in odd}
    place: dict[str, int] = {}
    for name, whole in RANKED_FILES:
        with open(tokenizer_path(name), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        found: dict[str, int] = {}
        for piece in sorted(vocab, key=vocab.__getitem__):
            if (m := whole.fullmatch(piece)) and all(c in byte_of for c in m[1]):
                word = bytes(byte_of[c] for c in m[1]).decode("utf-8", "replace").lower()
                if len(word) >= MIN_WORD and word.isalpha():
                    found.setdefault(word, len(COMMON) + len(found))
        for word, i in found.items():
            place[word] = min(i, place.get(word, i))
    return {w: math.log2(i + 2) for w, i in place.items()} | {w: math.log2(i + 2) for i, w in enumerate(COMMON)}


_NEAR: dict[str, set[str]] = {}
for _r, _row in enumerate(ROWS):
    for _c, _k in enumerate(_row):
        _NEAR[_k] = {ROWS[r][c] for r in range(max(0, _r - 1), min(4, _r + 2)) for c in range(max(0, _c - 1), _c + 2) if c < len(ROWS[r])} - {_k}


def _brute_bits(ch: str) -> float:
    if ch.isdigit():
        return math.log2(10)
    if ch.isascii() and ch.isalpha():
        return math.log2(26)
    return math.log2(33)


def piece_bits(value: str, i: int, j: int) -> float:
    """log2 guesses of value[i:j] as one piece of any kind but brute force; infinite if it is none."""
    rank = ranked_words()
    low, size, got = value.lower(), j - i, math.inf
    part = low[i:j]
    near = [b in _NEAR.get(a, ()) for a, b in zip(part, part[1:], strict=False)]
    steps = {ord(b) - ord(a) for a, b in zip(part, part[1:], strict=False)}
    if size >= 3 and all(near):
        got = WALK_BITS + size
    if 3 <= size <= MAX_SEQUENCE and steps in ({1}, {-1}):
        got = min(got, math.log2(2 * 36 * size) + 1)
    if size >= 3 and steps == {0}:
        got = min(got, _brute_bits(part[0]) + math.log2(size) + 1)
    if 2 <= size <= MAX_PIECE and i >= size and low[i - size : i] == part:
        got = min(got, 2.0)
    if 2 <= size <= MAX_PIECE:
        word = part.translate(LEET)
        if word in rank and (size > MIN_WORD or word in _COMMON or not (value[i - 1 : i].isalpha() or value[j : j + 1].isalpha())):
            got = min(got, rank[word] + (value[i:j] != part) + (word != part) + 1)
        elif value[i].isdigit() and 4 <= size <= 10 and DATE.fullmatch(value, i, j):
            got = min(got, (math.log2(120) if size == 4 else math.log2(120 * 366)) + 1)
    return got


def _case_bits(value: str) -> float:
    mixed = sum(c.isupper() for c in value)
    return 0.0 if not mixed or mixed == len(value) or (mixed == 1 and value[0].isupper()) else 1.0


@lru_cache(maxsize=5_000)
def guess_bits(value: str) -> float:
    """log2 of the guesses that the cheapest segmentation of value takes; 0 for an empty one.

    Pieces: one character by brute force, or a piece of piece_bits(). Each further piece costs one bit, so that many
    tiny pieces don't beat one fitting piece. The least over all segmentations: every start of every kind of piece is
    tried. Walks cost the same for each further key, so the best open one is carried on. A repeat of one character
    need only begin in the first MAX_PIECE + 1 places of its run: a piece that began before the run ends there, and to
    cut what lies between into pieces costs more than the longer repeat.
    """
    rank = ranked_words()
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    case = _case_bits(value)
    walk = same = up = down = 1  # places of the keyboard walk, repeat and sequences that end here
    open_walk = math.inf  # cheapest segmentation whose last piece is a walk of three keys or more that ends here
    for j in range(1, n + 1):
        c, p = low[j - 1], low[j - 2] if j > 1 else ""
        step = ord(c) - ord(p) if p else 2
        walk = walk + 1 if p and c in _NEAR.get(p, ()) else 1
        same, up, down = same + 1 if step == 0 else 1, up + 1 if step == 1 else 1, down + 1 if step == -1 else 1
        # brute force by one more character
        b = best[j - 1] + _brute_bits(value[j - 1]) + case * value[j - 1].isalpha()
        if walk >= 3:
            open_walk = min(open_walk + 1 if walk > 3 else math.inf, best[j - 3] + WALK_BITS + 3)
            b = min(b, open_walk)
        for k in range(3, min(max(up, down), MAX_SEQUENCE) + 1):
            b = min(b, best[j - k] + math.log2(2 * 36 * k) + 1)
        if same >= 3:
            base = _brute_bits(c) + 1
            for i in range(j - same, min(j - same + MAX_PIECE, j - 3) + 1):
                b = min(b, best[i] + math.log2(j - i) + base)
        for k in range(2, min(MAX_PIECE, j // 2) + 1):  # a block written twice or more
            if low[j - k : j] == low[j - 2 * k : j - k]:
                b = min(b, best[j - k] + 2.0)
        for i in range(max(0, j - MAX_PIECE), j - 1):
            word = plain[i:j]
            if word in rank and (j - i > MIN_WORD or word in _COMMON or not (value[i - 1 : i].isalpha() or value[j : j + 1].isalpha())):
                b = min(b, best[i] + rank[word] + (value[i:j] != low[i:j]) + (word != low[i:j]) + 1)
            elif value[i].isdigit() and 4 <= j - i <= 10 and DATE.fullmatch(value, i, j):
                b = min(b, best[i] + (math.log2(120) if j - i == 4 else math.log2(120 * 366)) + 1)
        best[j] = b
    return best[n]


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points: the base kinds, and "guess" for every costly value, also where a base span covers a part of it."""
    if not text:
        return []
    out = [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if HINT.search(text):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        at = 0
        while m := CONTEXT.search(text, at):
            a, b = m.span(1)
            if b - a >= MIN_VALUE and guess_bits(m[1]) >= MIN_BITS:
                out.append((a, b, "guess"))
            at = a if b - a <= MAX_NAME else b
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, spans array<struct<start, end, kind>>.

    Null and empty texts have no span. Repeated rows give repeated results. Other columns of docs
    are not read, whatever their names. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in slices(batches):
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<start: bigint, end: bigint, kind: string>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    if not text or not (spans := find_spans(text)):
        return text
    out, at = [], 0
    end = -1
    for a, b, _ in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
            at = end = b
        else:
            at = end = max(end, b)
    return "".join(out) + text[at:]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of scan_secrets over the whole texts of documents."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for spans in b.column(1).to_pylist():
                spans = [(s["start"], s["end"], s["kind"]) for s in spans]
                for c, k in zip(cols, KINDS[:3], strict=False):
                    c.append(sum(x[2] == k for x in spans))
                cols[3].append(hashlib.sha256(joined([x for x in spans if x[2] != "guess"]).encode()).hexdigest())
                cols[4].append(joined(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
