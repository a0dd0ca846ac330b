import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.packing import cut_document, difference, op5_packing, pack, pack_documents
from quire.llm.tokens import CachedTokenizer, op6_token_ids, tokenize, tokenizer_path

BIG = 9007199254740993  # 2**53 + 1: a float would lose it
TOKS = {f: CachedTokenizer(tokenizer_path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}
TEXT = st.lists(st.sampled_from(["a", "The", "don't", "é", "É", "é", " ", "  ", "\n", ",", ".", "x1", "0", "００", "\t", "　", "\xa0", "ß", "İ", "Σ", "ΑΣ", "ǅ", "<|endoftext|>", "-", "'s", "日本", "\x1c", "word.\nNext", "😀"]), max_size=25).map("".join)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_cached_ids_equal_the_library(text):
    for t in TOKS.values():
        assert t.encode_all([text]) == [np.array(FRESH[next(f for f in TOKS if TOKS[f] is t)].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


FRESH = {f: Tokenizer.from_file(tokenizer_path(f)) for f in TOKS}


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_cached_ids_equal_a_fresh_tokenizer(text):
    for f, t in TOKS.items():
        for x in (text, f"{text}<|endoftext|>{text}", f"a <|startoftext|> {text}<|ENDOFTEXT|>"):
            assert t.encode_all([x]) == [np.array(FRESH[f].encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_marks_behind_letters():
    """A normalizer can leave a combining mark that joins the marks behind it ("İ" lower-cased)."""
    words = ["a", "été", "İ", "ß", "ǅ", "日本", "ÀÉ", "don't", "e\u0301"]
    for f, t in TOKS.items():
        for text in (f"x {w}{tail} y\n{w}{tail} {w}" for w in words for tail in ("", ".", ",", "$$$", ".&&&", "]!", "'", "'.", "-")):
            assert t.encode_all([text]) == [np.array(FRESH[f].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]


@given(st.lists(st.one_of(st.none(), TEXT, st.text("ab.,! \nÀ", max_size=12)), max_size=8), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_ids_of_a_column_equal_the_library(texts, skip):
    for f, t in TOKS.items():
        got = t.encode_column(pa.array(texts, pa.string())[skip:], 5)
        assert got.to_pylist() == [FRESH[f].encode(x or "", add_special_tokens=False).ids + [5] for x in texts[skip:]]


def test_a_column_learns_letters_once():
    """Letters are learned once, whatever marks come behind, and words that the memory holds aren't learned again."""
    for f in TOKS:
        t, text = CachedTokenizer(tokenizer_path(f)), "x zarglon zarglon. zarglon! éturi\nzarglon, éturi, 3-4, zarglon. --"
        got = t.encode_column(pa.array([text, None, text, ""]), 5).to_pylist()
        ids = FRESH[f].encode(text, add_special_tokens=False).ids
        assert got == [ids + [5], [5], ids + [5], [5]]
        assert not [w for w in t.memo if w.rstrip(".,!") != w and w.rstrip(".,!").strip("\n").isalpha()]
        t.learn = t.bulk = None
        t.memo.learn = None
        assert t.encode_column(pa.array([text]), 5).to_pylist() == [ids + [5]]


def test_literals_of_added_tokens_are_their_ids():
    assert 50256 in np.frombuffer(TOKS["byte_bpe_50k.json"].encode_all(["a<|endoftext|>b c"])[0], "<u4")
    assert 49407 in np.frombuffer(TOKS["word_bpe_49k.json"].encode_all(["a<|endoftext|>b c"])[0], "<u4")


def plain(text, f, end):
    return np.array(FRESH[f].encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@given(st.lists(st.integers(1, 2047), max_size=120))
@settings(max_examples=60, deadline=None)
def test_pack_is_a_partition_within_capacity(sizes):
    got = pack(sizes)
    assert sorted(i for g in got for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 2048 for g in got)


def plain_difference(sizes, m):
    """Multiway differencing with all m windows of every partial partition."""
    parts = [(s, i, [0] * (m - 1) + [s]) for i, s in enumerate(sizes)]
    tie = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        a, b = parts.pop(0), parts.pop(0)
        sums = sorted(x + y for x, y in zip(a[2], reversed(b[2]), strict=True))
        parts.append((sums[-1] - sums[0], tie, sums))
        tie += 1
    return parts[0][2]


@given(st.lists(st.integers(1, 512), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_differencing_equals_the_plain_form(sizes, m):
    got = sorted(sum(sizes[i] for i in g) for g in difference(sizes, m))
    assert [x for x in got if x] == [x for x in plain_difference(sizes, m) if x]


def test_big_ids_beside_null_ids(spark, odd, write):
    more = spark.createDataFrame([(BIG, "a b", "en", "a", 3), (BIG + 1, "a <|endoftext|> b", "en", "a", 3), (None, None, None, None, None)], odd.schema)
    at = write(documents=odd.unionByName(more))
    assert {BIG, BIG + 1, None} <= {r.doc_id for r in op5_packing(spark, at).collect()}
    assert {BIG, BIG + 1, None} <= {r.doc_id for r in op6_token_ids(spark, at).collect()}


def test_cut_document():
    for n in (1, 511, 512, 513, 2047, 2048, 2049, 10000):
        got = cut_document(n)
        assert sum(k for _, k in got) == n and all(k == 2048 or k <= 512 for _, k in got)
        assert [a for a, _ in got] == list(np.cumsum([0] + [k for _, k in got[:-1]]))


def check_pieces(rows, texts):
    ids = {}
    for d, t in texts:
        ids.setdefault(d, plain(t, "word_bpe_49k.json", 1))
    seen = {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    return seen


def test_packing_query(spark, odd, none, clashing, write):
    rows = op5_packing(spark, write(documents=odd)).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check_pieces(rows, texts)
    assert sum(r.length for r in rows) == sum(len(plain(t, "word_bpe_49k.json", 1)) for _, t in texts)
    path = tokenizer_path("word_bpe_49k.json")
    assert pack_documents(none, path, 1).collect() == []
    assert pack_documents(clashing, path, 1).count() == len(rows)


def test_little_padding(spark, sf_dir):
    rows = op5_packing(spark, sf_dir).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    seen = check_pieces(rows, texts)
    assert sum(r.length for r in rows) >= 0.97 * 2048 * len(seen)


def test_token_files(spark, odd, none, clashing, write):
    got = sorted(op6_token_ids(spark, write(documents=odd)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is not None, x or 0))
    at = 0
    by = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        ids = plain(by[r.doc_id], "byte_bpe_50k.json", 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = tokenizer_path("byte_bpe_50k.json")
    assert tokenize(none, path, 0).collect() == [] and tokenize(clashing, path, 0).count() == 14


def test_many_files(spark, sf_dir, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.unionByName(docs.withColumn("doc_id", F.lit(7).cast("bigint")))  # half of all rows bear one id
    monkeypatch.setattr(tokens, "FILES_PER_BLOCK", 3)
    at = str(tmp_path / "files")
    tokens.write_token_files(rows, at, tokenizer_path("byte_bpe_50k.json"), 0, docs_per_file=20)
    files = tokens.read_token_files(spark, at)
    got = files.join(tokens.file_starts(files.select("file", "n_tokens")), "file").select("doc_id", "n_tokens", "file", "row", "before").collect()
    assert len({r.file for r in got}) > 10 and max(sum(r.file == f for r in got) for f in {r.file for r in got}) < 100
    at_id, last = 0, None
    for r in sorted(got, key=lambda r: (r.file, r.row)):
        assert r.row or r.before == at_id
        assert last is None or r.doc_id >= last
        at_id, last = at_id + r.n_tokens, r.doc_id


def test_token_files_of_an_empty_table(spark, none, write):
    assert op6_token_ids(spark, write(documents=none)).collect() == []
