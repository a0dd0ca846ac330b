"""Token ids as Parquet list columns, and the word cache that both tokenizing operators share.

Ids are written with dictionary encoding, in row groups and pages of set sizes, with Parquet's page
indexes, in files that are sorted by document: a reader can skip to some documents or columns.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._shared import by_bytes, shared_dir, slices, table

#: The place of the tokenizer files: None asks the public_tokenizers package.
TOKENIZER_DIR: str | None = None
#: Words that one worker remembers; the memory is emptied when full, so it stays bounded.
CACHE_WORDS = 1_000_000
#: Marks that may stand in a run behind letters, and such runs that one worker remembers.
_MARKS, TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 4_096
_ID = attrgetter("id")
#: Bytes of text whose words are told apart together, and words that are learned in one call.
COLUMN_BYTES, BULK_WORDS = 2 << 20, 3_000
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_ASCII_SPACES = [c for c in _OTHER_SPACES if c.isascii()]
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
#: Documents that one output file holds, about.
DOCS_PER_FILE = 8_000
FILES_PER_BLOCK = 4_096


def tokenizer_path(name: str, folder: str | None = TOKENIZER_DIR) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(words: pa.Array) -> str:
    """Words with a space between them."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py()


def _strings(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings, in a fraction of to_pylist()'s time."""
    return _joined(words).split(" ") if len(words) else []


def _lists(found: list[bytes]) -> pa.LargeListArray:
    """Packed ids as lists."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(np.frombuffer(b"".join(found), "<i4")))


class Memory(dict):
    """Words and their ids; one that is asked for and lacks is learned."""

    def __init__(self, tokenizer: CachedTokenizer):
        super().__init__()
        self.learn = tokenizer.learn

    def __missing__(self, w: str) -> bytes:
        got = self[w] = self.learn(w)
        return got


class CachedTokenizer:
    """encode_all() of one tokenizer file, word by word with a bounded memory.

    Both kinds of files cut a text before each single space between other characters, so the ids of
    such a text are those of its words one after another; a single line feed is kept in front of its
    word. Texts with other white space beside either, or with the literal of an added token such as
    "<|endoftext|>", go to the tokenizer whole. A word of letters is one piece for the merge table and goes
    straight to it; a run of ASCII marks behind it is another, whose ids are remembered by themselves.
    encode_column() gives the same ids of many texts at once, for less.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # texts with an added token's literal go whole; its first two characters stand in, as no normalizer makes them from others
        self.literals = tuple({t.content[:2] for t in self.tok.get_added_tokens_decoder().values()})
        self.model = self.tok.model
        self.spaced = self._ids("a b") != self._ids("a") + self._ids("b")  # a leading space belongs to the word
        # byte-level pieces write byte b as one character: itself if printable, else 256 and on
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.byte_chars = {b: 256 + i for i, b in enumerate(odd)}
        self.byte_table = "".join(chr(self.byte_chars.get(b, b)) for b in range(256))
        self.tails: dict[str, bytes] = {}  # the ids of marks behind letters
        self.lead = chr(self.byte_chars[32]) if self.spaced else ""
        self.feed = self._pack(self._ids("\n")) if self.spaced else b""
        self.most = CACHE_WORDS
        self.bulk = None  # the merge table behind a cut before each space, made when first needed
        self.memo = Memory(self)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _letters(self, w: str, lead: str) -> bytes:
        """The ids of a word of letters by the merge table alone; lead: the character of a space before it, or none."""
        if not w.isascii():
            if max(w) >= "\u0250":
                return self._pack(self._ids(" " + w if lead else w))
            if not self.spaced:
                w = unicodedata.normalize("NFC", w).lower()
                if not w.isalpha():
                    return self._pack(self._ids(w))
            w = w.encode().decode("latin-1").translate(self.byte_chars)
        elif not self.spaced:
            w = w.lower()
        return array("I", list(map(_ID, self.model.tokenize(lead + w)))).tobytes()

    def _stays(self, w: str) -> bool:
        """Whether w is of letters in which a normalizer leaves nothing that could join the marks behind."""
        return w.isalpha() and (w.isascii() or max(w) < "\u0250" and (self.spaced or unicodedata.normalize("NFC", w).lower().isalpha()))

    def _tail(self, marks: str) -> bytes:
        """The ids of a run of marks behind letters, which is a piece of its own."""
        if not marks:
            return b""
        got = self.tails.get(marks)
        if got is None:
            got = self._pack(self._ids("a" + marks)[len(self._ids("a")) :])
            if len(self.tails) < TAILS:
                self.tails[marks] = got
        return got

    def learn(self, w: str) -> bytes:
        """The ids of a word behind a space (or with its own line feed in front)."""
        if w.isalpha():
            return self._letters(w, self.lead)
        core = w.rstrip(_MARKS)
        if core[:1] != "\n":
            if self._stays(core):
                return (self.memo.get(core) or self._letters(core, self.lead)) + self._tail(w[len(core) :])
        elif self._stays(core[1:]) or core == w and core[1:].isalpha():
            return self.feed + self._letters(core[1:], "") + self._tail(w[len(core) :])
        return self._pack(self._ids(" " + w if self.spaced and w[:1] != "\n" else w))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as unsigned 32-bit integers in the machine's order, which is little-endian."""
        out, join = [], b"".join
        for t in texts:
            if not t:
                out.append(b"")
            elif self._uneven(t) or any(x in t for x in self.literals):
                out.append(self._pack(self._ids(t)))
            else:
                if len(self.memo) > self.most:
                    self.memo.clear()
                get = self.memo.__getitem__
                if self.spaced:
                    parts = t.replace("\n", " \n").split(" ")
                    out.append(self._pack(self._ids(parts[0])) + join(map(get, parts[1:])))
                else:
                    out.append(join(map(get, t.replace("\n", " ").split(" "))))
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Where each text's words begin among all, the number of each word, and the distinct words."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.spaced else " "), " ")
        coded = cut.values.dictionary_encode()
        return cut.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy(), coded.dictionary

    def _parts(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """The ids of distinct parts of words, and each word's two parts by number: itself or its letters, and no or the marks behind them.
        Only the first kind is remembered among words, so letters are learned once whatever marks come behind."""
        n, core = len(words), pc.ascii_rtrim(words, characters=_MARKS)
        behind = pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy()
        marked = np.flatnonzero(behind)
        stays = [c.isascii() and c.isalpha() or self._stays(c.removeprefix("\n")) for c in _strings(core.take(pa.array(marked)))]
        marked = marked[np.array(stays, dtype=bool)]
        pick = np.arange(n)
        pick[marked] += n
        coded = pa.concat_arrays([words, core]).take(pa.array(pick)).dictionary_encode()
        found = self._known(_strings(coded.dictionary))
        tails = [w[-k:] for w, k in zip(_strings(words.take(pa.array(marked))), behind[marked].tolist(), strict=True)]
        number = {"": len(found)} | {t: i for i, t in enumerate(dict.fromkeys(tails), len(found) + 1)}
        tail = np.full(n, len(found))
        tail[marked] = [number[t] for t in tails]
        return found + [self._tail(t) for t in number], np.column_stack([coded.indices.to_numpy(), tail])

    def _known(self, names: list[str]) -> list[bytes]:
        """The ids of distinct words behind a space (or with their own line feed in front); those that the memory lacks are learned,
        words of letters many at a time."""
        if len(self.memo) > self.most:
            self.memo.clear()
        found = list(map(self.memo.get, names))
        new = [i for i, ids in enumerate(found) if ids is None]
        if self.spaced:
            letters = [w for w in map(names.__getitem__, new) if w.isalpha() and (w.isascii() or max(w) < "\u0250")]
            for k in range(0, len(letters), BULK_WORDS):
                self._learn_letters(letters[k : k + BULK_WORDS])
        for i in new:
            found[i] = self.memo[names[i]]
        return found

    def _learn_letters(self, words: list[str]) -> None:
        """Learn words of letters below U+0250 behind a space. Their bytes' characters go to the merge table in one call, cut before each
        space's character, which only begins a word: so do just those ids whose tokens begin with it."""
        if self.bulk is None:
            from tokenizers import Tokenizer, pre_tokenizers

            self.bulk = Tokenizer(self.model)
            self.bulk.pre_tokenizer = pre_tokenizers.Metaspace(self.lead, "never", True)
            vocab = self.tok.get_vocab()
            self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.begins[[i for t, i in vocab.items() if t.startswith(self.lead)]] = True
        chars = charmap_decode(f" {' '.join(words)}".encode(), "strict", self.byte_table)[0]
        ids = np.array(self.bulk.encode_batch_fast([chars], add_special_tokens=False)[0].ids, dtype="<u4")
        at, raw = np.append(np.flatnonzero(self.begins[ids]) * 4, len(ids) * 4).tolist(), ids.tobytes()
        self.memo.update(zip(words, (raw[a:e] for a, e in zip(at[:-1], at[1:], strict=True)), strict=True))

    def encode_column(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text (null: none) and end_id behind them. Arrow cuts the words and tells them apart, so each distinct
        word of the column is looked up once; then the ids of the words are put together by their numbers."""
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        plain, apart = texts.cast(pa.large_string()), {}
        at, which, words = self._cut(plain.fill_null(""))
        if self._odd(words):  # texts without words, and those that go to the tokenizer whole: one word stands in
            rows = texts.to_pylist()
            for i, t in enumerate(rows):
                if not t or self._uneven(t) or any(x in t for x in self.literals):
                    apart[i], rows[i] = self._pack(self._ids(t)) if t else b"", "a"
            at, which, words = self._cut(pa.array(rows, pa.large_string()))
        found, parts = self._parts(words)
        # nothing stands before a text's first word, so its ids aren't those of the memory
        first = _strings(words.take(pa.array(which[at[:-1]])))
        heads = [apart[i] if i in apart else self._pack(self._ids(w)) for i, w in enumerate(first)]
        n, ends = len(words), self._pack([end_id])
        both = _lists(found).take(pa.array(parts.ravel()))
        sizes = np.concatenate([np.diff(both.offsets.to_numpy()[::2]), [len(x) // 4 for x in heads], [1]])
        flat = np.concatenate([both.flatten().to_numpy(), np.frombuffer(b"".join(heads) + ends, "<i4")])
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))
        which = which.copy()
        which[at[:-1]] = np.arange(n, n + len(texts))
        which = np.insert(which, at[1:], n + len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes[which])])[at + np.arange(len(at))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists.take(pa.array(which)).flatten())

    def _odd(self, words: pa.Array) -> bool:
        """Whether, by its distinct words, some text of a column may have to go whole: an empty word, a line feed alone, other white space or a literal."""
        text = f" {_joined(words)} "
        if "  " in text or "\n " in text or any(x in text or any(map(str.isspace, x)) for x in self.literals):
            return True
        return any(c in text for c in (_ASCII_SPACES if text.isascii() else _OTHER_SPACES))

    @staticmethod
    def _uneven(text: str) -> bool:
        """Whether white space other than single spaces and line feeds, or any at an end or beside another, makes the cuts differ."""
        if text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return True
        return any(c in text for c in (_ASCII_SPACES if text.isascii() else _OTHER_SPACES))


_LOADED: dict[str, CachedTokenizer] = {}


def loaded(path: str) -> CachedTokenizer:
    """One tokenizer for each file and worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the ids of each whole text (null: empty) and end_id behind them; row for row, in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        for b in by_bytes(batches, "text", COLUMN_BYTES):
            yield from slices([pa.RecordBatch.from_arrays([b.column(0), tok.encode_column(b.column(1), end_id)], ["id", "ids"])])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = DOCS_PER_FILE) -> None:
    """Write id, n_tokens, ids in ascending order of id, then of the text's hash: files cover ranges of both and are sorted inside.

    Rows of one id may fill any number of files; only rows that are equal stay in one. Null ids come first.
    """
    n = docs.count()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h"))
    parts = max(1, -(-n // docs_per_file))
    ordered = rows.repartitionByRange(parts, "doc_id", "h") if parts > 1 else rows.coalesce(1)
    ids = tokenize(ordered.sortWithinPartitions("doc_id", "h", "text"), tokenizer, end_id)
    out = ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
    writer = out.write.option("parquet.enable.dictionary", "true").option("parquet.block.size", str(ROW_GROUP_BYTES)).option("maxRecordsPerFile", 0)
    writer.option("parquet.page.size", str(PAGE_BYTES)).option("parquet.page.row.count.limit", str(PAGE_ROWS)).option("parquet.dictionary.page.size", str(1 << 20)).option("compression", "snappy").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of the files, and each row's place: file (its number in the order of ids) and row."""
    files = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-([0-9]+)", 1).cast("bigint")
    return files.select("doc_id", "n_tokens", "ids", number.alias("file"), F.col("_metadata.row_index").alias("row"))


def file_starts(files: DataFrame) -> DataFrame:
    """file, before: the ids in all files before each. Sums of blocks of files are added up first, then those within a block,
    so no task sees more than FILES_PER_BLOCK rows or one for each block."""
    per = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("file") / FILES_PER_BLOCK))
    blocks = per.groupBy("block").agg(F.sum("n").alias("n"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select("file", (F.col("base") + F.col("own")).alias("before"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest, from the files: start of each document among all ids in order, its size, crc32 of its ids.

    Starts add the sizes of the files before to those of the documents before in the same file; a file holds about
    DOCS_PER_FILE rows. A null id or text, ties and repeated rows keep their own rows; an empty table gives an empty one.
    """
    at = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), at, tokenizer_path("byte_bpe_50k.json"), 0)
    files = read_token_files(spark, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, cut = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = flat.view("<u4")
            crc = [zlib.crc32(raw[a:e]) for a, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64()), b.column(3), b.column(4)], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    # a file may be read in several splits, by row groups: places inside a file come from its own sizes column
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    digest = files.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file bigint, row bigint").withColumn("inside", F.coalesce(inside, F.lit(0)))
    out = digest.join(file_starts(files.select("file", "n_tokens")), "file")
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
