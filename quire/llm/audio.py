"""Media columns: telephony audio.

mu-law and A-law samples expand by 256-entry tables; ADPCM blocks of one size decode side by side,
one numpy step for each sample place over all blocks; PCM is resampled by a low-pass filter with a phase for
each place between samples. A payload is stored losslessly as the 8-bit mu-law samples of a WAV file, beside its PCM;
many of them share a block, in which media, high bytes and low bytes of the PCM are compressed apart, and copies of a
text share what is stored.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm import bitmap
from quire.llm._shared import by_bytes, forget, slices, stored, table

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000
UNIT = 64
#: The rate of the PCM that the query stores, and the lobes on each side of the resampling filter.
STORED_RATE, LOBES = 4000, 6
#: Bytes of media and PCM in a block, and of the media that are read from one at a time.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 1 << 20


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    e, m = (u >> 4) & 7, u & 15
    x = (((m.astype(np.int32) << 3) + 132) << e.astype(np.int32)) - 132
    return np.where(u & 128, -x, x).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    e, m = ((a >> 4) & 7).astype(np.int32), (a & 15).astype(np.int32)
    x = np.where(e == 0, (m << 4) + 8, ((m << 4) + 264) << np.maximum(e - 1, 0))
    return np.where(a & 128, x, -x).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()
# Index changes and step growth of the IMA ADPCM format; its steps grow by about a tenth.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: (n, size) bytes to (n, 1 + 2 * (size - 4)) samples, all blocks at once."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), dtype=np.int16)  # a row for each place, so that a step writes straight on
    pred = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = pred
    for k in range(2 * (size - 4)):
        code = (body[k >> 1] >> 4) if k & 1 else (body[k >> 1] & 15)
        step = IMA_STEPS[index]
        diff = (step * (2 * (code & 7).astype(np.int32) + 1)) >> 3
        pred = np.clip(np.where(code & 8, pred - diff, pred + diff), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[k + 1] = pred
    return out.T


@lru_cache(maxsize=16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """Taps of the low-pass filter for each of the `up` phases, as integers that add up to 2**14 (sums of products
    with samples stay within 32 bits), and the taps before the centre.

    A windowed sinc that cuts at nine tenths of the lower of the two half rates.
    """
    wide = max(1.0, down / up)
    half = int(np.ceil(LOBES * wide))
    k = np.arange(-half + 1, half + 1)
    taps = []
    for p in range(up):
        t = (k - p / up) / wide
        h = 0.9 * np.sinc(0.9 * t) * np.where(np.abs(t) < LOBES, 0.5 + 0.5 * np.cos(np.pi * t / LOBES), 0)
        whole = np.floor(h / h.sum() * (1 << 14) + 0.5).astype(np.int64)
        whole[half - 1] += (1 << 14) - whole.sum()
        taps.append(whole)
    return np.array(taps), half - 1


def resample_all(pcm: np.ndarray, sizes: np.ndarray, src: int, dst: int) -> tuple[np.ndarray, np.ndarray]:
    """Signals one after another to a new rate, each by itself, low-passed; their samples and sizes.

    A signal keeps its first sample's time; beyond its ends it is silent. Sums are of integers, so that equal signals
    give equal samples whatever stands beside them. An empty signal stays empty.
    """
    if src == dst or not len(pcm):
        return pcm.astype(np.int16), sizes
    g = int(np.gcd(src, dst))
    up, down = dst // g, src // g
    taps, before = _phases(up, down)
    n = np.where(sizes > 0, np.maximum(1, sizes * up // down), 0)
    width = taps.shape[1]
    slots = -(-(sizes + width) // down) * down  # silence behind each signal; all begin at a multiple of the step
    first = np.concatenate([[0], np.cumsum(slots)[:-1]])
    flat = np.zeros(int(slots.sum()) + 2 * width + down, dtype=np.int32)
    flat[np.arange(len(pcm)) + np.repeat(before + first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] = pcm
    k = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    if up == 1:  # one phase: every step-th place of the whole run, then those that are wanted
        whole = np.zeros(int(slots.sum()) // down, dtype=np.int32)
        for j in range(width):
            whole += taps[0, j].astype(np.int32) * flat[j : j + len(whole) * down : down]
        total = whole[k + np.repeat(first // down, n)]
    else:
        at, phase = k * down // up + np.repeat(first, n), k * down % up
        total = np.zeros(len(k), dtype=np.int32)
        for j in range(width):
            total += taps[phase, j].astype(np.int32) * flat[at + j]
    return np.clip((total + (1 << 13)) >> 14, -32768, 32767).astype(np.int16), n


def resample(pcm: np.ndarray, src: int, dst: int) -> np.ndarray:
    """One signal to a new rate, low-passed."""
    return resample_all(pcm, np.array([len(pcm)]), src, dst)[0]


def wav(data: bytes, form: int, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono WAV file. Formats other than PCM have the size of their format's extension and a fact chunk with the number of samples."""
    per_block = 1 + 2 * (align - 4)
    fmt = struct.pack("<HHIIHH", form, 1, rate, rate * align // per_block if form == IMA else rate * align, align, bits)
    if form == PCM:
        head = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    else:
        fmt += struct.pack("<HH", 2, per_block) if form == IMA else struct.pack("<H", 0)
        head = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) // align * per_block if form == IMA else len(data))
    body = head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format, rate, block size and the sample bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, rate, align, data = 12, 0, 0, 1, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return form, rate, align, data


def samples(form: int, rate: int, align: int, data: bytes) -> np.ndarray:
    """The PCM samples of mu-law, A-law, IMA ADPCM, 8-bit or 16-bit sample bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if form == MULAW:
        return MULAW_TABLE[raw]
    if form == ALAW:
        return ALAW_TABLE[raw]
    if form == IMA:
        whole = len(raw) // align * align
        return decode_ima(raw[:whole].reshape(-1, align)).reshape(-1)
    if align == 2:
        return np.frombuffer(data[: len(data) // 2 * 2], dtype="<i2")
    return ((raw.astype(np.int16) - 128) << 8).astype(np.int16)


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """PCM samples and rate of a WAV file."""
    form, rate, align, data = read_wav(media)
    return samples(form, rate, align, data), rate


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, ..) as (id, n_bytes, media, ..)."""
    for b in slices(batches):
        data = [(t or "").encode() for t in b.column(1).to_pylist()]
        media = [wav(x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)), MULAW) for x in data]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary()), *b.columns[2:]], ["id", "n_bytes", "media", *b.schema.names[2:]])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a mu-law WAV.

    Null and empty texts give 64 zero bytes. Equal texts give equal media. Only the two columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_encoded, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def decode_all(media: list[bytes], rate: int) -> tuple[list[bytes], list[bytes]]:
    """The sample bytes of each WAV file, and its signal at the new rate as little-endian 16-bit PCM; files of one rate are resampled together."""
    raw = [read_wav(m) for m in media]
    out = [b""] * len(media)
    by: dict[int, list[int]] = {}
    for i, (_, src, _, _) in enumerate(raw):
        by.setdefault(src, []).append(i)
    for src, own in by.items():
        signals = [samples(*raw[i]) for i in own]
        got, n = resample_all(np.concatenate(signals), np.array([len(x) for x in signals]), src, rate)
        data, end = got.astype("<i2").tobytes(), 2 * np.cumsum(n)
        for i, a, e in zip(own, np.concatenate([[0], end[:-1]]).tolist(), end.tolist(), strict=True):
            out[i] = data[a:e]
    return [x[3] for x in raw], out


def _with_pcm(batches: Iterator[pa.RecordBatch], column: str, rate: int) -> Iterator[pa.RecordBatch]:
    """The rows with pcm_rate and pcm behind their columns."""
    for b in by_bytes(batches, column, 1 << 19):
        values = b.column(b.schema.get_field_index(column)).to_pylist()
        some = [i for i, m in enumerate(values) if m is not None]
        out: list[bytes | None] = [None] * len(values)
        if some:
            for i, x in zip(some, decode_all([values[i] for i in some], rate)[1], strict=True):
                out[i] = x
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([rate] * b.num_rows, pa.int32()), pa.array(out, pa.binary())], [*b.schema.names, "pcm_rate", "pcm"])


def pcm_column(media: DataFrame, rate: int = 16000, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The rows with pcm_rate and pcm behind their columns: each media value decoded, resampled and as little-endian 16-bit PCM; a null value stays null."""
    return media.mapInArrow(lambda batches: _with_pcm(batches, media_col, rate), StructType(list(media.schema.fields)).add("pcm_rate", "integer").add("pcm", "binary"))


def _alike(media: list[bytes]) -> np.ndarray:
    """An order that brings media of like bytes together: along the axis on which shares of the bytes' last five bits differ most."""
    count = np.array([np.bincount(np.frombuffer(m, dtype=np.uint8) & 31, minlength=32) for m in media], dtype=np.float64)
    share = np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True)))
    share -= share.mean(axis=0)
    return np.argsort(share @ np.linalg.eigh(share.T @ share)[1][:, -1], kind="stable")


def _block(rows: list[pa.RecordBatch], copied: bool) -> pa.RecordBatch:
    """One row that holds all the rows, those with like media side by side. The PCM's high bytes follow the words' lengths and
    compress well, its low ones only where a passage comes again; so they lie apart, the latter with the codec of the longer window."""
    t = pa.Table.from_batches(rows)
    t = t.take(pa.array(_alike(t.column("media").to_pylist()))).combine_chunks()
    sizes = [pc.binary_length(t.column(c)).cast(pa.int64()) for c in ("media", "pcm")]
    pcm = np.frombuffer(b"".join(t.column("pcm").to_pylist()), dtype=np.uint8)
    lists = [x.combine_chunks() for x in (t.column("id"), t.column("n_bytes"), t.column("key"), *sizes, t.column("pcm_rate"))]
    blobs = [bz2.compress(b"".join(t.column("media").to_pylist())), bz2.compress(pcm[1::2].tobytes()), pa.Codec("zstd", 9).compress(pcm[::2].tobytes(), asbytes=True)]
    cols = [pa.array([copied]), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], *[pa.array([x], pa.binary()) for x in blobs]]
    return pa.RecordBatch.from_arrays(cols, ["copied", "id", "n_bytes", "key", "media_size", "pcm_size", "pcm_rate", "media", "pcm_high", "pcm_low"])


def _packed(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_bytes, media, key, pcm_rate, pcm) in blocks; those with a key, which stand for copies, have blocks of their own."""
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}
    for b in batches:
        for copied in held:
            part = b.filter(pc.is_valid(b.column(3)) if copied else pc.is_null(b.column(3)))
            if part.num_rows:
                held[copied].append(part)
                size[copied] += part.nbytes
            if size[copied] >= limit:
                yield _block(held[copied], copied)
                held[copied], size[copied] = [], 0
    for copied, rows in held.items():
        if rows:
            yield _block(rows, copied)


def _unpacked(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks, byte for byte what _packed was given."""
    for b in batches:
        for i in range(b.num_rows):
            ids, n_bytes, keys, media_size, pcm_size, rates = (b.column(c)[i].values for c in ("id", "n_bytes", "key", "media_size", "pcm_size", "pcm_rate"))
            ends, pcm_ends = (np.concatenate([[0], np.cumsum(x.to_numpy())]) for x in (media_size, pcm_size))
            media = bz2.decompress(b.column("media")[i].as_py())
            both = np.empty(int(pcm_ends[-1]), dtype=np.uint8)
            both[1::2] = np.frombuffer(bz2.decompress(b.column("pcm_high")[i].as_py()), dtype=np.uint8)
            both[::2] = np.frombuffer(pa.Codec("zstd").decompress(b.column("pcm_low")[i].as_py(), len(both) // 2, asbytes=True), dtype=np.uint8)
            pcm, at = both.tobytes(), 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
                cut = [pa.array([x[e[k] : e[k + 1]] for k in range(at, to)], pa.binary()) for x, e in ((media, ends), (pcm, pcm_ends))]
                yield pa.RecordBatch.from_arrays([*[x.slice(at, to - at) for x in (ids, n_bytes)], cut[0], keys.slice(at, to - at), rates.slice(at, to - at), cut[1]], ["id", "n_bytes", "media", "key", "pcm_rate", "pcm"])
                at = to


def store_media(docs: DataFrame, rate: int = STORED_RATE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Every text as mu-law media and its signal at the rate as PCM, in blocks in the shared folder. Copies of a text share what is stored.

    The blocks (of rows id, n_bytes, media, key, pcm_rate, pcm: see read_media) and, where texts may repeat, a table (id, key) of
    the rows that are stored under a key: their text's sha256, first half. A text without a copy is stored with its id
    and a null key. Texts don't travel: bitmaps tell which may have copies and which row of them is written, that with
    the least id; too full a bitmap only stores more rows than need be. Null and empty texts are copies.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(docs[id_col].alias("id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"))
    repeated = stored(keyed.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-texts")
    n, members, first = repeated.count(), None, None
    shared = spark.sparkContext.broadcast(bitmap.build(repeated, n)) if n else None
    forget(repeated)
    if n:

        def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(bitmap.contains(shared.value, b.column(2).to_numpy()))).select([0, 1])

        members = stored(keyed.select("id", "key", F.xxhash64("text").alias("h")).mapInArrow(among, f"id {kind}, key binary"), "copies")
        heads = members.groupBy("key").agg(F.min("id").alias("id")).select(F.xxhash64("key", "id"))
        first = spark.sparkContext.broadcast(bitmap.build(heads, members.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not n:
                    yield b.set_column(2, "key", pa.nulls(b.num_rows, pa.binary())).select([0, 1, 2])
                    continue
                copied = bitmap.contains(shared.value, b.column(3).to_numpy())
                key = pc.if_else(pa.array(copied), b.column(2), pa.scalar(None, b.schema.field(2).type))
                yield b.set_column(2, "key", key).select([0, 1, 2]).filter(pa.array(~copied | bitmap.contains(first.value, b.column(4).to_numpy())))

        yield from _packed(_with_pcm(_encoded(wanted()), "media", rate))

    rows = keyed.select("id", "text", "key", F.xxhash64("text").alias("h"), F.xxhash64("key", "id").alias("own"))
    shape = f"copied boolean, id array<{kind}>, n_bytes array<bigint>, key array<binary>, media_size array<bigint>, pcm_size array<bigint>, pcm_rate array<int>, media binary, pcm_high binary, pcm_low binary"
    # rows are large: the writer must look at its sizes after each
    sizes = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
    return stored(rows.mapInArrow(run, shape), "telephony", "zstd", **sizes), members


def read_media(blocks: DataFrame) -> DataFrame:
    """The rows id, n_bytes, media, key, pcm_rate, pcm of stored blocks; not for each row of the input, but for each text that was stored."""
    kind = blocks.schema["id"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_unpacked, f"id {kind}, n_bytes bigint, media binary, key binary, pcm_rate int, pcm binary")


def features(payloads: list[bytes]) -> list[str]:
    """Loudness, peak and sign changes of each payload heard as mu-law, as A-law and as ADPCM blocks of 64 bytes.

    The samples of all payloads are worked on together; each payload must be a positive multiple of 64 bytes.
    """
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    size = np.array([len(p) for p in payloads])
    per_block = 1 + 2 * (UNIT - 4)
    parts = []
    for name, pcm, n in (("mu", MULAW_TABLE[raw], size), ("a", ALAW_TABLE[raw], size), ("ima", decode_ima(raw.reshape(-1, UNIT)).reshape(-1), size // UNIT * per_block)):
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        wide = pcm.astype(np.int32)
        power = np.add.reduceat(wide * wide, first, dtype=np.int64) // n
        peak = np.maximum.reduceat(np.abs(wide), first)
        flips = np.zeros(len(wide), dtype=bool)
        flips[1:] = (wide[1:] < 0) != (wide[:-1] < 0)
        flips[first] = False
        parts.append([f"{name}:{x}:{y}:{z}" for x, y, z in zip(power, peak, np.add.reduceat(flips, first, dtype=np.int64), strict=True)])
    return ["|".join(x) for x in zip(*parts, strict=True)]


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: every text is written as mu-law media, with its signal resampled to STORED_RATE as PCM beside it,
    to Parquet in the shared folder; both are read back from there, and the feature's last part is the stored PCM's checksum.

    Copies of a text share the media they are read from. Null and empty texts are 64 zero bytes; repeated rows give repeated
    results; an empty table gives an empty one.
    """
    blocks, members = store_media(table(spark, sf_dir, "documents"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in _unpacked(batches):
            media, pcm = b.column(2).to_pylist(), b.column(5).to_pylist()
            payloads = [read_wav(m)[3] for m in media]
            rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f"{f}|pcm:{len(x) // 2}:{zlib.crc32(x)}") for p, m, f, x in zip(payloads, media, features(payloads), pcm, strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), *cols], ["doc_id", "key", *names])

    shape = "doc_id bigint, key binary, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    alone = blocks.filter("not copied").mapInArrow(run, shape).select("doc_id", *names)
    if members is None:
        return alone
    shared = blocks.filter("copied").mapInArrow(run, shape).drop("doc_id").dropDuplicates(["key"])
    return alone.unionByName(members.withColumnRenamed("id", "doc_id").join(shared, "key").select("doc_id", *names))
