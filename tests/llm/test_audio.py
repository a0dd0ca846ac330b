import hashlib
import math
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import audio, bitmap
from quire.llm._shared import shared_dir
from quire.llm.audio import ALAW, ALAW_TABLE, IMA, IMA_INDEX, IMA_STEPS, LOBES, MULAW, MULAW_TABLE, PCM, STORED_RATE, decode, decode_ima, encode_media, op9_telephony, pcm_column, read_wav, resample, resample_all, wav


def test_tables():
    assert MULAW_TABLE[0xFF] == 0 and MULAW_TABLE[0x00] == -32124 and MULAW_TABLE[0x80] == 32124
    assert ALAW_TABLE[0xD5] == 8 and ALAW_TABLE[0x55] == -8 and ALAW_TABLE.max() == 32256


def test_ima_equals_one_sample_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (5, 64), dtype=np.uint8)
    got = decode_ima(blocks)
    for b, row in zip(blocks, got, strict=True):
        p, i = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88)
        want = [p]
        for x in b[4:]:
            for code in (int(x) & 15, int(x) >> 4):
                s = int(IMA_STEPS[i])
                d = s * (2 * (code & 7) + 1) >> 3
                p = max(-32768, min(32767, p - d if code & 8 else p + d))
                i = max(0, min(88, i + int(IMA_INDEX[code])))
                want.append(p)
        assert row.tolist() == want


def test_wav_round_trip():
    for data in (b"", b"abc", bytes(range(256))):
        assert read_wav(wav(data, MULAW))[3] == data
    assert len(decode(wav(bytes(128), IMA, align=64))[0]) == 2 * 121
    assert decode(wav(b"\x55", ALAW))[0].tolist() == [-8]
    assert len(resample(np.arange(10, dtype=np.int16), 8000, 16000)) == 20


def chunks(media):
    at, out = 12, {}
    while at < len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        out[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def test_formats_other_than_pcm_have_extension_and_fact():
    got = chunks(wav(b"abc", MULAW))
    assert len(got[b"fmt "]) == 18 and int.from_bytes(got[b"fact"], "little") == 3 and got[b"data"] == b"abc"
    got = chunks(wav(bytes(128), IMA, bits=4, align=64))
    assert len(got[b"fmt "]) == 20 and int.from_bytes(got[b"fact"], "little") == 2 * 121
    got = chunks(wav(b"abcd", PCM, bits=16, align=2))
    assert len(got[b"fmt "]) == 16 and b"fact" not in got


def plain_resample(x, src, dst):
    """One sample at a time, from the filter's definition."""
    g = math.gcd(src, dst)
    up, down = dst // g, src // g
    wide = max(1.0, down / up)
    half = math.ceil(LOBES * wide)
    out = []
    for i in range(max(1, len(x) * up // down) if len(x) else 0):
        at, phase = divmod(i * down, up)
        h = [0.9 * np.sinc(0.9 * (k - phase / up) / wide) * (0.5 + 0.5 * math.cos(math.pi * (k - phase / up) / wide / LOBES) if abs(k - phase / up) < LOBES * wide else 0) for k in range(-half + 1, half + 1)]
        q = [math.floor(v / sum(h) * (1 << 14) + 0.5) for v in h]
        q[half - 1] += (1 << 14) - sum(q)
        total = sum(c * int(x[at + k]) for c, k in zip(q, range(-half + 1, half + 1), strict=True) if 0 <= at + k < len(x))
        out.append(max(-32768, min(32767, (total + (1 << 13)) >> 14)))
    return out


def test_resampling_equals_one_sample_at_a_time():
    rng = np.random.default_rng(3)
    signals = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (0, 1, 2, 64, 127)]
    for src, dst in ((8000, 4000), (8000, 16000), (8000, 8000), (11025, 8000), (8000, 6000)):
        got, n = resample_all(np.concatenate(signals), np.array([len(x) for x in signals]), src, dst)
        want = [x.tolist() if src == dst else plain_resample(x, src, dst) for x in signals]
        assert n.tolist() == [len(x) for x in want]
        diff = np.abs(got.astype(int) - np.array([v for x in want for v in x], dtype=int))
        assert diff.max() <= 1  # floats of the filter may round the other way


def test_the_filter_stops_what_the_lower_rate_cannot_hold():
    t = np.arange(4000) / 8000
    low, high = (np.round(20000 * np.sin(2 * np.pi * f * t)).astype(np.int16) for f in (500, 3500))
    assert np.abs(resample(low, 8000, 4000)[100:-100]).max() > 19000 and np.abs(resample(high, 8000, 4000)[100:-100]).max() < 300


def plain_feature(payload):
    parts = []
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    for name, pcm in (("mu", [int(MULAW_TABLE[x]) for x in payload]), ("a", [int(ALAW_TABLE[x]) for x in payload]), ("ima", [int(x) for x in decode_ima(blocks).ravel()])):
        parts.append(f"{name}:{sum(x * x for x in pcm) // len(pcm)}:{max(map(abs, pcm))}:{sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:], strict=False))}")
    low = resample(MULAW_TABLE[np.frombuffer(payload, np.uint8)], 8000, STORED_RATE)
    return "|".join([*parts, f"pcm:{len(low)}:{zlib.crc32(low.astype('<i2').tobytes())}"])


def test_query(spark, odd, none, clashing, write, tmp_path):
    got = op9_telephony(spark, write(documents=odd)).collect()
    assert len(got) == 14
    by_text = {}
    for r in got:
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id) or ""
        raw = text.encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.media_bytes == len(wav(want, MULAW)) and r.feature == plain_feature(want)
        assert by_text.setdefault(text, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert encode_media(none).collect() == []
    assert encode_media(clashing).count() == 14
    both = pcm_column(encode_media(odd).withColumn("media", F.when(F.col("doc_id") != 1, F.col("media"))).withColumn("rate", F.lit("clash"))).collect()
    assert all((r.pcm is None) == (r.media is None) and r.pcm_rate == 16000 and r.rate == "clash" for r in both)
    assert all(len(r.pcm) == 4 * len(read_wav(r.media)[3]) for r in both if r.media is not None)


def test_what_is_stored_is_no_larger_than_it_must_be(spark):
    at, sf = Path(shared_dir(spark).removeprefix("file:")), "/root/testdata/sf0.01"
    before = set(at.glob("telephony-*"))
    op9_telephony(spark, sf)
    size = sum(f.stat().st_size for d in set(at.glob("telephony-*")) - before for f in d.glob("*.parquet"))
    assert 0 < size < 1.7 * os.path.getsize(f"{sf}/documents.parquet")  # small tables compress worse; 2.1 with plain PCM


def test_blocks_come_back_byte_for_byte():
    rng = np.random.default_rng(5)
    media = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 64, 500, 70, 64, 3000)]
    pcm = [rng.integers(0, 256, 2 * n, dtype=np.uint8).tobytes() for n in (0, 3, 200, 35, 0, 1500)]
    cols = [pa.array([3, None, 1, 1, 9, 4], pa.int64()), pa.array(range(6), pa.int64()), pa.array(media, pa.binary()), pa.array([None, b"k", None, b"l", None, None], pa.binary()), pa.array([4000] * 6, pa.int32()), pa.array(pcm, pa.binary())]
    rows = pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "media", "key", "pcm_rate", "pcm"])
    for limit in (1, 1200, 1 << 20):
        blocks = list(audio._packed(iter([rows.slice(0, 2), rows.slice(2)]), limit))
        got = pa.Table.from_batches(audio._unpacked(iter(blocks), min(limit, 100)))
        assert got.sort_by("n_bytes").to_pylist() == rows.to_pylist()
        assert all((k is not None) == b.column("copied")[0].as_py() for b in blocks for k in b.column("key")[0].as_py())


def test_copies_share_what_is_stored(odd):
    blocks, members = audio.store_media(odd)
    got = audio.read_media(blocks).collect()
    want = {r.media: r for r in pcm_column(encode_media(odd), STORED_RATE).collect()}
    assert sorted(r.media for r in got) == sorted(want)
    assert all((r.n_bytes, r.pcm_rate, r.pcm) == (want[r.media].n_bytes, STORED_RATE, want[r.media].pcm) for r in got)
    assert sorted(r.id for r in members.collect()) == [1, 2, 3, 5, 5] and sorted(r.id for r in got if r.key) == [1, 2]
    blocks, members = audio.store_media(odd.filter("doc_id > 5"))
    assert members is None and audio.read_media(blocks).count() == 7


def test_full_bitmaps_change_no_result(spark, odd, write, monkeypatch):
    at = write(documents=odd)
    want = sorted(op9_telephony(spark, at).collect(), key=str)
    monkeypatch.setattr(bitmap, "build", lambda hashes, n: np.full(1 << 13, 255, dtype=np.uint8))
    assert sorted(op9_telephony(spark, at).collect(), key=str) == want
