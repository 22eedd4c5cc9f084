"""Telephony audio columns: companded and ADPCM samples, stored and expanded.

A payload is kept as the 8-bit samples of a WAV container. Mu-law and A-law are
expanded through tables of 256 entries; IMA ADPCM is decoded for all blocks of
a batch at once, one nibble of every block per step; linear PCM is resampled
and kept as a column of its own. ``store`` makes these two columns, which are
written as a table; ``features`` reads them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm import arrow, work

UNIT = 64
RATE = 8000
TARGET_RATE = 16000
BATCH_BYTES = 1 << 21
BLOCK_BYTES = 1 << 25

# WAV format tags, IMA ADPCM index changes and step sizes.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    mantissa, exponent = (code & 0x0F) << 4, code >> 4 & 7
    size = np.where(exponent > 0, mantissa + 0x108 << np.maximum(exponent - 1, 0), mantissa + 8)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and nibble: the change of the sample, and the next index."""
    steps, nibble = np.asarray(STEPS)[:, None], np.arange(16)
    change = (steps >> 3) + (nibble >> 2 & 1) * steps + (nibble >> 1 & 1) * (steps >> 1) + (nibble & 1) * (steps >> 2)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.asarray(INDEX_CHANGE * 2), 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), after.astype(np.int32).ravel()


def expand(data: np.ndarray, codec: str) -> np.ndarray:
    """16-bit samples of companded bytes."""
    return {"mulaw": mulaw_table, "alaw": alaw_table}[codec]()[data]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row each.

    ``blocks`` is (n, size) bytes: a little-endian first sample, a step index
    (above 88 it counts as 88), a reserved byte, then nibbles, low one first.
    Every step works on one nibble of all blocks."""
    change, after = adpcm_tables()
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel()
    sample, index = head.astype(np.int32), np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = sample
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    row = 1
    for column in columns:
        for nibble in (column & 15, column >> 4):
            at = (index << 4) + nibble
            sample += change.take(at)
            np.clip(sample, -32768, 32767, out=sample)
            index = after.take(at)
            out[row] = sample
            row += 1
    return out.T


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation between neighbours, in whole numbers; the last sample is held."""
    if rate == target or not len(pcm):
        return pcm
    count = len(pcm) * target // rate
    if target == 2 * rate:
        out = np.empty(count, np.int16)
        out[::2] = pcm
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    place = np.arange(count, dtype=np.int64) * rate
    at, part = place // target, place % target
    wide = np.append(pcm, pcm[-1]).astype(np.int64)
    return ((wide[at] * (target - part) + wide[at + 1] * part) // target).astype(np.int16)


def wav_bytes(payload: bytes, codec: str = "mulaw", rate: int = RATE, unit: int = UNIT) -> bytes:
    """A WAV of one channel; ``unit`` is the size of its ADPCM blocks, of which the last may be shorter."""
    tag, samples = TAGS[codec], len(payload)
    if codec == "ima_adpcm":
        each, rest = 1 + 2 * (unit - 4), len(payload) % unit
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * unit // each, unit, 4, 2, each)
        samples = len(payload) // unit * each + (1 + 2 * (rest - 4) if rest > 3 else 0)
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    fact = struct.pack("<I", samples)
    parts = [(b"fmt ", form), (b"fact", fact), (b"data", payload)]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, bytes, int]:
    """Codec, rate, sample bytes and block size of a WAV of one companded or ADPCM channel.

    Anything else is a ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, codec, rate, unit = 12, "", 0, 1
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, channels, rate, _, unit = struct.unpack_from("<HHIIH", media, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag, "")
            if not codec or channels != 1 or codec == "ima_adpcm" and unit < 5:
                raise ValueError(f"a WAV of format {tag} with {channels} channels and blocks of {unit} bytes")
        elif kind == b"data" and codec:
            return codec, rate, media[at + 8 : at + 8 + size], unit
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of the unit."""
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def decode(media: bytes, target: int = TARGET_RATE) -> bytes:
    """Little-endian 16-bit PCM of a stored medium at the target rate.

    The last ADPCM block may be short; fewer bytes than a block's head are none."""
    codec, rate, data, unit = read_wav(media)
    raw = np.frombuffer(data, np.uint8)
    if codec == "ima_adpcm":
        whole = len(raw) - len(raw) % unit
        blocks = [raw[:whole].reshape(-1, unit), raw[None, whole:]]
        pcm = np.concatenate([decode_adpcm(b).ravel() for b in blocks if b.shape[1] > 3])
    else:
        pcm = expand(raw, codec)
    return resample(pcm, rate, target).astype("<i2").tobytes()


def pack_pcm(pcm: bytes) -> bytes:
    """16-bit PCM as it is stored, without loss: the samples at even places, then the
    others as differences from the mean of their neighbours, which compress to
    little where the rate was raised."""
    wide = np.frombuffer(pcm, "<i2").astype(np.int32)
    even, odd = wide[::2], wide[1::2]
    after = np.append(even[1:], even[-1:])[: len(odd)]
    return np.concatenate([even, odd - (even[: len(odd)] + after >> 1)]).astype("<i2").tobytes()


def read_pcm(stored: bytes) -> bytes:
    """The 16-bit PCM that ``pack_pcm`` stored."""
    wide = np.frombuffer(stored, "<i2").astype(np.int32)
    even, change = wide[: (len(wide) + 1) // 2], wide[(len(wide) + 1) // 2 :]
    out = np.empty(len(wide), "<i2")
    after = np.append(even[1:], even[-1:])[: len(change)]
    out[::2], out[1::2] = even, (change + (even[: len(change)] + after >> 1)).astype(np.int16)
    return out.tobytes()


def _features(payloads: list[bytes], highs: list[bytes]) -> list[str]:
    """For each payload: loudness and sign changes of its mu-law samples, loudness
    as A-law and as ADPCM, and the number and checksum of its resampled samples."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.asarray([len(p) for p in payloads])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pcm, law = expand(raw, "mulaw"), expand(raw, "alaw")

    def loud(x: np.ndarray) -> np.ndarray:
        rows = x.reshape(len(raw) // UNIT, -1).astype(np.float64)
        return np.add.reduceat(np.einsum("ij,ij->i", rows, rows), begins // UNIT)

    change = np.empty(len(pcm), np.uint8)
    change[0] = 0
    np.not_equal(pcm[1:] < 0, pcm[:-1] < 0, out=change[1:])
    change[begins] = 0
    crossings = np.add.reduceat(change, begins, dtype=np.int64)
    a, b, c = loud(pcm), loud(law), loud(decode_adpcm(raw.reshape(-1, UNIT)))
    return [
        f"mulaw_rms={int((a[k] / size) ** 0.5)};crossings={crossings[k]};alaw_rms={int((b[k] / size) ** 0.5)};adpcm_rms={int((c[k] / (size // UNIT * (2 * UNIT - 7))) ** 0.5)};pcm_samples={len(high) // 2};pcm_crc32={zlib.crc32(high)}"
        for k, (size, high) in enumerate(zip(sizes.tolist(), highs))
    ]


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values of a column have ``BATCH_BYTES`` together, or one row."""
    begin = held = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        held += size
        if held >= BATCH_BYTES or k == batch.num_rows - 1:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "mulaw", rate: int = RATE, target: int = TARGET_RATE) -> DataFrame:
    """doc_id, n_bytes, media (the WAV) and pcm (resampled, 16 bits, by
    ``pack_pcm``) of each document.

    A null text is empty; an empty payload is one unit of zeros. Very long
    texts are taken whole. Repeated rows and null ids give a row each; equal
    texts give equal values. Only the two named columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 1):
                texts = list(arrow.text_bytes(part.column(1)))
                media = [wav_bytes(pad(t), codec, rate) for t in texts]
                high = [pack_pcm(decode(m, target)) for m in media]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(high, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    return work.bound_batches(docs).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary, pcm binary")


def features(stored: DataFrame) -> DataFrame:
    """Checksums and features of the columns of ``store``, as they are read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch, 2):
                ids, sizes, media, high = (c.to_pylist() for c in part.columns)
                back = [read_wav(m)[2] for m in media]
                rows = [(i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f) for i, n, p, m, f in zip(ids, sizes, back, media, _features(back, [read_pcm(h) for h in high]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return work.bound_batches(stored).select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, schema)


def op2_telephony(spark, sf_dir: str) -> DataFrame:
    """The media and PCM columns of all documents, written as a table and read back."""
    path = work.new_path(spark, "media")
    store(work.read(spark, sf_dir, "documents")).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 6).option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return features(spark.read.parquet(path))
