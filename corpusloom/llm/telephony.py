"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, and their PCM.

A row's codec bytes are stored in a WAV file of one channel; reading expands them to
16-bit PCM (companded codecs by a table of 256 entries, ADPCM nibble by nibble with
numpy over all blocks of many rows at once) and resamples it with an integer filter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, extended, released, small_batches, text_of
from .sentencepieces import parts

CODECS = ("mulaw", "alaw", "ima_adpcm")
FORMAT = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
RATE, OUT_RATE = 8_000, 16_000
BLOCK_BYTES = 64
PART_BYTES = 2_000_000

# Fixed values of the IMA ADPCM format: changes of the step index by code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# Fixed values of the IMA ADPCM format: step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
        1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 4 + bytes) blocks -> (n, 1 + 2 * bytes) samples, low nibble first."""
    n, size = blocks.shape[0], blocks.shape[1] - 4
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * size, n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(size):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            step = STEPS[index]
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * ((code >> 1) & 1) + step * ((code >> 2) & 1)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code], 0, 88)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def to_wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """Codec bytes in a WAV file; ADPCM nibbles go to blocks that start from silence."""
    if codec == "ima_adpcm":
        if len(payload) % BLOCK_BYTES:
            raise ValueError(f"nibbles come in blocks of {BLOCK_BYTES} bytes")
        body = np.zeros((len(payload) // BLOCK_BYTES, 4 + BLOCK_BYTES), np.uint8)
        body[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_BYTES)
        data, align, bits, extra = body.tobytes(), 4 + BLOCK_BYTES, 4, struct.pack("<H", 1 + 2 * BLOCK_BYTES)
        samples, speed = len(body) * (1 + 2 * BLOCK_BYTES), rate * (4 + BLOCK_BYTES) // (1 + 2 * BLOCK_BYTES)
    else:
        data, align, bits, extra, samples, speed = payload, 1, 8, b"", len(payload), rate
    head = struct.pack("<HHIIHHH", FORMAT[codec], 1, rate, speed, align, bits, len(extra)) + extra
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", head), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and the data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    kind, _, rate, _, align = struct.unpack_from("<HHIIH", chunks[b"fmt "])
    return {v: k for k, v in FORMAT.items()}[kind], rate, align, chunks[b"data"]


def payload_of(codec: str, align: int, data: bytes) -> bytes:
    """The codec bytes, without the blocks' heads."""
    if codec != "ima_adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def expand(files: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of (codec, block size, data); ADPCM blocks of all files go together."""
    out: list = [TABLES[c][np.frombuffer(d, np.uint8)] if c in TABLES else None for c, _, d in files]
    for align in {a for c, a, _ in files if c == "ima_adpcm"}:
        which = [k for k, (c, a, _) in enumerate(files) if c == "ima_adpcm" and a == align]
        blocks = [np.frombuffer(files[k][2], np.uint8).reshape(-1, align) for k in which]
        pcm = decode_adpcm(np.concatenate(blocks))
        for k, part in zip(which, np.split(pcm, np.cumsum([len(b) for b in blocks])[:-1])):
            out[k] = part.reshape(-1)
    return out


def resampler(source: int, target: int, half: int = 6) -> tuple[int, int, np.ndarray]:
    """Up, down and the integer filter (2 ** 14 is one) by phase and tap: a windowed sinc."""
    d = gcd(source, target)
    up, down = target // d, source // d
    wide = max(1.0, down / up)
    taps = 2 * int(np.ceil(half * wide))
    x = np.arange(up)[:, None] / up - (np.arange(taps)[None] - taps // 2 + 1)
    h = np.sinc(x / wide) * np.cos(np.pi * np.clip(x / taps, -0.5, 0.5)) ** 2
    q = np.round(h / h.sum(1, keepdims=True) * (1 << 14)).astype(np.int32)
    return up, down, q


def resample(pcm: np.ndarray, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """ceil(n * up / down) samples; outside the signal there is silence."""
    n, width = len(pcm), taps.shape[1]
    total = -(-n * up // down)
    padded = np.zeros(n + 2 * width, np.int32)
    padded[width : width + n] = pcm
    out = np.empty(total, np.int16)
    for first in range(min(up, total)):
        phase, base = first * down % up, first * down // up
        count = -(-(total - first) // up)
        acc = np.full(count, 1 << 13, np.int32)
        for j in range(width):
            if taps[phase, j]:
                begin = width + base + j - width // 2 + 1
                acc += padded[begin : begin + (count - 1) * down + 1 : down] * taps[phase, j]
        out[first::up] = np.clip(acc >> 14, -32768, 32767)
    return out


def describe(codec: str, rate: int, pcm: np.ndarray) -> str:
    """Integers only, so that every machine says the same."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};{rate};{len(pcm)};{int(np.abs(wide).max(initial=0))};{int(wide @ wide)};{crossings};{zlib.crc32(pcm.tobytes()):08x}"


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, filled with bytes 0 up to a positive
    multiple of 64, as one telephony file.

    The codec is dealt by the payload's checksum, so that equal texts give equal files.
    Null texts count as empty (64 bytes 0). Repeated rows give repeated results.
    """
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in parts([len(t) for t in texts], PART_BYTES):
                sizes, media = [], []
                for text in texts[begin:end]:
                    data = text.encode("utf-8", "surrogatepass")
                    payload = data + bytes(-len(data) % 64 if data else 64)
                    sizes.append(len(data))
                    media.append(to_wav(payload, CODECS[zlib.crc32(payload) % 3]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return small_batches(rows).mapInArrow(released(run), schema).withColumnRenamed("id", id_col)


def read_media(df: DataFrame, media_col: str = "media", out_rate: int = OUT_RATE, with_pcm: bool = True) -> DataFrame:
    """Adds codec, payload, pcm (16-bit little-endian at ``out_rate``) and feature of each
    telephony file; without ``with_pcm`` a checksum of the PCM stays in the feature only.

    Null files give nulls; a file that is no WAV of a known codec raises. Columns of
    the added names are replaced.
    """
    df = df.drop("codec", "payload", "pcm", "feature")
    schema = extended(df, codec="string", payload="binary", **({"pcm": "binary"} if with_pcm else {}), feature="string")
    at = df.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple] = {}
        for batch in batches:
            media = batch.column(at).to_pylist()
            for begin, end in parts([len(m or b"") for m in media], PART_BYTES):
                heads = [from_wav(m) if m is not None else None for m in media[begin:end]]
                signals = iter(expand([(c, a, d) for h in heads if h for c, _, a, d in (h,)]))
                found = []
                for head in heads:
                    if head is None:
                        found.append((None,) * 4)
                        continue
                    codec, rate, align, data = head
                    pcm = resample(next(signals), *filters.setdefault(rate, resampler(rate, out_rate)))
                    found.append((codec, payload_of(codec, align, data), pcm.astype("<i2").tobytes() if with_pcm else None, describe(codec, out_rate, pcm)))
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.string())
                added = [pa.array([f[k] for f in found], kinds[k]) for k in range(4) if k != 2 or with_pcm]
                rows = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=schema.names)

    return small_batches(df).mapInArrow(released(run), schema)


def _digests(df: DataFrame, id_col: str) -> DataFrame:
    """Digests of the bytes read back and of the stored file, and the PCM; SHA-256 and CRC in the JVM."""
    return df.select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "pcm",
    )


def telephony_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digests of the payload and of its file, feature and resampled PCM of every text.

    The files are written to the shared folder and read back from there. Null and empty
    texts are 64 bytes 0; equal texts have equal values, repeated rows repeated ones; null
    ids are kept; an empty table gives none. Other columns are not read.
    """
    stored = Scratch(docs.sparkSession, "telephony").save(store_payloads(docs, id_col, text_col), "media")
    return _digests(read_media(stored), id_col)
