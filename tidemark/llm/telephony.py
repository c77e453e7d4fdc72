"""Telephony audio columns: G.711 mu-law and A-law, and IMA ADPCM, in WAVE containers.

Mu-law and A-law expand by 256-entry tables built from their formulas.  ADPCM blocks are
decoded together: each step of the predictor runs in numpy across all blocks of a batch.
Decoded sound is resampled from 8 to 16 kHz by linear interpolation, as 16-bit PCM, which ``sounds``
stores beside the WAVE file.

Null and empty texts are one unit of blanks.  Equal texts give equal values.  Repeated rows
each give a row; ties don't arise, since rows don't meet; an empty table gives an empty result.  Very long texts are decoded
and described piece by piece, so that beside the sound itself memory stays bounded.  Other columns are
ignored, whatever their names, unless they are asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

UNIT = 192
RATE = 8000
LONG = 1 << 20
CODECS = ("mulaw", "alaw", "ima")
TAGS = {"mulaw": 7, "alaw": 6, "ima": 17}
# Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _tables() -> dict[str, np.ndarray]:
    code = np.arange(256)
    u = ~code & 0xFF
    size = (((u & 15) << 3) + 132 << ((u & 0x70) >> 4)) - 132
    mulaw = np.where(u & 0x80, -size, size)
    a = code ^ 0x55
    part, low = (a & 0x70) >> 4, (a & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return {"mulaw": mulaw.astype(np.int16), "alaw": np.where(a & 0x80, size, -size).astype(np.int16)}


TABLES = _tables()


def store(codec: str, payload: bytes) -> bytes:
    """A WAVE file whose samples are the payload; ADPCM has a four-byte state before every unit."""
    if codec == "ima":
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, more = blocks.tobytes(), UNIT + 4, 4, struct.pack("<HH", 2, 2 * UNIT + 1)
        samples = len(blocks) * (2 * UNIT + 1)
        speed = RATE * align // (2 * UNIT + 1)
    else:
        data, align, bits, more, samples, speed = payload, 1, 8, struct.pack("<H", 0), len(payload), RATE
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, speed, align, bits) + more
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a stored file."""
    at, codec, align = 12, "", 1
    while at < len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            return codec, data if codec != "ima" else np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x 2 UNIT + 1) of IMA ADPCM blocks that start from predictor 0 and step 0."""
    codes = np.empty((2 * blocks.shape[1], len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = blocks.T & 15, blocks.T >> 4
    out = np.zeros((len(codes) + 1, len(blocks)), np.int16)
    value, index = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int32)
    for k, code in enumerate(codes):
        step = STEPS[index]
        size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + INDEX[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def decode(codec: str, data: np.ndarray) -> np.ndarray:
    """16-bit samples of payload bytes."""
    return adpcm(data.reshape(-1, UNIT)).reshape(-1) if codec == "ima" else TABLES[codec][data]


def doubled(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation, sound by sound; the last sample of each sound is held."""
    after = np.append(pcm[1:], 0).astype(np.int32)
    after[ends - 1] = pcm[ends - 1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2], out[1::2] = pcm, (pcm.astype(np.int32) + after) >> 1
    return out


class Summary:
    """Figures of a 16 kHz sound that comes in pieces."""

    def __init__(self) -> None:
        self.samples = self.peak = self.power = self.turns = self.crc = 0
        self.hash, self.sign = hashlib.sha256(), None

    def add(self, pcm: np.ndarray) -> None:
        wide, sign, raw = pcm.astype(np.int64), pcm < 0, pcm.tobytes()
        self.samples += len(pcm)
        self.peak = max(self.peak, int(np.abs(wide).max(initial=0)))
        self.power += int((wide * wide).sum())
        self.turns += int((sign[1:] != sign[:-1]).sum()) + int(self.sign is not None and bool(sign[0]) != self.sign)
        self.sign, self.crc = bool(sign[-1]), zlib.crc32(raw, self.crc)
        self.hash.update(raw)


def resampled(codec: str, payload: bytes, piece: int) -> Iterator[np.ndarray]:
    """The 16 kHz samples of a payload, ``piece`` payload bytes (whole units) at a time."""
    held = np.zeros(0, np.int16)
    for at in range(0, len(payload), piece):
        pcm = np.concatenate([held, decode(codec, np.frombuffer(payload[at : at + piece], np.uint8))])
        last = at + piece >= len(payload)
        out = doubled(pcm, np.array([len(pcm)]))
        yield out if last else out[:-2]
        held = pcm[-1:]


def line_of(codec: str, samples: int, peak: int, power: int, turns: int, crc: int) -> str:
    return f"{codec} samples={samples} peak={peak} power={power} crossings={turns} crc={crc:08x}"


def telephone(docs: DataFrame, keep: list[str], with_pcm: bool = False, piece: int = LONG) -> DataFrame:
    """Store every text as a sound, read it back, decode, resample and describe it; ``with_pcm`` adds media and PCM.

    Texts of up to ``piece`` bytes are decoded together, longer ones in pieces of that size.
    """
    source = docs.select(*keep, "text")
    columns = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("pcm_bytes", "long"), ("pcm_sha256", "string")]
    columns += [("media", "binary"), ("pcm", "binary")] * with_pcm
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema] + [f"{n} {t}" for n, t in columns])
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, max_bytes=1 << 20):
            data, offsets = common.text_bytes(batch.column("text"))
            rows = [None] * batch.num_rows
            groups: dict[str, list[tuple[int, bytes]]] = {c: [] for c in CODECS}
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                payload = raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")
                media = store(CODECS[zlib.crc32(payload) % len(CODECS)], payload)
                codec, back = read(media)
                rows[i] = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest()]
                if len(back) <= piece:
                    groups[codec].append((i, back))
                    found, pcm = None, None
                else:
                    found, pcm = Summary(), []
                    for part in resampled(codec, back, piece // UNIT * UNIT):
                        found.add(part)
                        pcm += [part.tobytes()] * with_pcm
                    rows[i] += [line_of(codec, found.samples, found.peak, found.power // found.samples, found.turns, found.crc), 2 * found.samples, found.hash.hexdigest()]
                    rows[i] += [media, b"".join(pcm)] * with_pcm
                if found is None and with_pcm:
                    rows[i].append(media)
            for codec, members in groups.items():
                if not members:
                    continue
                pcm = decode(codec, np.frombuffer(b"".join(b for _, b in members), np.uint8))
                units = np.array([len(b) // UNIT for _, b in members])
                ends = np.cumsum(units) * (len(pcm) // units.sum())
                pcm, cuts = doubled(pcm, ends), np.concatenate([[0], 2 * ends])
                wide = pcm.astype(np.int64)
                peak = np.maximum.reduceat(np.abs(wide), cuts[:-1])
                power = np.add.reduceat(wide * wide, cuts[:-1]) // np.diff(cuts)
                sign = pcm < 0
                turns = np.append(sign[1:] != sign[:-1], False)
                turns[cuts[1:] - 1] = False
                crossings = np.add.reduceat(turns.astype(np.int64), cuts[:-1])
                for k, (i, _) in enumerate(members):
                    sound = pcm[cuts[k] : cuts[k + 1]].tobytes()
                    media = [rows[i].pop()] if with_pcm else []
                    rows[i] += [line_of(codec, len(sound) // 2, peak[k], power[k], crossings[k], zlib.crc32(sound)), len(sound), hashlib.sha256(sound).hexdigest(), *media, *[sound] * with_pcm]
            made = [pa.array([r[c] for r in rows], kinds[t]) for c, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, *[n for n, _ in columns]])

    return source.mapInArrow(run, schema)


def sounds(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """Write media and resampled PCM of every text as Parquet at ``path``, and return the table."""
    telephone(docs, keep, with_pcm=True).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``sounds`` would store of every document, by lengths, hashes and features."""
    return telephone(common.table(spark, sf_dir, "documents").select("doc_id", F.col("text")), ["doc_id"])
