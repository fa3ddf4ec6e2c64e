"""PNG images in binary columns: zlib chunks with checksum tests, numpy unfiltering, cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, in_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 16
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(image: np.ndarray) -> np.ndarray:
    """Rows with their filter byte: none, left or above, whichever has the least sum of absolute differences."""
    left = image.copy()
    left[:, 1:] -= image[:, :-1]
    above = image.copy()
    above[1:] -= image[:-1]
    forms = np.stack([image, left, above])
    cost = np.where(forms > 127, 256 - forms.astype(np.int16), forms).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out = np.empty((len(image), image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = forms[best, np.arange(len(image))]
    return out


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """The image behind filtered rows of 8-bit grey samples; all five filters of the format."""
    kind, image = rows[:, 0], rows[:, 1:].copy()
    if (kind > 4).any():
        raise ValueError("unknown PNG filter")
    row_only = kind == 1
    image[row_only] = np.cumsum(image[row_only], axis=1, dtype=np.uint8)
    y = 0
    while y < len(image):
        if kind[y] == 2:  # a run of rows that lean on the row above is one running sum
            end = y + 1
            while end < len(image) and kind[end] == 2:
                end += 1
            top = image[y - 1 : y] if y else np.zeros((1, image.shape[1]), np.uint8)
            image[y:end] = np.cumsum(np.concatenate([top, image[y:end]]), axis=0, dtype=np.uint8)[1:]
            y = end
            continue
        if kind[y] >= 3:
            above = image[y - 1].astype(int) if y else np.zeros(image.shape[1], int)
            left = corner = 0
            for x in range(image.shape[1]):
                if kind[y] == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                    corner = above[x]
                left = (int(image[y, x]) + guess) & 255
                image[y, x] = left
        y += 1
    return image


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """8-bit grey PNG, 64 samples a row, of a payload whose length is a positive multiple of 64."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(filtered(image).tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without interlace.  ValueError for anything that is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut PNG chunk")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey PNG without interlace is read")
            size = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("PNG without IHDR or IEND")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(f"PNG data: {e}") from e
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("PNG data of a wrong length")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


_DCT = _cosines()


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine frequencies of the image at 32 x 32 are above their median."""
    def shrink(a: np.ndarray) -> np.ndarray:
        n = len(a)
        if n < SIDE:
            return a[np.arange(SIDE) * n // SIDE]
        edge = np.arange(SIDE) * n // SIDE
        return np.add.reduceat(a, edge, axis=0) / np.diff(np.append(edge, n))[:, None]

    small = shrink(shrink(image.astype(np.float64)).T).T
    low = (_DCT @ small @ _DCT.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64; a null is empty."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``, the PNG of each text's payload.

    A null or empty text gives one row of 64 zero samples.  A null doc_id is kept.  Repeated rows
    give repeated rows; an empty table gives none; other columns of ``docs`` are not read.
    """
    in_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = column(b, "text").to_pylist()
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode_png(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    d = docs.select("doc_id", docs[text].alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored bytes of ``media`` say: the payload's length and digests, and the image's hash.

    A null or damaged image gives nulls for what is read from it; the row stays.
    """
    key = stored.schema["doc_id"].dataType.simpleString()

    def facts(media):
        if media is None:
            return [None] * 6
        known = [len(media), hashlib.sha256(media).hexdigest()]
        try:
            image = decode_png(media)
        except ValueError:
            return [None, None, None, *known, None]
        payload = image.tobytes()
        return [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *known, cosine_hash(image)]

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            rows = [facts(m) for m in column(b, "media").to_pylist()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "n_bytes"), *cols], ["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
