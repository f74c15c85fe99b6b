"""Media columns: PNG images in binary columns, written and read back with zlib and numpy, and their frequency hashes.

A text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, are the 8-bit grey samples of an image 64 wide. The
writer tries the row filters None, Sub and Up on the whole image and takes the one of the least sum of absolute differences.
The reader tests the signature and every chunk's checksum, joins the IDAT data, inflates it and undoes all five row
filters. The feature is a cosine-transform hash: rows are averaged to a 32 x 32 picture, and the signs of
its 64 lowest frequencies against their median make 64 bits.

Defined results: null text is empty, one row of 64 zero bytes. Equal texts give equal images. Rows that repeat a doc_id, or
have none, get one row each. Other columns are ignored. A corrupt image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, real_id, table, utf8, whole_text

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH = 64


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(pixels: np.ndarray, level: int = 6, chunk_bytes: int = 1 << 20) -> bytes:
    """An 8-bit grey PNG of a (height, width) array."""
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    sub = pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    tried = (pixels, sub, up)
    kind = min((NONE, SUB, UP), key=lambda k: int(np.abs(tried[k].view(np.int8).astype(np.int16)).sum(dtype=np.int64)))
    raw = np.empty((len(pixels), pixels.shape[1] + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, tried[kind]
    data = zlib.compress(raw.tobytes(), level)
    head = struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), 8, 0, 0, 0, 0)
    body = b"".join(chunk(b"IDAT", data[i : i + chunk_bytes]) for i in range(0, len(data), chunk_bytes))
    return SIGNATURE + chunk(b"IHDR", head) + body + chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, data) of each chunk, with its checksum tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the last chunk is cut")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered rows, each with its filter's number before it; step: bytes of a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip(np.append(0, edges).tolist(), np.append(edges, len(kinds)).tolist(), strict=True):
        if lo == hi:
            continue
        kind = kinds[lo]
        if kind == SUB:
            part = rows[lo:hi].reshape(hi - lo, -1, step)
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == UP:
            if lo:
                rows[lo] += rows[lo - 1]
            np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8, out=rows[lo:hi])
        elif kind in (AVERAGE, PAETH):
            for y in range(lo, hi):
                above = rows[y - 1].astype(int).tolist() if y else [0] * rows.shape[1]
                line = rows[y].astype(int).tolist()
                for x, v in enumerate(line):
                    a = line[x - step] if x >= step else 0
                    b = above[x]
                    c = above[x - step] if x >= step else 0
                    if kind == AVERAGE:
                        line[x] = (v + (a + b) // 2) & 255
                    else:
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        line[x] = (v + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
                rows[y] = line
    return rows


def read_png(png: bytes) -> np.ndarray:
    """The (height, width x channels) samples of an 8-bit PNG without palette or interlacing."""
    head, data = None, []
    for kind, x in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", x)
        elif kind == b"IDAT":
            data.append(x)
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[4:] != (0, 0, 0):
        raise ValueError("only 8-bit images without palette or interlacing are read")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("bad image data") from e
    if len(raw) != head[1] * (1 + head[0] * step):
        raise ValueError("wrong amount of image data")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], -1), step)


SIDE, LOW = 32, 8
COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE)[None, :] + 0.5) * np.arange(LOW)[:, None])


def frequency_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 8 x 8 lowest cosine frequencies are over their median."""
    picture = shrunk(shrunk(pixels.astype(np.float64), SIDE).T, SIDE).T
    low = np.round(COSINES @ picture @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def shrunk(a: np.ndarray, n: int) -> np.ndarray:
    """n means of equal stretches of rows; short inputs repeat rows."""
    edges = np.arange(n + 1) * len(a) // n
    if len(a) < n:
        return a[edges[:-1]]
    return np.add.reduceat(a, edges[:-1], axis=0) / np.diff(edges)[:, None]


def stored(docs: DataFrame, level: int = 6) -> DataFrame:
    """did, n_bytes, media (binary: the PNG of the padded text)."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b["text"])
            size = np.diff(offsets)
            for lo in range(0, b.num_rows, 256):
                media = []
                for a, n in zip(offsets[lo : min(lo + 256, b.num_rows)].tolist(), size[lo : lo + 256].tolist(), strict=True):
                    payload = np.zeros(max(1, -(-n // WIDTH)) * WIDTH, np.uint8)
                    payload[:n] = data[a : a + n]
                    media.append(write_png(payload.reshape(-1, WIDTH), level))
                yield pa.RecordBatch.from_arrays([b["did"].slice(lo, 256), pa.array(size[lo : lo + 256]), pa.array(media, pa.binary())], ["did", "n_bytes", "media"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), whole_text().alias("text"))
    return rows.mapInArrow(run, "did long, n_bytes long, media binary")


FIELDS = "did long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """What the stored images give when read back."""

    def run(batches):
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for b in batches:
            out = []
            for png in b["media"].to_pylist():
                pixels = read_png(png)
                payload = pixels.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), frequency_hash(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b["did"], b["n_bytes"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.mapInArrow(run, FIELDS).withColumn("did", real_id()).withColumnRenamed("did", "doc_id")


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")))


QUERIES = {"op10_png_media": op10_png_media}
ORACLE_SQL: dict[str, str] = {}
