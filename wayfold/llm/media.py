"""Media columns: samples stored as lossless WebP frames, decoded to pixel arrays, and features of these."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import webp
from wayfold.llm.common import table, text_of

#: Pixels in a row; rows of three samples a pixel make 192 bytes.
WIDTH = 64
ROW = 3 * WIDTH


def store_bytes(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media: WebP frames) of (doc_id, text): the UTF-8 bytes, blanks up to a positive multiple of 192, as red, green and blue samples of rows of 64 pixels.

    A frame has at most 16384 rows, the most that the format allows (3 MiB of samples), so longer texts take several.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    most = ROW * webp.MOST_SIDE

    def store(batches):
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                data = text.encode()
                sizes.append(len(data))
                data += b" " * (-len(data) % ROW if data else ROW)
                media.append([webp.encode_bytes(data[a : a + most], WIDTH) for a in range(0, len(data), most)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(store, f"doc_id {kind}, n_bytes long, media array<binary>")


def decode_media(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """Decodes the frames of a column of WebP files (an array of binaries a row): adds width, height and pixels, the red, green and blue samples of all frames one below the other, and error.

    Frames of one row must have one width; height is that of all. Null or no frames: an empty array of width and height 0. A
    damaged frame, or one of another width: null pixels and the reason in `error`. Columns beside `keep` are left out.
    """
    chosen = rows.select(*keep, media)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)

    def decode(batches):
        for b in batches:
            out = [_decoded(frames or []) for frames in b.column(len(keep)).to_pylist()]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], [*b.schema.names, "width", "height", "pixels", "error"])

    return chosen.mapInArrow(decode, f"{fields}, width int, height int, pixels binary, error string")


def _decoded(frames: list[bytes]) -> tuple[int, int, bytes | None, str | None]:
    width, height, parts = 0, 0, []
    try:
        for f in frames:
            w, h, px = webp.decode(f)
            if width and w != width:
                raise webp.WebpError("frames differ in width")
            width, height = w, height + h
            parts.append(np.ascontiguousarray(px.view(np.uint8).reshape(-1, 4)[:, 2::-1]).tobytes())
    except (webp.WebpError, TypeError, IndexError) as e:
        return 0, 0, None, str(e) or type(e).__name__
    return width, height, b"".join(parts), None


def feature_of(width: int, height: int, pixels: bytes) -> str:
    """Size, mean of each channel and a 64-bit average hash of the grey image reduced to 8 by 8."""
    rgb = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
    mean = rgb.reshape(-1, 3).mean(0)
    grey = rgb.sum(2, dtype=np.int64)
    rows = np.add.reduceat(np.repeat(grey, 8, 0), np.arange(8) * height, 0)
    cells = np.add.reduceat(np.repeat(rows, 8, 1), np.arange(8) * width, 1)
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{width}x{height} {mean[0]:.3f} {mean[1]:.3f} {mean[2]:.3f} {bits}"


def media_digests(decoded: DataFrame) -> DataFrame:
    """Per row of (doc_id, n_bytes, media, width, height, pixels): lengths and digests of what was read back and of the stored form, and the feature."""
    rows = decoded.select("doc_id", "n_bytes", "media", "width", "height", "pixels")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for b in batches:
            out = []
            for _, n, media, width, height, pixels in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                stored = b"".join(media)
                out.append((n, len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(width, height, pixels)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_bytes(text_of(table(spark, sf_dir, "documents"), "doc_id"))
    return media_digests(decode_media(stored, ("doc_id", "n_bytes")))
