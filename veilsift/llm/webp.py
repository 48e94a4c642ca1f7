"""Media columns: texts stored as lossless WebP images, and pixel arrays read from such images.

Media of a corpus come from many writers, so streams of every kind must be met.  Each text is, whatever it
holds, an image with transforms: the palette, the predictor, cross-colour and subtract-green, or all of
these three, in equal shares dealt by content.  All have references and code lengths that follow the counts
of their pixels; tile modes and factors follow the pixels too, and pixels of four samples have a colour cache.
"""

from __future__ import annotations

import hashlib
import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from .common import map_batches, text_bytes
from .webp_read import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN, decode, decode_all  # noqa: F401
from .webp_write import MATCH_BLOCK, encode_all

MAX_SIDE = 1 << 14
UNIT = 64
#: Longer payloads have four samples a pixel.
MOST_GREEN = 1 << 20
#: Transforms of an image in the order in which they are applied.
FORMS = ((PALETTE,), (PREDICTOR,), (SUBTRACT_GREEN, CROSS_COLOUR), (SUBTRACT_GREEN, PREDICTOR, CROSS_COLOUR))
#: A palette of so few colours puts several samples into one pixel.
FEW = 16


def shape_for(pixels: int) -> tuple[int, int]:
    """Width and height for a number of pixels: about a square, rows in sixteens."""
    width = min(MAX_SIDE, max(16, (isqrt(pixels) + 15) // 16 * 16))
    height = max(1, -(-pixels // width))
    if height > MAX_SIDE:
        raise ValueError("a payload of more than 1 GiB doesn't fit an image")
    return width, height


def form_of(payload: bytes) -> tuple[int, ...]:
    """The transforms of a payload's image, by its content: all forms come equally often, and no payload goes without."""
    place = zlib.crc32(payload)
    if len(payload) > MOST_GREEN:
        return FORMS[1 + place % 3]
    few = len(set(payload[:UNIT * FEW])) <= FEW and len(set(payload)) <= FEW
    return FORMS[0] if few else FORMS[place % len(FORMS)]


def encode_payload(payload: bytes) -> bytes:
    """A lossless WebP file whose samples are the payload; its pixels end with zeros."""
    return encode_payloads([payload])[0]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Files as ``encode_payload`` makes them: those of one form are written together, about ``MATCH_BLOCK`` pixels at once."""
    out: list[bytes] = [b""] * len(payloads)
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, payload in enumerate(payloads):
        groups.setdefault(form_of(payload), []).append(i)
    for form, places in groups.items():
        each = 1 if form == (PALETTE,) else 4
        shapes = [shape_for(len(payloads[i]) // each) for i in places]
        ends = np.cumsum([width * height for width, height in shapes])
        for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(ends // MATCH_BLOCK)) + 1):
            widths, heights = np.array([shapes[k] for k in part]).T
            given = b"".join(payloads[places[k]].ljust(each * shapes[k][0] * shapes[k][1], b"\0") for k in part)
            samples = np.frombuffer(given, np.uint8)
            if each == 1:
                pixels = np.zeros((len(samples), 4), np.uint8)
                pixels[:, 0], pixels[:, 2] = 255, samples
            else:
                pixels = samples.reshape(-1, 4)[:, [3, 1, 0, 2]]
            for k, file in zip(part, encode_all(pixels, widths, heights, form, each > 1, each > 1)):
                out[places[k]] = file
    return out


def samples_of(pixels: np.ndarray, alpha: bool) -> np.ndarray:
    """``(height, width, channels)``: green, red, blue and alpha, or less where that loses nothing.

    Without alpha there are three channels, or green alone if red and blue are 0 everywhere.
    """
    if alpha:
        return pixels[..., [2, 1, 3, 0]]
    return pixels[..., [2, 1, 3]] if pixels[..., 1].any() or pixels[..., 3].any() else pixels[..., 2:3]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def store_text(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, media``: each text as the samples of a WebP file.

    Null and empty texts are 64 zero bytes; equal texts give equal files.  A text of more than 1 GiB
    fits no image and fails the query.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        payloads = [padded(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array(encode_payloads(payloads), pa.binary()),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "media"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        fn,
        "doc_id long, n_bytes long, payload_bytes long, media binary",
    )


PIXELS = {"width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "pixels": pa.binary(), "problem": pa.string()}
PIXEL_FIELDS = from_arrow_schema(pa.schema(PIXELS))


def pixel_arrays(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with ``width, height, channels, pixels, problem``: the decoded samples, row by row.

    Samples are green, red, blue and, where the image uses it, alpha, or green alone.  Null media have nulls.  A
    broken stream has nulls too and a ``problem`` that names what is wrong; it is never skipped.
    Columns of these names that ``media`` already has are replaced, all others stay.
    """
    kept = media.select(*(c for c in media.columns if c == column or c not in PIXELS))
    at = kept.columns.index(column)
    schema = StructType([*kept.schema.fields, *PIXEL_FIELDS.fields])

    def row(found: tuple | Exception | None) -> tuple:
        if found is None:
            return None, None, None, None, None
        if isinstance(found, Exception):
            return None, None, None, None, str(found)
        samples = samples_of(*found)
        height, width, channels = samples.shape
        return width, height, channels, samples.tobytes(), None

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        streams = batch.column(at).to_pylist()
        found = iter(decode_all([m for m in streams if m is not None]))
        columns = zip(*(row(None if m is None else next(found)) for m in streams))
        extra = [pa.array(list(c), t) for c, t in zip(columns, PIXELS.values())]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *PIXELS])

    return map_batches(kept, fn, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every whole text as lossless WebP, read its pixels back, and digest what was read.

    Null and empty texts are 64 zero bytes.  Null and repeated ids: a row each.  Equal
    texts give equal values.  An empty table gives none.  A text of more than 1 GiB fits no image
    and fails the query.  Other columns are not read.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = {name: batch.column(name).to_pylist() for name in ("payload_bytes", "media", "width", "height", "channels", "pixels", "problem")}
        out: list[list] = [[], [], [], [], []]
        for n, media, width, height, channels, pixels, problem in zip(*row.values()):
            if problem is not None:
                raise ValueError(f"a stored text can't be read: {problem}")
            samples = np.frombuffer(pixels, np.uint8)
            read = pixels[:n]
            means = samples.reshape(-1, channels).mean(axis=0)
            shades = np.bincount(samples[:n] >> 4, minlength=16)
            out[0].append(hashlib.sha256(read).hexdigest())
            out[1].append(zlib.crc32(read[-UNIT:]))
            out[2].append(len(media))
            out[3].append(hashlib.sha256(media).hexdigest())
            out[4].append(f"{width}x{height};" + ",".join(f"{m:.3f}" for m in means) + ";" + ",".join(map(str, shades)))
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *(pa.array(x, t) for x, t in zip(out, types))], [*batch.schema.names[:3], *names]
        )

    return map_batches(
        pixel_arrays(store_text(docs)),
        fn,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string",
    )
