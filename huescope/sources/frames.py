"""Encoded frames as tables, and pixels out of them.

PNG and JPEG are decoded from bytes in the tasks that hold them, with EXIF
orientation applied before any coordinate means something.  Decoding,
cropping and scaling happen in one function, so that no full-size frame is
ever a row.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from . import jpeg

PIXELS = "image_id long, y int, x int, r8 int, g8 int, b8 int"
#: Fixed value: the tag that holds the orientation.
_ORIENTATION = 0x0112


class FrameError(ValueError):
    """The bytes are not a readable frame."""


def _unfilter(raw: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    """Bytes of the rows from what their filters left of them.

    A byte depends on those to the left, above and above left of it, so all
    bytes of one diagonal are worked out together, whatever their filters.
    """
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    kinds = lines[:, 0]
    if kinds.max(initial=0) > 4:
        raise FrameError("unknown filter")
    if not kinds.any():
        return lines[:, 1:].copy()
    width = stride // bpp
    left = np.zeros((height + 1, width + 1, bpp), np.int16)
    given = lines[:, 1:].reshape(height, width, bpp).astype(np.int16)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c, kind = left[y + 1, x], left[y, x + 1], left[y, x], kinds[y, None]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess = np.select((kind == 0, kind == 1, kind == 2, kind == 3), (np.zeros_like(a), a, b, (a + b) >> 1), nearest)
        left[y + 1, x + 1] = (given[y, x] + guess) & 255
    return left[1:, 1:].astype(np.uint8).reshape(height, stride)


def _samples(rows: np.ndarray, width: int, bands: int, depth: int) -> np.ndarray:
    """Samples (height, width, bands) of packed rows, as they are stored;
    of 16 bits the upper 8."""
    if depth == 8:
        return rows.reshape(len(rows), width, bands)
    if depth == 16:
        return rows.reshape(len(rows), width, bands, 2)[..., 0]
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)[:, : width * bands].reshape(len(rows), width, bands)


#: Fixed values: (first column, first row, column step, row step) of the seven passes of an interlaced frame.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _grid(raw: bytes, width: int, height: int, bands: int, depth: int, interlaced: bool) -> np.ndarray:
    bpp = max(bands * depth // 8, 1)
    stride = lambda w: (w * bands * depth + 7) // 8
    if not interlaced:
        return _samples(_unfilter(raw, height, stride(width), bpp), width, bands, depth)
    out, at = np.zeros((height, width, bands), np.uint8), 0
    for x, y, dx, dy in _PASSES:
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            size = h * (stride(w) + 1)
            out[y::dy, x::dx] = _samples(_unfilter(raw[at : at + size], h, stride(w), bpp), w, bands, depth)
            at += size
    return out


def _orientation(exif: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 8:
        return 1
    at = struct.unpack(order + "I", exif[4:8])[0]
    if at + 2 > len(exif):
        return 1
    for k in range(struct.unpack(order + "H", exif[at : at + 2])[0]):
        entry = exif[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == _ORIENTATION:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The frame as it was meant to be seen (orientation 1 to 8)."""
    if orientation in (2, 3, 7):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 5):
        pixels = pixels[::-1]
    turns = {5: -1, 6: -1, 7: -1, 8: 1}.get(orientation, 0)
    return np.rot90(pixels, turns) if turns else pixels


def decode_png(data: bytes) -> np.ndarray:
    """Upright 8-bit RGB of a PNG of any colour type and depth; of 16 bits
    the upper 8 count, transparency does not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FrameError("not a PNG")
    at, body, palette, exif, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise FrameError("truncated")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"eXIf":
            exif = chunk
        at += 12 + size
    if head is None or not body:
        raise FrameError("no picture")
    width, height, depth, color, _, _, interlaced = head
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    grid = _grid(zlib.decompress(b"".join(body)), width, height, bands, depth, bool(interlaced))
    if color == 3:
        return upright(palette[grid[..., 0]], _orientation(exif))
    if depth < 8:
        grid = grid * (255 // ((1 << depth) - 1))
    return upright(np.repeat(grid[..., :1], 3, 2) if bands < 3 else grid[..., :3], _orientation(exif))


def decode_frame(data: bytes) -> np.ndarray:
    """Upright 8-bit RGB of a PNG or JPEG; FrameError for anything else, for
    damaged and for truncated bytes."""
    try:
        if data[:2] == b"\xff\xd8":
            return upright(jpeg.decode(data), _orientation(jpeg.exif_of(data)))
        return decode_png(data)
    except FrameError:
        raise
    except Exception as e:  # whatever bytes from outside may do to a decoder
        raise FrameError(str(e) or type(e).__name__) from e


def encode_png(rgb: np.ndarray, exif: bytes = b"") -> bytes:
    """PNG bytes of an 8-bit RGB frame."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(height))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), *([chunk(b"eXIf", exif)] if exif else []), chunk(b"IDAT", zlib.compress(raw)), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


def _weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights of a triangle filter as wide as the step."""
    scale = n / m
    reach = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    w = np.maximum(1 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / reach, 0)
    return w / w.sum(1, keepdims=True)


def resize(rgb: np.ndarray, width: int, resample: str) -> np.ndarray:
    """To ``width``, height in proportion (rounded half to even, at least 1)."""
    height, have = rgb.shape[:2]
    if have == width:
        return rgb
    tall = max(int(round(height * width / have)), 1)
    if resample == "nearest":
        return rgb[((np.arange(tall) + 0.5) * height / tall).astype(int)][:, ((np.arange(width) + 0.5) * have / width).astype(int)]
    if resample != "bilinear":
        raise ValueError(f"unknown resample {resample}")
    across = np.rint(np.einsum("wn,hnc->hwc", _weights(have, width), rgb.astype(float)))
    return np.clip(np.rint(np.einsum("hn,nwc->hwc", _weights(height, tall), across)), 0, 255).astype(np.uint8)


def crop_box(roi: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """Pixel box of a relative rectangle, edges rounded half to even."""
    x, y, w, h = roi
    if min(x, y) < -1e-9 or max(x + w, y + h) > 1 + 1e-9:
        raise FrameError("region outside the frame")
    x0, y0, x1, y1 = (int(min(max(round(v * n), 0), n)) for v, n in ((x, width), (y, height), (x + w, width), (y + h, height)))
    if x1 <= x0 or y1 <= y0:
        raise FrameError("region without a pixel")
    return x0, y0, x1, y1


def working_frame(rgb: np.ndarray, roi=(0.0, 0.0, 1.0, 1.0), working_width: int | None = None, resample: str = "bilinear") -> np.ndarray:
    """The region of a frame, scaled to the working width."""
    x0, y0, x1, y1 = crop_box(roi, rgb.shape[1], rgb.shape[0])
    part = rgb[y0:y1, x0:x1]
    return part if working_width is None else resize(part, working_width, resample)


def relative(box: tuple[int, int, int, int], width: int, height: int) -> tuple[float, float, float, float]:
    """A pixel box as a relative rectangle."""
    x0, y0, x1, y1 = box
    return x0 / width, y0 / height, (x1 - x0) / width, (y1 - y0) / height


def polygon_raster(rings, crop: tuple[float, float, float, float], height: int, width: int) -> np.ndarray:
    """Which cells of a crop's grid have their centre in the even-odd region.

    ``rings``: lists of (x, y) in image coordinates.  A row's centres are
    inside where an odd number of edges cross the row to their right; an edge
    counts from its upper end up to, not including, its lower one.
    """
    x = crop[0] + (np.arange(width) + 0.5) / width * crop[2]
    y = crop[1] + (np.arange(height) + 0.5) / height * crop[3]
    inside = np.zeros((height, width), bool)
    for ring in rings:
        points = np.array(ring, float).reshape(-1, 2)
        for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0)):
            rows = np.flatnonzero((min(ay, by) <= y) & (y < max(ay, by)))
            if len(rows):
                inside[rows] ^= x[None, :] < (ax + (y[rows] - ay) * (bx - ax) / (by - ay))[:, None]
    return inside


PICTURES = "*.{png,PNG,jpg,JPG,jpeg,JPEG}"


def read_frames(spark: SparkSession, path: str, pattern: str = PICTURES) -> DataFrame:
    """Encoded frames: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def archive(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Names of archived frames; contents are not read."""
    return read_frames(spark, path, pattern).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"))


def frame_pixels(frames: DataFrame, roi=(0.0, 0.0, 1.0, 1.0), working_width: int | None = None, resample: str = "bilinear", rings=None) -> DataFrame:
    """Pixels of PNG or JPEG frames (image_id, content), with ``in_region``
    where the region has rings; a frame that cannot be read is one row with
    NULL coordinates, so that nothing fails the job and nothing is passed over
    in silence."""
    schema = PIXELS + (", in_region boolean" if rings is not None else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts):
        for part in parts:
            for r in part.itertuples():
                try:
                    whole = decode_frame(r.content)
                    box = crop_box(roi, whole.shape[1], whole.shape[0])
                    rgb = working_frame(whole, roi, working_width, resample)
                except FrameError:
                    yield pd.DataFrame({c: pd.array([r.image_id if c == "image_id" else None], dtype="boolean" if c == "in_region" else "Int64") for c in names})
                    continue
                y, x = np.indices(rgb.shape[:2])
                out = {"image_id": r.image_id, "y": y.ravel(), "x": x.ravel(), **{n: rgb[..., k].ravel().astype(np.int32) for k, n in enumerate(("r8", "g8", "b8"))}}
                if rings is not None:
                    out["in_region"] = polygon_raster(rings, relative(box, whole.shape[1], whole.shape[0]), *rgb.shape[:2]).ravel()
                yield pd.DataFrame(out)

    return frames.select("image_id", "content").mapInPandas(run, schema)


def _inside(rect: tuple, roi: tuple) -> tuple[float, float, float, float]:
    """An image rectangle in a region's own coordinates, cut at its edges."""
    (x, y, w, h), (rx, ry, rw, rh) = rect, roi
    x0, y0, x1, y1 = (x - rx) / rw, (y - ry) / rh, (x + w - rx) / rw, (y + h - ry) / rh
    x0, y0 = max(x0, 0.0), max(y0, 0.0)
    return x0, y0, min(x1, 1.0) - x0, min(y1, 1.0) - y0


MARKED = "bin_id string, image_id long, auto boolean, ord int, y int, x int, r8 int, g8 int, b8 int, error string"


def marked_pixels(frames: DataFrame, marks: DataFrame, working_width: int | None = None, resample: str = "bilinear") -> DataFrame:
    """Pixels under the marks of each frame (image_id, content), each mark on
    the grid of the region that it was drawn in.

    ``marks``: image_id, bin_id, auto, ord, rect, roi.  A frame meets its few
    marks by its id, and is decoded once, each of its marks' regions scaled
    once.  A mark without a pixel, or on a frame that cannot be read, is one
    row with its ``error``.
    """
    names = [c.split()[0] for c in MARKED.split(", ")]
    plain = lambda r: (r["x"], r["y"], r["w"], r["h"])

    def run(parts):
        for part in parts:
            for f in part.itertuples():
                grids, rows, whole, broken = {}, [], None, None
                try:
                    whole = decode_frame(f.content)
                except FrameError as e:
                    broken = str(e)
                for m in f.marks:
                    row = {"bin_id": m["bin_id"], "image_id": f.image_id, "auto": m["auto"], "ord": m["ord"]}
                    try:
                        if broken:
                            raise FrameError(broken)
                        roi = plain(m["roi"])
                        if roi not in grids:
                            grids[roi] = working_frame(whole, roi, working_width, resample)
                        rgb = grids[roi]
                        x0, y0, x1, y1 = crop_box(_inside(plain(m["rect"]), roi), rgb.shape[1], rgb.shape[0])
                    except FrameError as e:
                        rows.append(pd.DataFrame([row | {"error": str(e)}], columns=names))
                        continue
                    y, x = (a.ravel() for a in np.mgrid[y0:y1, x0:x1])
                    rows.append(pd.DataFrame(row | {"y": y, "x": x, **{n: rgb[y, x, k].astype(int) for k, n in enumerate(("r8", "g8", "b8"))}}, columns=names))
                if rows:
                    yield pd.concat(rows, ignore_index=True).astype({c: "Int64" for c in ("y", "x", "r8", "g8", "b8")} | {"error": object, "bin_id": object})

    few = marks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("bin_id", "auto", "ord", "rect", "roi"))).alias("marks"))
    return frames.select("image_id", "content").join(few, "image_id").mapInPandas(run, MARKED)


def scene(size=(320, 200), rects=(), grey: float = 0.5, noise: float = 0.02, seed: int = 0) -> np.ndarray:
    """A synthetic frame: coloured rectangles ((r, g, b), (x, y, w, h)) on
    noisy grey, noise everywhere."""
    width, height = size
    frame = np.full((height, width, 3), grey)
    for rgb, (x, y, w, h) in rects:
        frame[round(y * height) : round((y + h) * height), round(x * width) : round((x + w) * width)] = rgb
    frame += np.random.default_rng(seed).normal(0, noise, frame.shape)
    return np.rint(np.clip(frame, 0, 1) * 255).astype(np.uint8)


def write_frames(frames: DataFrame, folder: str) -> int:
    """Archive encoded frames (name, content) as files of their own name in a
    folder that all executors share; how many there were.

    Each file is written under another name and then renamed, so a task that
    is repeated, or a frame that is archived again, replaces a whole file by
    an equal one.  Names that are no plain file names are an error, before
    anything is written.
    """
    bad = frames.where(~F.coalesce(geometry.is_plain_filename(F.col("name")), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("a frame's name is not a plain file name")
    target = folder.removeprefix("file://")
    if "://" in target:
        raise ValueError("frames are archived in a folder that executors reach as a path")

    def run(parts):
        os.makedirs(target, exist_ok=True)
        for part in parts:
            for r in part.itertuples():
                draft = os.path.join(target, f".{uuid.uuid4().hex}")
                with open(draft, "wb") as f:
                    f.write(r.content)
                os.replace(draft, os.path.join(target, r.name))
            yield pd.DataFrame({"n": [len(part)]})

    return frames.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def to_result_json(result: Column) -> Column:
    """A result struct as JSON, unrounded, NULLs kept."""
    return F.to_json(result, {"ignoreNullFields": "false"})
