"""Decoding against the JVM's own decoder, which also writes the fixtures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from huescope.sources import frames, jpeg

from .test_learning import SPOTS, picture


def jvm_image(spark, rgb):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(rgb.shape[1], rgb.shape[0], 1)
    packed = (rgb.astype(np.int64) << np.array([16, 8, 0])).sum(2)
    for y in range(rgb.shape[0]):
        row = spark.sparkContext._gateway.new_array(jvm.int, rgb.shape[1])
        for x, v in enumerate(packed[y].tolist()):
            row[x] = v
        image.setRGB(0, y, rgb.shape[1], 1, row, 0, rgb.shape[1])
    return image


def jvm_encoded(spark, rgb, path, kind="jpg", progressive=False, quality=0.9):
    """Bytes of the frame by the JVM's writer."""
    jvm = spark._jvm
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    param = writer.getDefaultWriteParam()
    if kind == "jpg":
        param.setCompressionMode(2)
        param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(jvm_image(spark, rgb), None, None), param)
    out.close()
    return path.read_bytes()


def jvm_decoded(spark, path):
    r = spark.read.format("image").load(str(path)).select("image.*").first()
    return np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)[..., ::-1]


def smooth(height, width, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    waves = [128 + 90 * np.sin(x / rng.uniform(5, 30) + y / rng.uniform(5, 30) + rng.uniform(0, 6)) for _ in range(3)]
    return np.clip(np.stack(waves, 2) + rng.normal(0, 3, (height, width, 3)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("shape", [(40, 56), (33, 49), (8, 8), (1, 1), (5, 70)])
def test_jpegs_equal_the_jvms_decoder(spark, tmp_path, shape, progressive):
    for quality in (0.35, 0.95):
        data = jvm_encoded(spark, smooth(*shape), tmp_path / f"a{quality}.jpg", progressive=progressive, quality=quality)
        got, want = frames.decode_frame(data).astype(int), jvm_decoded(spark, tmp_path / f"a{quality}.jpg").astype(int)
        assert got.shape == want.shape == (*shape, 3)
        assert np.abs(got - want).max() <= 4 and np.abs(got - want).mean() <= (0.7 if got.size > 300 else 1)


def exif(orientation, order="<"):
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0) + bytes(4)
    return tiff


def with_exif(data, tiff):
    body = b"Exif\0\0" + tiff
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]


#: How a stored frame looks for each orientation, from the upright one.
STORED = {
    1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.swapaxes(0, 1),
    6: lambda a: np.rot90(a, 1), 7: lambda a: a[::-1, ::-1].swapaxes(0, 1), 8: lambda a: np.rot90(a, -1),
}


@pytest.mark.parametrize("orientation", range(1, 9))
def test_all_orientations_of_both_formats(spark, tmp_path, orientation):
    upright = np.zeros((48, 32, 3), np.uint8)
    upright[:16, :16], upright[:16, 16:], upright[32:, :16] = (230, 20, 20), (20, 200, 20), (20, 20, 220)
    stored = np.ascontiguousarray(STORED[orientation](upright))
    for order in "<>":
        data = with_exif(jvm_encoded(spark, stored, tmp_path / "a.jpg", quality=1.0), exif(orientation, order))
        assert np.abs(frames.decode_frame(data).astype(int)[4:-4:8, 4:-4:8] - upright[4:-4:8, 4:-4:8]).max() < 12
        assert (frames.decode_frame(frames.encode_png(stored, exif(orientation, order))) == upright).all()


def png(rows, width, height, depth, color, interlaced=0, palette=None, kinds=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(grid, rng):
    """PNG rows with a filter drawn for each, by its definition."""
    height, width, bpp = grid.shape
    out = b""
    flat = grid.reshape(height, -1).astype(int)
    for y in range(height):
        kind = int(rng.integers(0, 5))
        line = []
        for i, v in enumerate(flat[y]):
            a = flat[y, i - bpp] if i >= bpp else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - bpp] if y and i >= bpp else 0
            p = a + b - c
            near = min(((abs(p - q), k, q) for k, q in enumerate((a, b, c))))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
    return out


def test_png_filters_depths_and_interlacing(spark, tmp_path):
    rng = np.random.default_rng(5)
    for bands, color in ((3, 2), (4, 6), (1, 0), (2, 4)):
        grid = rng.integers(0, 256, (17, 23, bands), dtype=np.uint8)
        want = grid[..., :3] if bands > 2 else np.repeat(grid[..., :1], 3, 2)
        assert (frames.decode_frame(png(filtered(grid, rng), 23, 17, 8, color)) == want).all()
        wide = np.stack((grid, rng.integers(0, 256, grid.shape, dtype=np.uint8)), -1).reshape(17, 23, -1)
        assert (frames.decode_frame(png(filtered(wide, rng), 23, 17, 16, color)) == want).all()
        passes = b"".join(filtered(grid[y::dy, x::dx], rng) for x, y, dx, dy in frames._PASSES if grid[y::dy, x::dx].size)
        assert (frames.decode_frame(png(passes, 23, 17, 8, color, 1)) == want).all()
    for depth in (1, 2, 4):
        grid = rng.integers(0, 1 << depth, (5, 11), dtype=np.uint8)
        bits = (grid[..., None] >> np.arange(depth)[::-1]) & 1
        rows = b"".join(b"\0" + np.packbits(r.ravel()).tobytes() for r in bits)
        assert (frames.decode_frame(png(rows, 11, 5, depth, 0))[..., 0] == grid * (255 // ((1 << depth) - 1))).all()
        palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        assert (frames.decode_frame(png(rows, 11, 5, depth, 3, palette=palette.tobytes())) == palette[grid]).all()
    data = jvm_encoded(spark, smooth(20, 31), tmp_path / "a.png", "png")
    assert (frames.decode_frame(data) == smooth(20, 31)).all()


def test_damaged_frames_are_errors_and_rows(spark, tmp_path):
    good = jvm_encoded(spark, smooth(40, 40), tmp_path / "a.jpg")
    bad = [b"", b"\xff\xd8", good[:40], good[: len(good) // 2], b"GIF89a", good[:2] + b"\xff\xd9"]
    for data in bad:
        with pytest.raises(frames.FrameError):
            frames.decode_frame(data)
    rng = np.random.default_rng(2)
    for _ in range(60):  # whatever is wrong with the bytes, no other error
        spoilt = bytearray(good)
        for _ in range(int(rng.integers(1, 20))):
            spoilt[int(rng.integers(2, len(spoilt)))] = int(rng.integers(0, 256))
        try:
            frames.decode_frame(bytes(spoilt))
        except frames.FrameError:
            pass
    rows = [(i, bytearray(b)) for i, b in enumerate([good, *bad])]
    got = {r.image_id: r.n for r in frames.frame_pixels(spark.createDataFrame(rows, "image_id long, content binary")).groupBy("image_id").agg(F.count("y").alias("n")).collect()}
    assert got == {0: 1600, **dict.fromkeys(range(1, len(rows)), 0)}


def test_archived_frames_are_files(spark, tmp_path):
    rows = [("a.jpg", bytearray(b"one")), ("b.jpg", bytearray(b"two"))]
    table = spark.createDataFrame(rows, "name string, content binary")
    for _ in range(2):
        assert frames.write_frames(table.repartition(2), f"file://{tmp_path}/arch") == 2
    assert {p.name: p.read_bytes() for p in (tmp_path / "arch").iterdir()} == {"a.jpg": b"one", "b.jpg": b"two"}
    assert sorted(r.path for r in frames.archive(spark, str(tmp_path / "arch")).collect()) == ["a.jpg", "b.jpg"]
    for name in ("../x", "a/b", "", ".."):
        with pytest.raises(ValueError):
            frames.write_frames(spark.createDataFrame([(name, bytearray(b"x"))], "name string, content binary"), str(tmp_path))


def test_a_scene_survives_as_jpeg(spark, tmp_path):
    data = jvm_encoded(spark, picture(SPOTS, 0), tmp_path / "a.jpg", quality=0.95)
    small = frames.working_frame(frames.decode_frame(data), (0.25, 0.25, 0.5, 0.5), 80)
    want = frames.working_frame(picture(SPOTS, 0), (0.25, 0.25, 0.5, 0.5), 80)
    assert small.shape == want.shape and np.abs(small.astype(int) - want).mean() < 4
    assert jpeg.exif_of(data) == b""
