"""JPEG frames decoded from bytes: sequential and progressive, 8 bits.

Written for the tasks that hold encoded frames as column values, so a frame
never has to be a file again.  Entropy decoding is a loop over symbols; all
that follows (dequantisation, inverse cosine transform, upsampling, colours)
is array arithmetic over the whole frame.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: The order in which a block's 64 coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_AHEAD = 64  # zero bytes that may be read past the end of a scan's data


class JpegError(ValueError):
    """The bytes are not a readable JPEG."""


class _Table:
    """A Huffman code: for each 16 bits ahead, code length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol, code, at = [0] * 65536, [0] * 65536, 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                span = 1 << (16 - n)
                first = code << (16 - n)
                if first + span > 65536:
                    raise JpegError("bad Huffman table")
                self.length[first : first + span] = [n] * span
                self.symbol[first : first + span] = [symbols[at]] * span
                code, at = code + 1, at + 1
            code <<= 1


class _Bits:
    """Bits of one restart interval, stuffing removed."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        self.most = 8 * len(data) + 8 * _AHEAD
        padded = data + bytes(_AHEAD + 8 - len(data) % 4)
        self.words = struct.unpack(f">{len(padded) // 4}I", padded[: len(padded) // 4 * 4])
        self.at, self.held, self.n = 0, 0, 0

    def _more(self) -> None:
        if self.at >= len(self.words):
            raise JpegError("truncated")
        self.held = (self.held & ((1 << self.n) - 1)) << 32 | self.words[self.at]
        self.at += 1
        self.n += 32

    def symbol(self, table: _Table) -> int:
        if self.n < 16:
            self._more()
        ahead = (self.held >> (self.n - 16)) & 0xFFFF
        length = table.length[ahead]
        if not length:
            raise JpegError("bad code")
        self.n -= length
        return table.symbol[ahead]

    def take(self, count: int) -> int:
        if self.n < count:
            self._more()
        self.n -= count
        return (self.held >> self.n) & ((1 << count) - 1)

    def signed(self, count: int) -> int:
        """A value of ``count`` bits; those with a leading 0 are negative."""
        if not count:
            return 0
        v = self.take(count)
        return v if v >> (count - 1) else v - (1 << count) + 1


class _Component:
    """One colour plane: its sampling, tables and coefficients."""

    def __init__(self, name: int, h: int, v: int, quant: int):
        self.name, self.h, self.v, self.quant = name, h, v, quant
        self.dc = self.ac = None
        self.before = 0

    def sized(self, width: int, height: int, most_h: int, most_v: int) -> None:
        self.width, self.height = -(-width * self.h // most_h), -(-height * self.v // most_v)
        self.across, self.down = -(-self.width // 8), -(-self.height // 8)  # blocks of a scan of its own
        mcus = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        self.stride, self.rows = mcus[0] * self.h, mcus[1] * self.v
        self.blocks = [[0] * 64 for _ in range(self.stride * self.rows)]


class _Scan:
    """Decodes one scan into its components' blocks."""

    def __init__(self, start: int, end: int, high: int, low: int, progressive: bool):
        self.start, self.end, self.low, self.run = start, end, low, 0
        if not progressive:
            self.block = self._whole
        elif start == 0:
            self.block = self._dc_refined if high else self._dc_first
        else:
            self.block = self._ac_refined if high else self._ac_first

    def _whole(self, bits: _Bits, c: _Component, block: list[int]) -> None:
        c.before += bits.signed(bits.symbol(c.dc))
        block[0] = c.before
        k, ac, symbol, signed = 1, c.ac, bits.symbol, bits.signed
        while k < 64:
            s = symbol(ac)
            size = s & 15
            if size:
                k += s >> 4
                if k > 63:
                    raise JpegError("bad run")
                block[k] = signed(size)
                k += 1
            elif s == 0xF0:
                k += 16
            else:
                return

    def _dc_first(self, bits: _Bits, c: _Component, block: list[int]) -> None:
        c.before += bits.signed(bits.symbol(c.dc))
        block[0] = c.before << self.low

    def _dc_refined(self, bits: _Bits, c: _Component, block: list[int]) -> None:
        block[0] |= bits.take(1) << self.low

    def _ac_first(self, bits: _Bits, c: _Component, block: list[int]) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.start
        while k <= self.end:
            s = bits.symbol(c.ac)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > 63:
                    raise JpegError("bad run")
                block[k] = bits.signed(size) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.run = (1 << run) - 1 + (bits.take(run) if run else 0)
                return

    def _ac_refined(self, bits: _Bits, c: _Component, block: list[int]) -> None:
        one, k = 1 << self.low, self.start

        def corrected(k: int) -> None:
            if bits.take(1) and not abs(block[k]) & one:
                block[k] += one if block[k] > 0 else -one

        while not self.run and k <= self.end:
            s = bits.symbol(c.ac)
            zeros, size = s >> 4, s & 15
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                self.run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            while k <= self.end:
                if block[k]:
                    corrected(k)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = value
                    k += 1
                    break
                k += 1
        if self.run:
            for k in range(k, self.end + 1):
                if block[k]:
                    corrected(k)
            self.run -= 1

    def read(self, data: bytes, parts: list[_Component], interval: int) -> None:
        """All blocks of the scan, interval by interval."""
        if len(parts) == 1:
            c = parts[0]
            order = [(c, y * c.stride + x) for y in range(c.down) for x in range(c.across)]
            unit = 1
        else:
            c = parts[0]
            order = []
            for my in range(c.rows // c.v):
                for mx in range(c.stride // c.h):
                    for c in parts:
                        for y in range(my * c.v, (my + 1) * c.v):
                            order += [(c, y * c.stride + x) for x in range(mx * c.h, (mx + 1) * c.h)]
                c = parts[0]
            unit = sum(c.h * c.v for c in parts)
        pieces = _RESTART.split(data) if interval else [data]
        each = interval * unit if interval else len(order)
        if interval and len(pieces) < -(-len(order) // each):
            raise JpegError("truncated")
        for n, at in enumerate(range(0, len(order), each)):
            bits, self.run = _Bits(pieces[n]), 0
            for c in parts:
                c.before = 0
            for c, i in order[at : at + each]:
                self.block(bits, c, c.blocks[i])
            if 32 * bits.at - bits.n > bits.most - 8 * _AHEAD + 16:
                raise JpegError("truncated")


def _cosines() -> np.ndarray:
    k, x = np.mgrid[:8, :8]
    return np.where(k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))


def _plane(c: _Component, quant: np.ndarray) -> np.ndarray:
    """The component's samples, 0 to 255."""
    stored = np.array(c.blocks, np.int64) * quant[None, :]
    natural = np.zeros(stored.shape)
    natural[:, ZIGZAG] = stored
    basis = _cosines()
    samples = basis.T @ natural.reshape(-1, 8, 8) @ basis
    samples = np.clip(np.rint(samples) + 128, 0, 255).astype(np.int32)
    whole = samples.reshape(c.rows, c.stride, 8, 8).swapaxes(1, 2).reshape(8 * c.rows, 8 * c.stride)
    return whole[: c.height, : c.width]


def _between(a: np.ndarray, axis: int, unit: int, early: int, late: int) -> np.ndarray:
    """Twice as many samples along an axis, each three parts of its nearest
    and one of the next; the outermost ones only of their nearest."""
    a = np.moveaxis(a, axis, -1)
    before, after = np.concatenate((a[..., :1], a[..., :-1]), -1), np.concatenate((a[..., 1:], a[..., -1:]), -1)
    out = np.stack((3 * a + before + early, 3 * a + after + late), -1).reshape(*a.shape[:-1], -1) >> unit
    return np.moveaxis(out, -1, axis)


def _stretched(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """To full size by smooth interpolation for factors of two, else by
    repeating samples."""
    if (across, down) == (2, 1) and plane.shape[1] > 2:
        return _between(plane, 1, 2, 1, 2)
    if (across, down) == (2, 2) and plane.shape[1] > 2:
        return _between(_between(plane, 0, 0, 0, 0), 1, 4, 8, 7)
    return plane.repeat(down, 0).repeat(across, 1)


def _segments(data: bytes):
    """(marker, body, position after it) up to the end of the image."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise JpegError("truncated")
        yield marker, body, at + 2 + size
        at += 2 + size


def exif_of(data: bytes) -> bytes:
    """The TIFF part of the frame's EXIF data, empty if it has none."""
    for marker, body, _ in _segments(data):
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        if marker == 0xDA:
            break
    return b""


def decode(data: bytes) -> np.ndarray:
    """8-bit RGB as it is stored, EXIF orientation not applied."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    quants: dict[int, np.ndarray] = {}
    codes: dict[int, _Table] = {}
    parts: dict[int, _Component] = {}
    interval, adobe, progressive, size, seen = 0, None, False, None, 0
    for marker, body, after in _segments(data):
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quants[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while len(body) > 16:
                n = sum(body[1:17])
                codes[body[0]] = _Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            depth, height, width, count = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not height or not width or count not in (1, 3, 4):
                raise JpegError("only 8-bit frames of 1, 3 or 4 components are read")
            progressive, size = marker == 0xC2, (width, height)
            for k in range(count):
                name, sampling, quant = body[6 + 3 * k : 9 + 3 * k]
                parts[name] = _Component(name, sampling >> 4, sampling & 15, quant)
            most_h, most_v = (max(getattr(c, a) for c in parts.values()) for a in ("h", "v"))
            if not all(c.h and c.v for c in parts.values()):
                raise JpegError("bad sampling")
            for c in parts.values():
                c.sized(width, height, most_h, most_v)
        elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("lossless, hierarchical and arithmetic frames are not read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            if size is None:
                raise JpegError("scan without a frame")
            mine = []
            for k in range(body[0]):
                name, use = body[1 + 2 * k : 3 + 2 * k]
                c = parts[name]
                c.dc, c.ac = codes.get(use >> 4), codes.get(16 | use & 15)
                mine.append(c)
            start, end, approx = body[-3:]
            stop = after
            while True:  # the scan's data end at the first marker that is no restart
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    raise JpegError("truncated")
                if data[stop + 1] != 0 and not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                stop += 2
            _Scan(start, end, approx >> 4, approx & 15, progressive).read(data[after:stop], mine, interval)
            seen += 1
    if not seen:
        raise JpegError("no picture")
    width, height = size
    planes = [_stretched(_plane(c, quants[c.quant]), most_h // c.h, most_v // c.v)[:height, :width] for c in parts.values()]
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
    named_rgb = list(parts) == [82, 71, 66]
    plain = adobe == 0 if adobe is not None else named_rgb or len(planes) == 4
    rgb = np.stack(planes[:3], 2).astype(float)
    if not plain:
        y, cb, cr = rgb[..., 0], rgb[..., 1] - 128, rgb[..., 2] - 128
        rgb = np.stack((y + np.rint(1.402 * cr), y + np.rint(-0.344136286 * cb - 0.714136286 * cr), y + np.rint(1.772 * cb)), 2)
        rgb = np.clip(rgb, 0, 255)
    if len(planes) == 4:  # four inks; the usual writer stores them inverted
        ink = np.concatenate((255 - rgb if not plain and adobe is None else rgb, planes[3][..., None]), 2)
        light = ink if adobe is not None else 255 - ink
        rgb = np.rint(light[..., :3] * light[..., 3:] / 255)
    return rgb.astype(np.uint8)
