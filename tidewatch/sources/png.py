"""PNG images as arrays: what radar frames come in, without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples to a pixel by colour type: grey, colour, palette, grey with alpha, colour with alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(data: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Bytes of the rows; each row was written as differences from its left, upper and upper left neighbours."""
    raw = np.frombuffer(data, np.uint8)[: rows * (width + 1)].reshape(rows, width + 1)
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for k in range(rows):
        kind, row = int(raw[k, 0]), raw[k, 1:]
        if kind == 0:
            out[k] = row
        elif kind == 2:
            out[k] = row + above
        elif kind == 1:
            out[k] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        else:
            made, up = bytearray(row.tobytes()), above.tolist()
            for i in range(width):
                left, corner = (made[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                made[i] = (made[i] + guess) & 255
            out[k] = np.frombuffer(bytes(made), np.uint8)
        above = out[k]
    return out


def decode(image: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(colours, alpha) of an image in any of PNG's colour types; None if it can't be read or is interlaced."""
    if not image or not image.startswith(MAGIC):
        return None
    try:
        at, parts = len(MAGIC), {}
        while at + 8 <= len(image):
            size, name = struct.unpack(">I4s", image[at : at + 8])
            parts[name] = parts.get(name, b"") + image[at + 8 : at + 8 + size]
            at += size + 12
        width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        samples = SAMPLES[kind]
        if interlaced or depth == 16:
            return None
        rows = _unfilter(zlib.decompress(parts[b"IDAT"]), height, -(-width * samples * depth // 8), max(1, samples * depth // 8))
        if depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
            rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
            rows = rows if kind == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
        pixels = rows[:, : width * samples].reshape(height, width, samples)
        opaque = np.full((height, width), 255, np.uint8)
        if kind == 3:
            palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
            alphas = np.full(len(palette), 255, np.uint8)
            given = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
            alphas[: len(given)] = given
            return palette[pixels[:, :, 0]], alphas[pixels[:, :, 0]]
        colours = np.repeat(pixels[:, :, :1], 3, axis=2) if samples < 3 else pixels[:, :, :3]
        return colours, (pixels[:, :, -1] if samples in (2, 4) else opaque)
    except (KeyError, ValueError, IndexError, struct.error, zlib.error):
        return None


def encode(pixels: np.ndarray) -> bytes:
    """An image of (rows, columns, 4) bytes: colours and alpha."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
