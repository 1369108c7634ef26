"""Uncompressed baseline TIFF: decoding of 8- and 16-bit grey and RGB, private notes, and a small writer."""

from __future__ import annotations

import struct

import numpy as np

# Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, STRIP_BYTES, EXIF, NOTE = 256, 257, 258, 259, 273, 277, 279, 34665, 37500
NOTE_MARK, NOTE_XML = b"KmsFile", 0x0800
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 12: 8}
_FORMATS = {1: "B", 3: "H", 4: "I"}


def directory(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, int]]:
    """``{tag: (type, count, place of the value)}`` of the directory at ``at``."""
    out = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        base = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, base)
        size = _SIZES.get(kind, 1) * count
        place = base + 8 if size <= 4 else struct.unpack_from(order + "I", data, base + 8)[0]
        out[tag] = (kind, count, place)
    return out


def _values(data: bytes, entry: tuple[int, int, int], order: str) -> tuple[int, ...]:
    kind, count, place = entry
    return struct.unpack_from(f"{order}{count}{_FORMATS[kind]}", data, place)


def opened(data: bytes) -> tuple[str, dict[int, tuple[int, int, int]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    return order, directory(data, struct.unpack_from(order + "I", data, 4)[0], order)


def decode(data: bytes) -> np.ndarray:
    """The first page as uint8 (height, width): colours are averaged, deeper pixels truncated."""
    order, tags = opened(data)
    one = lambda t, default=None: _values(data, tags[t], order)[0] if t in tags else default
    if one(COMPRESSION, 1) != 1:
        raise ValueError("compressed TIFF files are not supported")
    h, w, bits, samples = one(HEIGHT), one(WIDTH), one(BITS, 8), one(SAMPLES, 1)
    raw = b"".join(data[o : o + n] for o, n in zip(_values(data, tags[OFFSETS], order), _values(data, tags[STRIP_BYTES], order), strict=True))
    a = np.frombuffer(raw, dtype=np.dtype("u1" if bits == 8 else order + "u2"))[: h * w * samples].reshape(h, w, samples)
    return (a.mean(axis=2) if samples > 1 else a[:, :, 0]).astype(np.uint8)


def frame_note(data: bytes) -> str | None:
    """The XML text in a frame's private note; offsets in the note count from the start of the file."""
    order, tags = opened(data)
    if EXIF not in tags:
        return None
    inner = directory(data, _values(data, tags[EXIF], order)[0], order)
    if NOTE not in inner:
        return None
    _, count, place = inner[NOTE]
    note = data[place : place + count]
    if not note.startswith(NOTE_MARK):
        return None
    for tag, (_, size, at) in _note_entries(note).items():
        if tag == NOTE_XML:
            found = data[at : at + size].find(b"<?xml")
            return data[at + found : at + size].decode("utf-8", "replace") if found >= 0 else None
    return None


def _note_entries(note: bytes) -> dict[int, tuple[int, int, int]]:
    (n,) = struct.unpack_from("<H", note, 8)
    rows = (struct.unpack_from("<HHII", note, 10 + 12 * k) for k in range(n))
    return {tag: (kind, count, at) for tag, kind, count, at in rows}


def encode(a: np.ndarray, note_xml: str | None = None) -> bytes:
    """A little-endian TIFF of a uint8 array, with a private note if asked for (for fixtures)."""
    h, w = a.shape
    head, pixels = 8, a.astype(np.uint8).tobytes()
    tags = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, 1), (262, 3, 1, 1), (OFFSETS, 4, 1, head), (SAMPLES, 3, 1, 1), (278, 4, 1, h), (STRIP_BYTES, 4, 1, len(pixels))]
    at = head + len(pixels) + len(pixels) % 2
    tail = b""
    if note_xml is not None:
        exif = at + 2 + 12 * (len(tags) + 1) + 4
        note_at, xml = exif + 18, note_xml.encode()
        note = (NOTE_MARK + b"\0")[:8] + struct.pack("<H", 1) + struct.pack("<HHII", NOTE_XML, 7, len(xml), note_at + 22)
        tags.append((EXIF, 4, 1, exif))
        tail = struct.pack("<HHHII", 1, NOTE, 7, len(note), note_at) + struct.pack("<I", 0) + note + xml
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, at) + pixels + b"\0" * (len(pixels) % 2) + body + tail
