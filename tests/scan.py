"""A synthetic scan with known truth: dark rings in focus at their own depth, on a tiled grid, with a bright glass plane."""

import io
import struct
import zipfile

import numpy as np

from stackmeter.sources import group, tiff

DEPTH, HEIGHT, WIDTH = 20, 96, 128


def objects(n=6, seed=4, width=WIDTH, height=HEIGHT):
    rng = np.random.default_rng(seed)
    placed = []
    while len(placed) < n:
        x, y, z, r = rng.uniform(18, width - 18), rng.uniform(18, height - 18), rng.integers(4, 12), rng.uniform(7, 9)
        if all(np.hypot(x - a, y - b) > 34 for a, b, _, _ in placed):
            placed.append((x, y, float(z), r))
    return placed


def frame(placed, z, width=WIDTH, height=HEIGHT, glass=17, seed=0):
    """A slice: rings sharp at their own depth and fading away from it; texture on the glass."""
    yy, xx = np.mgrid[:height, :width]
    a = np.full((height, width), 180.0)
    for x, y, z0, r in placed:
        blur = 1.0 + 0.8 * abs(z - z0)
        a -= 110 / blur * np.exp(-((np.hypot(xx - x, yy - y) - r) ** 2) / (2 * (1.2 * blur) ** 2))
    rng = np.random.default_rng(seed + 99)
    a += rng.normal(0, 30, a.shape) * np.exp(-((z - glass) ** 2) / 2) + rng.normal(0, 0.3, a.shape)
    return np.clip(a, 0, 255)


def group_file(stacks, rows, columns, depth=DEPTH):
    """The bytes of a group file; ``stacks`` is {name: (row, column)}."""

    def short(text):
        raw = text.encode()
        out, n = b"", len(raw)
        while n >= 0x80:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n]) + raw

    bits = lambda v: struct.unpack("<q", struct.pack("<d", v))[0]
    listed = [(s, z, r, c) for s, (r, c) in stacks.items() for z in range(depth)]
    binary = struct.pack("<I", len(listed)) + b"".join(short("CH1") + struct.pack("<4i", 0, z, r, c) + short(f"{s}_Z{z + 1:03d}_CH1.tif") + struct.pack("<d", 100.0 - abs(z - 17)) for s, z, r, c in listed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr(group.STACK, f"<p><Pitch>100</Pitch><TotalNumber>{depth}</TotalNumber></p>")
        f.writestr(group.LENS, f"<p><Magnification>400</Magnification><LensName>Plan 4x: PlanApo 4x 0.20</LensName><NumericalAperture>{bits(0.2)}</NumericalAperture></p>")
        f.writestr(group.IMAGE, "<p><Calibration>4660518447848644499</Calibration></p>")
        f.writestr(group.JOINT, f"<p><Enabled>True</Enabled><Row>{rows}</Row><Column>{columns}</Column></p>")
        f.writestr(group.FILE_LIST, binary)
        f.writestr(group.EDGE_POINT.format(0), "<p><X>1</X><Y>2</Y><Z>3</Z></p>")
        f.writestr(group.EDGE_POINT.format(1), "<p><X>0</X><Y>0</Y><Z>0</Z></p>")
    return out.getvalue()


def write(root, stacks=None):
    """A scan folder with two tiles of three slices and a group file."""
    stacks = stacks or {"4x_00009": (0, 0), "4x_00010": (0, 1)}
    for n, s in enumerate(stacks):
        folder = root / s
        folder.mkdir()
        for z in range(3):
            note = f"<?xml version='1.0'?><p><StageLocationX>{1000 * n}</StageLocationX><StageLocationY>5</StageLocationY><StageLocationZ>{z}</StageLocationZ></p>" if z != 1 else None
            (folder / f"{s}_Z{z + 1:03d}_CH1.tif").write_bytes(tiff.encode(np.full((6, 8), 10 * n + z, dtype=np.uint8), note))
    (root / "scan.gci").write_bytes(group_file(stacks, 1, len(stacks), 3))
