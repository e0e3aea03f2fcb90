"""Image inventory over PNGs written with zlib + struct."""

import os
import struct
import zlib

from quarry.operators import images as IM
from quarry.sources.images import image_inventory


def _png(path, w, h):
    raw = b"".join(b"\x00" + bytes([120, 30, 200]) * w for _ in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    data = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    with open(path, "wb") as f:
        f.write(data)


def test_image_inventory(spark, tmp_dir):
    for cls, sizes in {"cat": [(4, 3), (4, 3)], "dog": [(8, 5)]}.items():
        os.makedirs(f"{tmp_dir}/{cls}")
        for i, (w, h) in enumerate(sizes):
            _png(f"{tmp_dir}/{cls}/{i}.PNG", w, h)
    with open(f"{tmp_dir}/cat/notes.txt", "w") as f:
        f.write("not an image")
    inv = image_inventory(spark, tmp_dir)
    counts = {r["class"]: r["count"] for r in IM.class_counts(inv).collect()}
    assert counts == {"cat": 2, "dog": 1}
    s = IM.image_stats(inv).first()
    assert s["n_images"] == 3 and s["max_width"] == 8 and s["min_height"] == 3
    assert s["sizes_vary"] and s["formats"] == "PNG" and s["modes"] == "RGB"
