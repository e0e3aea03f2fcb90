"""Sizes read from header bytes: all formats, damaged files and one listing."""

import os
import struct
import zlib

import pytest

from quarry.operators import images as IM
from quarry.sources import images as SI


def png(w, h, kind=2, depth=8):
    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + b"rest"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\xf7\0\0" + b"x" * 8


def bmp(w, h, bits=24):
    return b"BM" + struct.pack("<IHHI", 99, 0, 0, 54) + struct.pack("<IiiHH", 40, w, h, 1, bits) + b"\0" * 24


def old_bmp(w, h):
    return b"BM" + struct.pack("<IHHI", 99, 0, 0, 26) + struct.pack("<IHHHH", 12, w, h, 1, 8) + b"\0" * 24


def jpeg(w, h, channels=3, before=b"", marker=0xC0):
    segment = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    frame = segment(marker, struct.pack(">BHHB", 8, h, w, channels) + b"\1\x11\0" * channels)
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + before + frame + segment(0xDA, b"\0" * 6) + b"data\xff\xd9"


def tiff(w, h, samples=3, big=False, long=False, where=0):
    e = ">" if big else "<"
    value = lambda v: struct.pack(e + "I", v) if long else struct.pack(e + "HH", v, 0)
    kind = 4 if long else 3
    entries = [(256, kind, 1, value(w)), (257, kind, 1, value(h)), (258, 3, 3, struct.pack(e + "I", 8)), (262, 3, 1, struct.pack(e + "HH", 2, 0)),
               (277, 3, 1, struct.pack(e + "HH", samples, 0))]
    body = struct.pack(e + "H", len(entries)) + b"".join(struct.pack(e + "HHI", *x[:3]) + x[3] for x in entries) + b"\0" * 4
    return (b"MM\0*" if big else b"II*\0") + struct.pack(e + "I", 12 + where) + struct.pack(e + "HH", 8, 8) + b"\7" * where + body


def riff(body):
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def webp_lossy(w, h):
    return riff(b"VP8 " + struct.pack("<I", 30) + b"\x30\1\0\x9d\x01\x2a" + struct.pack("<HH", w | 0x4000, h) + b"\0" * 20)


def webp_lossless(w, h, alpha=0):
    return riff(b"VP8L" + struct.pack("<I", 30) + b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | alpha << 28) + b"\0" * 20)


def webp_extended(w, h, alpha=0):
    return riff(b"VP8X" + struct.pack("<I", 10) + bytes([16 * alpha, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))


EXIF = b"\xff\xe1" + struct.pack(">H", 65000) + b"\xff\xc0" * 32499  # looks like frame headers inside
GOOD = {
    "a.png": (png(4, 3), 4, 3, "RGB"), "grey.png": (png(70000, 1, 0), 70000, 1, "L"), "p.PNG": (png(5, 6, 3), 5, 6, "P"),
    "bit.png": (png(9, 8, 0, 1), 9, 8, "1"), "rgba.png": (png(9, 7, 6), 9, 7, "RGBA"), "la.png": (png(2, 7, 4), 2, 7, "LA"),
    "g.gif": (gif(300, 200), 300, 200, "P"), "b.bmp": (bmp(31, -17), 31, 17, "RGB"), "b32.bmp": (bmp(1, 2, 32), 1, 2, "RGBA"),
    "old.bmp": (old_bmp(640, 480), 640, 480, "P"), "j.jpg": (jpeg(1024, 768), 1024, 768, "RGB"), "l.jpeg": (jpeg(10, 20, 1), 10, 20, "L"),
    "deep.jpg": (jpeg(33, 44, 3, EXIF * 9), 33, 44, "RGB"), "prog.jpg": (jpeg(8, 9, 4, b"\xff\xff\xff", 0xC2), 8, 9, "CMYK"),
    "t.tiff": (tiff(12, 13), 12, 13, "RGB"), "m.tiff": (tiff(100000, 5, 4, True, True), 100000, 5, "RGBA"),
    "far.tiff": (tiff(7, 9, 1, False, False, 200000), 7, 9, "L"), "w.webp": (webp_lossy(640, 360), 640, 360, "RGB"),
    "wl.webp": (webp_lossless(16384, 3, 1), 16384, 3, "RGBA"), "wx.webp": (webp_extended(20000, 9), 20000, 9, "RGB"),
    "lying.gif": (png(3, 4), 3, 4, "RGB"),
}
BAD = {
    "cut.png": (png(4, 3)[:20], "truncated"), "zero.png": (png(0, 3), "corrupt"), "noise.jpg": (b"not an image at all", "corrupt"),
    "cut.jpg": (jpeg(9, 9)[:24], "truncated"), "cut2.jpg": (jpeg(33, 44, 3, EXIF)[:30000], "truncated"), "noframe.jpg": (b"\xff\xd8\xff\xda\0\6aaaa", "corrupt"),
    "lost.jpg": (b"\xff\xd8\xff\xe0\0\4aa" + b"\0" * 50, "corrupt"), "cut.gif": (gif(3, 3)[:8], "truncated"), "cut.bmp": (bmp(3, 3)[:20], "truncated"),
    "cut.tiff": (tiff(3, 3)[:30], "truncated"), "cut.webp": (webp_lossy(3, 3)[:22], "truncated"), "odd.webp": (riff(b"VP9 " + b"\0" * 30), "corrupt"),
    "short.jpg": (b"\xff", "truncated"), "seg.jpg": (b"\xff\xd8\xff\xe0\0\1" + b"\0" * 40, "corrupt"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    os.makedirs(root / "good" / "more")
    os.makedirs(root / "bad")
    for name, x in GOOD.items():
        (root / "good" / "more" / name).write_bytes(x[0])
    for name, x in BAD.items():
        (root / "bad" / name).write_bytes(x[0])
    (root / "notes.txt").write_text("no image")
    (root / "bad" / "empty.png").write_bytes(b"")  # not listed by Spark
    return str(root)


def test_every_format_and_every_damage(spark, folder):
    got = {os.path.basename(r["path"]): r for r in SI.image_headers(spark, folder).collect()}
    assert got.keys() == GOOD.keys() | BAD.keys()
    wrong = {n: got[n] for n, x in GOOD.items() if (got[n]["width"], got[n]["height"], got[n]["mode"], got[n]["status"]) != (*x[1:], "ok")}
    assert not wrong
    wrong = {n: got[n] for n, x in BAD.items() if (got[n]["status"], got[n]["width"], got[n]["mode"]) != (x[1], None, None)}
    assert not wrong
    assert got["m.tiff"]["n_channels"] == 4 and got["la.png"]["n_channels"] == 2


def test_inventory_is_one_scan_without_python(spark, folder):
    inv = SI.image_inventory(spark, folder)
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema") == 1
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan
    assert {r["class"]: r["count"] for r in IM.class_counts(inv).collect()} == {"good": len(GOOD), "bad": len(BAD)}
    s = IM.image_stats(inv).first()
    assert s["n_images"] == len(GOOD) + len(BAD) and s["max_width"] == 100000 and s["min_height"] == 1


def test_listing_does_not_read_contents(spark, folder):
    plan = SI.image_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
