"""Image sides from header bytes: equal to Spark's image source on real files, an error text on broken ones."""

import struct
import zlib

from sitelens.functions.images import NO_SIZE, image_size
from sitelens.sources import io as IO


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = zlib.compress(b"".join(b"\0" + b"\0\0\0" * w for _ in range(h)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def jpeg(w, h, before=b"", sof=0xC2):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + before + b"\xff" + bytes([sof]) + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\0" * 9


def test_headers(spark):
    riff = b"RIFF\0\0\0\0WEBP"
    cases = [
        (png(300, 70000 // 1000), ("png", 300, 70)),
        (b"GIF87a" + struct.pack("<HH", 640, 481), ("gif", 640, 481)),
        (jpeg(5000, 3), ("jpeg", 5000, 3)),
        (jpeg(12, 34, b"\xff\xc4\x00\x05abc\xff\xff\xfe\x00\x04xx", 0xC0), ("jpeg", 12, 34)),
        (riff + b"VP8X" + b"\0" * 8 + (1023).to_bytes(3, "little") + (70000).to_bytes(3, "little"), ("webp", 1024, 70001)),
        (riff + b"VP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 176 | 0x4000, 144), ("webp", 176, 144)),
        (riff + b"VP8L" + b"\0" * 4 + b"\x2f" + (399 | (299 << 14)).to_bytes(4, "little"), ("webp", 400, 300)),
    ]
    broken = [b"", None, b"<html>", png(9, 9)[:18], jpeg(9, 9)[:24], b"\xff\xd8\xff\xd9", b"GIF89a\x01", riff + b"VP9 ", png(0, 5), b"\xff\xd8" + b"\xff\xe0\x00\x01"]
    rows = [(i, c) for i, c in enumerate([c for c, _ in cases] + broken)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, c binary").select("i", image_size("c").alias("s")).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i].format, got[i].width, got[i].height, got[i].error) == (*want, None)
    for i in range(len(cases), len(rows)):
        assert got[i].error == NO_SIZE, i


def test_same_as_the_image_source(spark, tmp_path):
    for name, data in (("a.png", png(7, 5)), ("b.png", png(130, 2)), ("c.png", b"no image")):
        (tmp_path / name).write_bytes(data)
    old = {r.path: r for r in IO.read_images(spark, str(tmp_path)).collect()}
    new = {r.path: r for r in IO.read_image_sizes(spark, str(tmp_path)).collect()}
    assert old.keys() == new.keys()
    for k, r in new.items():
        assert (r.size_bytes, r.hash, r.px_width, r.px_height) == (old[k].size_bytes, old[k].hash, old[k].px_width, old[k].px_height)
        assert (r.analysis_error is None) == (old[k].analysis_error is None)
