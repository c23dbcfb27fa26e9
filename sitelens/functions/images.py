"""Image dimensions from header bytes (A7, E4): PNG, GIF, JPEG and WebP by byte arithmetic in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.urls import let

#: Segments of a JPEG file that are looked through for its frame (a file may hold some dozens).
JPEG_SEGMENTS = 1024
NO_SIZE = "no image size found"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _int(content: Column, start, size: int) -> Column:
    """`size` bytes from place `start` (1: the first) as a big-endian number; null beyond the end."""
    part = F.substring(content, _at(start), F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def _at(start) -> Column:
    return start if isinstance(start, Column) else F.lit(start)


def _little(content: Column, start: int, size: int) -> Column:
    return sum((_int(content, start + i, 1) * F.lit(1 << (8 * i)) for i in range(1, size)), _int(content, start, 1))


def _starts(content: Column, hex_text: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(hex_text) // 2)) == hex_text


def _pair(kind: str, width: Column, height: Column) -> Column:
    return F.struct(F.lit(kind).alias("format"), width.cast("long").alias("width"), height.cast("long").alias("height"))


def _jpeg(content: Column) -> Column:
    """Follow the segments' lengths up to the frame header (C0 to CF but C4, C8, CC)."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(3).cast("long").alias("at"), none.alias("width"), none.alias("height"))

    def step(s, _):
        marker = _int(content, s["at"].cast("int"), 2)
        kind = marker - 0xFF00
        frame = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        length = _int(content, (s["at"] + 2).cast("int"), 2)
        ended = s["at"] < 0
        return F.when(ended, s).when(
            F.coalesce(frame, F.lit(False)),
            F.struct(F.lit(-1).cast("long").alias("at"), _int(content, (s["at"] + 7).cast("int"), 2).alias("width"),
                     _int(content, (s["at"] + 5).cast("int"), 2).alias("height")),
        ).when(
            F.coalesce((kind >= 0) & (length >= 2), F.lit(False)),
            # a fill byte before a marker is passed over alone
            F.struct((s["at"] + F.when(kind == 0xFF, F.lit(1)).otherwise(2 + length)).alias("at"), s["width"], s["height"]),
        ).otherwise(F.struct(F.lit(-1).cast("long").alias("at"), s["width"], s["height"]))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), start, step)
    return let(found, lambda f: _pair("jpeg", f["width"], f["height"]))


def _webp(content: Column) -> Column:
    extended = _pair("webp", 1 + _little(content, 25, 3), 1 + _little(content, 28, 3))
    lossy = _pair("webp", _little(content, 27, 2).bitwiseAND(0x3FFF), _little(content, 29, 2).bitwiseAND(0x3FFF))
    bits = _little(content, 22, 4)
    lossless = _pair("webp", 1 + bits.bitwiseAND(0x3FFF), 1 + F.shiftright(bits, 14).bitwiseAND(0x3FFF))
    unknown = _pair("webp", F.lit(None), F.lit(None))
    return (F.when(_starts(content, "56503858", 13), extended)
            .when(_starts(content, "56503820", 13) & _starts(content, "9D012A", 24), lossy)
            .when(_starts(content, "5650384C", 13) & _starts(content, "2F", 21), lossless).otherwise(unknown))


def image_size(content) -> Column:
    """struct<format, width, height, error>: error is null when both sides were found; no other byte is decoded."""
    c = F.coalesce(_c(content), F.lit(b""))
    found = (F.when(_starts(c, "89504E470D0A1A0A") & _starts(c, "49484452", 13), _pair("png", _int(c, 17, 4), _int(c, 21, 4)))
             .when(_starts(c, "474946383761") | _starts(c, "474946383961"), _pair("gif", _little(c, 7, 2), _little(c, 9, 2)))
             .when(_starts(c, "52494646") & _starts(c, "57454250", 9), _webp(c))
             .when(_starts(c, "FFD8"), _jpeg(c)).otherwise(_pair("", F.lit(None), F.lit(None))))
    return let(found, lambda f: F.struct(
        F.when(f["format"] != "", f["format"]).alias("format"), f["width"].alias("width"), f["height"].alias("height"),
        F.when((f["width"] > 0) & (f["height"] > 0), F.lit(None).cast("string")).otherwise(F.lit(NO_SIZE)).alias("error")))
