"""Every cut and every changed byte of small pictures against what the formats say; reports by column."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from episodica.operators.quality import damage_by_column
from episodica.sources.pictures import picture, picture_state


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 4, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(bytes(40))) + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


def segment(marker, data):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data


FRAME = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, bytes(65)) + segment(0xC2, struct.pack(">BHHB", 8, 4, 9, 1) + b"\1\x11\0")
JPEG = b"\xff\xd8" + FRAME + segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x12\xff\0\x34\xff\xd0\x56\xff\xd1\x78" + b"\xff" + segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x9a\xff\xd0\xbc\xff\xd9"


def test_whole_pictures_and_what_follows_them():
    assert picture(PNG) == ("png", "whole", 9, 4) == picture(PNG + b"tail")
    assert picture(JPEG) == ("jpeg", "whole", 9, 4) == picture(JPEG + b"\0\0")
    assert [picture(b)[:2] for b in (None, b"", b"GIF89a", b"x" * 40)] == [("none", "empty"), ("none", "empty"), ("none", "unknown"), ("none", "unknown")]


@pytest.mark.parametrize("whole", [PNG, JPEG])
def test_every_cut_is_a_cut(whole):
    for n in range(1, len(whole)):
        assert picture(whole[:n])[1] == "cut", n


def test_every_changed_byte_of_a_png_is_found():
    for i in range(8, len(PNG)):
        for change in (1, 0x80, 0xFF):
            broken = PNG[:i] + bytes([PNG[i] ^ change]) + PNG[i + 1 :]
            assert picture(broken)[:2] in (("png", "corrupt"), ("png", "cut")), (i, change)
            if i < len(PNG) - 12:  # the end is there, so nothing is cut
                assert picture(broken)[1] == "corrupt", (i, change)
    assert {picture(bytes([PNG[0] ^ 1]) + PNG[1:])[:2]} == {("png", "corrupt")}


def test_structure_of_jpegs():
    first = JPEG.index(b"\xff\xda")
    broken = {
        "restarts out of order": JPEG.replace(b"\x34\xff\xd0", b"\x34\xff\xd1"),
        "marker that is reserved": JPEG.replace(b"\x12\xff\0", b"\x12\xff\x05"),
        "no marker where one must be": JPEG[:2] + b"\0" + JPEG[3:],
        "length of nothing": JPEG[: first + 2] + b"\0\1" + JPEG[first + 4 :],
        "length beyond the end": JPEG[: first + 2] + b"\x7f\xff" + JPEG[first + 4 :],
        "no scan": b"\xff\xd8" + FRAME + b"\xff\xd9",
        "no frame": b"\xff\xd8" + JPEG[first:],
    }
    assert {k: picture(v)[:2] for k, v in broken.items()} == dict.fromkeys(broken, ("jpeg", "corrupt"))
    assert picture(PNG[:8] + chunk(b"IDAT", b"x") + chunk(b"IEND", b""))[1] == "corrupt"
    assert picture(PNG[:8] + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b""))[1] == "corrupt"


def test_report_by_column(spark):
    rows = [(0, PNG, JPEG), (0, PNG[:-3], JPEG), (1, None, JPEG[:50]), (1, PNG[:-3], b"text"), (2, PNG[:-3], JPEG)]
    frames = spark.createDataFrame(rows, "ep long, front binary, side binary")
    states = {c: picture_state(F.col(c))["state"] for c in ("front", "side")} | {"never": F.lit(None)}
    got = {(r["column"], r["state"]): (r["frames"], r["episodes"]) for r in damage_by_column(frames, states).collect()}
    assert got == {("front", "whole"): (1, 1), ("front", "cut"): (3, 3), ("front", "empty"): (1, 1), ("side", "whole"): (3, 2), ("side", "cut"): (1, 1), ("side", "unknown"): (1, 1), ("never", "missing"): (5, 3)}
    assert damage_by_column(frames.where("ep > 9"), states).count() == 0
