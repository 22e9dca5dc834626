"""The structure of encoded pictures: whole, cut or corrupt, told by PNG chunks with their checksums and by JPEG markers, without decoding pixels."""

from __future__ import annotations

import re
import struct
import sys
import zlib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The PNG signature and its closing chunk.
SIGNATURE, CLOSING = b"\x89PNG\r\n\x1a\n", b"\x00\x00\x00\x00IEND\xaeB`\x82"
#: In a scan: a marker that ends it; a restart marker.
SCAN_END, RESTART = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]"), re.compile(rb"\xff([\xd0-\xd7])")
STATE = "kind string, state string, width int, height int"


def _png(b: bytes) -> tuple[str, int | None, int | None]:
    def ends(at: int) -> str:
        return "corrupt" if b.endswith(CLOSING) and at < len(b) - len(CLOSING) else "cut"  # a wrong length, if the end is there

    width = height = None
    at, data = len(SIGNATURE), False
    while True:
        if len(b) - at < 12:
            return ends(at), width, height
        (n,), name = struct.unpack_from(">I", b, at), b[at + 4 : at + 8]
        if n >> 31 or not name.isalpha():
            return "corrupt", width, height
        if at + 12 + n > len(b):
            return ends(at), width, height
        if zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0] or (width is None) != (name == b"IHDR"):
            return "corrupt", width, height
        if name == b"IHDR":
            if n != 13:
                return "corrupt", width, height
            width, height = struct.unpack_from(">II", b, at + 8)
        data |= name == b"IDAT"
        if name == b"IEND":
            return "whole" if data and n == 0 else "corrupt", width, height
        at += 12 + n


def _jpeg(b: bytes) -> tuple[str, int | None, int | None]:
    def ends() -> str:
        return "corrupt" if b.endswith(b"\xff\xd9") else "cut"

    width = height = None
    at, scans = 2, 0
    while True:
        start = at
        while at < len(b) and b[at] == 0xFF:
            at += 1
        if at >= len(b):
            return "cut", width, height
        marker = b[at]
        if at == start or marker < 0xC0 or marker == 0xD8 or 0xD0 <= marker <= 0xD7:
            return "corrupt", width, height
        at += 1
        if marker == 0xD9:
            return "whole" if scans and width is not None else "corrupt", width, height
        if at + 2 > len(b):
            return "cut", width, height
        (n,) = struct.unpack_from(">H", b, at)
        if n < 2:
            return "corrupt", width, height
        if at + n > len(b):
            return ends(), width, height
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if n < 8:
                return "corrupt", width, height
            height, width = struct.unpack_from(">HH", b, at + 3)
        at += n
        if marker == 0xDA:
            scans += 1
            end = SCAN_END.search(b, at)
            stop = end.start() if end else len(b)
            if any(m[1][0] != 0xD0 + i % 8 for i, m in enumerate(RESTART.finditer(b, at, stop))):
                return "corrupt", width, height
            if end is None:
                return "cut", width, height
            at = stop


def picture(b: bytes | None) -> tuple[str, str, int | None, int | None]:
    """(kind, state, width, height) of a cell. Kinds are png, jpeg and none; states whole, cut, corrupt, empty (null too) and unknown."""
    if not b:
        return "none", "empty", None, None
    if b.startswith(SIGNATURE):
        return "png", *_png(b)
    if b[12:16] == b"IHDR":
        return "png", "corrupt", None, None
    if b.startswith(b"\xff\xd8"):
        return "jpeg", *_jpeg(b)
    if SIGNATURE.startswith(b):
        return "png", "cut", None, None
    if b == b"\xff":
        return "jpeg", "cut", None, None
    return "none", "unknown", None, None


def picture_state(column: Column) -> Column:
    """picture() of a binary column as a struct, on Arrow batches.

    Every changed byte of a PNG's chunks is found by a checksum. A JPEG has none: what is found is a cut, a wrong marker or length, and restarts
    out of order, not a changed coefficient. Bytes after the end of a picture are ignored, as decoders do.
    """

    @F.pandas_udf(STATE)
    def states(cells: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([picture(None if b is None else bytes(b)) for b in cells], columns=["kind", "state", "width", "height"])
        return rows.astype({"width": "Int32", "height": "Int32"})

    return states(column)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
