"""Input encodings and their detection."""

from __future__ import annotations

import codecs
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 64 * 1024
_NAMES = {"": "utf8", "utf8": "utf8", "utf-8": "utf8", "cp1256": "cp1256", "windows-1256": "cp1256", "iso-8859-6": "iso-8859-6", "iso8859-6": "iso-8859-6", "utf16le": "utf16le", "utf-16le": "utf16le", "utf16be": "utf16be", "utf-16be": "utf16be", "auto": "auto"}
_CODECS = {"cp1256": "cp1256", "iso-8859-6": "iso8859-6", "utf16le": "utf-16-le", "utf16be": "utf-16-be"}
_NEVER = -(1 << 30)
_SPACES = frozenset("\t\n\v\f\r\x85")


def parse_encoding(name: str) -> str:
    if name.strip().lower() not in _NAMES:
        raise ValueError(f"unknown encoding {name!r}")
    return _NAMES[name.strip().lower()]


def _is_arabic(c: str) -> bool:
    o = ord(c)
    blocks = ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x10EC2, 0x10EFF), (0x1EE00, 0x1EEFF))
    # the shared punctuation and tatweel of the first block belong to no single script
    return any(a <= o <= b for a, b in blocks) and o not in (0x605, 0x60C, 0x61B, 0x61F, 0x640, 0x6DD, *range(0x64B, 0x656), 0x670, 0x8E2, 0xFD3E, 0xFD3F) and unicodedata.category(c) != "Cn"


def score(sample: bytes, encoding: str) -> int:
    """How much a sample reads like Arabic text in an encoding."""
    if encoding.startswith("utf16") and len(sample) % 2:
        sample = sample[:-1]
    total = 0
    for c in decode_as(sample, encoding):
        k = unicodedata.category(c)
        if _is_arabic(c):
            total += 12
        elif c in "�\0":
            total -= 20
        elif k == "Cc" and c not in _SPACES:
            total -= 8
        elif k[0] in "LNP" or c.isspace():
            total += 1
    return total


def plausible_utf8(sample: bytes, cut: bool) -> bool:
    """Valid UTF-8 without control characters; a cut sample may end inside a character."""
    d = codecs.getincrementaldecoder("utf-8")()
    try:
        text = d.decode(sample, final=not cut)
    except UnicodeDecodeError:
        return False
    return not any(unicodedata.category(c) == "Cc" and c not in _SPACES for c in text)


def decode_as(data: bytes, encoding: str) -> str:
    """Text of legacy bytes; a UTF-16 byte order mark is honoured, what can't be read is U+FFFD."""
    if encoding.startswith("utf16"):
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            encoding, data = ("utf16le" if data[0] == 0xFF else "utf16be"), data[2:]
        return data.decode(_CODECS[encoding], errors="replace")
    return data.decode(_CODECS[encoding], errors="replace")


def detect(data: bytes) -> str:
    """The encoding of an input by its first 64 KiB: byte order marks, UTF-8, then the best score."""
    s = data[:SAMPLE]
    if s.startswith(b"\xef\xbb\xbf"):
        return "utf8"
    if s.startswith(b"\xff\xfe"):
        return "utf16le"
    if s.startswith(b"\xfe\xff"):
        return "utf16be"
    if plausible_utf8(s, len(s) == SAMPLE):
        return "utf8"
    best, high = "cp1256", score(s, "cp1256")
    for e in ("iso-8859-6", "utf16le", "utf16be"):
        if (n := score(s, e)) > high:
            best, high = e, n
    return best


def to_utf8(data: bytes, encoding: str) -> tuple[bytes, str]:
    """(UTF-8 bytes, encoding used).  Explicit UTF-8 passes unchanged, mark and faults included; auto repairs."""
    if encoding == "utf8":
        return data, "utf8"
    used = detect(data) if encoding == "auto" else encoding
    if used == "utf8":
        return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", errors="replace").encode("utf-8"), used
    return decode_as(data, used).encode("utf-8", errors="replace"), used


def decode_column(content: Column, encoding: str = "auto") -> Column:
    """struct<text, encoding> of a binary column; null content stays null."""
    encoding = parse_encoding(encoding)
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])

    @F.arrow_udf(kind)
    def decoded(contents: pa.Array) -> pa.Array:
        rows = [None if c is None else to_utf8(c, encoding) for c in contents.to_pylist()]
        texts = [None if r is None else r[0].decode("utf-8", errors="replace") for r in rows]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([None if r is None else r[1] for r in rows], pa.string())], names=["text", "encoding"])

    return decoded(content)
