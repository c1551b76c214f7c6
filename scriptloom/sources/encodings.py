"""Text encodings of files without a mark: decoded piece by piece, chosen by likelihood."""

from __future__ import annotations

import codecs
import functools
import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Byte order marks, longer ones first. Fixed values.
MARKS = [
    (b"\xef\xbb\xbf", "UTF-8", "utf-8"), (b"\xff\xfe\x00\x00", "UTF-32", "utf-32-le"), (b"\x00\x00\xfe\xff", "UTF-32", "utf-32-be"),
    (b"\xff\xfe", "UTF-16", "utf-16-le"), (b"\xfe\xff", "UTF-16", "utf-16-be"),
]
#: Encodings that compete for a file without a mark, in the order in which equals are preferred.
UNMARKED = [("UTF-8", "utf-8"), ("GB18030", "gb18030"), ("Big5", "big5"), ("UTF-16", "utf-16-le"), ("UTF-16", "utf-16-be")]
#: How much likelier (natural logarithm) a decoding must be than one that gives another text.
MARGIN = 3.0
#: Log likelihood of a byte that breaks UTF-8: any of 256.
FAULT = -np.log(256)
#: How much rarer a Latin letter with an accent stands beside a character of another script than their kinds say.
ALOOF = 1000.0
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")
#: Bytes that are decoded at a time.
PIECE = 1 << 20

#: Kinds of characters: how often each kind comes, how often it follows itself, and among how many characters it
#: chooses. Common Chinese characters are of three kinds by their strokes. Our configuration.
KINDS = {
    "ascii": (0.30, 0.60, 96), "junk": (1e-7, 0.0, 70_000), "han": (0.34, 0.45, 3_400), "middle han": (0.14, 0.20, 1_700), "heavy han": (0.03, 0.05, 1_700), "rare han": (0.02, 0.08, 20_000), "marks": (0.10, 0.10, 300), "latin": (0.02, 0.10, 500),
    "kana": (0.005, 0.10, 250), "hangul": (0.001, 0.02, 11_172), "other": (0.005, 0.05, 30_000),
}
_NAMES = list(KINDS)


def _of(codec: str, leads, trails) -> set[int]:
    """The characters of a two-byte encoding with these first and second bytes."""
    pairs = (bytes([a, b]).decode(codec, "ignore") for a in leads for b in trails)
    return {ord(x) for x in pairs if len(x) == 1}


@functools.cache
def _table() -> np.ndarray:
    """The kind of each character up to U+FFFF; one more entry stands for all above."""
    kind = np.full(65_537, _NAMES.index("other"), dtype=np.uint8)

    def put(name: str, *spans) -> None:
        for a, b in spans:
            kind[a : b + 1] = _NAMES.index(name)

    put("latin", (0xA0, 0x24F), (0x1E00, 0x1EFF))
    put("marks", (0x2010, 0x203B), (0x3000, 0x3020), (0xFF00, 0xFF65), (0xB7, 0xB7), (0xAB, 0xAB), (0xBB, 0xBB))
    put("rare han", (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (65_536, 65_536))
    put("kana", (0x3040, 0x312F))
    put("hangul", (0x1100, 0x11FF), (0xAC00, 0xD7AF))
    put("junk", (0, 0x1F), (0x7F, 0x9F), (0xD800, 0xF8FF), (0xFDD0, 0xFDEF), (0xFFF0, 0xFFFF), (0x200B, 0x200F), (0x2028, 0x202E))
    kind[[c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]] = _NAMES.index("junk")
    put("ascii", (0x20, 0x7E), (0x9, 0xA), (0xD, 0xD))
    # the commoner level of each of the two encodings; that of Big5 is in the order of strokes
    trails = [*range(0x40, 0x7F), *range(0xA1, 0xFF)]
    for name, codec, leads in [("han", "gb2312", range(0xB0, 0xD8)), ("heavy han", "big5", range(0xBB, 0xC7)), ("middle han", "big5", range(0xB0, 0xBB)), ("han", "big5", range(0xA4, 0xB0))]:
        kind[[c for c in _of(codec, leads, range(0xA1, 0xFF) if codec == "gb2312" else trails) if 0x4E00 <= c <= 0x9FFF]] = _NAMES.index(name)
    return kind


@functools.cache
def _pairs() -> np.ndarray:
    """The log likelihood of a character of one kind after one of another."""
    often, again, size = (np.array(x) for x in zip(*KINDS.values(), strict=True))
    chance = (1 - again)[:, None] * (often / often.sum())[None, :] + np.diag(again)
    latin, others = _NAMES.index("latin"), [i for i, name in enumerate(_NAMES) if name not in ("ascii", "marks", "latin", "junk")]
    chance[latin, others] /= ALOOF
    chance[others, latin] /= ALOOF
    return np.log(chance) - np.log(size)[None, :]


def _pieces(content: memoryview, codec: str) -> Iterator[str]:
    """The text of the bytes piece by piece; an error unless it gives back the same bytes."""
    decoder = codecs.getincrementaldecoder(codec)("strict")
    kept = b""
    for at in range(0, len(content), PIECE):
        part = bytes(content[at : at + PIECE])
        text = decoder.decode(part, at + PIECE >= len(content))
        now = decoder.getstate()[0]
        if text.encode(codec) != (kept + part)[: len(kept) + len(part) - len(now)]:
            raise UnicodeError("another spelling of the same text")
        kept = now
        yield text


class _Likelihood:
    """The log likelihood of a text by its pairs of characters, summed piece by piece."""

    def __init__(self):
        self.total, self.before = 0.0, 0

    def add(self, text: str) -> None:
        letters = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kinds = np.append(self.before, _table()[np.minimum(letters, 65_536)]).astype(np.int64)
        counts = np.bincount(kinds[:-1] * len(KINDS) + kinds[1:], minlength=len(KINDS) ** 2)
        self.total += float((counts * _pairs().ravel()).sum())
        self.before = int(kinds[-1])


def likelihood(content: memoryview, codec: str) -> float | None:
    """How well an encoding explains the bytes, as a log likelihood of pairs of characters; None if it can't."""
    found = _Likelihood()
    try:
        for text in _pieces(content, codec):
            found.add(text)
    except UnicodeError:
        return None
    return found.total


def faulty_likelihood(content: memoryview) -> float:
    """How well UTF-8 with faults explains the bytes: bytes that break it and control characters cost ``FAULT`` each."""
    found, kept, decoder = _Likelihood(), 0, codecs.getincrementaldecoder("utf-8")("ignore")
    for at in range(0, len(content), PIECE):
        text = _CONTROLS.sub("", decoder.decode(bytes(content[at : at + PIECE]), at + PIECE >= len(content)))
        kept += len(text.encode())
        found.add(text)
    return found.total + FAULT * (len(content) - kept)


def _utf8(content: memoryview, codec: str) -> memoryview | None:
    out = io.BytesIO()
    try:
        for text in _pieces(content, codec):
            out.write(text.encode())
    except UnicodeError:
        return None
    return out.getbuffer()


def decode(content: bytes | None) -> tuple[str | None, memoryview | None, str | None]:
    """(charset, UTF-8 bytes, None) of a file, or (None, None, reason).

    A mark decides. Without one it is UTF-8 if that fits and there is no NUL; else, of the encodings that give back
    the same bytes, the likeliest one. If only one does it is taken. Where another one with another text
    comes near it is ambiguous; where none fits it is not decodable. UTF-16, which fits nearly any bytes, must be
    likelier than UTF-8 with faults. Memory: the file, its UTF-8 and a piece.
    """
    if content is None:
        return None, None, "not decodable"
    for mark, name, codec in MARKS:
        if content.startswith(mark):  # the leading mark goes, later ones stay
            text = _utf8(memoryview(content)[len(mark) :], codec)
            return (None, None, "not decodable") if text is None else (name, text, None)
    whole = memoryview(content)
    if b"\x00" not in content and (text := _utf8(whole, "utf-8")) is not None:
        return "UTF-8", text, None
    fits = [(-value, i) for i, (_, codec) in enumerate(UNMARKED) if (value := likelihood(whole, codec)) is not None]
    if any(UNMARKED[i][0] == "UTF-16" for _, i in fits):
        faulty = faulty_likelihood(whole)
        fits = [(loss, i) for loss, i in fits if UNMARKED[i][0] != "UTF-16" or -loss > faulty]
    if not fits:
        return None, None, "not decodable"
    fits.sort()
    best = fits[0][1]
    text = _utf8(whole, UNMARKED[best][1])
    for value, i in fits[1:]:
        if value - fits[0][0] < MARGIN and _utf8(whole, UNMARKED[i][1]) != text:
            return None, None, "ambiguous encoding"
    return UNMARKED[best][0], text, None
