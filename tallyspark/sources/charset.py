"""Charsets told from a file's head: by marks, by decoding, by zeros, and by which bytes follow which."""

from __future__ import annotations

import math
import unicodedata

HEAD = 100 * 1024
#: Byte order marks, and the single-byte charsets that are weighed against each other.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
SINGLE = ("windows-1252", "windows-1258")
#: Letters that western or Vietnamese text uses often, beside ASCII; others of a charset are possible but rare.
COMMON = {"windows-1252": "àâäáãåæçèéêëìíîïñòóôöõøùúûüßœÀÂÄÁÅÆÇÈÉÊËÍÎÑÓÔÖØÚÜ", "windows-1258": "àâáăèéêđìíòóôơùúưÀÂÁĂÈÉÊĐÍÓÔƠÚƯ"}
VOWELS = "aeiouyăâêôơư"


def _utf8(data: bytes) -> str | None:
    for cut in range(4 if len(data) >= HEAD else 1):  # a head may end inside a character
        try:
            return data[: len(data) - cut].decode("utf-8")
        except UnicodeDecodeError:
            continue
    return None


def _wide(data: bytes) -> tuple[str, float] | None:
    """UTF-16 without a mark: in text of mostly Latin letters every other byte is zero."""
    pairs = len(data) // 2
    if pairs < 2:
        return None
    high = [data[k : 2 * pairs : 2].count(0) / pairs for k in (0, 1)]
    for name, zeros, others in (("utf-16-be", high[0], high[1]), ("utf-16-le", high[1], high[0])):
        if zeros > 0.3 and others < 0.05:
            try:
                data[: 2 * pairs].decode(name)
            except UnicodeDecodeError:
                continue
            return name, min(0.99, 0.5 + zeros)
    return None


def _step(before: str, c: str, common: str) -> float:
    """The log-odds that text in the charset has c, which is not ASCII, after the character before."""
    kind, previous = unicodedata.category(c), unicodedata.category(before) if before else "Zs"
    if kind == "Mn":  # a tone stands on a vowel and nowhere else
        return 2.0 if unicodedata.normalize("NFD", before.lower())[:1] in tuple(VOWELS) else -6.0
    if kind in ("Cc", "Cn"):
        return -8.0
    if kind == "Ll":
        odds = 1.0 if c in common else -2.0
        if previous == "Ll" and not before.isascii():
            odds -= 1.0  # accented letters seldom stand side by side
        return odds - (0.5 if previous == "Nd" else 0)
    if kind == "Lu":
        return (0.5 if c in common else -2.0) - (3.0 if previous == "Ll" else 0)
    return -1.5 if previous in ("Ll", "Lu") else 0.0


def single_byte(data: bytes) -> tuple[str, float]:
    """(charset, confidence) of text that is not UTF-8, by the transitions into its bytes beyond ASCII."""
    scores: dict[str, float] = {}
    texts = {name: data.decode(name, "replace") for name in SINGLE}
    for name, text in texts.items():
        scores[name] = sum(-8.0 if c == "\ufffd" else _step(text[i - 1] if i else "", c, COMMON[name]) for i, c in enumerate(text) if not c.isascii())
    best = max(SINGLE, key=lambda n: (scores[n], -SINGLE.index(n)))
    others = [scores[best] - scores[n] for n in SINGLE if texts[n] != texts[best]]  # those that read the same text need no choice
    high = sum(b > 127 for b in data)
    plausible = 1 / (1 + math.exp(-(2.0 * scores[best] / max(1, high) + 0.5)))  # what else the bytes might be
    return best, round(plausible / (1 + math.exp(-min([50.0, *others]))), 3)


def detect_encoding(data: bytes) -> tuple[str, float]:
    """(encoding, confidence) of a file's head."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, 1.0
    if wide := _wide(data):
        return wide
    text = _utf8(data)
    if text is not None:
        return "utf-8", 1.0 if text.isascii() else 0.99
    return single_byte(data)
