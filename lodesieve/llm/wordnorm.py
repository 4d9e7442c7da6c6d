"""Texts as plain word sequences, for comparisons in which case, punctuation, markup and look-alike letters don't matter."""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: Cyrillic and Greek letters that look like Latin ones
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ё": "e",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɡ": "g",
    }
)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_NUMBERING = re.compile(r"\(\w{1,3}\)|\[\w{1,3}\]|^[ \t]*(?:\d{1,3}|[a-z])[.)][ \t]", re.M)
_IN_NUMBER = re.compile(r"[.,'’](?<=\d.)(?=\d)")
_WRAPPED = re.compile(r"[-‐](?<=\w.)\r?\n[ \t]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]+")
_LOOKS = re.compile(f"[{''.join(map(chr, LOOK_ALIKES))}]")
_SPACED = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))  # ASCII letters and digits, the rest blank


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without accents, markup, inserted numbering, invisible characters or separators in numbers."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "(" in text or "[" in text or ")" in text or "." in text:
        text = _NUMBERING.sub(" ", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))).lower()
        if _LOOKS.search(text):
            text = text.translate(LOOK_ALIKES)
    else:
        text = text.lower()
    if "-\n" in text or "-\r\n" in text or "\u2010" in text:
        text = _WRAPPED.sub("", text)
    text = _IN_NUMBER.sub("", text)
    return text.encode().translate(_SPACED).decode().split() if text.isascii() else _WORD.findall(text)
