"""The project's notion of a word, used by several operators."""

from __future__ import annotations

import unicodedata

import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")
FORMAT = regex.compile(r"\p{Cf}+")


def normal(text: str) -> str:
    """NFKC, without format characters, lower case."""
    if text.isascii():
        return text.lower()
    return FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the normalised text; [] for null."""
    return WORD.findall(normal(text)) if text else []
