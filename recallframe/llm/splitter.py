"""Problem 5: cutting oversized texts with content-defined landmarks.

A rolling hash over the last ``WINDOW`` characters marks landmarks.  A piece ends
at the first landmark past the least size, moved to the nearest natural boundary
that is allowed (paragraph, line, sentence, word); where no landmark lies in
reach the best boundary in reach is taken, and only a text without any break is
cut at the landmark itself.  Landmarks depend on the neighbouring characters
alone, so an edit changes only the pieces around it.  Every later piece repeats
the last ``overlap`` characters of the one before.

Null, blank and short texts give no piece.  Repeated deliveries of a row under
the same key are one item.  Sizes count Unicode code points of the text without
blanks, tabs, carriage returns and line feeds at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.session import spread

LIMIT, OVERLAP, LEAST, WINDOW, MASK_BITS = 1000, 120, 240, 32, 7
STRIP = " \t\r\n"
#: Natural boundaries, strongest first: a piece may end after such a match.
BREAKS = (
    regex.compile(r"(?:\r?\n[ \t]*){2,}"),
    regex.compile(r"\r?\n"),
    regex.compile(r"[.!?…。！？]+[\"'»”’)\]]*\s+|[。！？]"),
    regex.compile(r"[,;:，；：、]\s*(?=\s|\S)|\s+"),
)
REACH = (1.0, 1.0, 2.0, 6.0)  # a stronger break may lie this much farther away: distance times factor


def _gear() -> np.ndarray:
    x = np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def landmarks(text: str, bits: int = MASK_BITS) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW characters ends in zeros."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 0xFFFF
    values, rolling = GEAR[codes], np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for back in range(min(WINDOW, len(codes))):
            rolling[back:] += values[: len(codes) - back] << np.uint64(back)
    return np.flatnonzero((rolling >> np.uint64(16)) & np.uint64((1 << bits) - 1) == 0) + 1


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[int]:
    """Ends of the pieces' own parts; the first part starts at 0."""
    n, marks = len(text), landmarks(text)
    ends = [np.array([m.end() for m in b.finditer(text)], dtype=np.int64) for b in BREAKS]
    out, start = [], 0
    while n - start > limit - (overlap if start else 0):
        most = limit - (overlap if start else 0)
        lo, hi = start + min(least, most), start + most
        i = np.searchsorted(marks, lo)
        target = int(marks[i]) if i < len(marks) and marks[i] <= hi else hi
        best, cost = None, None
        for level, places in enumerate(ends):
            a, b = np.searchsorted(places, lo), np.searchsorted(places, hi, side="right")
            if a < b:
                near = places[a:b]
                at = int(near[np.argmin(np.abs(near - target))])
                c = abs(at - target) * REACH[level] + 40 * level
                if cost is None or c < cost:
                    best, cost = at, c
        if best is None:  # look below the least size before cutting where there is no break
            for places in ends:
                a, b = np.searchsorted(places, start + 1), np.searchsorted(places, lo)
                if a < b:
                    best = int(places[b - 1])
                    break
        if best is None:
            best = target
            while best > start + 1 and best < n and _clings(text[best]):
                best -= 1
        out.append(best)
        start = best
    return [*out, n]


def _clings(char: str) -> bool:
    return bool(regex.match(r"[\p{M}‍️]", char))


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece of an oversized text, else []."""
    body = (text or "").strip(STRIP)
    if len(body) <= limit:
        return []
    out, start = [], 0
    for end in cuts(body, limit, overlap, least):
        before = max(out[-1][1] if out else 0, start - overlap)
        while before < start and _clings(body[before]):
            before += 1
        out.append((before, start, end))
        start = end
    return out


def split_items(items: DataFrame, key: list[str], text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key.., piece_no, start, end, piece``: one row per piece of each oversized item."""
    body = F.expr(f"trim(BOTH ' \\t\\r\\n' FROM `{text_col}`)")
    large = items.select(*key, F.col(text_col)).where(F.char_length(body) > limit).dropDuplicates(key)
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for values in zip(*(pdf[k] for k in [*key, text_col])):
                text = values[-1].strip(STRIP)
                rows += [(*values[:-1], i, b, s, e, text[b:e]) for i, (b, s, e) in enumerate(split(text, limit, overlap))]
            yield pd.DataFrame(rows, columns=[*key, "piece_no", "piece_start", "own_start", "piece_end", "piece"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", piece_no int, piece_start int, own_start int, piece_end int, piece string"
    return spread(large).mapInPandas(run, schema)
