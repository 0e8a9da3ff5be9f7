"""Paragraphs of Markdown with the chain of headings above them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from recallframe.session import spread

HEADING = regex.compile(r"(#{1,6})\s+(.+?)\s*")
SIZE, OVERLAP = 1000, 120


def paragraphs(text: str) -> Iterator[tuple[str, str]]:
    """(heading chain, paragraph): headings and blank lines part, deeper headings end with their section."""
    titles: dict[int, str] = {}
    held: list[str] = []

    def chain() -> str:
        return " > ".join(titles[k] for k in sorted(titles))

    for line in [*(x.rstrip() for x in text.splitlines()), ""]:
        heading = HEADING.fullmatch(line)
        if (heading or not line.strip()) and held:
            if paragraph := "\n".join(held).strip():
                yield chain(), paragraph
            held = []
        if heading:
            level = len(heading.group(1))
            titles = {k: v for k, v in titles.items() if k < level} | {level: heading.group(2).strip()}
        elif line.strip():
            held.append(line)


def pieces(paragraph: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Overlapping windows of a long paragraph."""
    last = max(len(paragraph) - overlap, 1)
    return [paragraph[s : s + size] for s in range(0, last, size - overlap)] if len(paragraph) > size else [paragraph]


def chunk(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_no, heading, chunk of each document; null texts give none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf["text"]):
                flat = [(h, c) for h, p in paragraphs(text or "") for c in pieces(p)]
                rows += [(k, i, h, c) for i, (h, c) in enumerate(flat)]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "heading", "chunk"])

    return spread(docs.select(key, "text")).mapInPandas(run, f"`{key}` {kind}, chunk_no int, heading string, chunk string")
