"""Problem 7: encoding a corpus with a public tokenizer by a monoid tree reduction.

Splitting a text for byte-level BPE is a left-to-right scan whose matches never
cross certain places, whatever stands left or right of them (``sure_cut``).
Token sequences therefore form a monoid under ``join``: the tokens left of the
last sure place of the left half and right of the first sure place of the right
half are final; only the window between them is encoded again.  The window grows
to the whole of a half that has no sure place, so the result always equals that
of encoding the text in one go.

Null, empty: an empty list.  Marker strings such as ``<|endoftext|>`` are
ordinary text.  Any other columns of the input are left alone.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from recallframe.session import spread

LEAF_CHARS = 2048
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: The scan pattern that belongs to the public vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(name: str = TOKENIZER, folder: str = TOKENIZER_DIR):
    """The tokenizer of a ``.tiktoken`` rank file, without special tokens."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(char: str) -> str:
    if char.isspace() or char in "\x1c\x1d\x1e\x1f\x85":
        return "s"
    top = unicodedata.category(char)[0]
    return top if top in "LN" else "o"


def sure_cut(left: str, right: str) -> bool:
    """Whether the scan has a boundary between these neighbours in any context.

    No match holds a non-space followed by a space, a letter or digit followed by
    another kind, or a symbol followed by a letter or digit, contractions aside.
    """
    a, b = _kind(left), _kind(right)
    if a == b or a == "s":
        return False
    return not (left == "'" and b == "L")


def _last_cut(text: str) -> int:
    for at in range(len(text) - 1, 0, -1):
        if sure_cut(text[at - 1], text[at]):
            return at
    return 0


def _first_cut(text: str) -> int:
    for at in range(1, len(text)):
        if sure_cut(text[at - 1], text[at]):
            return at
    return len(text)


def join(left: tuple[str, list[int]], right: tuple[str, list[int]], encode) -> tuple[str, list[int]]:
    """The monoid's operation on (text, ids); ("", []) is its unit."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return (a + b, x or y)
    if sure_cut(a[-1], b[0]):
        return a + b, x + y
    i, j = _last_cut(a), _first_cut(b)
    kept = len(x) - len(encode(a[i:]))
    cut = len(encode(b[:j]))
    return a + b, x[:kept] + encode(a[i:] + b[:j]) + y[cut:]


def encode_tree(text: str | None, encode, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of a text: halves are encoded on their own and joined up the tree."""
    if not text:
        return []

    def up(lo: int, hi: int) -> tuple[str, list[int]]:
        if hi - lo <= leaf:
            return text[lo:hi], encode(text[lo:hi])
        mid = (lo + hi) // 2
        return join(up(lo, mid), up(mid, hi), encode)

    return up(0, len(text))[1]


def decode_tree(ids: list[int], name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    """The text again: bytes are joined up the tree, then read as UTF-8 once."""
    tok = tokenizer(name, folder)

    def up(lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF_CHARS:
            return tok.decode_bytes(ids[lo:hi])
        return up(lo, (lo + hi) // 2) + up((lo + hi) // 2, hi)

    return up(0, len(ids)).decode("utf-8", errors="replace")


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, counts_only: bool = False
) -> DataFrame:
    """``id, ids`` (or ``id, n_tokens``) of every row; one narrow pass, no shuffle of its own."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(name, folder).encode_ordinary
        for pdf in batches:
            ids = [encode_tree(t, encode) for t in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], **({"n_tokens": [len(x) for x in ids]} if counts_only else {"ids": ids})})

    out = "n_tokens bigint" if counts_only else "ids array<int>"
    return spread(docs.select(id_col, text_col)).mapInPandas(run, f"`{id_col}` {kind}, {out}")
