"""Encoding of a corpus with a public byte-level BPE tokenizer.

Long texts are encoded as a tree: both halves in parallel, then growing windows around the join are encoded
again until the window's ends agree with both sides. A window begins and ends where the tokenizer's pattern
splits any text: before a space that a letter, digit or mark follows, or a letter that follows a mark. What
lies on either side of such a place is encoded independently, so the joined list is exact. A stretch without
such a place is one run for the merges, and is encoded as a tree of bytes: two tokens may stand side by side
in a BPE encoding if and only if the pair itself encodes to these two, and with the window's ends agreed every
pair of the joined list has been checked by one encoding or another.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a text, or of an unsplit stretch, that one call encodes; longer ones go through the tree.
LEAF = 2_000
#: Tokens on each side of a join of bytes in the first window, and characters on each side of a join of texts.
WINDOW, REACH = 8, 32
#: Places where the pattern splits whatever stands around: none of the marks is a letter of a contraction or white space.
_SAFE = regex.compile(r"(?V1)(?<=[^\s\p{L}\p{N}'])(?=\p{L})(?<! )|(?<=\p{L})(?=[[^\s\p{L}\p{N}]--['’]])|(?= [^\s])")
_SPLIT = regex.compile(PATTERN)


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _pool(pid: int) -> ThreadPoolExecutor:
    return ThreadPoolExecutor(2)


@lru_cache(8)
def _long_run(leaf: int):
    """What any unsplit stretch of more than ``leaf`` bytes contains; a character has at most four."""
    n = max(1, leaf // 4 - 1)
    return re.compile(rf"\S{{{n}}}|\s{{{n}}}")


def _merge_bytes(enc, data: bytes) -> list[int]:
    return enc._encode_single_piece(data)


def join(enc, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
    """The encoding of the concatenated bytes of two encodings."""
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        middle = _merge_bytes(enc, enc.decode_bytes(a + b))
        whole_a, whole_b = len(a) == len(left), len(b) == len(right)
        # the window's outer token must be the one that is there, unless nothing lies beyond it
        if (whole_a or middle[0] == a[0]) and (whole_b or middle[-1] == b[-1]):
            return left[: len(left) - len(a)] + middle + right[len(b) :]
        if whole_a and whole_b:
            return middle
        window *= 2


def encode_unsplit(enc, data: bytes, leaf: int = LEAF, window: int = WINDOW, depth: int = 0) -> list[int]:
    """Encodes bytes that the pattern does not split, by halves."""
    if len(data) <= leaf:
        return _merge_bytes(enc, data)
    half = len(data) // 2
    if depth == 0:
        first = _pool(os.getpid()).submit(encode_unsplit, enc, data[:half], leaf, window, 1)
        right = encode_unsplit(enc, data[half:], leaf, window, 1)
        left = first.result()
    else:
        left, right = (encode_unsplit(enc, x, leaf, window, depth + 1) for x in (data[:half], data[half:]))
    return join(enc, left, right, window)


@lru_cache(4)
def _lengths(enc) -> np.ndarray:
    """Bytes of each token."""
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for token in enc._mergeable_ranks.values():
        out[token] = len(enc.decode_single_token_bytes(token))
    return out


def _leaf(enc, text: str, leaf: int) -> list[int]:
    """One piece of a text; a stretch in it that the pattern does not split goes through the tree of bytes if long."""
    if len(text) * 4 <= leaf or not _long_run(leaf).search(text):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for m in _SPLIT.finditer(text):
        piece = m.group().encode("utf-8", "surrogatepass")
        ids += encode_unsplit(enc, piece, leaf) if len(piece) > leaf else _merge_bytes(enc, piece)
    return ids


def _token_at(ends: np.ndarray, size: int) -> int | None:
    """How many tokens cover exactly the first ``size`` bytes; None where a token goes across."""
    i = int(np.searchsorted(ends, size))
    return i + 1 if i < len(ends) and ends[i] == size else None


def join_texts(enc, text: str, at: int, left: list[int], right: list[int], leaf: int = LEAF, reach: int = REACH) -> list[int]:
    """The encoding of a text from those of text[:at] and text[at:]."""
    ends = [np.cumsum(_lengths(enc)[np.array(x, dtype=np.int64)]) for x in (left, right)]
    size = lambda a, b: len(text[a:b].encode("utf-8", "surrogatepass"))
    while True:
        # the window's ends: safe places at least ``reach`` characters from the join, else the text's own ends
        lo = next((m.start() for m in _SAFE.finditer(text, max(0, at - 2 * reach), max(0, at - reach)) if m.start()), None) if at > reach else 0
        m = _SAFE.search(text, at + reach) if at + reach < len(text) else None
        if lo is None and at <= 2 * reach:
            lo = 0
        if lo is not None:
            hi = m.start() if m else len(text)
            i = _token_at(ends[0], size(0, lo)) if lo else 0
            j = _token_at(ends[1], size(at, hi)) if hi < len(text) else len(right)
            if i is not None and j is not None:
                middle = _leaf(enc, text[lo:hi], leaf)
                # the window's outer tokens must be those of both sides
                if (not lo or i == len(left) or middle[0] == left[i]) and (hi == len(text) or j == 0 or middle[-1] == right[j - 1]):
                    return left[:i] + middle + right[j:]
        if at - reach <= 0 and at + reach >= len(text):
            return _leaf(enc, text, leaf)
        reach *= 2


def encode_tree(enc, text: str, leaf: int = LEAF, reach: int = REACH, depth: int = 0) -> list[int]:
    """Encodes a text by halves, the first ones in parallel."""
    if len(text) <= leaf:
        return _leaf(enc, text, leaf)
    at = len(text) // 2
    if depth == 0:
        first = _pool(os.getpid()).submit(encode_tree, enc, text[:at], leaf, reach, 1)
        right = encode_tree(enc, text[at:], leaf, reach, 1)
        left = first.result()
    else:
        left, right = (encode_tree(enc, x, leaf, reach, depth + 1) for x in (text[:at], text[at:]))
    return join_texts(enc, text, at, left, right, leaf, reach)


def encode(enc, text: str | None, leaf: int = LEAF) -> list[int]:
    """Ids without special tokens, whose strings count as ordinary text; an empty list for null and empty text."""
    return encode_tree(enc, text, leaf) if text else []


def encode_column(text: Column, ranks: str = DEFAULT_RANKS) -> Column:
    """Array of token ids of a text column."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(ranks)
        for s in texts:
            yield pd.Series([encode(enc, t) for t in s], index=s.index, dtype=object)

    return run(text)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, partitions: int | None = None) -> DataFrame:
    """(doc_id, ids) of every document, in one pass without a shuffle of texts.

    Null and empty texts get an empty list, blank ones their ids. Ids are taken as unique: a row that repeats
    comes out again. ``partitions`` spreads few large files over more tasks. Other columns are ignored.
    """
    d = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_t"))
    if partitions:
        d = d.repartition(partitions)
    return d.select("doc_id", encode_column(F.col("_t"), ranks).alias("ids")).select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
