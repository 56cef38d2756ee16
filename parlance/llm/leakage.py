"""Passages of held-out items inside a corpus.

Windows slide over the items and over every document at two scales: that of the least passage, which finds
parts of an item, and that of the item itself, which tells whole or slightly edited copies. A window's SimHash
adds the signed bits of its words' hashes. Fingerprints within a radius agree on at least one of radius + 1
blocks of bits, so looking up each block finds all of them. Candidates are then compared exactly by their
weighted shingles; a shingle weighs more the fewer items hold it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed
from .plain import plain_words

#: Plain words in a row that make a passage; words of a shingle, and the least weighted similarity of windows.
PASSAGE, SHINGLE, LEAST = 12, 5, 0.8
#: Greatest Hamming distance of candidates at the passage's and at the item's scale.
RADIUS, ITEM_RADIUS = 2, 5
#: Item-sized windows come in sizes from 20 words on, each a quarter longer; a document's lie an eighth of their size apart.
SMALLEST, GROWTH, STEPS = 20, 1.25, 8
#: Characters of held-out text that one pass over the corpus may carry; more is searched in several passes.
PASS_CHARS = 4_000_000
#: Words of documents that are searched at a time, for memory.
_WORDS = 60_000
_PRESENT_BITS = 22


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of counters given as planes of bits, lowest first: 64 counters an element."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x, y = a[i] if i < len(a) else None, b[i] if i < len(b) else None
        if x is None or y is None:
            x = y if x is None else x
            out.append(x if carry is None else x ^ carry)
            carry = None if carry is None else x & carry
            continue
        half = x ^ y
        out.append(half if carry is None else half ^ carry)
        carry = x & y if carry is None else (x & y) | (half & carry)
    return out if carry is None else [*out, carry]


def simhashes(words: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of all windows over a sequence of 64-bit word hashes; a bit is set where most words set it."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, planes, size, at = [], [words], 1, 0
    while True:
        if window & size:
            total = _add(total, [p[at : at + n] for p in planes])
            at += size
        size *= 2
        if size > window:
            break
        half = size // 2
        planes = _add([p[:-half] for p in planes], [p[half:] for p in planes])
    # counters above half the window, from the highest plane down
    more, equal = np.zeros(n, dtype=np.uint64), np.full(n, ~np.uint64(0))
    for i in range(max(len(total), (window // 2).bit_length()) - 1, -1, -1):
        bit = total[i] if i < len(total) else np.zeros(n, dtype=np.uint64)
        if window // 2 >> i & 1:
            equal = equal & bit
        else:
            more |= equal & bit
            equal = equal & ~bit
    return more


def item_size(words: int) -> int | None:
    """The size of the windows that stand for a whole item of so many words; None for shorter ones than the smallest.

    A document that holds the item has a window of this size that lies inside the copy.
    """
    best, size = None, float(SMALLEST)
    while int(size) + int(size) // STEPS - 1 <= words:
        best, size = int(size), size * GROWTH
    return best


class Blocks:
    """Fingerprints by blocks of their bits: finds all within ``radius`` bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            v = self._block(prints, lo, hi)
            order = np.argsort(v, kind="stable")
            self.blocks.append((lo, hi, v[order], order))
        self.present: list[np.ndarray] = []

    def __getstate__(self):
        return self.__dict__ | {"present": []}

    @staticmethod
    def _block(v: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (v >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, own fingerprint) of all pairs within the radius."""
        if not self.present:
            for lo, hi, values, _ in self.blocks:
                p = np.zeros(1 << min(int(hi - lo), _PRESENT_BITS), dtype=bool)
                p[values & np.uint64(len(p) - 1)] = True
                self.present.append(p)
        qs, ws = [], []
        for (lo, hi, values, order), present in zip(self.blocks, self.present, strict=True):
            v = self._block(prints, lo, hi)
            maybe = np.flatnonzero(present[v & np.uint64(len(present) - 1)])
            v = v[maybe]
            a, b = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            n = b - a
            q = np.repeat(maybe, n)
            w = order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            close = np.bitwise_count(prints[q] ^ self.prints[w]) <= self.radius
            qs.append(q[close])
            ws.append(w[close])
        q, w = np.concatenate(qs), np.concatenate(ws)
        if not len(q):
            return q, w
        u = np.unique(q * np.int64(len(self.prints)) + w)
        return u // len(self.prints), u % len(self.prints)


def _shingles(words: list[str], size: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(min(size, len(words)))), strict=False))


def _longest(a: list[str], b: list[str]) -> int:
    """Most words in a row that both lists hold."""
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        prev = [0] + [prev[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *prev)
    return best


class Index:
    """Windows of the held-out items at both scales, by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[str, str]], passage: int = PASSAGE, radius: int = RADIUS, item_radius: int = ITEM_RADIUS, shingle: int = SHINGLE):
        self.passage, self.shingle = passage, shingle
        self.items, self.words, hashes = [], [], []
        for key, text in items:
            w = plain_words(text)
            if len(w) >= passage:
                self.items.append(key)
                self.words.append(w)
                hashes.append(_hash(w, {}))
        held = Counter(s for w in self.words for s in _shingles(w, shingle))
        #: What a shingle weighs; one that no item holds weighs as one that a single item does.
        self.weight = {s: 1 + math.log(len(self.words) / n) for s, n in held.items() if n > 1}
        self.rare = 1 + math.log(max(1, len(self.words)))
        sizes = {passage: [*range(len(self.items))]}
        for i, w in enumerate(self.words):
            if size := item_size(len(w)):
                sizes.setdefault(size, []).append(i)
        self.scales = []
        for size, own in sorted(sizes.items()):
            prints = [simhashes(hashes[i], size) for i in own]
            owner = np.repeat(np.array(own, dtype=np.int64), [len(p) for p in prints])
            place = np.concatenate([np.arange(len(p)) for p in prints]) if own else np.zeros(0, dtype=np.int64)
            blocks = Blocks(np.concatenate(prints) if own else np.zeros(0, dtype=np.uint64), radius if size == passage else item_radius)
            self.scales.append((size, 1 if size == passage else max(1, size // STEPS), owner, place, blocks))

    def similarity(self, a: list[str], b: list[str]) -> float:
        """Weighted Jaccard similarity of two windows' shingles."""
        if a == b:
            return 1.0
        x, y = _shingles(a, self.shingle), _shingles(b, self.shingle)
        of = lambda c: sum(n * self.weight.get(s, self.rare) for s, n in c.items())
        return of(x & y) / max(1e-9, of(x | y))

    def leaks(self, documents: list[list[str]], least: float = LEAST) -> list[tuple[int, str, bool, float]]:
        """(document, item, passage, whole) of pairs with a pair of windows of similarity ``least`` or more.

        ``passage``: the windows share a passage word by word; ``whole``: the greatest similarity of
        item-sized windows, 0 where none is similar.
        """
        if not self.items:
            return []
        found: dict[tuple[int, int], list] = {}
        cache: dict[str, int] = {}
        at = 0
        while at < len(documents):
            end, n = at, 0
            while end < len(documents) and (end == at or n + len(documents[end]) <= _WORDS):
                n += len(documents[end])
                end += 1
            sizes = np.array([len(d) for d in documents[at:end]], dtype=np.int64)
            owner = np.repeat(np.arange(at, end), sizes)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hashes = _hash([w for d in documents[at:end] for w in d], cache)
            for size, step, own, place, blocks in self.scales:
                prints = simhashes(hashes, size)
                keep = np.flatnonzero((owner[: len(prints)] == owner[size - 1 :]) & (inside[: len(prints)] % step == 0)) if len(prints) else np.zeros(0, dtype=np.int64)
                for i, j in zip(*(x.tolist() for x in blocks.near(prints[keep])), strict=True):
                    i = int(keep[i])
                    pair = (int(owner[i]), int(own[j]))
                    had = found.get(pair)
                    whole = size != self.passage
                    if had and (had[1] == 1.0 if whole else had[0]):
                        continue
                    p, k = int(inside[i]), int(place[j])
                    a, b = documents[pair[0]][p : p + size], self.words[pair[1]][k : k + size]
                    s = self.similarity(a, b)
                    if s >= least:
                        had = found.setdefault(pair, [False, 0.0])
                        had[0] = had[0] or a == b or _longest(a, b) >= self.passage
                        had[1] = max(had[1], s) if whole else had[1]
            at = end
            if len(cache) > 500_000:
                cache.clear()
        return [(d, self.items[i], *v) for (d, i), v in sorted(found.items())]


def _hash(words: list[str], cache: dict[str, int]) -> np.ndarray:
    new = {*words} - cache.keys()
    cache.update(zip(new, map(xxhash.xxh64_intdigest, new), strict=True))
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "blind_id", item_text: str = "reference", passage: int = PASSAGE, radius: int = RADIUS, item_radius: int = ITEM_RADIUS, least: float = LEAST, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(document id, item id, passage, whole), once per pair, of documents that hold an item or a part of it.

    ``passage`` says that ``passage`` plain words in a row are the same; ``whole`` is the greatest weighted
    similarity of item-sized windows from ``least`` on, else 0. Null, empty and short texts on either side
    share nothing; repeated rows count once; an empty table on either side gives no rows. The items ride with
    the tasks, in passes of at most ``pass_chars`` characters each; a pass is written before the next one's
    items are fetched, so the driver holds one pass only. Documents are read once per pass and never shuffled.
    """
    held = items.select(F.col(f"`{item_id}`").cast("string").alias("k"), F.col(f"`{item_text}`").alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    chars = held.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    passes = max(1, -(-int(chars) // pass_chars))
    docs = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_t")).where(F.length("_t") >= passage)
    kind = dict(docs.dtypes)["doc_id"]
    found = None
    for i in range(passes):
        rows = [(r["k"], r["t"]) for r in held.where(F.pmod(F.xxhash64("k"), F.lit(passes)) == i).toLocalIterator()]
        index = Index(sorted(rows), passage, radius, item_radius)

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                hits = index.leaks([plain_words(t) for t in b["_t"]], least)
                d, k, exact, whole = zip(*hits, strict=True) if hits else ((), (), (), ())
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[list(d)], "item": pd.Series(k, dtype=object), "passage": np.array(exact, dtype=bool), "whole": np.array(whole, dtype=float)})

        part = docs.mapInPandas(search, f"doc_id {kind}, item string, passage boolean, whole double")
        part = checkpointed(part) if passes > 1 else part
        found = part if found is None else found.unionByName(part)
    # rows that repeat an item or a document under the same id are one pair
    return found.groupBy(F.col("doc_id").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("passage").alias("passage"), F.max("whole").alias("whole"))
