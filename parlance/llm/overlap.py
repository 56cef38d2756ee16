"""Same or nearly the same records across splits.

Candidates are complete: a train record is cut into parts of six words, more than half as many as a pair may have
edits, so one part has an edit at most; five of its words are then five of six neighbours in the held-out record.
An exact word edit distance follows. For the pairs found, content-defined chunks (a cut lies before each word
whose rolling hash falls under a fraction of all values) give the overlap by the lengths of the shared chunks.
Exact copies are one class throughout and expand only in the final rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import packed, settled, slots
from .plain import plain_words

#: Share of words before which a cut lies, fewest and most words of a chunk, and independent sets of cuts.
CUT_SHARE, MIN_WORDS, MAX_WORDS, CUTTINGS = 1 / 3, 3, 16, 8
#: Fewest plain words of a record, and the share of the longer one that may be edited.
LEAST_WORDS, EDIT_SHARE = 20, 0.25
#: Words of a run, and runs that a pair shares at least: with LEAST_WORDS and EDIT_SHARE, no pair shares fewer.
RUN, COMMON = 3, 3
#: Words of a part of a train record, and of the parts where a held-out record has nearly a third more words.
PART, SHORT_PART = 6, 5
#: Classes of words that are counted in each record.
BAG = 32
#: Passes over the keys of parts: only those of one pass are on disk at a time.
PASSES = 3
#: Keys of a bucket, about: what a task matches at a time. Pairs that are made of them at a time.
_BUCKET, _PAIRS = 500_000, 2_000_000
#: Records whose chunks or texts are treated at a time, for memory; and records and words whose keys are made at a time.
_ROWS, _SLICE, _SLICE_WORDS = 1_000, 8_192, 500_000
#: Cuttings of the overlap fractions of all records.
FRACTION_CUTTINGS = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(MAX_WORDS, _BASE, dtype=np.uint64), dtype=np.uint64)


def _close(x: int, y: int) -> bool:
    k = int(EDIT_SHARE * y)
    rest = k - (y - x)
    return rest >= 0 and 2 * (x // PART) <= k and rest + (k - rest) // 2 >= x // SHORT_PART


#: Words of a train and a held-out record for which neither parts of six words nor whole ones of five are enough. There
#: are none from x = 75 on: y >= 8 * (x // 6), so the spoilt parts are x / 6 + 5 / 3 at most, under (x - 4) / 5.
CLOSE = [(x, y) for x in range(LEAST_WORDS, 75) for y in range(x + 1, 4 * x // 3 + 1) if _close(x, y)]


def split_name(column: str = "split"):
    s = F.lower(F.trim(F.col(column)))
    return F.when(s.isin("dev", "val", "valid"), "validation").when(s != "", s)


def chunk_digests(records: list[list[str]], cuttings: int = CUTTINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(record, digest, place, length) of each content-defined chunk of each list of words."""
    sizes = np.array([len(r) for r in records], dtype=np.int64)
    flat = [w for r in records for w in r]
    none = np.zeros(0, dtype=np.int64)
    if not flat:
        return none, none, none, none
    vocabulary: dict[str, int] = {}
    codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in flat), dtype=np.int64, count=len(flat))
    owner = np.repeat(np.arange(len(records)), sizes)
    first = np.zeros(len(flat), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)[codes]
    out = []
    with np.errstate(over="ignore"):
        for s in range(cuttings):
            roll = np.array([xxhash.xxh64_intdigest(w, s + 1) for w in vocabulary], dtype=np.uint64)[codes]
            cut = first | (roll < np.uint64(int(2**64 * CUT_SHARE)))
            begin = np.maximum.accumulate(np.where(cut, np.arange(len(flat)), 0))
            inside = (np.arange(len(flat)) - begin) % MAX_WORDS
            starts = np.flatnonzero(inside == 0)
            length = np.diff(np.append(starts, len(flat)))
            digest = np.add.reduceat(word * _POWERS[inside], starts) * _BASE + np.uint64(s)
            keep = length >= MIN_WORDS
            out.append((owner[starts[keep]], digest[keep].view(np.int64), at[starts[keep]], length[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def within(a: list[str], b: list[str], most: int) -> int | None:
    """Word edit distance where it is at most ``most``, else None; a band of the matrix suffices."""
    if abs(len(a) - len(b)) > most:
        return None
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        d = len(a) + len(b)
        return d if d <= most else None
    far = most + 1
    prev = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        cur = [far] * (len(b) + 1)
        if i <= most:
            cur[0] = i
        for j in range(lo, hi + 1):
            cur[j] = min(prev[j - 1] + (x != b[j - 1]), prev[j] + 1, cur[j - 1] + 1)
        if min(cur[max(0, lo - 1) : hi + 1]) > most:
            return None
        prev = cur
    return prev[-1] if prev[-1] <= most else None


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        w = [plain_words(t) for t in b["_t"]]
        b = b.assign(words=[" ".join(x) for x in w], n=np.array([len(x) for x in w], dtype=np.int32))
        b = b[b["n"] >= LEAST_WORDS]
        yield b.assign(_key=[hashlib.blake2b(x.encode(), digest_size=16).digest() for x in b["words"]])[["_id", "_split", "_source", "_key", "words", "n"]]


def run_digests(records: list[list[str]], hot: np.ndarray | None = None, count: np.ndarray | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(record, digest) of each record's rarest runs of ``RUN`` words, as many as a pair needs to share ``COMMON``.

    The join goes by ``candidate_keys``; this is an independent bound on what pairs share.

    ``hot`` has runs in order of value, with their ``count``; others are rare; ``every`` keeps all runs. A run's second, third ... occurrence
    in a record is a run of its own. With T = ceil(n / 4) - 2 runs shared by any pair, the first ``COMMON`` shared
    ones lie before the last T - COMMON of either record.
    """
    sizes = np.array([len(r) for r in records], dtype=np.int64)
    flat = [w for r in records for w in r]
    if len(flat) < RUN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    vocabulary: dict[str, int] = {}
    codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in flat), dtype=np.int64, count=len(flat))
    word = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)[codes]
    owner = np.repeat(np.arange(len(records)), sizes)
    with np.errstate(over="ignore"):
        run = sum(word[i : len(word) - RUN + 1 + i] * _POWERS[i] for i in range(RUN))
        whole = owner[: len(run)] == owner[RUN - 1 :]
        run, owner = run[whole], owner[: len(run)][whole]
        often = np.zeros(len(run), dtype=np.int64)
        if hot is not None and len(hot):
            at = np.minimum(np.searchsorted(hot, run), len(hot) - 1)
            often = np.where(hot[at] == run, count[at], 0)
        order = np.lexsort((run, often, owner))
        run, owner = run[order], owner[order]
        place = np.arange(len(run))
        group = np.ones(len(run), dtype=bool)
        group[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
        occurrence = place - np.maximum.accumulate(np.where(group, place, 0))
        least = np.ceil(sizes * EDIT_SHARE).astype(np.int64) - (RUN - 1)
        keep = place - np.searchsorted(owner, owner) < (sizes - (RUN - 1) - np.maximum(least - COMMON, 0) * (not every))[owner]
        digest = run + occurrence.astype(np.uint64) * _BASE
    return owner[keep], digest[keep].view(np.int64)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def word_numbers(records: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, numbers of the words among them, one record after the other; words of each record)."""
    flat, numbers = " ".join(records).split(" ") if records else [], _Numbers()
    found = np.fromiter(map(numbers.__getitem__, flat), dtype=np.uint32, count=len(flat))
    return np.array([xxhash.xxh32_intdigest(w) for w in numbers], dtype=np.uint32), found, np.array([r.count(" ") + 1 for r in records], dtype=np.int64)


def word_codes(records: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, one record after the other; words of each record); equal hashes may only add candidates."""
    hashes, numbers, sizes = word_numbers(records)
    return hashes[numbers], sizes


def _parts(sizes: np.ndarray, size: int) -> np.ndarray:
    """Place of the first word of each record's parts of ``size`` words."""
    count = sizes // size
    return np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(count) - count) * size, count) + np.arange(count.sum()) * size


def part_keys(word: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, key) of each record's parts of ``size`` words, each less one of its words; of a rest of size - 1 words too.

    ``word`` has the records' words as numbers, one record after the other, ``sizes`` their counts.
    """
    at = _parts(sizes, size)
    rest = np.flatnonzero(sizes % size == size - 1)
    of = [word[at + j] for j in range(size)]
    keys = [sum(x * _POWERS[i] for i, x in enumerate(of[1:]))]
    for i in range(size - 1):  # the word left out moves on by one
        keys.append(keys[-1] + (of[i] - of[i + 1]) * _POWERS[i])
    last = np.cumsum(sizes)[rest] - size + 1
    return np.concatenate([*[at] * size, last]), np.concatenate([*keys, sum(word[last + i] * _POWERS[i] for i in range(size - 1))])


def window_keys(word: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, key) of each size - 1 words in a row, and of each ``size`` words in a row less one between its ends."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(word) - size + 2)
    run = sum(word[i : n + i] * _POWERS[i] for i in range(size - 1))
    inside, window = owner[:n] == owner[size - 2 :], owner[: max(0, n - 1)] == owner[size - 1 :]
    places, keys, key = [np.flatnonzero(inside)], [run[inside]], run[: max(0, n - 1)]
    at = np.flatnonzero(window)
    for i in range(size - 2, 0, -1):
        key = key + (word[i + 1 : len(key) + i + 1] - word[i : len(key) + i]) * _POWERS[i]
        places.append(at)
        keys.append(key[window])
    return np.concatenate(places), np.concatenate(keys)


def candidate_keys(codes: np.ndarray, sizes: np.ndarray, train: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place of a word, key) such that a train and a held-out record within the edits share a key.

    Let x and y be the words of a train and a held-out record and k the edits they may have. x // 6 parts of six words
    have an edit or none in one of them at least where 2 * (x // 6) > k, and a part with one edit shares a key with the
    window it has become. Else y exceeds x, and nearly all edits are insertions: at most k - (y - x) are not. Those spoil
    a whole part of five words each, insertions two by two, so that one has a word more at most, unless x and y are
    ``CLOSE``. For these k <= x / 3, and parts of five words less one are enough: 2 * (x // 5) > x / 3, but for x = 24,
    where the four words that remain are a part that one edit spoils.
    """
    with np.errstate(over="ignore"):
        word = codes * _BASE
        word ^= word >> np.uint64(32)
        found = [(part_keys if train else window_keys)(word, sizes, PART)]
        for y in sorted({y for _, y in CLOSE}) if train else [None]:
            some = np.isin(sizes, [a if train else b for a, b in CLOSE if y in (None, b)])
            if some.any():
                words = np.flatnonzero(np.repeat(some, sizes))
                at, key = (part_keys if train else window_keys)(word[words], sizes[some], SHORT_PART)
                at = words[at]
                # lengths that meet have keys of their own
                found.append((at, key + np.uint64(0x94D049BB133111EB) * (np.uint64(y) if train else np.repeat(sizes, sizes).astype(np.uint64)[at])))
        if train:
            at = _parts(sizes, SHORT_PART)
            found.append((at, sum(word[at + i] * _POWERS[i] for i in range(SHORT_PART))))
        places, keys = zip(*found, strict=True)
        return np.concatenate(places), np.concatenate(keys)


def _slices(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Stretches of rows with ids that follow each other, of a bounded number of rows and words."""
    ids, words = b["id"].to_numpy(), np.cumsum(b["n"].to_numpy(dtype=np.int64))
    i = 0
    while i < len(b):
        jump = np.flatnonzero(np.diff(ids[i : i + _SLICE]) != 1)
        j = min(i + _SLICE, len(b), i + 1 + int(jump[0]) if len(jump) else len(b))
        j = max(i + 1, min(j, int(np.searchsorted(words, (words[i - 1] if i else 0) + _SLICE_WORDS, "right"))))
        yield b.iloc[i:j]
        i = j


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per slice: its first id, and sizes, sides and word codes of its records, compressed."""
    for b in (x for batch in batches for x in _slices(batch)):
        hashes, numbers, sizes = word_numbers(b["words"].tolist())
        numbers = numbers.astype(np.uint16 if len(hashes) <= 1 << 16 else np.uint32)
        data = b"".join(x.tobytes() for x in (sizes, hashes, numbers, (b["train"] + 2 * b["held"]).to_numpy(dtype=np.uint8)))
        yield pd.DataFrame({"first": [int(b["id"].iloc[0])], "n": [len(b)], "distinct": [len(hashes)], "size": [len(data)], "data": [pa.compress(data, "zstd", asbytes=True)]})


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, n, distinct, size, data in (x for b in batches for x in zip(b["first"], b["n"], b["distinct"], b["size"], b["data"], strict=True)):
        data = pa.decompress(data, size, "zstd", asbytes=True)
        sizes, hashes = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint32, distinct, 8 * n)
        numbers = np.frombuffer(data, np.uint16 if distinct <= 1 << 16 else np.uint32, int(sizes.sum()), 8 * n + 4 * distinct)
        yield first, sizes, np.frombuffer(data, np.uint8, n, size - n), hashes[numbers]


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many words of a record fall in each of ``BAG`` classes, 255 at most."""
    for first, sizes, side, codes in _decoded(batches):
        count = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * BAG + codes % BAG, minlength=len(sizes) * BAG).reshape(-1, BAG)
        yield pd.DataFrame({"id": first + np.arange(len(sizes)), "n": sizes.astype(np.int32), "side": side.astype(np.int32), "bag": [x.tobytes() for x in np.minimum(count, 255).astype(np.uint8)]})


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose counts differ by no more than the edits allow: two by a word replaced, one by one inserted or deleted."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, BAG).astype(np.int16) for c in ("bag_a", "bag_b"))
        n, m = b["n_a"].to_numpy(), b["n_b"].to_numpy()
        apart = np.abs(n - m)
        most = (EDIT_SHARE * np.maximum(n, m)).astype(np.int64)
        yield b.loc[(apart <= most) & (np.abs(x - y).sum(axis=1) <= 2 * most - apart), ["a", "b"]]


def _keys(batches: Iterator[pd.DataFrame], buckets: int, only: int) -> Iterator[pd.DataFrame]:
    """The keys of one pass, by bucket: first id, count of train's keys, keys of train and of held-out records, their records, and words before and from there.

    Counts of words are left open (255) where one is more than 254, and where a record has a key twice.
    """
    # 16 bits of a key tell pass and bucket, the next 32 are kept
    least, beyond = (-(-(x << 16) // PASSES) << 48 for x in (only, only + 1))
    for first, sizes, side, codes in _decoded(batches):
        sides = []
        for bit in (1, 2):
            at = np.flatnonzero(side & bit)
            own = sizes[at]
            place, key = candidate_keys(codes[np.repeat(side & bit > 0, sizes)], own, bit == 1)
            mine = (key >= np.uint64(least)) & (key <= np.uint64(beyond - 1))
            place, key = place[mine], key[mine]
            owner = np.repeat(np.arange(len(own)), own)[place]
            before = place - (np.cumsum(own) - own)[owner]
            after = own[owner] - before
            value = key & ~np.uint64(0xFFFF) | at.astype(np.uint64)[owner]
            order = np.argsort(value)
            value = value[order]
            # a key that a record repeats counts once
            once = np.flatnonzero(np.diff(value, prepend=~value[:1]) != 0)
            open_ = (np.diff(once, append=len(value)) > 1) | (np.maximum(before, after)[order][once] > 254)
            words = [np.where(open_, 255, x[order][once]).astype(np.uint8) for x in (before, after)]
            value = value[once]
            bucket = ((value >> np.uint64(48)) * np.uint64(buckets * PASSES) >> np.uint64(16)) - np.uint64(buckets * only)
            sides.append(([(value >> np.uint64(16)).astype(np.uint32), value.astype(np.uint16), *words], np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))))
        (train, te), (held, he) = sides
        parts = lambda i: [x.tobytes() for t, h in zip(train, held, strict=True) for x in (t[te[i] : te[i + 1]], h[he[i] : he[i + 1]])]  # noqa: B023, E731
        rows = [(i, np.array([first, te[i + 1] - te[i]], dtype=np.int64).tobytes() + b"".join(parts(i))) for i in range(buckets) if te[i] < te[i + 1] or he[i] < he[i + 1]]
        yield pd.DataFrame(rows, columns=["bucket", "keys"])


def _match(b: pd.DataFrame) -> pd.DataFrame:
    """Distinct pairs (a, b) of the ids of train and held-out records that share a key of the bucket."""
    sides: tuple[list, list] = ([], [])
    for x in b["keys"]:
        first, train = np.frombuffer(x, np.int64, 2)
        n = (len(x) - 16) // 8
        key, record, before, after = (np.frombuffer(x, kind, n, 16 + at * n) for kind, at in ((np.uint32, 0), (np.uint16, 4), (np.uint8, 6), (np.uint8, 7)))
        for side, part in zip(sides, (slice(0, train), slice(train, n)), strict=True):
            side.append((key[part], first + record[part].astype(np.int64), before[part], after[part]))
    low = np.uint64(0xFFFFFFFF)
    (tk, *t), (hk, *h) = (tuple(np.concatenate(c) for c in zip(*side, strict=True)) for side in sides)
    order = [np.sort(k.astype(np.uint64) << np.uint64(32) | np.arange(len(k), dtype=np.uint64)) for k in (tk, hk)]
    tk, hk = (x >> np.uint64(32) for x in order)
    begin = np.searchsorted(tk, hk)
    count = np.searchsorted(tk, hk, "right") - begin
    hit = np.flatnonzero(count)
    begin, count = begin[hit], count[hit]
    ti, hi = (order[0] & low).astype(np.int64), (order[1][hit] & low).astype(np.int64)
    out = [pd.DataFrame({"a": t[0][:0], "b": h[0][:0]})]
    # a key that many records have on both sides makes its pairs in stretches
    total = np.cumsum(count)
    for low_ in range(0, int(total[-1]) if len(total) else 0, _PAIRS):
        pair = np.arange(low_, min(low_ + _PAIRS, int(total[-1])))
        of = np.searchsorted(total, pair, "right")
        x, y = ti[begin[of] + pair - (total[of] - count[of])], hi[of]
        before, after, before_, after_ = (c[i].astype(np.int64) for i, side in ((x, t), (y, h)) for c in side[1:])
        # words that one has more before or after are edits, but for those by which the part and its window may differ
        near = np.abs(before - before_) + np.abs(after - after_) <= (EDIT_SHARE * np.maximum(before + after, before_ + after_)).astype(np.int64) + 4
        near |= (before == 255) | (before_ == 255)
        out.append(pd.DataFrame({"a": t[0][x[near]], "b": h[0][y[near]]}).drop_duplicates())
        if len(out) > 8:
            out = [pd.concat(out).drop_duplicates()]
    found = pd.concat(out).drop_duplicates()
    return found[found["a"] != found["b"]]


def _overlaps(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """Share of the shorter record's words in chunks that both records of a pair have; each chunk of it counts."""
    short, long = zip(*(sorted(p, key=len) for p in zip(a, b, strict=True)), strict=True) if a else ((), ())
    owner, digest, _, length = chunk_digests([*short])
    has = pd.MultiIndex.from_arrays(chunk_digests([*long])[:2])
    hit = pd.MultiIndex.from_arrays([owner, digest]).isin(has) if len(owner) else np.zeros(0, dtype=bool)
    n = np.array([len(x) for x in short], dtype=np.int64)
    return np.bincount(owner[hit], length[hit], minlength=len(n)) / (CUTTINGS * np.maximum(n, 1))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in (x.iloc[i : i + _ROWS] for x in batches for i in range(0, len(x), _ROWS)):
        d, near = [], []
        for x, y in zip(b["words_a"], b["words_b"], strict=True):
            x, y = x.split(" "), y.split(" ")
            most, longer = int(EDIT_SHARE * max(len(x), len(y))), max(len(x), len(y))
            # words that the other record lacks are edits, wherever they stand
            d.append(within(x, y, most) if longer - (Counter(x) & Counter(y)).total() <= most else None)
            if d[-1] is not None:
                near.append((x, y))
        b = b.assign(distance=pd.array(d, dtype="Int64"))
        b = b[b["distance"].notna()]
        yield pd.DataFrame({"a": b["a"], "b": b["b"], "distance": b["distance"].astype(np.int32), "overlap": _overlaps([x for x, _ in near], [y for _, y in near])})


def classes(records: DataFrame, id_col: str = "example_id", split_col: str = "split", text_col: str = "text", source_col: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """(members, representatives): members id, split, source, cls; one representative per distinct plain text.

    Records with a null id, split or text, and those under ``LEAST_WORDS`` plain words, take no part.
    Repeated rows count once. Other columns are ignored.
    """
    base = records.select(F.col(f"`{id_col}`").alias("_id"), split_name(f"`{split_col}`").alias("_split"), F.lower(F.trim(F.col(f"`{source_col}`"))).alias("_source"), F.col(f"`{text_col}`").alias("_t")).where("_id IS NOT NULL AND _split IS NOT NULL AND length(_t) >= 20")
    # read several times below; the plain words are made once, and texts travel once: 128 bits stand for them
    plain = packed(base.mapInPandas(_plain, "_id string, _split string, _source string, _key binary, words string, n int"))
    train = F.col("_split") == "train"
    reps = plain.groupBy("_key").agg(F.min("_id").alias("cls"), F.first("words").alias("words"), F.first("n").alias("n"), F.max(train.cast("int")).alias("train"), F.max((~train).cast("int")).alias("held"))
    reps = packed(reps.withColumn("id", F.monotonically_increasing_id()))
    members = packed(plain.select("_id", "_split", "_source", "_key").join(reps.select("_key", "cls"), "_key").select("_id", "_split", "_source", "cls"))
    return members, reps


def near_classes(reps: DataFrame) -> DataFrame:
    """Pairs of different classes, ``a`` with train and ``b`` with held-out members, with distance and overlap.

    Classes are numbers until texts are compared. Their keys go to buckets, 8 bytes each, one pass of them after the
    other; what a pass has shuffled is gone before the next begins.
    """
    spark = reps.sparkSession
    # keys a word, about: up to two of a train record, six of a held-out one
    keys = reps.agg(F.sum(F.col("n").cast("bigint") * (2 * F.col("train") + 6 * F.col("held")))).first()[0] or 0
    buckets = max(slots(spark), keys // (PASSES * _BUCKET))
    coded = settled(reps.select("id", "words", "n", "train", "held").mapInPandas(_coded, "first long, n int, distinct int, size long, data binary"))
    counts = settled(coded.mapInPandas(_bags, "id long, n int, side int, bag binary"))
    bags = lambda bit, c: counts.where(F.col("side").bitwiseAND(F.lit(bit)) > 0).select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bag").alias(f"bag_{c}"))
    pairs = None
    for i in range(PASSES):
        found = coded.mapInPandas(partial(_keys, buckets=buckets, only=i), "bucket int, keys binary").groupBy("bucket").applyInPandas(_match, "a long, b long").distinct()
        # few chance pairs are left when texts are joined
        found = settled(found.join(bags(1, "a"), "a").join(bags(2, "b"), "b").mapInPandas(_alike, "a long, b long"))
        pairs = found if pairs is None else pairs.unionByName(found)
    # texts grow with the data: they are joined by shuffles, never sent to the driver
    texts = lambda side, c: reps.where(f"{side} = 1").select(F.col("id").alias(c), F.col("cls").alias(f"cls_{c}"), F.col("words").alias(f"words_{c}")).hint("merge")
    return settled(
        pairs.distinct()
        .join(texts("train", "a"), "a")
        .join(texts("held", "b"), "b")
        .select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "words_a", "words_b")
        .mapInPandas(_verify, "a string, b string, distance int, overlap double")
    )


def cross_split_pairs(records: DataFrame, **columns: str) -> DataFrame:
    """One row per pair of a train and a held-out record that are the same or nearly so.

    Columns: id_a < id_b, id, split and source of the held-out record, distance in words and overlap (1.0 for copies).
    Empty tables and null texts give no rows.
    """
    members, reps = classes(records, **columns)
    links = near_classes(reps).unionByName(reps.where("train = 1 AND held = 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0).alias("distance"), F.lit(1.0).alias("overlap")))
    t = members.where("_split = 'train'").select(F.col("_id").alias("t_id"), F.col("cls").alias("a")).distinct()
    h = members.where("_split <> 'train'").select(F.col("_id").alias("h_id"), "_split", "_source", F.col("cls").alias("b")).distinct()
    return (
        links.join(t, "a")
        .join(h, "b")
        .where("t_id <> h_id")
        .select(F.least("t_id", "h_id").alias("id_a"), F.greatest("t_id", "h_id").alias("id_b"), F.col("h_id").alias("held_id"), F.col("_split").alias("split"), F.col("_source").alias("source"), "distance", "overlap")
        .dropDuplicates(["id_a", "id_b"])
    )


def document_classes(records: DataFrame, **columns: str) -> DataFrame:
    """One row per record and class, of train and held-out splits alike: its class id, and its number of links.

    Links are the classes on the other side that its class is near to, its own included where it has members
    there. Records that take no part (null split or text, too few words) have no row.
    """
    members, reps = classes(records, **columns)
    near = near_classes(reps)
    count = lambda c: near.groupBy(F.col(c).alias("cls")).agg(F.count(F.lit(1)).alias(f"near_{c}"))
    links = reps.select("cls", "train", "held").join(count("a"), "cls", "left").join(count("b"), "cls", "left")
    train = F.col("_split") == "train"
    n = F.when(train, F.coalesce("near_a", F.lit(0)) + F.col("held")).otherwise(F.coalesce("near_b", F.lit(0)) + F.col("train"))
    return members.join(links, "cls").select(F.col("_id").alias("example_id"), F.col("_split").alias("split"), F.col("_source").alias("source"), F.col("cls").alias("class_id"), n.alias("links")).distinct()


def _cut(batches: Iterator[pd.DataFrame], cuttings: int) -> Iterator[pd.DataFrame]:
    for b in (x.iloc[i : i + _ROWS] for x in batches for i in range(0, len(x), _ROWS)):
        owner, digest, _, length = chunk_digests([w.split(" ") for w in b["words"]], cuttings)
        yield pd.DataFrame({"cls": b["cls"].to_numpy()[owner], "digest": digest, "length": length.astype(np.int32)})


def overlap_fractions(records: DataFrame, cuttings: int = FRACTION_CUTTINGS, **columns: str) -> DataFrame:
    """(example_id, split, source, words, overlap) of each held-out record: the share of its words in content-defined chunks that train has too.

    Copies of one text are cut once; train's chunks are made distinct before they are joined, so a chunk that many
    records hold is one row.
    """
    members, reps = classes(records, **columns)
    chunks = lambda side: reps.where(f"{side} = 1").select("cls", "words").mapInPandas(partial(_cut, cuttings=cuttings), "cls string, digest long, length int")
    shared = chunks("held").join(chunks("train").select("digest").distinct(), "digest", "left_semi").groupBy("cls").agg(F.sum("length").alias("_shared"))
    held = members.where("_split <> 'train'").join(reps.select("cls", "n"), "cls").join(shared, "cls", "left")
    return held.select(F.col("_id").alias("example_id"), F.col("_split").alias("split"), F.col("_source").alias("source"), F.col("n").alias("words"), F.round(F.coalesce("_shared", F.lit(0)) / (F.col("n") * cuttings), 9).alias("overlap")).distinct()


def overlap_report(records: DataFrame, **columns: str) -> DataFrame:
    """Held-out records and pairs with an overlap into train, per split and source."""
    pairs = cross_split_pairs(records, **columns)
    return pairs.groupBy("split", "source").agg(F.countDistinct("held_id").alias("records"), F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("distance") == 0, 1)).alias("exact_pairs"))
