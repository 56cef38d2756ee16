"""Minimum-edit alignment of token lists, for many pairs at once.

Pairs of a batch are aligned together along the anti-diagonals of their matrices. Each cell carries its
distance with the substitutions and true positives of the chosen path, from which deletions and insertions
follow, so no backward pass is needed. Of equal distances the match comes first, then a mask with or without a word,
substitution, deletion and insertion.
"""

from __future__ import annotations

import numpy as np

from .lexicon import CLITIC_S, UNCLEAR

#: Cells of one batch.
CELLS = 100_000
#: Width of the first band beyond the difference of lengths.
FIRST_BAND = 6
_MASK, _CLITIC = 1, 2


def _codes(pairs: list[tuple[list[str], list[str]]]) -> tuple[list[list[int]], list[list[int]], dict[str, int]]:
    v = {UNCLEAR: _MASK, CLITIC_S: _CLITIC, "is": 3, "has": 4}
    return [[v.setdefault(t, len(v) + 1) for t in r] for r, _ in pairs], [[v.setdefault(t, len(v) + 1) for t in h] for _, h in pairs], v


def _flags(tokens: list[list[str]], width: int, kinds) -> np.ndarray:
    out = np.zeros((len(tokens), width, len(kinds)), dtype=bool)
    for i, t in enumerate(tokens):
        for k, f in enumerate(kinds):
            if t:
                out[i, : len(t), k] = [f(t, j) for j in range(len(t))]
    return out


def align(pairs: list[tuple[list[str], list[str]]], kinds=(), masked: bool = True) -> np.ndarray:
    """Per pair: substitutions, deletions, insertions, then the true positives of each kind.

    A kind is a function of (tokens, index); a true positive is an aligned pair of equal tokens for which it
    holds on both sides. With ``masked``, an unclear mark takes no or one word freely and 's equals is and has.
    """
    out = np.zeros((len(pairs), 3 + len(kinds)), dtype=np.int64)
    masks = np.array([r.count(UNCLEAR) if masked else 0 for r, _ in pairs], dtype=np.int64)
    # a path of cost c leaves the main diagonal by c and its free steps at most, so a band that wide is exact
    band = np.array([abs(len(r) - len(h)) for r, h in pairs], dtype=np.int64) + masks + FIRST_BAND
    todo = [*range(len(pairs))]
    while todo:
        todo.sort(key=lambda i: (band[i] // 32, len(pairs[i][0]), len(pairs[i][1])))
        again, at = [], 0
        while at < len(todo):
            end, n, m = at, 0, 0
            while end < len(todo):
                a, b = (max(x, len(s)) for x, s in zip((n, m), pairs[todo[end]], strict=True))
                if end > at and (end - at + 1) * (a + 1) * (3 + len(kinds)) > CELLS:
                    break
                n, m, end = a, b, end + 1
            batch = todo[at:end]
            wide = int(band[batch].max())
            found = _batch([pairs[i] for i in batch], n, m, kinds, masked, wide)
            for i, row in zip(batch, found, strict=True):
                if row[:3].sum() + masks[i] <= wide or wide >= max(n, m):
                    out[i] = row
                else:
                    band[i] = 4 * wide
                    again.append(i)
            at = end
        todo = again
    return out


#: A cell's value: distance, masks without a word and substitutions, each in a field of 21 bits.
_FIELD = 21
_ONE, _FREE, _SUB = 1 << 2 * _FIELD, 1 << _FIELD, (1 << 2 * _FIELD) + 1
_FAR = 1 << 62


def _batch(pairs, n: int, m: int, kinds, masked: bool, band: int) -> np.ndarray:
    if max(n, m) >= 1 << _FIELD - 1:
        raise ValueError("a list of more than a million tokens")
    size, width = len(pairs), len(kinds)
    refs, hyps, _ = _codes(pairs)
    ref, hyp = np.zeros((size, n + 1), dtype=np.int32), np.zeros((size, m + 1), dtype=np.int32)
    for i, (r, h) in enumerate(zip(refs, hyps, strict=True)):
        ref[i, 1 : len(r) + 1], hyp[i, 1 : len(h) + 1] = r, h
    rl, hl = np.array([len(r) for r in refs], dtype=np.int64), np.array([len(h) for h in hyps], dtype=np.int64)
    if kinds:
        rf, hf = (np.pad(_flags(x, w, kinds), ((0, 0), (1, 0), (0, 0))) for x, w in (([r for r, _ in pairs], n), ([h for _, h in pairs], m)))
    special = masked and any(UNCLEAR in r or CLITIC_S in r or CLITIC_S in h for r, h in pairs)
    value, hits = np.zeros(size, dtype=np.int64), np.zeros((size, width), dtype=np.int64)
    # cells of an anti-diagonal stand at their row + 1; the buffers are this diagonal and the two before it
    d = [np.full((size, n + 3), _FAR, dtype=np.int64) for _ in range(3)]
    c = [np.zeros((size, n + 3, width), dtype=np.int32) for _ in range(3)] if kinds else None
    for k in range(n + m + 1):
        lo, hi = max(0, k - m, (k - band + 1) // 2), min(n, k, (k + band) // 2)
        d0, d1, d2 = d[k % 3], d[(k - 1) % 3], d[(k - 2) % 3]
        here, up = slice(lo + 1, hi + 2), slice(lo, hi + 1)
        d0[:, lo], d0[:, min(hi + 2, n + 2)] = _FAR, _FAR
        if lo > hi:
            continue
        if k == 0:
            d0[:, 1] = 0
        else:
            r, h = ref[:, lo : hi + 1], hyp[:, k - hi : k - lo + 1][:, ::-1]
            equal = r == h
            if special:
                mask = r == _MASK
                same = equal | mask | ((r == _CLITIC) & ((h == 3) | (h == 4))) | ((h == _CLITIC) & ((r == 3) | (r == 4)))
                delete = d1[:, up] + np.where(mask, _FREE, _ONE)
            else:
                same = equal
                delete = d1[:, up] + _ONE
            best = d2[:, up] + np.where(same, 0, _SUB)
            insert = d1[:, here] + _ONE
            # of equal distances the diagonal step comes first, then the deletion
            by_delete = delete >> 2 * _FIELD < best >> 2 * _FIELD
            best = np.where(by_delete, delete, best)
            by_insert = insert >> 2 * _FIELD < best >> 2 * _FIELD
            d0[:, here] = np.where(by_insert, insert, best)
            if kinds:
                both = rf[:, lo : hi + 1] & hf[:, k - hi : k - lo + 1][:, ::-1] & equal[..., None]
                c0, c1, c2 = c[k % 3], c[(k - 1) % 3], c[(k - 2) % 3]
                c0[:, here] = np.where(by_insert[..., None], c1[:, here], np.where(by_delete[..., None], c1[:, up], c2[:, up] + both))
        done = np.flatnonzero((rl + hl == k) & (rl >= lo) & (rl <= hi))
        if len(done):
            value[done] = d0[done, rl[done] + 1]
            if kinds:
                hits[done] = c[k % 3][done, rl[done] + 1]
    cost, free, subs = value >> 2 * _FIELD, value >> _FIELD & _FREE - 1, value & _FREE - 1
    # what the reference has more than the hypothesis is deleted more often than inserted, but for free steps
    dels = (cost - subs - (hl - rl + free)) // 2
    return np.column_stack([subs, dels, cost - subs - dels, hits])
