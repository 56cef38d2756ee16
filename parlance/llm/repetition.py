"""Repetition inside single documents.

Each document is described by rule statistics of its words. An isolation forest grown on ordinary documents
tells which stand apart: random splits of the statistics' whole range need short paths to isolate them. Two
thresholds are calibrated on labelled rows: beyond them the forest decides, between them it cannot tell, and
the share of repeated words is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plain import words

#: Words of a run, fewest words of a document, and the share from which it counts as repetitive.
RUN, LEAST_WORDS, SHARE = 4, 8, 0.4
#: Texts that the forest is grown and calibrated on; trees, and rows of a tree.
SAMPLE, TREES, TREE_ROWS = 4_000, 64, 256
#: Of the sampled texts, how many are also spoilt by repeats of their own words, as further labelled rows.
SPOILT = 400


def repeated_share(w: list[str], run: int = RUN) -> float:
    """Share of the words that lie in a run of ``run`` words seen before; 0 below ``LEAST_WORDS`` words."""
    if len(w) < LEAST_WORDS:
        return 0.0
    seen: set[tuple[str, ...]] = set()
    covered, until = 0, 0
    for i in range(len(w) - run + 1):
        k = tuple(w[i : i + run])
        if k in seen:
            covered += i + run - max(i, until)
            until = i + run
        else:
            seen.add(k)
    return covered / len(w)


def statistics(w: list[str]) -> tuple[float, float, float, float]:
    """Shares of runs of two, three and four words that came before, and the share of the longest stretch of such runs of four.

    None of them grows with the length of ordinary text, as the share of single words that came before does.
    """
    n = len(w)
    if n < LEAST_WORDS:
        return 0.0, 0.0, 0.0, 0.0
    runs = [*zip(*(w[i:] for i in range(RUN)), strict=False)]
    distinct = len({*runs})
    best = now = 0
    if distinct < len(runs):
        seen = set()
        for k in runs:
            now = now + 1 if k in seen else 0
            best = max(best, now)
            seen.add(k)
    two, three = (1 - len({*zip(*(w[i:] for i in range(r)), strict=False)}) / (n - r + 1) for r in (2, 3))
    return two, three, 1 - distinct / len(runs), (best + RUN - 1) / n if best else 0.0


def _path(n: float) -> float:
    """Mean path length of a search that ends without success among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees of random splits over the range 0 to 1 of each statistic, grown on ordinary rows.

    What lies where ordinary rows are rare is alone after few splits.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 20260803):
        draw = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        depth = math.ceil(math.log2(max(2, self.size)))
        box = np.zeros(rows.shape[1]), np.ones(rows.shape[1])
        self.trees = [self._grow(rows[draw.choice(len(rows), self.size, replace=False)], depth, draw, *box) for _ in range(trees)] if len(rows) else []

    def _grow(self, x: np.ndarray, depth: int, draw, low: np.ndarray, high: np.ndarray):
        if depth == 0 or len(x) <= 1:
            return _path(len(x))
        f = int(draw.integers(x.shape[1]))
        at = float(draw.uniform(low[f], high[f]))
        left, below, above = x[:, f] < at, high.copy(), low.copy()
        below[f] = above[f] = at
        return (f, at, self._grow(x[left], depth - 1, draw, low, below), self._grow(x[~left], depth - 1, draw, above, high))

    def _length(self, tree, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
        if isinstance(tree, float):
            out[rows] += depth + tree
            return
        f, at, low, high = tree
        left = x[rows, f] < at
        for part, side in ((low, rows[left]), (high, rows[~left])):
            if len(side):
                self._length(part, x, side, depth + 1, out)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; short paths score high."""
        distinct, back = np.unique(x, axis=0, return_inverse=True) if len(x) else (x, np.zeros(0, dtype=int))
        total = np.zeros(len(distinct))
        for t in self.trees:
            self._length(t, distinct, np.arange(len(distinct)), 0, total)
        if not self.trees:
            return np.ones(len(x))
        return (2 ** (-total / len(self.trees) / max(1e-9, _path(self.size))))[back.reshape(-1)]


def spoilt(w: list[str]) -> list[list[str]]:
    """A text's words with repeats of their own added, from a few to most of it: one long
    stretch, or one phrase again and again, in a row or apart."""
    out, n = [], len(w)
    for share in (0.08, 0.15, 0.22, 0.5, 0.6, 0.75, 0.9):
        more = int(n * share / (1 - share)) + 1
        out.append(w + (w * (more // n + 1))[:more])
        phrase = w[n // 3 : n // 3 + max(RUN, min(9, n // 2))]
        out.append(w + (phrase * (more // len(phrase) + 1))[:more])
        # the phrase again and again, with other words between
        k = max(1, round(more / len(phrase)))
        step = max(1, n // k)
        out.append([x for i in range(0, n, step) for x in (w[i : i + step] + (phrase if i // step < k else []))])
    return out


def calibrate(forest: Forest, rows: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(low, high): below ``low`` no labelled row is repetitive, above ``high`` each is; between them the forest cannot tell."""
    if labels.all() or not labels.any():
        return 0.0, 1.0
    s = forest.score(rows)
    a, b = float(s[labels].min()), float(s[~labels].max())
    return min(a, b), max(a, b)


class Detector:
    """A forest with its thresholds, trained on some texts and spoilt copies of them."""

    def __init__(self, texts: list[str], share: float = SHARE):
        self.share = share
        lists = [w for w in map(words, texts) if len(w) >= LEAST_WORDS]
        own = np.array([repeated_share(w) >= share for w in lists], dtype=bool)
        lists_more = [x for w, odd in [*zip(lists, own, strict=True)][:SPOILT] if not odd for x in spoilt(w)]
        x = np.array([statistics(w) for w in lists]).reshape(-1, 4)
        # every other ordinary row grows the forest, the rest and all spoilt ones calibrate it
        grown = np.zeros(len(x), dtype=bool)
        grown[np.flatnonzero(~own)[::2]] = True
        self.forest = Forest(x[grown])
        held = np.vstack([x[~grown], np.array([statistics(w) for w in lists_more]).reshape(-1, 4)])
        self.low, self.high = calibrate(self.forest, held, np.array([*own[~grown], *(repeated_share(w) >= share for w in lists_more)], dtype=bool))

    def decide(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, whether the forest could tell, repetitive) of each list of words."""
        x = np.array([statistics(w) for w in lists]).reshape(-1, 4)
        s = self.forest.score(x)
        long = np.array([len(w) >= LEAST_WORDS for w in lists], dtype=bool)
        told = (s < self.low) | (s > self.high) | ~long
        yes = (s > self.high) & long
        for i in np.flatnonzero(~told):
            yes[i] = repeated_share(lists[i]) >= self.share
        return s, told, yes


def repetition(predictions: DataFrame, id_col: str = "pred_id", text_col: str = "hypothesis", share: float = SHARE, sample: int = SAMPLE, shares: bool = True) -> DataFrame:
    """(id, share, score, told, repetitive) of each text, once per id.

    ``repetitive`` is the forest's decision where it could tell (``told``); between its thresholds it is whether
    the exact share is at least ``share``. ``share`` is counted for all rows with ``shares``, else null. Null and
    empty texts, and those under eight words, have share 0 and are not repetitive. The forest is grown and
    calibrated on the ``sample`` distinct texts of the smallest hashes; an empty table gives no rows. Other
    columns are ignored.
    """
    base = predictions.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t")).where("_id IS NOT NULL")
    hashed = base.where("_t IS NOT NULL").select("_t", F.xxhash64("_t").alias("_h"))
    # copies of one text are one row of the sample
    last = hashed.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h").alias("last")).first()["last"]
    texts = sorted(r["_t"] for r in hashed.where(F.col("_h") <= last).select("_t").distinct().collect()) if last is not None else []
    detector = Detector(texts, share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [words(t) for t in b["_t"]]
            score, told, yes = detector.decide(lists)
            exact = [repeated_share(w) for w in lists] if shares else None
            yield pd.DataFrame({"_id": b["_id"], "share": exact, "score": score, "told": told, "repetitive": yes})

    kind = dict(base.dtypes)["_id"]
    return base.mapInPandas(run, f"_id {kind}, share double, score double, told boolean, repetitive boolean").dropDuplicates(["_id"]).withColumnRenamed("_id", id_col)
