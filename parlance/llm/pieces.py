"""Oversized clips cut into pieces at natural boundaries, with an overlap.

The units of a recording leave a boundary where none of them goes on. Boundaries of a clip are a sorted
array in which the last one under the limit is found by bisection; prefix sums of the units' words turn
times into places in the clip's text. Where no boundary lies under the limit the cut is hard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_MS, OVERLAP_MS = 27_500, 1_000
#: Least time by which a piece at a boundary goes on beyond the overlap with the piece before it.
ADVANCE_MS = 1_000
#: Length of the shortest time bins that clips and units meet in; each level's bins are four times as long. A unit
#: is put at the level whose bins are as long as itself, so it meets a clip of any length in few bins.
BIN_MS, LEVELS = 30_000, 16


def boundaries(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted instants at which a unit ends and none goes on."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((ends, starts))
    s, e = starts[order], np.maximum.accumulate(ends[order])
    return e[np.append(s[1:] >= e[:-1], True)]


def cut(start: int, end: int, cuts, limit: int = LIMIT_MS, overlap: int = OVERLAP_MS, advance: int = ADVANCE_MS) -> list[tuple[int, int, str]]:
    """(start, end, how it ends) of the pieces of one clip: 'boundary', 'hard' or 'end'.

    No piece is longer than ``limit``; each begins ``overlap`` before the one before it ends. A boundary counts
    from ``overlap`` + ``advance`` after the piece's start.
    """
    if not 0 <= overlap < limit or advance < 0 or overlap + advance > limit:
        raise ValueError("overlap must be at least 0 and less than the limit, with room to advance")
    out = []
    while end - start > limit:
        i = bisect_right(cuts, start + limit) - 1
        at, how = (int(cuts[i]), "boundary") if i >= 0 and cuts[i] > start + overlap and cuts[i] >= start + overlap + advance else (start + limit, "hard")
        out.append((start, at, how))
        start = at - overlap
    out.append((start, end, "end"))
    return out


def pieces_of(start: int, end: int, text: str | None, units, limit: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """Pieces of one clip with their text, from (start, end, words) of the units."""
    u = np.array([(a, b, n) for a, b, n in units], dtype=np.int64).reshape(-1, 3)
    u = u[np.lexsort((u[:, 0], u[:, 1]))]
    cuts = boundaries(u[:, 0], u[:, 1])
    pieces = cut(start, end, cuts[(cuts > start) & (cuts < end)], limit, overlap)
    words = (text or "").split()
    inside = u[(u[:, 0] >= start) & (u[:, 1] <= end)]
    total = int(inside[:, 2].sum())
    if total:
        # words up to each unit's end, brought to the clip's own number of words
        times, offsets = np.append(start, np.maximum.accumulate(inside[:, 1])), np.append(0, np.cumsum(inside[:, 2])) * (len(words) / total)
    else:
        times, offsets = np.array([start, end]), np.array([0, len(words)])
    place = lambda t: len(words) if t >= end else int(round(float(np.interp(t, times, offsets))))
    return [(a, b, how, " ".join(words[place(a) : place(b)])) for a, b, how in pieces]


def clip_times(chunks: DataFrame) -> DataFrame:
    """Adds start_ms, end_ms and length_ms: end minus start, else duration, which above 1,000 is in milliseconds."""
    ms = lambda c: F.expr(f"cast(round(`{c}` * 1000) AS bigint)")
    duration = F.expr("cast(round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END) AS bigint)")
    t = chunks.withColumns({"_a": ms("start"), "_b": ms("end"), "_d": duration})
    return t.withColumns({"length_ms": F.coalesce(F.col("_b") - F.col("_a"), F.col("_d")), "start_ms": F.expr("coalesce(_a, _b - _d, 0)")}).withColumn("end_ms", F.col("start_ms") + F.col("length_ms")).drop("_a", "_b", "_d")


def oversized_pieces(chunks: DataFrame, units: DataFrame, limit_ms: int = LIMIT_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """(example_id, piece, start_ms, end_ms, cut, text) of every chunk longer than the limit.

    Chunks without any length or id, and those within the limit, give no rows; repeated rows count once per
    example_id. A chunk without start and end is placed at 0. Units without start or end and with end not after
    start leave no boundaries; without units all cuts are hard. Null text gives empty text. Other columns are
    ignored. The units of one clip meet in one row: their number is bounded by the clip's own length.
    """
    over = clip_times(chunks.select("example_id", "recording", "start", "end", "duration", "text")).where(f"example_id IS NOT NULL AND length_ms > {int(limit_ms)}").dropDuplicates(["example_id"]).select("example_id", F.upper(F.trim("recording")).alias("_rec"), "start_ms", "end_ms", "text")
    size = f"({BIN_MS} * power(4, _level))"
    bins = lambda a, b: F.explode(F.expr(f"sequence(cast(floor({a} / {size}) AS bigint), cast(floor({b} / {size}) AS bigint))"))
    real = (
        units.select(F.upper(F.trim("recording")).alias("_rec"), F.expr("cast(round(`start` * 1000) AS bigint)").alias("_s"), F.expr("cast(round(`end` * 1000) AS bigint)").alias("_e"), F.expr("size(filter(split(text, '\\\\s+'), x -> x <> ''))").alias("_n"))
        .where("_e > _s")
        .withColumn("_level", F.expr(f"cast(least({LEVELS - 1}, greatest(0, ceil(log(4, (_e - _s) / {BIN_MS})))) AS int)"))
        .select("_rec", "_s", "_e", F.greatest("_n", F.lit(0)).alias("_n"), "_level", bins("_s", "_e").alias("_bin"))
    )
    asked = over.select("example_id", "_rec", F.col("start_ms").alias("_a"), F.col("end_ms").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level"))
    met = asked.select("*", bins("_a", "_b").alias("_bin")).join(real, ["_rec", "_level", "_bin"]).where("_s < _b AND _e > _a").groupBy("example_id").agg(F.collect_set(F.struct("_s", "_e", "_n")).alias("units"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, a, e, text, own in zip(b["example_id"], b["start_ms"], b["end_ms"], b["text"], b["units"], strict=True):
                own = [] if own is None else [(u["_s"], u["_e"], u["_n"]) for u in own]
                out += [(key, i, *p) for i, p in enumerate(pieces_of(int(a), int(e), text, own, limit_ms, overlap_ms))]
            yield pd.DataFrame(out, columns=["example_id", "piece", "start_ms", "end_ms", "cut", "text"])

    return over.join(met, "example_id", "left").mapInPandas(run, "example_id string, piece int, start_ms long, end_ms long, cut string, text string")
