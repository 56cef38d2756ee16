"""Token loops in decoded sequences, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How often a run of each size must repeat to count as a loop.
REPETITIONS = {1: 8, 2: 8, 3: 4, **dict.fromkeys(range(4, 13), 3)}


def first_loop(ids: Column, smallest: int = 1, largest: int = 5, repetitions: dict[int, int] | int = 8) -> Column:
    """Struct (start, size) of the first loop, from 0; of one start the smallest size; null where there is none.

    A run of n tokens that comes k times is n * (k - 1) tokens in a row that equal the one n places on: those
    equalities are written as a string of marks, in which that many in a row are searched.
    """
    wanted = repetitions if isinstance(repetitions, dict) else dict.fromkeys(range(smallest, largest + 1), repetitions)
    found = []
    for n, k in sorted(wanted.items()):
        if smallest <= n <= largest:
            # zipped with itself n places on: a lambda must not refer to the whole array, which would be made again for each element
            marks = F.array_join(F.zip_with(ids, F.slice(ids, n + 1, F.greatest(F.size(ids), F.lit(0))), _mark), "")
            at = F.locate("1" * (n * (k - 1)), marks)
            found.append(F.when(at > 0, F.struct((at - 1).alias("start"), F.lit(n).alias("size"))))
    return F.array_min(F.array_compact(F.array(*found)))


def _mark(now: Column, later: Column) -> Column:
    return F.when(now == later, "1").otherwise("0")


def trim_loop(ids: Column, loop: Column, keep: int = 1) -> Column:
    """Tokens up to and with ``keep`` runs of the loop; all of them where there is none."""
    return F.when(loop.isNull(), ids).otherwise(F.slice(ids, 1, loop["start"] + loop["size"] * keep))


def repaired(ids: Column, attempts: int = 5, keep: int = 1) -> Column:
    """Struct (ids, kept) after up to ``attempts`` repairs; ``kept`` has the tokens that each left standing.

    A repair rewinds to ``keep`` runs of the first loop and goes on with what follows the next run, as decoding
    again would with another token; a loop that is left after the last attempt is cut off with all that follows.
    """
    kind = "struct<ids: array<string>, kept: array<int>>"

    def step(state: Column, attempt: Column) -> Column:
        now = state["ids"]
        loop = first_loop(now, 1, 12, REPETITIONS)
        end = loop["start"] + loop["size"] * keep
        rest = F.when(attempt <= attempts, F.slice(now, end + loop["size"] + 1, F.size(now))).otherwise(F.array().cast("array<string>"))
        cut = F.struct(F.concat(F.slice(now, F.lit(1), end), rest).alias("ids"), F.array_append(state["kept"], end).alias("kept"))
        return F.when(loop.isNull(), state).otherwise(cut.cast(kind))

    start = F.struct(ids.cast("array<string>").alias("ids"), F.array().cast("array<int>").alias("kept")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(attempts + 1)), start, step)


def until(ids: Column, end: Column | int) -> Column:
    """Tokens before the first ``end`` token."""
    end = end if isinstance(end, Column) else F.lit(end)
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def without_prefix(ids: Column, prefix: Column) -> Column:
    """Tokens after ``prefix``, where they begin with it."""
    n = F.size(prefix)
    return F.when(F.slice(ids, F.lit(1), n) == prefix, F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))).otherwise(ids)


def insert_before(ids: Column, mark: Column, new: Column) -> Column:
    """``new`` before the first ``mark``; unchanged where there is none."""
    at = F.array_position(ids, mark)
    return F.when(at > 0, F.array_insert(ids, at.cast("int"), new)).otherwise(ids)
