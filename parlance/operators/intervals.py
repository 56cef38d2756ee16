"""Periods and gaps of time intervals per entity.

Starts and ends are sorted independently of each other. With n intervals of one entity, all of the
first k are over before the next begins exactly where the (k+1)-th smallest start exceeds the k-th
smallest end; those places are the gaps, and what lies between them are the continuous periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Time covered by one sort. A sort holds at most this many distinct instants, however hot an entity is.
BLOCK_MS = 600_000


def periods_and_gaps(intervals: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """One row per period and per gap: the keys, ``kind`` ('period' or 'gap'), start and end.

    Intervals with a null key, start or end, or with end not after start, are left out; repeated and
    nested ones change nothing; touching ones join. Other columns are ignored, whatever their names.
    An empty input gives an empty result.

    No entity is held in one task: instants are counted before the shuffle, sorted in blocks of
    ``block_ms`` and ranked with offsets from the blocks' totals.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    valid = intervals.select(
        *[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)],
        F.col(f"`{start}`").cast("bigint").alias("_s"),
        F.col(f"`{end}`").cast("bigint").alias("_e"),
    ).where(" AND ".join([*(f"{a} IS NOT NULL" for a in k), "_s < _e"]))
    instants = (
        valid.select(*k, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_s").alias("t")), F.struct(F.lit(1).alias("side"), F.col("_e").alias("t")))).alias("x"))
        .select(*k, "x.side", F.floor(F.col("x.t") / block_ms).alias("block"), "x.t")
        .groupBy(*k, "side", "block", "t")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # totals of blocks -> how many instants of that side precede a block
    before = Window.partitionBy(*k, "side").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = instants.groupBy(*k, "side", "block").agg(F.sum("n").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy(*k, "side", "block").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = instants.withColumn("upto", F.sum("n").over(inside)).join(offsets, [*k, "side", "block"]).withColumn("upto", F.col("upto") + F.col("offset"))
    # at a start: the rank before its first copy; at an end: the rank of its last copy
    ranked = ranked.select(*k, "side", "t", F.when(F.col("side") == 0, F.col("upto") - F.col("n")).otherwise(F.col("upto")).alias("rank"))
    # the (k+1)-th start beside the k-th end; rank 0 has only a start, the last rank only an end
    cuts = (
        ranked.groupBy(*k, "rank")
        .agg(F.max(F.when(F.col("side") == 1, F.col("t"))).alias("e"), F.min(F.when(F.col("side") == 0, F.col("t"))).alias("s"), F.max("side").alias("ends"))
        .where("s IS NULL OR e IS NULL OR s > e")
        # a start alone at a later rank lies inside a tie of ends, an end alone inside a tie of starts
        .where("(rank = 0 AND s IS NOT NULL) OR e IS NOT NULL")
    )
    total = instants.where("side = 1").groupBy(*k).agg(F.sum("n").alias("total"))
    cuts = cuts.join(total, k).where("rank = 0 OR rank = total OR s IS NOT NULL").select(*k, "s", "e", F.floor(F.coalesce("s", "e") / block_ms).alias("block"))
    # a period runs from the last cut's start to this cut's end
    carried = Window.partitionBy(*k).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = cuts.groupBy(*k, "block").agg(F.max("s").alias("m")).withColumn("carry", F.max("m").over(carried)).drop("m")
    here = Window.partitionBy(*k, "block").orderBy(F.coalesce("s", "e"))
    paired = cuts.join(carry, [*k, "block"]).withColumn("since", F.coalesce(F.lag("s").over(here), F.col("carry")))
    rows = paired.select(
        *k,
        F.explode(
            F.array(
                F.struct(F.lit("period").alias("kind"), F.col("since").alias("a"), F.col("e").alias("b")),
                F.struct(F.lit("gap").alias("kind"), F.col("e").alias("a"), F.col("s").alias("b")),
            )
        ).alias("x"),
    ).where("x.a IS NOT NULL AND x.b IS NOT NULL")
    return rows.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], "x.kind", F.col("x.a").alias(start), F.col("x.b").alias(end))


def unit_intervals(units: DataFrame) -> DataFrame:
    """Units as intervals of one speaker in one recording, in whole milliseconds; blank speakers count as none."""
    return units.select(
        "recording",
        F.expr("nullif(upper(trim(speaker)), '')").alias("speaker"),
        F.expr("cast(round(`start` * 1000) AS bigint)").alias("start_ms"),
        F.expr("cast(round(`end` * 1000) AS bigint)").alias("end_ms"),
    )
