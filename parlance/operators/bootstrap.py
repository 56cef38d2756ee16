"""Paired cluster bootstrap of summed errors.

Rows are summed by system and cluster first; draws then join clusters, never rows. All systems share a
replicate's draw. Draws are either hashes, the same in any engine, or those of Python's generator.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_sums(scores: DataFrame, system: str = "system", cluster: str = "cluster", errors: str = "errors", units: str = "units") -> DataFrame:
    """(system, cluster, rank, errors, units); rank numbers the clusters in order, from 0."""
    s = scores.where(F.col(cluster).isNotNull()).groupBy(F.col(system).alias("system"), F.col(cluster).alias("cluster")).agg(F.sum(errors).alias("errors"), F.sum(units).alias("units"))
    ranks = s.select("cluster").distinct().withColumn("rank", F.row_number().over(Window.orderBy("cluster")) - 1)
    return s.join(ranks, "cluster")


def hashed_draws(sums: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(replicate, rank, times): as many draws of clusters with replacement as there are clusters, by sha256."""
    n = sums.agg((F.max("rank") + 1).alias("n"))
    places = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("n", "replicate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "replicate", "place"), 256), 1, 8), 16, 10).cast("bigint")
    return places.select("replicate", F.pmod(h, F.col("n")).cast("int").alias("rank")).groupBy("replicate", "rank").agg(F.count(F.lit(1)).alias("times"))


def replicate_rates(sums: DataFrame, draws: DataFrame) -> DataFrame:
    """(replicate, system, rate) of each draw; a replicate without units has a null rate."""
    w = sums.join(draws, "rank")
    return w.groupBy("replicate", "system").agg((F.sum(F.col("errors") * F.col("times")) / F.nullif(F.sum(F.col("units") * F.col("times")), F.lit(0))).alias("rate"))


def intervals(rates: DataFrame, sums: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(system, point, low, high); the point divides by at least 1, null replicates are left out and counted."""
    point = sums.groupBy("system").agg((F.sum("errors") / F.greatest(F.sum("units"), F.lit(1))).alias("point"))
    return rates.groupBy("system").agg(F.percentile("rate", low).alias("low"), F.percentile("rate", high).alias("high"), F.count_if(F.col("rate").isNull()).alias("undefined")).join(point, "system")


def paired_differences(rates: DataFrame, baseline: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(system, low, high, better) of each system's rate minus the baseline's in the same replicate."""
    b = rates.where(F.col("system") == baseline).select("replicate", F.col("rate").alias("base"))
    d = rates.where(F.col("system") != baseline).join(b, "replicate").withColumn("d", F.col("rate") - F.col("base"))
    return d.groupBy("system").agg(F.percentile("d", low).alias("low"), F.percentile("d", high).alias("high"), F.avg((F.col("d") < 0).cast("double")).alias("better"))


#: Clusters, and (system, cluster) sums, that may come to the driver for draws of Python's generator.
MOST_CLUSTERS, MOST_SUMS = 100_000, 800_000


def generator_rates(sums: DataFrame, replicates: int = 20_000, seed: int = 20260803) -> dict[str, np.ndarray]:
    """Replicate rates by system from ``random.Random(seed).choices`` over the sorted clusters, one draw per replicate."""
    rows = sums.limit(MOST_SUMS + 1).collect()
    if len(rows) > MOST_SUMS:
        raise ValueError(f"more than {MOST_SUMS} sums of systems and clusters; use hashed_draws")
    clusters = sorted({r["cluster"] for r in rows})
    if len(clusters) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters; use hashed_draws")
    place, systems = {c: i for i, c in enumerate(clusters)}, sorted({r["system"] for r in rows})
    total = {s: np.zeros((2, len(clusters))) for s in systems}
    for r in rows:
        total[r["system"]][:, place[r["cluster"]]] = r["errors"], r["units"]
    draw, out = random.Random(seed), {s: np.empty(replicates) for s in systems}
    for k in range(replicates):
        times = np.bincount([place[c] for c in draw.choices(clusters, k=len(clusters))], minlength=len(clusters))
        for s in systems:
            e, u = total[s] @ times
            out[s][k] = e / u if u else np.nan
    return out
