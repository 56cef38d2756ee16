"""Duration-balanced allocation of components to splits, and smallest-label components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed

TARGETS = {"train": 0.70, "validation": 0.10, "test": 0.20}
#: Components of a stratum that are held in memory; larger strata are sorted on disk and read in batches.
SEQUENTIAL = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each connected component, by smallest labels and pointer jumping.

    Null ends are ignored. Each round halves the distance to the smallest label.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = checkpointed(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = checkpointed(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "c"), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("m"))
        jump = label.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = checkpointed(label.join(jump, "c", "left").join(near, "node", "left").select("node", "c", F.least("c", F.coalesce("cc", "c"), F.coalesce("m", "c")).alias("n")))
        if new.where("n <> c").isEmpty():
            return label.withColumnRenamed("c", "component")
        label = new.select("node", F.col("n").alias("c"))


def allocate(sizes: DataFrame, seed: str, targets: dict[str, float] | None = None, sequential: int = SEQUENTIAL) -> DataFrame:
    """(stratum, component, duration, split): longest components first, each to the split that is least full.

    ``sizes`` has stratum, component, members (what the tie hash is taken of) and duration. Ties go by sha256
    of the seed, the stratum where it isn't empty, and the members.
    A split's fill is its duration over max(1, total x target). The rule is sequential by nature, one task per
    stratum whatever its size. Strata of more than ``sequential`` components are sorted by Spark and read in batches.
    """
    targets = targets or TARGETS
    total = sizes.groupBy("stratum").agg(F.sum("duration").alias("total"))
    tied = sizes.join(total, "stratum").withColumn("tie", F.sha2(F.concat_ws(":", F.lit(seed), F.nullif("stratum", F.lit("")), "members"), 256))
    fill = sorted(targets)
    cut = tied.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    small = cut.where(F.col("_n") <= sequential).select("stratum")
    hashes = {s: F.sha2(F.concat_ws(":", "tie", F.lit(s)), 256).alias(f"h_{s}") for s in fill}
    held = tied.join(small, "stratum", "left_semi").select("stratum", "component", "duration", "total", "tie", *hashes.values())
    schema = "stratum string, component string, duration double, split string"

    def step(rows: pd.DataFrame, used: dict[str, float]) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            s = min(targets, key=lambda t: (used[t] / max(1.0, r.total * targets[t]), getattr(r, f"h_{t}")))
            used[s] += r.duration
            out.append(s)
        return rows[["stratum", "component", "duration"]].assign(split=out)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return step(rows.sort_values(["duration", "tie"], ascending=[False, True], kind="stable"), dict.fromkeys(targets, 0.0))

    def run_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stratum, used = None, {}
        for b in batches:
            for name, rows in b.groupby("stratum", sort=False):
                if name != stratum:
                    stratum, used = name, dict.fromkeys(targets, 0.0)
                yield step(rows, used)

    large = tied.join(small, "stratum", "left_anti").repartition("stratum").sortWithinPartitions("stratum", F.desc("duration"), "tie").select("stratum", "component", "duration", "total", *hashes.values())
    return held.groupBy("stratum").applyInPandas(run, schema).unionByName(large.mapInPandas(run_sorted, schema))
