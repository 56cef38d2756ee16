"""Splits that keep related records together.

Recordings and the people in them form a graph. Each node exchanges its neighbours' cluster with the
cluster's smallest member (hash-to-min) until nothing changes; a component then goes to a split by
weighted rendezvous hashing.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed
from .overlap import split_name

# What stands in place of a speaker id but names nobody.
NOBODY = ("", "unknown", "unk", "n/a", "na", "n.a.", "none", "null", "nil", "-", "--", "?", "??", "tbd", "anonymous")
TARGETS = {"train": 0.7, "validation": 0.1, "test": 0.2}
#: Factors by which the weights of all splits but the largest may leave their targets. Hashes never change, so
#: other weights move the fewest components: only from a split whose weight falls, only to one whose weight rises.
FACTORS = (0.25, 0.4, 0.55, 0.7, 0.85, 1.0, 1.2, 1.45, 1.75, 2.1, 2.5, 3.0)
#: Deviation from the targets, summed over the splits, that is near enough to leave the weights as they are.
NEAR = 0.06


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph given by its edges; component is its smallest node.

    Edges with a null end are ignored, repeated ones and loops change nothing. Each round exchanges rows
    (node, member), so no cluster is ever one value; rounds grow as the logarithm of the diameter.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v IS NOT NULL AND u IS NOT NULL")
    both = F.explode(F.expr("array(struct(v, u), struct(u AS v, v AS u), struct(v, v AS u), struct(u AS v, u))")).alias("x")
    state = checkpointed(e.select(both).select("x.v", "x.u").distinct())
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == mark:
            break
        mark = now
        least = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(least, "v").select(F.explode(F.expr("array(struct(m AS v, u), struct(u AS v, m AS u))")).alias("x"))
        state = checkpointed(sent.select("x.v", "x.u").distinct())
    return state.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")


def recording_groups(recordings: DataFrame, participants: DataFrame) -> DataFrame:
    """(recording, component): recordings that share a person, also through others, have one component.

    Names are compared without case and outer blanks; ids that name nobody link nothing. A recording without
    such people is its own component; null and blank recordings take no part. ``recording`` is upper case.
    """
    key = F.upper(F.trim("recording"))
    own = recordings.select(key.alias("rec")).where("rec <> ''")
    people = participants.select(key.alias("rec"), F.lower(F.trim("speaker_id")).alias("who")).where(F.expr("rec <> '' AND who IS NOT NULL") & ~F.col("who").isin(*NOBODY))
    edges = own.select(F.concat(F.lit("r:"), "rec").alias("a"), F.concat(F.lit("r:"), "rec").alias("b")).unionByName(people.select(F.concat(F.lit("r:"), "rec").alias("a"), F.concat(F.lit("s:"), "who").alias("b")))
    return hash_to_min(edges).where("node LIKE 'r:%'").select(F.expr("substr(node, 3)").alias("recording"), "component")


def record_splits(chunks: DataFrame) -> DataFrame:
    """(recording, split) that the chunks show; 'dev' is validation, null and blank splits count for nothing."""
    return chunks.select(F.upper(F.trim("recording")).alias("recording"), split_name().alias("split")).where("recording <> '' AND split IS NOT NULL").distinct()


def torn_recordings(recordings: DataFrame, participants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Recordings, spelled as in ``recordings``, of all groups whose chunks show more than one split."""
    groups = recording_groups(recordings, participants)
    torn = record_splits(chunks).join(groups, "recording").groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("component")
    named = recordings.select(F.upper(F.trim("recording")).alias("_key"), F.col("recording").alias("_name")).where("_key <> ''").distinct()
    return groups.join(torn, "component", "left_semi").join(named, F.col("recording") == F.col("_key")).select(F.col("_name").alias("recording"))


def _rendezvous(weights: dict[str, Column]) -> Column:
    """The split of the greatest weighted hash, by sha256 of the component and the split."""
    uniform = lambda x: (F.conv(F.substring(F.sha2(F.concat_ws(":", "component", F.lit(x)), 256), 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))
    score = [F.struct((-w / F.log(uniform(s))).alias("score"), F.lit(s).alias("split")) for s, w in sorted(weights.items())]
    return F.array_max(F.array(*score))["split"]


def assign_splits(recordings: DataFrame, participants: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(recording, component, split, seconds) of every recording, components whole, near the targets of duration.

    Null, negative and blank durations count as 0 seconds; repeated recordings count once, with their longest
    duration. A component goes to a split by weighted rendezvous hashing, its hashes fixed for good. Where weights
    equal to the targets miss them by more than ``NEAR``, the combination of ``FACTORS`` that comes nearest is
    taken, of equal ones the first; only sums by combination come to the driver. A component that alone exceeds a
    target stays whole all the same. An empty table gives no rows.
    """
    targets = targets or TARGETS
    length = recordings.select(F.upper(F.trim("recording")).alias("recording"), F.greatest(F.coalesce(F.expr("nanvl(duration, 0)"), F.lit(0.0)), F.lit(0.0)).alias("seconds")).where("recording <> ''").groupBy("recording").agg(F.max("seconds").alias("seconds"))
    groups = checkpointed(recording_groups(recordings, participants).join(length, "recording"))
    # whole milliseconds, so that sums are the same in any order
    sizes = groups.groupBy("component").agg(F.sum(F.expr("cast(round(seconds * 1000) AS bigint)")).alias("ms"))
    free = sorted(targets, key=lambda s: (-targets[s], s))[1:]
    options = [dict(zip(free, f, strict=True)) for f in itertools.product(FACTORS, repeat=len(free))]
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("option"), *[F.lit(targets[s] * o.get(s, 1.0)).alias(s) for s in targets]) for i, o in enumerate(options)])).alias("o")
    tried = sizes.select("component", "ms", grid).select("component", "ms", "o.*").withColumn("split", _rendezvous({s: F.col(s) for s in targets}))
    totals = tried.groupBy("option", "split").agg(F.sum("ms").alias("ms")).collect()  # options x splits rows
    whole, off = sum(targets.values()), {}
    for i in range(len(options)):
        by = {r["split"]: r["ms"] for r in totals if r["option"] == i}
        n = sum(by.values()) or 1
        off[i] = round(sum(abs(by.get(s, 0) / n - w / whole) for s, w in targets.items()), 9)
    plain = next(i for i, o in enumerate(options) if set(o.values()) <= {1.0})
    best = plain if off[plain] <= NEAR else min(off, key=lambda i: (off[i], i))
    weights = {s: F.lit(w * options[best].get(s, 1.0)) for s, w in targets.items()}
    return groups.withColumn("split", _rendezvous(weights)).select("recording", "component", "split", "seconds")
