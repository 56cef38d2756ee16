"""Timed units into chunks: greedy grouping, overlap of speakers and quality tiers.

Greedy grouping is sequential, but what a block of ten minutes does to it is a small table: which unit opens the
block's first chunk depends only on the start of the chunk that is open, and all else follows. The tables of a
recording are composed, one row for each block, and then every block is grouped by itself; no recording, and no
stretch without pauses, is held in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, slots

MAX_SPAN_MS, MAX_GAP_MS = 27_500, 3_000
BLOCK_MS = 600_000
#: Speakers that stand for sounds of the room.
NOT_PEOPLE = ("ENV", "NOISE")


def timed_units(units: DataFrame) -> DataFrame:
    """Clean units: one row per unit_id (the earliest delivery), whole milliseconds, speaker in upper case.

    Units without recording, speaker, start or end, and with end not after start, are left out.
    """
    ms = lambda c: F.expr(f"cast(round(`{c}` * 1000) AS bigint)")
    text = F.coalesce("text", F.lit(""))
    t = units.select("unit_id", "recording", F.expr("nullif(upper(trim(speaker)), '')").alias("speaker"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), text.rlike("[A-Za-z0-9]").alias("worded"), text.alias("text"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), "ingested_at")
    t = t.where("unit_id IS NOT NULL AND recording IS NOT NULL AND speaker IS NOT NULL AND end_ms > start_ms")
    order = F.struct("ingested_at", "start_ms", "end_ms", "speaker", F.xxhash64("text"))
    # texts apart from times, so that who needs only these moves only these
    first = t.groupBy("unit_id").agg(F.min_by(F.struct("recording", "speaker", "start_ms", "end_ms", "worded"), order).alias("u"), F.min_by(F.struct("text", "flags"), order).alias("t"))
    return first.select("unit_id", "u.*", "t.*")


def lexical(units: DataFrame, max_span_ms: int = MAX_SPAN_MS) -> DataFrame:
    """Units with a word, of a person, no longer than a chunk may be."""
    return units.where(F.col("worded") & (F.col("end_ms") - F.col("start_ms") <= max_span_ms) & ~F.col("speaker").isin(*NOT_PEOPLE))


def _pauses(s: list[int], e: list[int], max_gap_ms: int) -> list[bool]:
    """Whether a pause above the limit stands before each unit of a block, the first one aside."""
    return [False, *(b - a > max_gap_ms for a, b in zip(e, s[1:], strict=False))]


#: Stands for the start of an open chunk where a block's first unit opens one.
_OPENS = -(1 << 62)
_TABLE = "struct<limits: array<bigint>, counts: array<bigint>, lasts: array<bigint>>"


def _tables(max_span_ms: int, max_gap_ms: int):
    @F.pandas_udf(_TABLE)
    def run(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_table(s.tolist(), e.tolist(), max_span_ms, max_gap_ms) for s, e in zip(starts, ends, strict=True)], columns=["limits", "counts", "lasts"])

    return run


def _table(s: list[int], e: list[int], max_span_ms: int, max_gap_ms: int) -> tuple[list[int], list[int], list[int]]:
    """What a block makes of the chunk that is open: by the limit that its reach stays under, chunks that open and the last one's start."""
    n, opens = len(s), _pauses(s, e, max_gap_ms)
    count, last = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        k = i + 1
        while k < n and not opens[k] and e[k] - s[i] <= max_span_ms:
            k += 1
        count[i], last[i] = (1 + count[k], last[k]) if k < n else (1, s[i])
    # the first unit to open is the first that ends beyond the open chunk's reach, or follows a pause
    limits, counts, lasts, reach = [], [], [], None
    for i in range(n):
        if opens[i] or reach is None or e[i] > reach:
            reach = e[i] if reach is None else max(reach, e[i])
            # an open chunk began before this block, so its reach is bounded
            sure = opens[i] or reach > s[0] + max_span_ms
            limits.append((1 << 62) if sure else reach)
            counts.append(count[i])
            lasts.append(last[i])
            if sure:
                break
    return limits, counts, lasts


def _composed(max_span_ms: int, max_gap_ms: int):
    def run(key: tuple, blocks_of: pd.DataFrame) -> pd.DataFrame:
        first, before, chunks, out = None, None, 0, []
        for b, begin, end, limits, counts, lasts in blocks_of.sort_values("_b")[["_b", "begin", "end", "limits", "counts", "lasts"]].itertuples(index=False):
            # a first unit that opens is the table's first entry
            opened = first is None or begin - before > max_gap_ms
            out.append((key[0], b, _OPENS if opened else first, chunks))
            at = 0 if opened else next((k for k, x in enumerate(limits) if x > first + max_span_ms), None)
            if at is not None:
                first, chunks = int(lasts[at]), chunks + int(counts[at])
            before = end
        return pd.DataFrame(out, columns=["recording", "_b", "_first", "_ahead"])

    return run


def _numbered(max_span_ms: int, max_gap_ms: int):
    @F.pandas_udf("array<bigint>")
    def run(starts: pd.Series, ends: pd.Series, first: pd.Series, ahead: pd.Series) -> pd.Series:
        out = []
        for s, e, f, n in zip(starts, ends, first, ahead, strict=True):
            s, e, f, n, seq = s.tolist(), e.tolist(), int(f), int(n) - 1, []
            opens = _pauses(s, e, max_gap_ms)
            opens[0] = f == _OPENS
            for a, b, x in zip(s, e, opens, strict=True):
                if x or b - f > max_span_ms:
                    f, n = a, n + 1
                seq.append(n)
            out.append(seq)
        return pd.Series(out, dtype=object)

    return run


def assign_chunks(units: DataFrame, max_span_ms: int = MAX_SPAN_MS, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """(unit_id, recording, speaker, start_ms, end_ms, chunk) of lexical units; chunks count from 0 in a recording.

    A chunk closes when the unit would end more than ``max_span_ms`` after its first start, or begins more
    than ``max_gap_ms`` after the last appended unit's end. Texts stay where they are; only times move, and go
    through Python. Blocks are written once, as their tables are composed before they are grouped.
    """
    order = ["start_ms", "end_ms", "speaker", "unit_id"]
    u = units.select("unit_id", "recording", "speaker", "start_ms", "end_ms", F.floor(F.col("start_ms") / BLOCK_MS).alias("_b"))
    # few bytes but much work in a block: over all cores, whatever their size
    packed = u.repartition(slots(units.sparkSession), "recording", "_b").groupBy("recording", "_b").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("us"))
    times = F.col("us.start_ms"), F.col("us.end_ms")
    packed = checkpointed(packed.withColumn("_t", _tables(max_span_ms, max_gap_ms)(*times)))
    heads = packed.select("recording", "_b", F.element_at("us.start_ms", 1).alias("begin"), F.element_at("us.end_ms", -1).alias("end"), "_t.*").groupBy("recording").applyInPandas(_composed(max_span_ms, max_gap_ms), "recording string, _b bigint, _first bigint, _ahead bigint")
    seq = _numbered(max_span_ms, max_gap_ms)(*times, F.col("_first"), F.col("_ahead"))
    rows = packed.join(heads, ["recording", "_b"]).select("recording", "us", seq.alias("seq")).select("recording", F.explode(F.arrays_zip("us", "seq")).alias("x"))
    return rows.select("x.us.unit_id", "recording", "x.us.speaker", "x.us.start_ms", "x.us.end_ms", F.col("x.seq").cast("bigint").alias("chunk"))


def merge_tails(chunked: DataFrame, least_ms: int = 4_000, max_span_ms: int = MAX_SPAN_MS) -> DataFrame:
    """A recording's last chunk under ``least_ms`` joins the one before it, if both fit into one."""
    order = F.struct("start_ms", "end_ms", "speaker", "unit_id")
    spans = chunked.groupBy("recording", "chunk").agg(F.min("start_ms").alias("s"), F.max_by("end_ms", order).alias("e"))
    last = spans.groupBy("recording").agg(F.max("chunk").alias("last"))
    two = spans.join(last, "recording").where("chunk >= last - 1").groupBy("recording", "last").agg(F.max(F.when(F.col("chunk") == F.col("last"), F.col("s"))).alias("s"), F.max(F.when(F.col("chunk") == F.col("last"), F.col("e"))).alias("e"), F.min("s").alias("s0"), F.count(F.lit(1)).alias("n"))
    merged = two.where(f"n = 2 AND e - s < {least_ms} AND e - s0 <= {max_span_ms}").select("recording", F.col("last").alias("chunk"), F.lit(1).alias("_m"))
    return chunked.join(merged, ["recording", "chunk"], "left").withColumn("chunk", F.col("chunk") - F.coalesce("_m", F.lit(0))).drop("_m")


def overlap_ms(chunked: DataFrame) -> DataFrame:
    """(recording, chunk, overlap_ms): time in which more than one speaker of a chunk speaks.

    A speaker's own overlapping units are merged first; then speakers are counted along the boundaries.
    """
    k = ["recording", "chunk"]
    own = Window.partitionBy(*k, "speaker").orderBy("start_ms", "end_ms")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    spans = chunked.select(*k, "speaker", "start_ms", "end_ms").withColumn("m", F.max("end_ms").over(before)).withColumn("g", F.sum(F.when(F.col("m").isNull() | (F.col("start_ms") > F.col("m")), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = spans.groupBy(*k, "speaker", "g").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    events = merged.select(*k, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x")).groupBy(*k, F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    along = Window.partitionBy(*k).orderBy("t")
    depth = events.withColumn("depth", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("w", F.lead("t").over(along) - F.col("t"))
    return depth.groupBy(*k).agg(F.coalesce(F.sum(F.when(F.col("depth") > 1, F.col("w"))), F.lit(0)).cast("bigint").alias("overlap_ms"))


def chunk_rows(chunked: DataFrame, units: DataFrame, padding_ms: int = 0, three_tiers: bool = False) -> DataFrame:
    """One row per chunk: bounds, duration, text, tokens, speakers, flags, overlap and tier.

    Texts and flags come from ``units`` by unit_id.
    ``end_ms`` is the end of the last appended unit. Two tiers are A and CHALLENGE (any overlap, unintelligible
    or uncertain speech); three add B for an overlap of at most 5 % of the padded duration.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "speaker", "unit_id", "text"))), lambda x: x[c])
    last = F.max_by("end_ms", F.struct("start_ms", "end_ms", "speaker", "unit_id"))
    rows = chunked.join(units.select("unit_id", "text", "flags"), "unit_id").groupBy("recording", "chunk").agg(
        F.greatest(F.min("start_ms") - padding_ms, F.lit(0)).alias("start_ms"),
        (last + padding_ms).alias("end_ms"),
        F.trim(F.array_join(ordered("text"), " ")).alias("text"),
        F.array_sort(F.collect_set("speaker")).alias("speakers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
    )
    rows = rows.join(overlap_ms(chunked), ["recording", "chunk"]).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    rows = rows.withColumns({"token_count": F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*(?:-[A-Za-z0-9]+)*-?"), F.lit(0))), "speaker_count": F.size("speakers"), "overlap_ratio": F.round(F.col("overlap_ms") / F.greatest("duration_ms", F.lit(1)), 6)})
    unclear = F.array_contains("flags", "unintelligible")
    if three_tiers:
        tier = F.when((F.col("overlap_ms") == 0) & ~unclear, "A").when((F.col("overlap_ms") / F.greatest("duration_ms", F.lit(1)) <= 0.05) & ~unclear, "B").otherwise("CHALLENGE")
    else:
        tier = F.when((F.col("overlap_ms") > 0) | unclear | F.array_contains("flags", "uncertain"), "CHALLENGE").otherwise("A")
    return rows.withColumn("quality_tier", tier).withColumn("example_id", F.format_string("%s_%04d", "recording", "chunk"))
