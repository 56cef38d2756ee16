"""Queries of the general operators over the tables in a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..runtime import ship, table
from ..sources import readers
from . import allocate, segment
from .intervals import periods_and_gaps, unit_intervals


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of each speaker in each recording, and the gaps between them."""
    return periods_and_gaps(unit_intervals(table(spark, d, "units")), ["recording", "speaker"]).select("recording", "speaker", "kind", "start_ms", "end_ms")


QUERIES = {"p7_found": p7_found}

SQL = {
    "p7_found": """
WITH u AS (
  SELECT DISTINCT recording, upper(trim(speaker)) AS speaker, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e
  FROM units WHERE recording IS NOT NULL AND trim(speaker) <> ''),
v AS (SELECT *, max(e) OVER (PARTITION BY recording, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u WHERE e > s),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY recording, speaker ORDER BY s, e) AS g FROM v),
p AS (SELECT recording, speaker, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY recording, speaker, g),
n AS (SELECT recording, speaker, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY recording, speaker ORDER BY start_ms) AS end_ms FROM p)
SELECT recording, speaker, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL SELECT recording, speaker, 'gap', start_ms, end_ms FROM n WHERE end_ms IS NOT NULL""",
}


# ---- chunks of units

UNITS = """base AS (
  SELECT unit_id, recording, nullif(upper(trim(speaker)), '') AS speaker, CAST(round("start" * 1000) AS BIGINT) AS start_ms, CAST(round("end" * 1000) AS BIGINT) AS end_ms, coalesce(text, '') AS text, coalesce(flags, []) AS flags, ingested_at
  FROM units),
u AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ingested_at, start_ms, end_ms, speaker, text) AS copy FROM base
  WHERE unit_id IS NOT NULL AND recording IS NOT NULL AND speaker IS NOT NULL AND end_ms > start_ms) WHERE copy = 1)"""
GREEDY = f"""{UNITS},
o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start_ms, end_ms, speaker, unit_id) AS n FROM u
  WHERE regexp_matches(text, '[A-Za-z0-9]') AND end_ms - start_ms <= 27500 AND speaker NOT IN ('ENV', 'NOISE')),
g AS (
  SELECT recording, n, unit_id, start_ms AS first, end_ms AS last, 0 AS chunk FROM o WHERE n = 1
  UNION ALL
  SELECT o.recording, o.n, o.unit_id, CASE WHEN o.end_ms - g.first > 27500 OR o.start_ms - g.last > 3000 THEN o.start_ms ELSE g.first END, o.end_ms,
    g.chunk + CASE WHEN o.end_ms - g.first > 27500 OR o.start_ms - g.last > 3000 THEN 1 ELSE 0 END
  FROM g JOIN o ON o.recording = g.recording AND o.n = g.n + 1),
c AS (SELECT o.*, g.chunk FROM o JOIN g USING (unit_id))"""
TAILS = f"""{GREEDY},
sp AS (SELECT recording, chunk, min(start_ms) AS s, arg_max(end_ms, n) AS e FROM c GROUP BY recording, chunk),
two AS (SELECT l.recording, l.chunk FROM sp l JOIN sp b ON b.recording = l.recording AND b.chunk = l.chunk - 1
  WHERE l.chunk = (SELECT max(chunk) FROM sp x WHERE x.recording = l.recording) AND l.e - l.s < 4000 AND l.e - b.s <= 27500),
cm AS (SELECT c.* EXCLUDE (chunk), c.chunk - CASE WHEN two.chunk IS NULL THEN 0 ELSE 1 END AS chunk FROM c LEFT JOIN two USING (recording, chunk))"""
OVERLAP = """pt AS (SELECT DISTINCT recording, chunk, unnest([start_ms, end_ms]) AS t FROM {0}),
iv AS (SELECT *, lead(t) OVER (PARTITION BY recording, chunk ORDER BY t) AS nxt FROM pt),
ov AS (SELECT iv.recording, iv.chunk, iv.t, any_value(nxt - t) AS w FROM iv JOIN {0} USING (recording, chunk) WHERE nxt IS NOT NULL AND start_ms < (t + nxt) / 2 AND (t + nxt) / 2 < end_ms GROUP BY iv.recording, iv.chunk, iv.t HAVING count(DISTINCT speaker) > 1),
os AS (SELECT recording, chunk, CAST(sum(w) AS BIGINT) AS overlap_ms FROM ov GROUP BY recording, chunk)"""
_WORD = "[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*(?:-[A-Za-z0-9]+)*-?"


def _units(spark, d):
    return segment.timed_units(table(ship(spark), d, "units"))


def _chunked(spark, d):
    return segment.assign_chunks(segment.lexical(_units(spark, d)))


def chunk_units(spark: SparkSession, d: str) -> DataFrame:
    """The chunk of each lexical unit."""
    return _chunked(spark, d).select("unit_id", "recording", "chunk")


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with bounds, text, speakers, overlap and two tiers."""
    return segment.chunk_rows(_chunked(spark, d), _units(spark, d)).select("example_id", "start_ms", "end_ms", "duration_ms", "text", "token_count", "speaker_count", "speakers", "flags", "overlap_ms", "overlap_ratio", "quality_tier")


def chunk_tail_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after short tails are merged, padded by half a second, in three tiers."""
    return segment.chunk_rows(segment.merge_tails(_chunked(spark, d)), _units(spark, d), 500, True).select("example_id", "start_ms", "end_ms", "overlap_ms", "quality_tier")


def chunk_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and milliseconds by tier."""
    return segment.chunk_rows(_chunked(spark, d), _units(spark, d)).groupBy("quality_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"))


def long_units(spark: SparkSession, d: str) -> DataFrame:
    """Lexical units longer than a chunk may be."""
    return _units(spark, d).where(F.col("worded") & (F.col("end_ms") - F.col("start_ms") > segment.MAX_SPAN_MS)).select("unit_id", "recording", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def recording_stats(spark: SparkSession, d: str) -> DataFrame:
    """Units, speakers and the latest end of each recording."""
    return _units(spark, d).groupBy("recording").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("speaker").alias("speakers"), F.coalesce(F.max("end_ms"), F.lit(0)).alias("last_ms"))


# ---- groups and splits

# What stands in place of a speaker id but names nobody.
NOBODY = "('', 'unknown', 'unk', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', '-', '--', '?', '??', 'tbd', 'anonymous')"
GROUPS = f"""people AS (
  SELECT DISTINCT upper(trim(recording)) AS rec, lower(trim(speaker_id)) AS who FROM participants WHERE lower(trim(speaker_id)) NOT IN {NOBODY} AND trim(recording) <> ''),
recs AS (SELECT upper(trim(recording)) AS rec, CAST(round(max(coalesce(duration, 0)) * 1000) AS BIGINT) AS ms, bool_or(coalesce(explicit_other_l1, false)) AS other FROM recordings WHERE trim(recording) <> '' GROUP BY 1),
links AS (SELECT DISTINCT a.rec AS a, b.rec AS b FROM people a JOIN people b USING (who)),
reach AS (SELECT rec AS a, rec AS b FROM recs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS recording, min(b) AS component FROM reach GROUP BY a)"""


def _recs(spark, d):
    key = F.upper(F.trim("recording"))
    return table(spark, d, "recordings").select(key.alias("rec"), "duration", "explicit_other_l1").where("rec <> ''").groupBy("rec").agg(F.expr("cast(round(max(coalesce(duration, 0)) * 1000) AS bigint)").alias("ms"), F.max(F.coalesce("explicit_other_l1", F.lit(False))).alias("other"))


def _components(spark, d):
    people = table(spark, d, "participants").select(F.upper(F.trim("recording")).alias("rec"), F.lower(F.trim("speaker_id")).alias("who")).where(f"rec <> '' AND who NOT IN {NOBODY}").distinct()
    # '~' sorts after the letters and digits of recordings, so the smallest node is a recording
    edges = people.select(F.col("rec").alias("a"), F.concat(F.lit("~"), "who").alias("b")).unionByName(_recs(spark, d).select(F.col("rec").alias("a"), F.col("rec").alias("b")))
    return allocate.components(edges).where("node NOT LIKE '~%'").withColumnRenamed("node", "recording")


def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected recordings by shared people, with the smallest recording as label."""
    return _components(spark, d)


def split_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Components to splits, longest first, each to the least full."""
    rows = _components(spark, d).join(_recs(spark, d), F.col("recording") == F.col("rec"))
    sizes = rows.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("recording")), ",").alias("members"), F.sum("ms").cast("double").alias("duration")).withColumn("stratum", F.lit(""))
    return allocate.allocate(sizes, "splits-v1").select("component", "duration", "split")


def split_allocation_strata(spark: SparkSession, d: str) -> DataFrame:
    """Recordings to splits within the strata of first languages."""
    sizes = _recs(spark, d).select(F.when(F.col("other"), "explicit-other-l1").otherwise("core").alias("stratum"), F.col("rec").alias("component"), F.col("rec").alias("members"), F.col("ms").cast("double").alias("duration"))
    return allocate.allocate(sizes, "splits-v1").select("stratum", "component", "split")


_PICK = "list_sort([" + ", ".join(f"struct_pack(r := a.u_{s} / greatest(1.0, o.total * CAST({w} AS DOUBLE)), h := sha256(o.tie || ':{s}'), s := '{s}')" for s, w in (("train", 0.70), ("validation", 0.10), ("test", 0.20))) + "])[1].s"
ALLOCATED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY duration DESC, tie) AS n, sum(duration) OVER (PARTITION BY stratum) AS total FROM z),
p AS (SELECT DISTINCT stratum, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS u_train, CAST(0 AS DOUBLE) AS u_validation, CAST(0 AS DOUBLE) AS u_test, '' AS component, CAST(0 AS DOUBLE) AS duration, '' AS split FROM o),
a AS (
  SELECT * FROM p
  UNION ALL
  SELECT stratum, n, u_train + CASE WHEN split = 'train' THEN duration ELSE 0 END, u_validation + CASE WHEN split = 'validation' THEN duration ELSE 0 END, u_test + CASE WHEN split = 'test' THEN duration ELSE 0 END, component, duration, split
  FROM (SELECT a.stratum, o.n, a.u_train, a.u_validation, a.u_test, o.component, o.duration, {_PICK} AS split FROM a JOIN o ON o.stratum = a.stratum AND o.n = a.n + 1))"""


# ---- transcripts

def _transcripts(spark, d):
    return table(ship(spark), d, "raw_transcripts").select("transcript_id", "speakers", F.coalesce("raw_text", "text").alias("body")).dropDuplicates(["transcript_id"])


def parse_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Timed units of transcripts with tiers and bullets."""
    return parse.parse_tiers(_transcripts(spark, d), "transcript_id", "body")


def parse_interviews(spark: SparkSession, d: str) -> DataFrame:
    """Turns by labels that name speakers in full."""
    return parse.parse_interviews(_transcripts(spark, d), "transcript_id", "body", "speakers")


def file_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and sha256 of the bench file."""
    return readers.file_lineage(spark, f"{d}/bench_items.parquet")


QUERIES |= {q.__name__: q for q in (chunk_units, chunk_rows, chunk_tail_merge, chunk_tiers, long_units, recording_stats, components, split_allocation, split_allocation_strata, parse_tiers, parse_interviews, file_lineage)}

_TOKENS_OF = f"len(regexp_extract_all(text, '{_WORD}'))"
_ROWS = """SELECT recording, chunk, min(start_ms) AS s, arg_max(end_ms, (start_ms, end_ms, speaker, unit_id)) AS e, trim(string_agg(text, ' ' ORDER BY start_ms, end_ms, speaker, unit_id)) AS text, list_sort(list(DISTINCT speaker)) AS speakers, list_sort(list_distinct(flatten(list(flags)))) AS flags FROM {0} GROUP BY recording, chunk"""
_ID = "recording || '_' || CASE WHEN chunk < 10000 THEN lpad(CAST(chunk AS VARCHAR), 4, '0') ELSE CAST(chunk AS VARCHAR) END"
_TIER = "CASE WHEN coalesce(overlap_ms, 0) > 0 OR list_contains(flags, 'unintelligible') OR list_contains(flags, 'uncertain') THEN 'CHALLENGE' ELSE 'A' END"
SQL |= {
    "chunk_units": f"WITH RECURSIVE {GREEDY} SELECT unit_id, recording, CAST(chunk AS BIGINT) AS chunk FROM c",
    "chunk_rows": f"""WITH RECURSIVE {GREEDY}, {OVERLAP.format("c")}, r AS ({_ROWS.format("c")})
SELECT {_ID} AS example_id, s AS start_ms, e AS end_ms, e - s AS duration_ms, text, CAST({_TOKENS_OF} AS INT) AS token_count, CAST(len(speakers) AS INT) AS speaker_count, speakers, flags, coalesce(overlap_ms, 0) AS overlap_ms, round(coalesce(overlap_ms, 0) / greatest(e - s, 1), 6) AS overlap_ratio, {_TIER} AS quality_tier
FROM r LEFT JOIN os USING (recording, chunk)""",
    "chunk_tail_merge": f"""WITH RECURSIVE {TAILS}, {OVERLAP.format("cm")}, r AS ({_ROWS.format("cm")}),
x AS (SELECT *, greatest(s - 500, 0) AS a, e + 500 AS b FROM r LEFT JOIN os USING (recording, chunk))
SELECT {_ID} AS example_id, a AS start_ms, b AS end_ms, coalesce(overlap_ms, 0) AS overlap_ms, CASE WHEN list_contains(flags, 'unintelligible') THEN 'CHALLENGE' WHEN coalesce(overlap_ms, 0) = 0 THEN 'A' WHEN overlap_ms / greatest(b - a, 1) <= 0.05 THEN 'B' ELSE 'CHALLENGE' END AS quality_tier FROM x""",
    "chunk_tiers": f"""WITH RECURSIVE {GREEDY}, {OVERLAP.format("c")}, r AS ({_ROWS.format("c")}) SELECT {_TIER} AS quality_tier, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS ms FROM r LEFT JOIN os USING (recording, chunk) GROUP BY 1""",
    "long_units": f"WITH {UNITS} SELECT unit_id, recording, end_ms - start_ms AS duration_ms FROM u WHERE regexp_matches(text, '[A-Za-z0-9]') AND end_ms - start_ms > 27500",
    "recording_stats": f"WITH {UNITS} SELECT recording, count(*) AS units, count(DISTINCT speaker) AS speakers, coalesce(max(end_ms), 0) AS last_ms FROM u GROUP BY recording",
    "components": f"WITH RECURSIVE {GROUPS} SELECT recording, component FROM comp",
    "split_allocation": f"""WITH RECURSIVE {GROUPS},
z AS (SELECT '' AS stratum, component, CAST(sum(ms) AS DOUBLE) AS duration, sha256('splits-v1:' || string_agg(recording, ',' ORDER BY recording)) AS tie FROM comp JOIN recs ON rec = recording GROUP BY component),
{ALLOCATED} SELECT component, duration, split FROM a WHERE n > 0""",
    "split_allocation_strata": f"""WITH RECURSIVE {GROUPS},
z AS (SELECT CASE WHEN other THEN 'explicit-other-l1' ELSE 'core' END AS stratum, rec AS component, CAST(ms AS DOUBLE) AS duration, sha256('splits-v1:' || CASE WHEN other THEN 'explicit-other-l1' ELSE 'core' END || ':' || rec) AS tie FROM recs),
{ALLOCATED} SELECT stratum, component, split FROM a WHERE n > 0""",
}
