"""Queries over the tables in a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, table
from . import chars, groups, leakage, overlap, pieces, repetition, sentences, tokens, turns


def _values(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t, key, field: table(spark, d, t).select(F.lit(t).alias("src"), F.col(key).cast("string").alias("row_key"), F.lit(field).alias("field"), F.col(field).alias("text"))
    return pick("predictions", "pred_id", "reference").unionByName(pick("predictions", "pred_id", "hypothesis")).unionByName(pick("chunks", "example_id", "text")).unionByName(pick("documents", "doc_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chars.affected_values(_values(ship(spark), d)).select("src", "row_key", "field")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field hold each kind of confusable form."""
    return chars.affected_values(_values(ship(spark), d)).select("src", "field", F.explode("kinds").alias("kind")).groupBy("src", "field", "kind").agg(F.count(F.lit(1)).alias("n_values"))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized chunk with their texts."""
    ship(spark)
    return pieces.oversized_pieces(table(spark, d, "chunks"), table(spark, d, "units"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized chunk: bounds, and whether they end at a boundary."""
    return p2_texts(spark, d).select("example_id", "piece", "start_ms", "end_ms", "cut")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_texts(spark, d).where("piece = 0").select("example_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(ship(spark), d, "chunks")).select("id_a", "id_b")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(ship(spark), d, "chunks"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.document_classes(table(ship(spark), d, "chunks"))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlap fraction of each held-out record with train, by content-defined chunks."""
    return overlap.overlap_fractions(table(ship(spark), d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.torn_recordings(table(spark, d, "recordings"), table(spark, d, "participants"), table(spark, d, "chunks"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return groups.assign_splits(table(spark, d, "recordings"), table(spark, d, "participants"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(ship(spark), d, "raw_transcripts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_turns(spark, d).select("transcript_id", "speaker", "line_start", "line_end")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(ship(spark), d, "predictions")).select("pred_id", F.round("share", 9).alias("share"), "repetitive")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(ship(spark), d, "predictions"), shares=False).where("repetitive").select("pred_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(ship(spark), d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).where("passage").select("doc_id", "blind_id")


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(ship(spark), d, "documents"), table(spark, d, "bench_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, with the number of documents each is in, and in as a whole or slightly edited."""
    return _leaked(spark, d).groupBy("blind_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("whole") > 0).alias("n_whole"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(ship(spark), d, "documents"))


QUERIES = {q.__name__: q for q in (p1_found, p1_kinds, p2_found, p2_pieces, p2_texts, p3_found, p3_report, p3_classes, p3_overlaps, p4_found, p4_splits, p5_found, p5_turns, p6_found, p6_shares, p8_ids, p9_found, p9_items, p10_found)}

SQL = {
    "p2_found": """
SELECT DISTINCT example_id FROM chunks
WHERE coalesce(round("end" * 1000) - round("start" * 1000), round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END)) > 27500""",
    "p2_pieces": """
WITH RECURSIVE clips AS (
  SELECT example_id, upper(trim(recording)) AS rec, CAST(round("start" * 1000) AS BIGINT) AS a0, CAST(round("end" * 1000) AS BIGINT) AS b0,
    CAST(round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END) AS BIGINT) AS d FROM chunks WHERE example_id IS NOT NULL),
over AS (
  SELECT DISTINCT example_id, rec, coalesce(a0, b0 - d, 0) AS a, coalesce(a0, b0 - d, 0) + coalesce(b0 - a0, d) AS b FROM clips WHERE coalesce(b0 - a0, d) > 27500),
u AS (SELECT DISTINCT upper(trim(recording)) AS rec, CAST(round("start" * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e FROM units),
m AS (
  SELECT example_id, a, b, max(e) OVER (PARTITION BY example_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bd, lead(s) OVER (PARTITION BY example_id ORDER BY s, e) AS nxt
  FROM over JOIN u USING (rec) WHERE e > s AND s < b AND e > a),
c AS (SELECT example_id, list(DISTINCT bd) AS cuts FROM m WHERE (nxt IS NULL OR nxt >= bd) AND bd > a AND bd < b GROUP BY example_id),
p AS (
  SELECT example_id, 0 AS piece, a AS s, b AS b, coalesce(cuts, []) AS cuts FROM over LEFT JOIN c USING (example_id)
  UNION ALL
  SELECT example_id, piece + 1, coalesce(list_max(list_filter(cuts, lambda x: x >= s + 2000 AND x <= s + 27500)), s + 27500) - 1000, b, cuts FROM p WHERE b - s > 27500)
SELECT example_id, CAST(piece AS INT) AS piece, s AS start_ms,
  CASE WHEN b - s > 27500 THEN coalesce(list_max(list_filter(cuts, lambda x: x >= s + 2000 AND x <= s + 27500)), s + 27500) ELSE b END AS end_ms,
  CASE WHEN b - s <= 27500 THEN 'end' WHEN list_max(list_filter(cuts, lambda x: x >= s + 2000 AND x <= s + 27500)) IS NULL THEN 'hard' ELSE 'boundary' END AS cut
FROM p""",
    "p4_found": """
WITH RECURSIVE people AS (
  SELECT DISTINCT upper(trim(recording)) AS rec, lower(trim(speaker_id)) AS who FROM participants
  WHERE lower(trim(speaker_id)) NOT IN ('', 'unknown', 'unk', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', '-', '--', '?', '??', 'tbd', 'anonymous')),
links AS (SELECT DISTINCT a.rec AS a, b.rec AS b FROM people a JOIN people b USING (who)),
reach AS (
  SELECT DISTINCT upper(trim(recording)) AS a, upper(trim(recording)) AS b FROM recordings WHERE trim(recording) <> ''
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
shown AS (
  SELECT DISTINCT upper(trim(recording)) AS b, CASE WHEN lower(trim(split)) IN ('dev', 'val', 'valid') THEN 'validation' ELSE lower(trim(split)) END AS split
  FROM chunks WHERE trim(split) <> ''),
torn AS (SELECT a FROM reach JOIN shown USING (b) GROUP BY a HAVING min(split) <> max(split))
SELECT DISTINCT recording FROM recordings JOIN torn ON upper(trim(recording)) = a""",
    "p4_splits": f"""
WITH RECURSIVE people AS (
  SELECT DISTINCT upper(trim(recording)) AS rec, lower(trim(speaker_id)) AS who FROM participants
  WHERE trim(recording) <> '' AND lower(trim(speaker_id)) NOT IN {groups.NOBODY}),
links AS (SELECT DISTINCT a.rec AS a, b.rec AS b FROM people a JOIN people b USING (who)),
recs AS (SELECT upper(trim(recording)) AS rec, max(greatest(coalesce(CASE WHEN isnan(duration) THEN 0 ELSE duration END, 0), 0)) AS seconds FROM recordings WHERE trim(recording) <> '' GROUP BY 1),
reach AS (SELECT rec AS a, rec AS b FROM recs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS recording, 'r:' || min(b) AS component FROM reach GROUP BY a),
sizes AS (SELECT component, CAST(sum(CAST(round(seconds * 1000) AS BIGINT)) AS BIGINT) AS ms FROM comp JOIN recs ON rec = recording GROUP BY 1),
f AS (SELECT unnest({list(groups.FACTORS)}) AS x, generate_subscripts({list(groups.FACTORS)}, 1) AS k),
options AS (SELECT (a.k - 1) * {len(groups.FACTORS)} + b.k - 1 AS option, 0.7::DOUBLE AS train, 0.2::DOUBLE * a.x::DOUBLE AS test, 0.1::DOUBLE * b.x::DOUBLE AS validation, a.x = 1 AND b.x = 1 AS plain FROM f a, f b),
uniform AS (SELECT component, ms, {", ".join(f"(CAST('0x' || substr(sha256(component || ':{s}'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u_{s}" for s in sorted(groups.TARGETS))} FROM sizes),
tried AS (SELECT component, ms, option, plain, list_sort([{", ".join(f"struct_pack(r := -{s} / ln(u_{s}), s := '{s}')" for s in sorted(groups.TARGETS))}])[-1].s AS split FROM uniform, options),
totals AS (SELECT option, plain, split, sum(ms)::DOUBLE / (SELECT greatest(sum(ms), 1) FROM sizes)::DOUBLE AS part FROM tried GROUP BY ALL),
off AS (SELECT option, plain, round({" + ".join(f"abs(coalesce(max(CASE WHEN split = '{s}' THEN part END), 0) - {w}::DOUBLE)" for s, w in groups.TARGETS.items())}, 9) AS off FROM totals GROUP BY ALL),
best AS (SELECT option FROM off ORDER BY (plain AND off <= {groups.NEAR}) DESC, off, option LIMIT 1)
SELECT c.recording, c.component, t.split, r.seconds FROM comp c JOIN recs r ON r.rec = c.recording JOIN tried t USING (component) JOIN best USING (option)""",
}
