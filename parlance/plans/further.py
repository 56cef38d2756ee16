"""Queries of sources, sinks and the remaining operators over the tables in a folder, and their SQL.

What a sink writes is read again by the source that belongs to it, so that both are compared with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize, parse
from ..functions.lexicon import FILLERS_WIDE
from ..operators import loops, scoring
from ..runtime import ship, shared_folder, table
from ..sources import readers, writers
from . import manifests as M
from . import scoring_sql as sql
from .queries import CHUNKS, canonical_scores, chunks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- manifests written and read again

@query("SELECT DISTINCT pred_id, system, mode, reference, hypothesis FROM predictions")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as JSON lines with sorted keys, read by schema."""
    path = _folder(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "predictions").select("pred_id", "system", "mode", "reference", "hypothesis").distinct(), path)
    return readers.read_jsonl(spark, path, "pred_id long, system string, mode string, reference string, hypothesis string")


@query("SELECT DISTINCT pred_id, system, mode, reference, hypothesis FROM predictions")
def public_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines through the projection to the public fields; blank lines are skipped."""
    source, target = _folder(spark, "lines"), _folder(spark, "public")
    rows = table(spark, d, "predictions").select("pred_id", "system", "mode", "reference", "hypothesis").distinct().withColumn("private_note", F.lit("x"))
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(source)
    M.public_lines(spark, source, target, ("pred_id", *M.PUBLIC))
    lines = spark.read.text(target).where("value LIKE '%private_note%'")
    out = readers.read_jsonl(spark, target, "pred_id long, system string, mode string, reference string, hypothesis string")
    return out.join(lines.limit(1), F.lit(True), "left_anti")


@query(f"""WITH {CHUNKS} SELECT example_id, split, coalesce(nullif(array_to_string(flags, ','), ''), '') AS flags, coalesce(nullif(array_to_string(speakers, ','), ''), '') AS speakers, CAST(duration_ms AS VARCHAR) AS duration_ms FROM chunk""")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as tab-separated values with joined lists, read as text."""
    path = _folder(spark, "tsv")
    c = chunks(spark, d).select("example_id", "split", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), "duration_ms", F.lit("left out").alias("extra"))
    writers.write_tsv(c, path, ["example_id", "split", "flags", "speakers", "duration_ms"])
    t = spark.read.option("sep", "\t").option("header", True).schema("example_id string, split string, flags string, speakers string, duration_ms string").csv(path)
    return t.withColumns({x: F.coalesce(x, F.lit("")) for x in ("flags", "speakers")})


@query(f"WITH {CHUNKS} SELECT split, example_id, duration_ms FROM chunk WHERE split IS NOT NULL")
def release_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The release's folder for each split, read as one table."""
    path = _folder(spark, "release")
    writers.write_release(chunks(spark, d).where("split IS NOT NULL").select("split", "example_id", "duration_ms"), path)
    return spark.read.option("header", True).schema("example_id string, duration_ms long, split string").csv(path)


@query("""WITH t AS (SELECT DISTINCT transcript_id, coalesce(raw_text, text) AS body FROM raw_transcripts WHERE coalesce(raw_text, text) <> '' AND transcript_id IS NOT NULL)
SELECT 't' || transcript_id AS recording, length(replace(regexp_replace(body, '^' || chr(65279), ''), chr(13) || chr(10), chr(10))) AS chars, md5(replace(regexp_replace(body, '^' || chr(65279), ''), chr(13) || chr(10), chr(10))) AS digest FROM t""")
def transcripts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts as files of their own, read whole, without a byte order mark and CRLF."""
    path = _folder(spark, "transcripts")
    t = table(ship(spark), d, "raw_transcripts").select("transcript_id", F.coalesce("raw_text", "text").alias("body")).where("body <> '' AND transcript_id IS NOT NULL").distinct()
    writers.write_texts(t.select(F.concat(F.lit("t"), "transcript_id").alias("name"), "body"), path, ".txt").count()
    return readers.read_transcripts(spark, path).select("recording", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("""WITH p AS (SELECT DISTINCT recording, trim(code) AS code FROM participants WHERE regexp_matches(trim(recording), '[0-9]+$') AND trim(code) <> '' AND NOT contains(code, chr(9)))
SELECT 'REC' || lpad(CAST(CAST(regexp_extract(trim(recording), '([0-9]+)$', 1) AS INT) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(regexp_extract(trim(recording), '([0-9]+)$', 1) AS INT) AS VARCHAR))) AS INT), '0') AS recording, list_sort(list_distinct(list(code))) AS speaker_ids FROM p GROUP BY 1""")
def segment_table(spark: SparkSession, d: str) -> DataFrame:
    """Headerless metadata lines (recording, key, value) of the participants, read as speakers by recording."""
    path = _folder(spark, "segments")
    p = table(spark, d, "participants").select("recording", F.trim("code").alias("code")).where(F.expr("trim(recording) RLIKE '[0-9]+$' AND code <> ''") & ~F.contains(F.col("code"), F.lit("\t"))).distinct()
    p.select(F.concat_ws("\t", "recording", F.lit("speaker:"), "code").alias("value")).unionByName(spark.createDataFrame([("short\tline",), ("no digits\tspeaker\tx",)], "value string")).write.text(path)
    return readers.read_segment_table(spark, path, "REC").select("recording", "speaker_ids")


# ---- audio: tones whose samples follow from the tables

_TONES = """c AS (SELECT DISTINCT blind_id, CAST(round(duration_seconds * 10) AS BIGINT) AS n FROM bench_items WHERE blind_id IS NOT NULL AND duration_seconds > 0),
one AS (SELECT blind_id, max(n) AS n FROM c GROUP BY blind_id)"""


def _tones(spark: SparkSession, d: str, rate: int) -> DataFrame:
    one = table(spark, d, "bench_items").select("blind_id", F.expr("cast(round(duration_seconds * 10) AS bigint)").alias("n")).where("blind_id IS NOT NULL AND duration_seconds > 0").groupBy("blind_id").agg(F.max("n").alias("n"))
    samples = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: (F.pmod(i * 37, F.lit(2001)) - 1000) / 32768.0).cast("array<float>")
    return one.select(F.col("blind_id").alias("example_id"), F.lit(rate).alias("rate"), samples.alias("samples"))


@query(f"""WITH {_TONES} SELECT blind_id AS example_id, n AS samples, CAST((SELECT sum((x.range * 37) % 2001 - 1000) FROM range(0, 2001) x WHERE x.range < n % 2001) AS BIGINT) AS total FROM one WHERE n % 2001 > 0
UNION ALL SELECT blind_id, n, 0 FROM one WHERE n % 2001 = 0""")
def wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Clips written as 16-bit WAV files and read again: their length and the sum of their samples."""
    import os

    path = _folder(ship(spark), "wav")
    os.makedirs(path.removeprefix("file:"), exist_ok=True)
    writers.write_wav(_tones(spark, d, 16_000), path.removeprefix("file:")).count()
    w = readers.read_wav(spark, path)
    whole = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + F.rint(x * 32768).cast("bigint"))
    return w.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("example_id"), F.size("samples").cast("long").alias("samples"), whole.alias("total"))


@query(f"""WITH {_TONES}, w AS (SELECT blind_id, n, least(n, CAST(round_even(0.00123 * 16000, 0) AS BIGINT)) AS a, least(n, CAST(round_even(0.00789 * 16000, 0) AS BIGINT)) AS b FROM one)
SELECT blind_id AS example_id, b - a AS samples, CAST(coalesce((SELECT sum((x.range * 37) % 2001 - 1000) FROM range(0, 2001) x WHERE x.range >= a AND x.range < b), 0) AS BIGINT) AS total FROM w""")
def cut_clips(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a clip's bounds, rounded half to even and clamped to the audio's length."""
    audio = _tones(spark, d, 16_000).withColumnRenamed("example_id", "path")
    clips = audio.select(F.col("path").alias("example_id"), "path", F.lit(1.23).alias("start_ms"), F.lit(7.89).alias("end_ms"))
    cut = readers.cut_samples(clips, audio)
    whole = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + F.rint(x * 32768).cast("bigint"))
    return cut.select("example_id", F.size("samples").cast("long").alias("samples"), whole.alias("total"))


# ---- checks and orders

@query("""WITH u AS (SELECT DISTINCT unit_id, CAST(round("end" * 1000) - round("start" * 1000) AS BIGINT) AS want, CAST(round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END) AS BIGINT) AS got FROM units WHERE "start" IS NOT NULL AND "end" IS NOT NULL AND duration IS NOT NULL)
SELECT CASE WHEN got > 29500 THEN 'too long' WHEN abs(got - want) > 1 THEN 'duration' ELSE 'ok' END AS verdict, count(*) AS n FROM u GROUP BY 1""")
def cut_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Cut clips against their manifest: rate, channels, duration within a sample and a half, greatest length."""
    ms = lambda c: F.expr(f"cast(round(`{c}` * 1000) AS bigint)")
    u = table(spark, d, "units").where("start IS NOT NULL AND end IS NOT NULL AND duration IS NOT NULL")
    u = u.select("unit_id", (ms("end") - ms("start")).alias("want_ms"), F.expr("cast(round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END) AS bigint)").alias("got_ms")).distinct()
    # whole milliseconds: one of them is the tolerance of a sample and a half at 1,000 Hz
    verdict = M.clip_verdict(F.lit(1_000), F.lit(1), F.col("got_ms") / 1000, F.col("want_ms") / 1000, 1_000, 29.5)
    return u.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS} SELECT example_id, row_number() OVER (ORDER BY split NULLS FIRST, corpus NULLS FIRST, example_id) AS place FROM (SELECT DISTINCT example_id, split, corpus FROM chunk) QUALIFY place <= 500")
def alphabetical_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 rows of the manifest in alphabetical order of split, corpus and id."""
    first = M.alphabetical_order(chunks(spark, d).select("example_id", "split", "corpus").distinct()).limit(500)
    # numbered in one task, as there are no more than 500
    return first.select("example_id", F.row_number().over(Window.orderBy("split", "corpus", "example_id")).cast("long").alias("place"))


@query(f"""WITH {CHUNKS}, x AS (SELECT example_id, split, token_count, flags, coalesce(token_count, 0) <> 0 AND coalesce(speaker_count, 0) > 1 OR coalesce(list_contains(flags, 'overlap'), false) AS overlap FROM chunk)
SELECT split, overlap, count(*) AS n FROM x GROUP BY ALL""")
def overlap_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose overlapped tokens (here those of clips of several speakers) or flags show an overlap."""
    c = chunks(spark, d).withColumn("overlap_token_count", F.when(F.col("speaker_count") > 1, F.col("token_count")))
    return c.groupBy("split", M.has_token_overlap().alias("overlap")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT pred_id, corpus, reference, hypothesis FROM predictions)
SELECT corpus, count(*) FILTER (WHERE reference IS DISTINCT FROM hypothesis) AS changed, count(*) FILTER (WHERE reference IS NOT DISTINCT FROM hypothesis) AS unchanged,
  list_sort(coalesce(list(pred_id) FILTER (WHERE coalesce(trim(hypothesis), '') = ''), [])) AS fallback FROM p GROUP BY corpus""")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the policy changes and leaves, and the ids of those that it empties."""
    p = table(spark, d, "predictions").select("pred_id", "corpus", "reference", "hypothesis").distinct()
    return M.change_counts(p, ["corpus"], "pred_id", "reference", "hypothesis")


# ---- token lists

@query("""WITH r AS (SELECT DISTINCT pred_id, unnest(loop_repairs) AS r FROM predictions), x AS (SELECT DISTINCT pred_id, r.attempt AS attempt, r.ngram_token_ids AS ids FROM r WHERE len(r.ngram_token_ids) > 0)
SELECT pred_id, attempt, CASE WHEN list_contains(ids, ids[-1]) THEN ids[1 : list_position(ids, ids[-1]) - 1] ELSE ids END AS before_end,
  ids[3:] AS after_prompt, CASE WHEN len(ids) > 1 THEN list_concat(ids[1 : list_position(ids, ids[2]) - 1], [7], ids[list_position(ids, ids[2]) :]) ELSE ids END AS with_policy FROM x""")
def token_edits(spark: SparkSession, d: str) -> DataFrame:
    """Tokens before the end token, after the prompt, and with a policy token before the mark."""
    r = table(spark, d, "predictions").select("pred_id", F.explode("loop_repairs").alias("r")).select("pred_id", "r.attempt", F.col("r.ngram_token_ids").alias("ids")).where("size(ids) > 0").distinct()
    ids = F.col("ids")
    end = F.element_at(ids, -1)
    return r.select("pred_id", "attempt", loops.until(ids, end).alias("before_end"), loops.without_prefix(ids, F.slice(ids, 1, 2)).alias("after_prompt"), F.when(F.size(ids) > 1, loops.insert_before(ids, F.get(ids, 1), F.lit(7))).otherwise(ids).alias("with_policy"))


_WORDS = """p AS (SELECT DISTINCT pred_id, str_split(trim(regexp_replace(hypothesis, '[ ]+', ' ', 'g')), ' ') AS t FROM predictions WHERE hypothesis IS NOT NULL)"""
_SIZES = ", ".join(f"({n}, {k})" for n, k in loops.REPETITIONS.items())


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("pred_id", "hypothesis").where("hypothesis IS NOT NULL").distinct().select("pred_id", F.split(F.trim(F.regexp_replace("hypothesis", "[ ]+", " ")), " ").alias("t"))


@query(f"""WITH {_WORDS}, s AS (SELECT pred_id, t, unnest(range(0, len(t))) AS i FROM p), z AS (SELECT * FROM s, (VALUES {_SIZES}) AS v(n, k) WHERE i + n * k <= len(t)),
hit AS (SELECT pred_id, i, n FROM z WHERE t[i + 1 : i + n * (k - 1)] = t[i + n + 1 : i + n * k]) SELECT pred_id, CAST(min(i) AS INT) AS "start", CAST(arg_min(n, i * 100 + n) AS INT) AS size FROM hit GROUP BY pred_id""")
def token_loops_wide(spark: SparkSession, d: str) -> DataFrame:
    """The first loop of each hypothesis among all sizes up to twelve."""
    w = _words(spark, d).withColumn("loop", loops.first_loop(F.col("t"), 1, 12, loops.REPETITIONS))
    return w.where("loop IS NOT NULL").select("pred_id", "loop.start", "loop.size")


_FIRST = ", ".join(
    f"list_min(list_filter(range(0, greatest(0, len(t) - {n * k} + 1)), lambda i: t[i + 1 : i + {n * (k - 1)}] = t[i + {n + 1} : i + {n * k}])) * 100 + {n}" for n, k in loops.REPETITIONS.items()
)


@query(f"""WITH RECURSIVE {_WORDS}, g AS (SELECT pred_id, 0 AS attempt, t, CAST(NULL AS BIGINT) AS hit, CAST([] AS BIGINT[]) AS kept FROM p),
a AS (
  SELECT pred_id, attempt, t, list_min([{_FIRST}]) AS hit, kept FROM g
  UNION ALL
  SELECT pred_id, attempt + 1, t2, list_min([{_FIRST.replace("(t)", "(t2)").replace(" t[", " t2[").replace("= t[", "= t2[")}]), kept2
  FROM (SELECT pred_id, attempt, t[1 : hit // 100 + hit % 100] || (CASE WHEN attempt < 5 THEN t[hit // 100 + 2 * (hit % 100) + 1 :] ELSE [] END) AS t2, list_append(kept, hit // 100 + hit % 100) AS kept2 FROM a WHERE hit IS NOT NULL AND attempt <= 5))
SELECT pred_id, CAST(attempt AS INT) AS repairs, CAST(len(t) AS INT) AS tokens, list_transform(kept, lambda x: CAST(x AS INT)) AS kept FROM a WHERE attempt > 0 QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY attempt DESC) = 1""")
def loop_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Up to five repairs of each hypothesis, each rewound to one run of its loop and gone on without the next one; a loop left then is cut off."""
    w = _words(spark, d)
    w = w.where(loops.first_loop(F.col("t"), 1, 12, loops.REPETITIONS).isNotNull())
    return w.withColumn("x", loops.repaired(F.col("t"))).select("pred_id", F.size("x.kept").alias("repairs"), F.size("x.ids").alias("tokens"), "x.kept")


# ---- headers of transcripts

_LINES = """t AS (SELECT DISTINCT transcript_id, coalesce(raw_text, text) AS body FROM raw_transcripts WHERE transcript_id IS NOT NULL AND coalesce(raw_text, text) <> ''),
l AS (SELECT transcript_id, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS line FROM t)"""


@query(f"WITH {_LINES} SELECT transcript_id, regexp_extract(line, '^@([A-Za-z]+)', 1) AS header, count(*) AS n, count(*) FILTER (WHERE contains(line, ':')) AS with_value FROM l WHERE regexp_matches(line, '^@[A-Za-z]') GROUP BY ALL")
def transcript_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header lines of transcripts by name, and how many of them have a value."""
    t = table(spark, d, "raw_transcripts").select("transcript_id", F.coalesce("raw_text", "text").alias("body")).where("transcript_id IS NOT NULL AND body <> ''").distinct()
    return parse.headers(t, "transcript_id", "body").groupBy("transcript_id", "header").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNotNull()).alias("with_value"))


@query("""WITH p AS (SELECT DISTINCT upper(trim(recording)) AS recording, trim(code) AS code, trim(age) AS age, trim(sex) AS sex, trim(role) AS role, lower(trim(reported_other_l1)) AS other FROM participants
  WHERE trim(recording) <> '' AND regexp_matches(trim(code), '^[A-Za-z0-9]+$') AND NOT contains(concat_ws('', age, sex, role, reported_other_l1), '|'))
SELECT recording, code, coalesce(age, '') AS age, coalesce(sex, '') AS sex, coalesce(role, '') AS role, coalesce(other, '') AS other_l1 FROM p""")
def participant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Participants written as @ID lines of one header for each recording, and parsed again; codes must be those of its @Participants line."""
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    p = table(ship(spark), d, "participants").select(F.upper(F.trim("recording")).alias("recording"), F.trim("code").alias("code"), t("age").alias("age"), t("sex").alias("sex"), t("role").alias("role"), F.lower(t("reported_other_l1")).alias("other_l1"))
    p = p.where("recording <> '' AND code RLIKE '^[A-Za-z0-9]+$' AND NOT contains(concat(age, sex, role, other_l1), '|')").distinct()
    line = F.concat_ws("|", F.lit("@ID:\teng"), F.lit("corpus"), "code", "age", "sex", F.lit(""), F.lit(""), "role", F.lit(""), "other_l1", F.lit(""))
    files = p.groupBy("recording").agg(F.concat(F.lit("@Participants:\t"), F.array_join(F.collect_set(F.concat_ws(" ", "code", F.lit("Speaker"))), ", "), F.lit("\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n@Comment:\tnone")).alias("text"))
    return parse.participants_of(files, "recording", "text")


# ---- scores and intended text once more, as far as SQL can follow

@query(f"{sql.scored()} SELECT system, count(*) AS examples, CAST(sum(xu) AS BIGINT) AS units, CAST(sum(xe) AS BIGINT) AS errors, sum(xe) / greatest(sum(xu), 1) AS error_rate FROM e WHERE unclear = 0 GROUP BY system")
def cer_totals(spark: SparkSession, d: str) -> DataFrame:
    """Character errors of predictions whose reference has no unclear words."""
    s = canonical_scores(spark, d, "cer").where("cer_units IS NOT NULL")
    m = scoring.micro(s, ["system"], "cer")
    return m.select("system", "examples", "units", (F.col("subs") + F.col("dels") + F.col("ins")).alias("errors"), "error_rate")


_EVENT = r"(?i)\[(?:laugh(?:ter|s|ing)?|noise|cough(?:ing)?|breath(?:ing)?|sneeze|sigh|music|inaudible|vocali[sz]ation)[^\]]*\]"
_SAID = "[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*(?:-[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*)*-?"
_WIDTH = " ".join(f"WHEN len(l) - i + 1 >= {2 * w} AND low[i : i + {w - 1}] = low[i + {w} : i + {2 * w - 1}] THEN {w}" for w in (4, 3, 2, 1))


@query(f"""WITH RECURSIVE c AS (SELECT DISTINCT example_id, text FROM chunks),
f AS (SELECT example_id, text, replace({sql.folded("coalesce(text, '')")}, '’', '''') AS x FROM c),
g AS (SELECT example_id, text, len(regexp_extract_all(x, '{_EVENT}')) AS events, regexp_extract_all(regexp_replace(x, '{_EVENT}', ' ', 'g'), '{_SAID}') AS t FROM f),
h AS (SELECT *, list_filter(t, lambda w: NOT list_contains([{sql._quoted(FILLERS_WIDE)}], lower(w))) AS u FROM g),
s AS (SELECT *, list_filter(u, lambda w: w[-1] <> '-') AS v FROM h),
k AS (SELECT *, list_filter(v, lambda w, i: NOT (length(w) = 1 AND lower(w) NOT IN ('a', 'i') AND (coalesce(starts_with(lower(v[i + 1]), lower(w)), false) OR coalesce(starts_with(lower(v[i + 2]), lower(w)), false)))) AS kept FROM s),
r AS (
  SELECT example_id, text, kept AS l, list_transform(kept, lambda w: lower(w)) AS low, 1 AS i, len(kept) AS was, 0 AS repeats, false AS done FROM k
  UNION ALL
  SELECT example_id, text, CASE WHEN n IS NULL THEN l ELSE l[1 : i + n - 1] || l[i + 2 * n :] END, CASE WHEN n IS NULL THEN low ELSE low[1 : i + n - 1] || low[i + 2 * n :] END,
    CASE WHEN i > len(l) THEN 1 WHEN n IS NULL THEN i + 1 ELSE i END, CASE WHEN i > len(l) THEN len(l) ELSE was END, repeats + CASE WHEN n IS NULL THEN 0 ELSE 1 END, i > len(l) AND was = len(l)
  FROM (SELECT *, CASE {_WIDTH} END AS n FROM r WHERE NOT done))
SELECT k.example_id, CASE WHEN len(l) = 0 THEN k.text ELSE array_to_string(l, ' ') END AS intended_text, CAST(events AS INT) AS events, CAST(len(t) - len(u) AS INT) AS fillers, CAST(len(u) - len(v) AS INT) AS fragments, CAST(len(v) - len(kept) AS INT) AS repairs, CAST(repeats AS INT) AS repeats
FROM k JOIN r ON r.example_id = k.example_id AND r.text IS NOT DISTINCT FROM k.text WHERE done""")
def intended_steps(spark: SparkSession, d: str) -> DataFrame:
    """Intended texts with what was taken away: events, fillers, fragments, one-letter starts and repeats."""
    c = table(ship(spark), d, "chunks").select("example_id", "text").distinct().withColumn("x", normalize.intended_column(F.col("text")))
    n = lambda *names: sum((F.coalesce(F.col("x.operations")[x], F.lit(0)) for x in names), F.lit(0)).cast("int")
    return c.select(
        "example_id",
        F.when(F.col("x.text") == "", F.col("text")).otherwise(F.col("x.text")).alias("intended_text"),
        n("bracketed_event").alias("events"),
        n("filler").alias("fillers"),
        n("marked_fragment").alias("fragments"),
        n("single_letter_repair").alias("repairs"),
        n(*(f"repeat_span_{w}" for w in (1, 2, 3, 4))).alias("repeats"),
    )
