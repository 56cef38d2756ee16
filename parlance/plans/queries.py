"""Queries of manifests, scores and summaries over the tables in a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, tokens
from ..functions.lexicon import FILLERS_WIDE
from ..functions.align import align
from ..operators import blocks, bootstrap, loops, scoring
from ..runtime import ship, slots, table
from . import manifests as M
from . import scoring_sql as sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


# ---- views

CHUNKS = """chunk AS (
  SELECT DISTINCT example_id, upper(trim(recording)) AS recording,
    CASE WHEN lower(trim(split)) = 'dev' THEN 'validation' ELSE lower(trim(split)) END AS split,
    corpus, text, audio, quality_tier, boundary_method, token_count, speaker_count, speakers, flags, overlap_seconds, has_overlap,
    CAST(coalesce(round("end" * 1000) - round("start" * 1000), round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END)) AS BIGINT) AS duration_ms
  FROM chunks)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each, with clean recording, split and duration."""
    t = table(spark, d, "chunks")
    ms = F.expr("cast(coalesce(round(`end` * 1000) - round(`start` * 1000), round(CASE WHEN duration > 1000 THEN duration ELSE duration * 1000 END)) AS bigint)")
    return t.select("example_id", F.upper(F.trim("recording")).alias("recording"), M.clean_split().alias("split"), "corpus", "text", "audio", "quality_tier", "boundary_method", "token_count", "speaker_count", "speakers", "flags", "overlap_seconds", "has_overlap", ms.alias("duration_ms")).distinct()


def predictions(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    """Predictions once each; ``spread`` over all cores where costly Python work follows on few bytes."""
    t = table(spark, d, "predictions").select("pred_id", "system", "mode", "corpus", "example_id", "blind_id", "reference", "hypothesis")
    return (t.repartition(slots(spark), "pred_id") if spread else t).distinct()


def bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_items").distinct()


# ---- word errors

_HYP = "coalesce(hypothesis, '')"
_TOKENS = "regexp_extract_all(replace(lower({0}), '’', ''''), '[a-z0-9]+(?:[''’][a-z0-9]+)*(?:-[a-z0-9]+(?:[''’][a-z0-9]+)*)*-?')"
PAIRS = f"""p AS (
  SELECT DISTINCT pred_id, system, corpus, blind_id, {_TOKENS.format("reference")} AS r, {_TOKENS.format("coalesce(hypothesis, '')")} AS h
  FROM predictions WHERE reference IS NOT NULL),
e AS (
  SELECT pred_id, system, corpus, blind_id, len(r) AS units,
    list_reduce(r, lambda prev, tok: list_reduce(range(1, len(h) + 1), lambda cur, j:
        list_append(cur, least(prev[j + 1] + 1, cur[j] + 1, prev[j] + CASE WHEN h[j] = tok THEN 0 ELSE 1 END)), [prev[1] + 1]),
      range(0, len(h) + 1))[-1] AS errors
  FROM p)"""


def _sdi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = align([([*r], [*h]) for r, h in zip(b["r"], b["h"], strict=True)], masked=False)
        yield b.drop(columns=["r", "h"]).assign(subs=n[:, 0], dels=n[:, 1], ins=n[:, 2])


def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """(pred_id, system, corpus, blind_id, units, subs, dels, ins) by lexical tokens; a null hypothesis is empty."""
    p = predictions(ship(spark), d, spread=True).where("reference IS NOT NULL")
    p = p.select("pred_id", "system", "corpus", "blind_id", tokens.lexical_tokens(F.col("reference")).alias("r"), tokens.lexical_tokens(F.coalesce("hypothesis", F.lit(""))).alias("h")).withColumn("units", F.size("r").cast("bigint"))
    return p.mapInPandas(_sdi, "pred_id long, system string, corpus string, blind_id string, units long, subs long, dels long, ins long")


def _errors(spark, d):
    return word_errors(spark, d).withColumn("errors", F.col("subs") + F.col("dels") + F.col("ins"))


@query(f"WITH {PAIRS} SELECT system, count(*) AS clips, CAST(sum(units) AS BIGINT) AS units, CAST(sum(errors) AS BIGINT) AS errors, sum(errors) / greatest(1, sum(units)) AS wer FROM e GROUP BY system")
def wer_micro_by_system(spark, d):
    return _errors(spark, d).groupBy("system").agg(F.count(F.lit(1)).alias("clips"), F.sum("units").alias("units"), F.sum("errors").alias("errors"), scoring.rate(F.sum("errors"), F.sum("units")).alias("wer"))


@query(f"WITH {PAIRS} SELECT system, CAST(sum(units) AS BIGINT) AS units, CAST(sum(errors) AS BIGINT) AS errors, sum(errors) / greatest(1, sum(units)) AS wer FROM e WHERE blind_id IN (SELECT blind_id FROM bench_items WHERE analysis_eligible) GROUP BY system")
def wer_eligible_subset(spark, d):
    eligible = bench(spark, d).where("analysis_eligible").select("blind_id")
    return _errors(spark, d).join(eligible, "blind_id", "left_semi").groupBy("system").agg(F.sum("units").alias("units"), F.sum("errors").alias("errors"), scoring.rate(F.sum("errors"), F.sum("units")).alias("wer"))


@query(f"WITH {PAIRS}, c AS (SELECT system, corpus, sum(errors) / greatest(1, sum(units)) AS wer FROM e GROUP BY system, corpus) SELECT system, round(avg(wer), 12) AS macro_wer, count(*) AS n_corpora FROM c GROUP BY system")
def wer_macro(spark, d):
    c = _errors(spark, d).groupBy("system", "corpus").agg(scoring.rate(F.sum("errors"), F.sum("units")).alias("wer"))
    return c.groupBy("system").agg(F.round(F.avg("wer"), 12).alias("macro_wer"), F.count(F.lit(1)).alias("n_corpora"))


@query(f"WITH p AS (SELECT DISTINCT pred_id, system, mode, corpus, {_TOKENS.format('reference')} AS r, {_TOKENS.format(_HYP)} AS h FROM predictions WHERE reference IS NOT NULL), {sql.aligned('p', FILLERS_WIDE)} SELECT system, CAST(sum(units) AS BIGINT) AS units, CAST(sum(subs) AS BIGINT) AS subs, CAST(sum(dels) AS BIGINT) AS dels, CAST(sum(ins) AS BIGINT) AS ins FROM al GROUP BY system")
def sdi_counts(spark, d):
    return word_errors(spark, d).groupBy("system").agg(*[F.sum(c).alias(c) for c in ("units", "subs", "dels", "ins")])


@query(f"""WITH {PAIRS}, w AS (SELECT blind_id, system, errors / greatest(1, units) AS wer FROM e WHERE blind_id IS NOT NULL),
x AS (SELECT blind_id, max(CASE WHEN system = 'baseline_large' THEN wer END) - max(CASE WHEN system = 'verbatim_full' THEN wer END) AS advantage FROM w GROUP BY blind_id)
SELECT blind_id, round(advantage, 12) AS advantage FROM x WHERE advantage IS NOT NULL ORDER BY advantage DESC, blind_id LIMIT 10""")
def per_clip_advantage_top10(spark, d):
    w = _errors(spark, d).where("blind_id IS NOT NULL").withColumn("wer", scoring.rate(F.col("errors"), F.col("units")))
    x = w.groupBy("blind_id").pivot("system", ["baseline_large", "verbatim_full"]).agg(F.max("wer")).withColumn("advantage", F.col("baseline_large") - F.col("verbatim_full"))
    return x.where("advantage IS NOT NULL").orderBy(F.desc("advantage"), "blind_id").limit(10).select("blind_id", F.round("advantage", 12).alias("advantage"))


# ---- canonical scores

def canonical_scores(spark, d, *parts: str) -> DataFrame:
    return scoring.scored(predictions(ship(spark), d, spread=True), ["pred_id", "system", "mode", "corpus", "blind_id"], parts=parts)


@query(f"{sql.scored()} SELECT system, mode, count(*) AS examples, count(*) FILTER (unclear > 0) AS examples_with_unclear, CAST(sum(unclear) AS BIGINT) AS unclear_units, {', '.join(f'{r} AS {p}_rate' for p, r in sql.RATES)} FROM e GROUP BY system, mode")
def canonical_report(spark, d):
    return scoring.report(canonical_scores(spark, d, "verbatim", "conventional", "cer"), ["system", "mode"])


@query(sql.one("verbatim", " " + sql.micro("al", "system")))
def masked_sdi_counts(spark, d):
    return scoring.micro(canonical_scores(spark, d, "verbatim"), ["system"], "verbatim")


@query(sql.one("conventional", " " + sql.micro("al", "system")))
def conventional_wer(spark, d):
    return scoring.micro(canonical_scores(spark, d, "conventional"), ["system"], "conventional")


@query()
def cer(spark, d):
    return scoring.micro(canonical_scores(spark, d, "cer").where("cer_units IS NOT NULL"), ["system"], "cer")


@query(sql.one("verbatim", f", {sql.events('al', True)} SELECT * FROM ev"))
def event_prf(spark, d):
    return scoring.event_rates(canonical_scores(spark, d, "events"), ["system"])


@query(f"""WITH p AS (SELECT DISTINCT pred_id, system, mode, corpus, example_id, blind_id, {_TOKENS.format(sql.folded('reference'))} AS r, {_TOKENS.format(sql.folded(_HYP))} AS h FROM predictions WHERE reference IS NOT NULL), {sql.aligned('p', FILLERS_WIDE)}, {sql.events('al', False)} SELECT * FROM ev""")
def event_prf_lexical(spark, d):
    return scoring.event_rates(scoring.scored(predictions(ship(spark), d, spread=True), ["pred_id", "system"], lexical=True), ["system"], nullable=False)


@query(sql.one("conventional", f", c AS ({sql.micro('al', 'system, corpus')}) SELECT system, avg(error_rate) AS macro_rate, count(*) AS n_groups FROM c GROUP BY system"))
def conventional_macro(spark, d):
    return scoring.macro(canonical_scores(spark, d, "conventional"), ["system"], "corpus", "conventional")


@query(f"WITH {sql.start()} SELECT DISTINCT pred_id, coalesce(verbatim, []) AS verbatim, coalesce(conventional, []) AS conventional FROM predictions LEFT JOIN ct ON t = reference")
def canonical_tokens(spark, d):
    return predictions(ship(spark), d, spread=True).select("pred_id", tokens.canonical_tokens_column(F.col("reference")).alias("verbatim"), tokens.canonical_tokens_column(F.col("reference"), True).alias("conventional"))


# ---- bootstrap

_BOOT = """c AS (SELECT system, video_id AS cluster, sum(errors) AS errors, sum(units) AS units FROM e JOIN (SELECT DISTINCT blind_id, video_id FROM bench_items) USING (blind_id) WHERE video_id IS NOT NULL GROUP BY system, video_id),
k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS rank FROM (SELECT DISTINCT cluster FROM c)),
n AS (SELECT count(*) AS n FROM k),
w AS (SELECT r.range AS replicate, CAST('0x' || substr(sha256('boot:' || r.range || ':' || p.range), 1, 8) AS BIGINT) % (SELECT n FROM n) AS rank
  FROM range(0, 400) r, range(0, (SELECT n FROM n)) p),
t AS (SELECT replicate, rank, count(*) AS times FROM w GROUP BY replicate, rank),
q AS (SELECT replicate, system, sum(errors * times) / nullif(sum(units * times), 0) AS rate FROM t JOIN k USING (rank) JOIN c USING (cluster) GROUP BY replicate, system)"""


def _boot(spark, d):
    video = bench(spark, d).select("blind_id", F.col("video_id").alias("cluster")).distinct()
    sums = bootstrap.cluster_sums(_errors(spark, d).join(video, "blind_id"))
    return sums, bootstrap.replicate_rates(sums, bootstrap.hashed_draws(sums, 400, "boot"))


@query(f"WITH {PAIRS}, {_BOOT}, s AS (SELECT system, sum(errors) / greatest(sum(units), 1) AS point FROM c GROUP BY system) SELECT system, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high, count(*) FILTER (rate IS NULL) AS undefined, round(any_value(point), 9) AS point FROM q JOIN s USING (system) GROUP BY system")
def bootstrap_ci(spark, d):
    sums, rates = _boot(spark, d)
    return bootstrap.intervals(rates, sums).select("system", *[F.round(c, 9).alias(c) for c in ("low", "high")], "undefined", F.round("point", 9).alias("point"))


@query(f"WITH {PAIRS}, {_BOOT}, x AS (SELECT a.system, a.rate - b.rate AS d FROM q a JOIN q b USING (replicate) WHERE b.system = 'baseline_large' AND a.system <> 'baseline_large') SELECT system, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 9) AS better FROM x GROUP BY system")
def bootstrap_paired_diff(spark, d):
    return bootstrap.paired_differences(_boot(spark, d)[1], "baseline_large").select("system", *[F.round(c, 9).alias(c) for c in ("low", "high", "better")])


# ---- manifests

@query(f"WITH {CHUNKS} SELECT count(*) AS examples, sum(duration_ms) / 3600000 AS hours, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) FILTER (coalesce(speaker_count, len(speakers)) > 1) AS several_speakers, count(DISTINCT recording) AS recordings, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split IS NULL) AS n_none FROM chunk")
def manifest_summary(spark, d):
    return M.summary(chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT split, coalesce(corpus, 'unknown') AS corpus, quality_tier, count(*) AS examples, coalesce(sum(duration_ms), 0) / 3600000 AS hours FROM chunk GROUP BY ALL")
def manifest_groups(spark, d):
    return chunks(spark, d).groupBy("split", F.coalesce("corpus", F.lit("unknown")).alias("corpus"), "quality_tier").agg(F.count(F.lit(1)).alias("examples"), M.hours(F.col("duration_ms")).alias("hours"))


@query(f"WITH {CHUNKS} SELECT split, count(*) AS all_examples, count(*) FILTER (quality_tier = 'A') AS clean_examples, CAST(sum(duration_ms) AS BIGINT) AS all_ms, CAST(coalesce(sum(CASE WHEN quality_tier = 'A' THEN duration_ms END), 0) AS BIGINT) AS clean_ms FROM chunk GROUP BY split")
def split_conditional_stats(spark, d):
    clean = F.col("quality_tier") == "A"
    return chunks(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("all_examples"), F.count_if(clean).alias("clean_examples"), F.sum("duration_ms").alias("all_ms"), F.coalesce(F.sum(F.when(clean, F.col("duration_ms"))), F.lit(0)).alias("clean_ms"))


@query("SELECT recording, count(*) AS units, count(*) FILTER (list_contains(flags, 'fragment')) AS fragments, count(*) FILTER (list_contains(flags, 'overlap')) AS overlaps, count(*) FILTER (len(flags) > 0) AS flagged FROM (SELECT DISTINCT unit_id, recording, flags FROM units) GROUP BY recording")
def turn_flag_stats(spark, d):
    has = lambda f: F.count_if(F.array_contains("flags", f))
    return table(spark, d, "units").select("unit_id", "recording", "flags").distinct().groupBy("recording").agg(F.count(F.lit(1)).alias("units"), has("fragment").alias("fragments"), has("overlap").alias("overlaps"), F.count_if(F.size("flags") > 0).alias("flagged"))


_CHANGED = "(SELECT unit_id, any_value(recording) AS recording, unnest(map_entries(any_value(normalization_changes))) AS x FROM units GROUP BY unit_id)"


def _changes(spark, d):
    one = table(spark, d, "units").groupBy("unit_id").agg(F.first("recording").alias("recording"), F.first(F.map_entries("normalization_changes")).alias("m"))
    return one.select("unit_id", "recording", F.map_from_entries("m").alias("m"))


@query(f"SELECT x.key AS name, CAST(sum(x.value) AS BIGINT) AS total FROM {_CHANGED} GROUP BY 1")
def change_totals(spark, d):
    return M.map_totals(_changes(spark, d), "m")


@query(f"SELECT recording, unit_id, x.key AS rule, x.value AS count FROM {_CHANGED}")
def change_log(spark, d):
    return _changes(spark, d).select("recording", "unit_id", F.explode("m").alias("rule", "count"))


_CATEGORIES = ("country", "state", "stratum", "audio_quality", "boundary_status", "overlap")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM (SELECT DISTINCT * FROM bench_items) GROUP BY {c}" for c in _CATEGORIES))
def category_counts(spark, d):
    return M.frequencies(bench(spark, d), _CATEGORIES)


@query("SELECT count(DISTINCT video_id) AS videos, count(DISTINCT (country, council_name)) AS councils, count(*) FILTER (analysis_eligible) AS eligible, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(reference, ''), '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM (SELECT DISTINCT * FROM bench_items)")
def distinct_counts(spark, d):
    return bench(spark, d).agg(F.countDistinct("video_id").alias("videos"), F.countDistinct(F.struct("country", "council_name")).alias("councils"), F.count_if("analysis_eligible").alias("eligible"), F.sum(tokens.white_words(F.col("reference"))).alias("words"))


@query(f"WITH {CHUNKS} SELECT pred_id, p.example_id, recording, split, duration_ms FROM (SELECT DISTINCT pred_id, example_id FROM predictions) p JOIN chunk USING (example_id)")
def exact_join(spark, d):
    return predictions(spark, d).select("pred_id", "example_id").join(chunks(spark, d).select("example_id", "recording", "split", "duration_ms"), "example_id").select("pred_id", "example_id", "recording", "split", "duration_ms")


@query("SELECT recording, r.split, count(DISTINCT code) AS codes, count(DISTINCT nullif(lower(trim(role)), '')) AS roles FROM (SELECT DISTINCT recording, split FROM recordings) r LEFT JOIN participants USING (recording) GROUP BY recording, r.split")
def metadata_left_join(spark, d):
    people = table(spark, d, "participants").groupBy("recording").agg(F.countDistinct("code").alias("codes"), F.countDistinct(F.expr("nullif(lower(trim(role)), '')")).alias("roles"))
    return table(spark, d, "recordings").select("recording", "split").distinct().join(people, "recording", "left").select("recording", "split", F.coalesce("codes", F.lit(0)).alias("codes"), F.coalesce("roles", F.lit(0)).alias("roles"))


@query("SELECT coalesce(a.example_id, b.example_id) AS example_id, CASE WHEN b.example_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT example_id FROM chunks WHERE example_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT example_id FROM predictions WHERE example_id IS NOT NULL) b USING (example_id) WHERE a.example_id IS NULL OR b.example_id IS NULL")
def id_set_diff(spark, d):
    return M.id_differences(table(spark, d, "chunks").where("example_id IS NOT NULL"), table(spark, d, "predictions").where("example_id IS NOT NULL"), "example_id")


@query("SELECT DISTINCT pred_id, system, blind_id FROM predictions WHERE blind_id IN (SELECT blind_id FROM bench_items WHERE analysis_eligible)")
def semi_subset(spark, d):
    return predictions(spark, d).join(bench(spark, d).where("analysis_eligible"), "blind_id", "left_semi").select("pred_id", "system", "blind_id")


@query(f"WITH {CHUNKS} SELECT recording, list_sort(list(DISTINCT split)) AS splits FROM chunk WHERE split IS NOT NULL GROUP BY recording HAVING count(DISTINCT split) > 1")
def split_leak(spark, d):
    return M.split_leaks(chunks(spark, d))


@query("SELECT example_id, count(*) AS n FROM chunks GROUP BY example_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return M.duplicate_ids(table(spark, d, "chunks"), "example_id")


@query(f"WITH {CHUNKS} SELECT DISTINCT recording FROM chunk WHERE recording NOT IN (SELECT upper(trim(recording)) FROM recordings)")
def missing_recordings(spark, d):
    known = table(spark, d, "recordings").select(F.upper(F.trim("recording")).alias("recording"))
    return M.unmatched(chunks(spark, d).select("recording").distinct(), known, "recording")


@query("SELECT list_sort(list(DISTINCT corpus)) AS labels, list_sort(list(DISTINCT corpus)) = (SELECT list_sort(list(DISTINCT corpus)) FROM recordings) AS complete FROM chunks")
def corpus_labels(spark, d):
    """The corpora of the chunks, and whether they are those of the recordings."""
    both = table(spark, d, "chunks").select(F.lit("c").alias("t"), "corpus").unionByName(table(spark, d, "recordings").select(F.lit("r").alias("t"), "corpus")).distinct()
    sides = both.agg(F.array_sort(F.collect_set(F.when(F.col("t") == "c", F.col("corpus")))).alias("labels"), F.array_sort(F.collect_set(F.when(F.col("t") == "r", F.col("corpus")))).alias("known"))
    return sides.select("labels", (F.col("labels") == F.col("known")).alias("complete"))


_MANIFESTS = """m AS (SELECT example_id AS id, corpus, split, duration_ms, token_count, NULL AS system FROM chunk
  UNION ALL SELECT 'pred_' || pred_id, corpus, NULL, NULL, NULL, system FROM (SELECT DISTINCT pred_id, corpus, system FROM predictions)
  UNION ALL SELECT blind_id, 'bench', NULL, CAST(round(duration_seconds * 1000) AS BIGINT), NULL, NULL FROM (SELECT DISTINCT * FROM bench_items))"""


@query(f"WITH {CHUNKS}, {_MANIFESTS} SELECT corpus, split, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms, CAST(sum(token_count) AS BIGINT) AS tokens, count(system) AS with_system FROM m GROUP BY corpus, split")
def union_manifests(spark, d):
    a = chunks(spark, d).select(F.col("example_id").alias("id"), "corpus", "split", "duration_ms", "token_count")
    b = predictions(spark, d).select(F.concat(F.lit("pred_"), "pred_id").alias("id"), "corpus", "system")
    c = bench(spark, d).select(F.col("blind_id").alias("id"), F.lit("bench").alias("corpus"), F.expr("cast(round(duration_seconds * 1000) AS bigint)").alias("duration_ms"))
    return M.combine(a, b, c).groupBy("corpus", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"), F.sum("token_count").alias("tokens"), F.count("system").alias("with_system"))


@query(f"WITH {CHUNKS} SELECT example_id, corpus, split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS split_rank FROM chunk ORDER BY 4, 2, 1")
def union_sorted_rank(spark, d):
    return M.ranked_order(chunks(spark, d).select("example_id", "corpus", "split"))


@query("SELECT example_id, min(pred_id) AS pred_id, arg_min(system, pred_id) AS system FROM predictions WHERE example_id IS NOT NULL GROUP BY example_id")
def first_per_pair(spark, d):
    return M.first_per(predictions(spark, d).where("example_id IS NOT NULL").select("example_id", "pred_id", "system"), "example_id", ["pred_id"])


@query("SELECT DISTINCT pred_id, system FROM predictions WHERE hypothesis IS DISTINCT FROM reference ORDER BY pred_id LIMIT 100")
def preview_100(spark, d):
    """The first 100 changed rows, the feature of a preview."""
    return predictions(spark, d).where(~F.col("hypothesis").eqNullSafe(F.col("reference"))).orderBy("pred_id").limit(100).select("pred_id", "system")


@query("SELECT DISTINCT pred_id, example_id FROM predictions WHERE example_id IN (SELECT example_id FROM predictions WHERE example_id IS NOT NULL GROUP BY example_id ORDER BY min(pred_id) LIMIT 8)")
def smoke_pairs(spark, d):
    """All rows of the first eight pairs, the feature of a smoke run."""
    p = predictions(spark, d).where("example_id IS NOT NULL").select("pred_id", "example_id")
    first = p.groupBy("example_id").agg(F.min("pred_id").alias("o")).orderBy("o").limit(8)
    return p.join(first, "example_id", "left_semi").select("pred_id", "example_id")


@query("SELECT pred_id || '__' || policy AS example_id, CAST(pred_id AS VARCHAR) AS pair_id, policy, '<|ovw_' || policy || '|>' AS policy_token, CASE policy WHEN 'verbatim' THEN reference ELSE hypothesis END AS text FROM (SELECT DISTINCT pred_id, reference, hypothesis FROM predictions), (VALUES ('verbatim'), ('intended')) AS v(policy)")
def pair_fanout(spark, d):
    p = predictions(spark, d).select(F.col("pred_id").cast("string").alias("example_id"), "reference", "hypothesis")
    return M.policy_rows(p, "reference", "hypothesis").select("example_id", "pair_id", "policy", "policy_token", "text")


@query(f"WITH {CHUNKS}, t AS (SELECT example_id, corpus FROM chunk WHERE split = 'train') SELECT * FROM t UNION ALL SELECT example_id || '__matched_repeat', corpus FROM t")
def exposure_repeat(spark, d):
    return M.exposure_repeat(chunks(spark, d).where("split = 'train'").select("example_id", "corpus"))


@query("SELECT DISTINCT system, mode, example_id, blind_id, reference, hypothesis, CAST(len(loop_repairs) AS INT) AS n_repairs FROM predictions")
def public_projection(spark, d):
    return M.public_fields(table(spark, d, "predictions")).withColumn("n_repairs", F.when(F.col("loop_repairs").isNotNull(), F.size("loop_repairs"))).drop("loop_repairs").distinct()


@query(f"WITH {CHUNKS} SELECT split, example_id AS file_id, text AS transcription, array_to_string(speakers, '|') AS speakers, array_to_string(coalesce(flags, []), ',') AS flags, coalesce(quality_tier, 'unknown') AS quality_tier, '/data/' || audio AS audio FROM chunk")
def release_projection(spark, d):
    c = chunks(spark, d)
    return c.select("split", F.col("example_id").alias("file_id"), F.col("text").alias("transcription"), F.array_join("speakers", "|").alias("speakers"), F.array_join(F.coalesce("flags", F.array().cast("array<string>")), ",").alias("flags"), F.coalesce("quality_tier", F.lit("unknown")).alias("quality_tier"), M.absolute(F.col("audio"), "/data").alias("audio"))


@query('SELECT DISTINCT unit_id, CAST(round("start" * 1000) AS BIGINT) + 150 AS start_ms, CAST(round("end" * 1000) AS BIGINT) - 150 AS end_ms FROM units WHERE round("end" * 1000) - round("start" * 1000) > 300')
def boundary_unpad(spark, d):
    u = table(spark, d, "units").select("unit_id", F.expr("cast(round(`start` * 1000) AS bigint)").alias("start_ms"), F.expr("cast(round(`end` * 1000) AS bigint)").alias("end_ms")).where("end_ms - start_ms > 300").distinct()
    return M.unpadded(u)


@query(f"WITH {CHUNKS} SELECT coalesce(overlap_seconds > 0, list_contains(flags, 'temporal_overlap'), false) AS overlap, quality_tier, count(*) AS n FROM chunk GROUP BY 1, 2")
def overlap_partition(spark, d):
    c = chunks(spark, d)
    return c.groupBy(M.has_overlap(c).alias("overlap"), "quality_tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS} SELECT recording, max(duration_ms) AS longest_ms, count(*) FILTER (duration_ms > 27500) AS over_limit FROM chunk GROUP BY recording")
def duration_violations(spark, d):
    return chunks(spark, d).groupBy("recording").agg(F.max("duration_ms").alias("longest_ms"), F.count_if(F.col("duration_ms") > 27_500).alias("over_limit"))


@query("SELECT recording, coalesce(explicit_other_l1, false) AS stratum, list_sort(list_distinct(coalesce(reported_other_l1_codes, []))) AS codes FROM (SELECT DISTINCT * FROM recordings)")
def language_strata(spark, d):
    r = table(spark, d, "recordings").distinct()
    return r.select("recording", F.coalesce("explicit_other_l1", F.lit(False)).alias("stratum"), F.array_sort(F.array_distinct(F.coalesce("reported_other_l1_codes", F.array().cast("array<string>")))).alias("codes"))


@query("SELECT system, count(*) FILTER (len(loop_repairs) > 0) AS repaired, CAST(sum(coalesce(len(loop_repairs), 0)) AS BIGINT) AS repairs FROM (SELECT DISTINCT pred_id, system, loop_repairs FROM predictions) GROUP BY system")
def repaired_counts(spark, d):
    p = table(spark, d, "predictions").select("pred_id", "system", "loop_repairs").distinct()
    n = F.coalesce(F.when(F.col("loop_repairs").isNotNull(), F.size("loop_repairs")), F.lit(0))
    return p.groupBy("system").agg(F.count_if(n > 0).alias("repaired"), F.sum(n).cast("bigint").alias("repairs"))


# ---- tokens and texts

_ASCII_TOKENS = {
    "display": r"[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*|[A-Za-z]+",
    "fragment": r"[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*(?:-[A-Za-z0-9]+)*-?",
}


@query(f"SELECT DISTINCT example_id, regexp_extract_all(text, '{_ASCII_TOKENS['display']}') AS tokens FROM chunks")
def tok_display(spark, d):
    return table(spark, d, "chunks").select("example_id", "text").distinct().select("example_id", tokens.display_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT DISTINCT example_id, regexp_extract_all(text, '{_ASCII_TOKENS['fragment']}') AS tokens FROM chunks")
def tok_fragment(spark, d):
    return table(spark, d, "chunks").select("example_id", "text").distinct().select("example_id", tokens.fragment_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT DISTINCT example_id, {_TOKENS.format('text')} AS tokens FROM chunks")
def tok_lexical(spark, d):
    return table(spark, d, "chunks").select("example_id", "text").distinct().select("example_id", tokens.lexical_tokens(F.col("text")).alias("tokens"))


@query("SELECT DISTINCT example_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*(?:-[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*)*-?'), lambda t: replace(t, '’', '''')) AS tokens FROM chunks")
def tok_policy(spark, d):
    return table(spark, d, "chunks").select("example_id", "text").distinct().select("example_id", tokens.policy_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT DISTINCT example_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_'']*(?:-[\s\p{Z}]|-$)?'), lambda t: regexp_replace(t, '[\s\p{Z}]+$', '')) AS tokens FROM chunks""")
def tok_words(spark, d):
    return table(spark, d, "chunks").select("example_id", "text").distinct().select("example_id", tokens.word_tokens(F.col("text")).alias("tokens"))


@query(f"""SELECT DISTINCT example_id, list_filter(list_transform(list_transform(regexp_extract_all(text, '{_ASCII_TOKENS['display']}'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')),
  lambda t: CASE WHEN t IN ('mmm', 'mmmm', 'mmhmm', 'mhm') THEN 'mm' WHEN t = 'hmmm' THEN 'hmm' WHEN t IN ('erm', 'errm') THEN 'um' WHEN t = 'gunna' THEN 'gonna' WHEN t = 'ok' THEN 'okay' ELSE t END), lambda t: t <> '') AS tokens FROM chunks""")
def match_tokens(spark, d):
    return table(spark, d, "chunks").select("example_id", "text").distinct().select("example_id", tokens.match_tokens(F.col("text")).alias("tokens"))


@query()
def intended_text(spark, d):
    c = table(ship(spark), d, "chunks").select("example_id", "text").distinct().withColumn("x", normalize.intended_column(F.col("text")))
    empty = F.col("x.text") == ""
    return c.select("example_id", F.when(empty, F.col("text")).otherwise(F.col("x.text")).alias("intended_text"), F.when(empty, F.map_concat("x.operations", F.create_map(F.lit("empty_fallback_to_verbatim"), F.lit(1)))).otherwise(F.col("x.operations")).alias("operations"))


def _units(spark, d):
    u = table(ship(spark), d, "units")
    return u.select("unit_id", "raw").distinct()


@query()
def normalize_analysis(spark, d):
    return _units(spark, d).select("unit_id", normalize.analysis_unit(F.col("raw")).alias("x")).select("unit_id", "x.*")


@query()
def normalize_tier(spark, d):
    return _units(spark, d).select("unit_id", normalize.tier_unit(F.col("raw")).alias("x")).select("unit_id", "x.text", "x.flags")


@query()
def normalize_turn(spark, d):
    u = table(ship(spark), d, "units").select("unit_id", "raw", "speaker").distinct()
    return u.select("unit_id", normalize.normalized_turn(F.col("raw"), F.array(F.coalesce("speaker", F.lit("")))).alias("x")).select("unit_id", "x.*")


# ---- loops

_LOOP_SQL = """p AS (SELECT DISTINCT pred_id, str_split(trim(regexp_replace(hypothesis, '[ ]+', ' ', 'g')), ' ') AS t FROM predictions WHERE hypothesis IS NOT NULL),
s AS (SELECT pred_id, t, unnest(range(0, len(t))) AS i FROM p),
z AS (SELECT * FROM s, (VALUES (1, 8), (2, 8), (3, 4), (4, 3), (5, 3)) AS v(n, k) WHERE i + n * k <= len(t)),
hit AS (SELECT pred_id, i, n FROM z WHERE t[i + 1 : i + n * (k - 1)] = t[i + n + 1 : i + n * k])"""


def _loops(spark, d):
    p = predictions(spark, d).where("hypothesis IS NOT NULL").select("pred_id", F.split(F.trim(F.regexp_replace("hypothesis", "[ ]+", " ")), " ").alias("t"))
    return p.withColumn("loop", loops.first_loop(F.col("t"), 1, 5, loops.REPETITIONS))


@query(f'WITH {_LOOP_SQL} SELECT pred_id, CAST(min(i) AS INT) AS "start", CAST(arg_min(n, i * 100 + n) AS INT) AS size FROM hit GROUP BY pred_id')
def token_loops(spark, d):
    return _loops(spark, d).where("loop IS NOT NULL").select("pred_id", "loop.start", "loop.size")


@query(f"WITH {_LOOP_SQL}, f AS (SELECT pred_id, min(i * 100 + n) AS x FROM hit GROUP BY pred_id) SELECT p.pred_id, CAST(coalesce(x // 100 + x % 100, len(t)) AS INT) AS kept FROM p LEFT JOIN f USING (pred_id)")
def loop_trim(spark, d):
    return _loops(spark, d).select("pred_id", F.size(loops.trim_loop(F.col("t"), F.col("loop"))).alias("kept"))


@query("SELECT example_id, pred_id, system, CAST(row_number() OVER (PARTITION BY example_id ORDER BY pred_id) - 1 AS INT) AS turn_index FROM (SELECT DISTINCT example_id, pred_id, system FROM predictions WHERE example_id IS NOT NULL)")
def sequence_index(spark, d):
    return M.numbered(predictions(spark, d).where("example_id IS NOT NULL").select("example_id", "pred_id", "system"), ["example_id"], ["pred_id"], "turn_index")


# ---- further forms

@query(f"{sql.scored()} SELECT system, count(*) AS examples, CAST(sum(unclear) AS BIGINT) AS unclear_units, {', '.join(f'round({r} * 100, 3) AS {p}_percent' for p, r in sql.RATES)} FROM e GROUP BY system")
def comparison_percent(spark, d):
    """One row per system, rates in percent, as published comparisons give them."""
    r = scoring.report(canonical_scores(spark, d, "verbatim", "conventional", "cer"), ["system"])
    return r.select("system", "examples", "unclear_units", *[F.round(F.col(f"{p}_rate") * 100, 3).alias(f"{p}_percent") for p in ("verbatim", "conventional", "cer")])


@query("SELECT DISTINCT pred_id, (row_number() OVER (ORDER BY pred_id) - 1) // 16 AS batch FROM (SELECT DISTINCT pred_id FROM predictions)")
def batches(spark, d):
    """Batches of sixteen rows by pred_id."""
    ids = table(spark, d, "predictions").select("pred_id").distinct().withColumn("_all", F.lit(0))
    n = blocks.row_numbers(ids, ["_all"], ["pred_id"], F.floor(F.col("pred_id") / 10_000), "n")
    return n.select("pred_id", F.floor(F.col("n") / 16).alias("batch"))


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(reference), '[a-z]+')) AS w FROM predictions) SELECT * FROM (SELECT w AS word, {sql.canonical_word('w')} AS canonical FROM w) WHERE canonical <> word")
def spelling_forms(spark, d):
    """Words of references whose canonical spelling differs."""
    words = predictions(ship(spark), d).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("reference"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    return words.withColumn("canonical", tokens.canonical_word_column(F.col("word"))).where("word <> canonical")


@query("""SELECT example_id, CASE WHEN has_overlap OR list_contains(flags, 'uncertain') OR speaker_count > 1 THEN CASE WHEN NOT list_contains(flags, 'uncertain') AND overlap_ratio <= 0.12 THEN 'B' ELSE 'CHALLENGE' END ELSE 'A' END AS tier
FROM (SELECT DISTINCT example_id, coalesce(has_overlap, false) AS has_overlap, coalesce(flags, []) AS flags, coalesce(speaker_count, 0) AS speaker_count, coalesce(overlap_ratio, 0) AS overlap_ratio FROM chunks)""")
def alignment_tiers(spark, d):
    """Tiers of aligned clips, all coverage and similarity known: A without overlap, doubt or second speaker; B with little overlap."""
    c = table(spark, d, "chunks").select("example_id", F.coalesce("has_overlap", F.lit(False)).alias("overlap"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("speaker_count", F.lit(0)).alias("speakers"), F.coalesce("overlap_ratio", F.lit(0.0)).alias("ratio")).distinct()
    return c.select("example_id", M.alignment_tier(F.lit(1.0), F.lit(1.0), F.col("ratio"), F.col("overlap"), F.array_contains("flags", "uncertain"), F.col("speakers") > 1).alias("tier"))


@query()
def bootstrap_generator(spark, d):
    """Intervals from 20,000 draws of Python's generator, as one by one."""
    video = bench(spark, d).select("blind_id", F.col("video_id").alias("cluster")).distinct()
    rates = bootstrap.generator_rates(bootstrap.cluster_sums(_errors(spark, d).join(video, "blind_id")))
    return spark.createDataFrame([(s, *map(float, np.nanpercentile(r, [2.5, 97.5]))) for s, r in rates.items()], "system string, low double, high double")
