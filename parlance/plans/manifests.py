"""Manifests: combining, expanding, checking and summarising. Checks return the rows that violate them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Order of splits, policy marks, and the fields of public predictions.
SPLIT_RANK = {"train": 0, "validation": 1, "test": 2}
POLICY_MARKS = {"verbatim": "<|ovw_verbatim|>", "intended": "<|ovw_intended|>"}
PUBLIC = """
example_id blind_id analysis_eligible country state council_name video_id video_title clip_start_seconds clip_end_seconds duration_seconds
youtube_url_at_target stratum boundary_status overlap audio_quality reference hypothesis loop_repairs system mode
""".split()
#: Padding of cut clips, in milliseconds.
PADDING_MS = 150


def clean_split(column: str | Column = "split") -> Column:
    s = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(s == "dev", "validation").otherwise(s)


def combine(*manifests: DataFrame) -> DataFrame:
    """All rows of manifests with different columns; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), manifests)


def ranked_order(df: DataFrame) -> DataFrame:
    """Rows by train, validation, test, then corpus and id."""
    rank = F.create_map(*[F.lit(x) for p in SPLIT_RANK.items() for x in p])
    return df.withColumn("split_rank", F.coalesce(F.element_at(rank, F.col("split")), F.lit(len(SPLIT_RANK)))).orderBy("split_rank", "corpus", "example_id")


def has_overlap(df: DataFrame) -> Column:
    """Overlap by seconds where they are known, else by flag."""
    return F.coalesce(F.col("overlap_seconds") > 0, F.array_contains("flags", "temporal_overlap"), F.lit(False))


def has_token_overlap() -> Column:
    """Overlap by overlapped tokens, or by flag."""
    return (F.coalesce("overlap_token_count", F.lit(0)) != 0) | F.coalesce(F.array_contains("flags", "overlap"), F.lit(False))


def alphabetical_order(df: DataFrame) -> DataFrame:
    """Rows by split, corpus and id in alphabetical order."""
    return df.orderBy("split", "corpus", "example_id")


def unpadded(df: DataFrame, start: str = "start_ms", end: str = "end_ms", padding_ms: int = PADDING_MS) -> DataFrame:
    """Bounds without the padding on both sides; an empty rest is an error."""
    a, b = F.col(start) + padding_ms, F.col(end) - padding_ms
    ok = F.when(a < b, a).otherwise(F.raise_error(F.lit("a clip is not longer than its padding")).cast("bigint"))
    return df.withColumns({start: ok, end: b})


def policy_rows(df: DataFrame, verbatim: str, intended: str) -> DataFrame:
    """Each row twice, with its verbatim and its intended text, policy, mark and ids."""
    both = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(POLICY_MARKS[p]).alias("policy_token"), F.col(t).alias("text")) for p, t in (("verbatim", verbatim), ("intended", intended))])
    return df.drop("text", "policy", "policy_token").withColumn("_p", F.explode(both)).select("*", "_p.*").drop("_p").withColumns({"pair_id": F.col("example_id"), "example_id": F.concat_ws("__", "example_id", "policy")})


def exposure_repeat(df: DataFrame) -> DataFrame:
    """Train rows once more under a repeat id."""
    return df.unionByName(df.withColumn("example_id", F.concat("example_id", F.lit("__matched_repeat"))))


def absolute(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))


def public_fields(df: DataFrame, fields: Sequence[str] = PUBLIC) -> DataFrame:
    """The listed fields, as far as they are there."""
    return df.select(*[c for c in fields if c in df.columns])


def public_lines(spark: SparkSession, source: str, target: str, fields: Sequence[str] = PUBLIC) -> None:
    """JSON lines with the listed fields only, in sorted order; a field that a line lacks is left out, a null one stays. Blank lines are skipped."""
    rows = spark.read.text(source).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"), "value")
    keep = F.filter(F.json_object_keys("value"), lambda k: k.isin(*fields))
    entries = F.transform(F.array_sort(keep), lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), F.to_json(F.try_variant_get("v", F.concat(F.lit("$['"), k, F.lit("']")), "variant"))))
    rows.select(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("value")).write.text(target)


# ---- checks

def clip_verdict(rate: Column, channels: Column, seconds: Column, wanted: Column, want_rate: int, longest: float) -> Column:
    """'rate', 'channels', 'too long', 'duration' (off by more than a sample and a half) or 'ok' of a cut clip."""
    off = F.abs(seconds - wanted) > 1.5 / want_rate
    return F.when(rate != want_rate, "rate").when(channels != 1, "channels").when(seconds > longest, "too long").when(off, "duration").otherwise("ok")


def split_leaks(df: DataFrame, key: str = "recording") -> DataFrame:
    """Keys with rows in more than one split."""
    return df.where(F.col("split").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one side has."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


# ---- summaries

def hours(ms: Column) -> Column:
    return F.coalesce(F.sum(ms), F.lit(0)) / 3_600_000


def summary(df: DataFrame, ms: str = "duration_ms") -> DataFrame:
    """One row: examples, hours, tokens, distinct recordings, rows with several speakers, examples by split."""
    one = df.groupBy("split", "recording").agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("ms"), F.sum("token_count").alias("tokens"), F.count_if(F.coalesce("speaker_count", F.size("speakers")) > 1).alias("several"))
    of = lambda s: F.coalesce(F.sum(F.when(F.coalesce("split", F.lit("none")) == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
    return one.agg(F.sum("n").alias("examples"), hours(F.col("ms")).alias("hours"), F.sum("tokens").alias("tokens"), F.sum("several").alias("several_speakers"), F.countDistinct("recording").alias("recordings"), *map(of, (*SPLIT_RANK, "none")))


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of each column's values, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def map_totals(df: DataFrame, column: str) -> DataFrame:
    """(name, total) over all rows' maps."""
    return df.select(F.explode(column).alias("name", "v")).groupBy("name").agg(F.sum("v").alias("total"))


def change_counts(df: DataFrame, by: Sequence[str], key: str, before: str, after: str) -> DataFrame:
    """Rows by group whose text changed and did not, and the sorted keys of those without a text after it."""
    same = F.col(before).eqNullSafe(F.col(after))
    empty = F.coalesce(F.trim(after), F.lit("")) == ""
    return df.groupBy(*by).agg(F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"), F.array_sort(F.collect_list(F.when(empty, F.col(key)))).alias("fallback"))


# ---- order

def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def first_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order, without a window over the group."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")


def alignment_tier(coverage: Column, similarity: Column, overlap_share: Column, overlap: Column, uncertain: Column, several: Column) -> Column:
    """A, B or CHALLENGE of a clip aligned to a recogniser's words."""
    a = (coverage >= 0.65) & (similarity >= 0.70) & ~overlap & ~uncertain & ~several
    b = (coverage >= 0.50) & (similarity >= 0.55) & (overlap_share <= 0.12) & ~uncertain
    return F.when(a, "A").when(b, "B").otherwise("CHALLENGE")
