"""Readers of manifests, transcripts, metadata tables and audio."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped, bad ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _stem():
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(recording, text) of whole files, without a byte order mark, lines ended by LF."""
    return spark.read.text(path, wholetext=True).select(_stem().alias("recording"), F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n", "\n").alias("text"))


def read_segment_table(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(recording, speaker_ids, extra) of headerless tables (recording, key, value...).

    A recording is named by its trailing digits. Values of ``speaker`` gather as a sorted set, of another key
    the last one stays; lines with fewer than three fields, without digits or key are skipped.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(_stem().alias("file"), F.monotonically_increasing_id().alias("line"), f.alias("f")).where(F.size("f") >= 3)
    rows = rows.select("file", "line", F.regexp_extract(F.trim(F.col("f")[0]), r"(\d+)$", 1).alias("digits"), F.rtrim(F.regexp_replace(F.trim(F.col("f")[1]), ":+$", "")).alias("key"), F.trim(F.array_join(F.slice("f", F.lit(3), F.size("f")), "\t")).alias("v"))
    rows = rows.where("digits <> '' AND key <> ''").withColumn("recording", F.format_string(f"{prefix}%03d", F.col("digits").cast("int")))
    last = rows.where("key <> 'speaker'").groupBy("recording", "key").agg(F.max_by("v", F.struct("file", "line")).alias("v")).groupBy("recording").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("extra"))
    people = rows.where("key = 'speaker'").groupBy("recording").agg(F.array_sort(F.collect_set("v")).alias("speaker_ids"))
    return people.join(last, "recording", "full")


def read_wav(spark: SparkSession, path: str, rate: int | None = 16_000) -> DataFrame:
    """(path, rate, samples) of 16-bit mono WAV files, samples in -1..1; with ``rate``, another one is an error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getnchannels() != 1 or w.getsampwidth() != 2 or rate not in (None, w.getframerate()):
                        raise ValueError(f"{p} is not 16-bit mono at {rate} Hz")
                    out.append((p, w.getframerate(), (np.frombuffer(w.readframes(w.getnframes()), dtype="<i2") / 32768).astype(np.float32)))
            yield pd.DataFrame(out, columns=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")


def cut_samples(clips: DataFrame, audio: DataFrame) -> DataFrame:
    """(example_id, rate, samples) of clips (example_id, path, start_ms, end_ms); bounds are rounded and clamped."""
    at = lambda c: F.greatest(F.lit(0), F.least(F.size("samples"), F.bround(F.col(c) * F.col("rate") / 1000).cast("int")))
    return clips.join(audio, "path").select("example_id", "rate", F.slice("samples", at("start_ms") + 1, at("end_ms") - at("start_ms")).alias("samples"))


def file_lineage(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """The same rows; an error where there are not exactly ``n``."""
    found = df.count()
    if found != n:
        raise ValueError(f"{found} rows instead of {n}")
    return df


def resampled(samples: np.ndarray, rate: int, to: int = 16_000) -> np.ndarray:
    """Polyphase resampling with a Kaiser-windowed low-pass filter; the length is rounded up."""
    from math import gcd

    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return samples
    wide = max(up, down)
    reach = 10 * wide
    n = np.arange(-reach, reach + 1)
    low_pass = np.sinc(n / wide) * np.kaiser(2 * reach + 1, 5.0)
    low_pass *= up / low_pass.sum()
    size = -(-len(samples) * up // down)
    centre = np.arange(size) * down
    out = np.zeros(size)
    # each output sample sees the inputs whose place on the fine grid lies within the filter
    first = -(-(centre - reach) // up)
    for k in range(2 * reach // up + 1):
        i = first + k
        offset = centre - i * up
        ok = (i >= 0) & (i < len(samples)) & (np.abs(offset) <= reach)
        out[ok] += samples[i[ok]] * low_pass[offset[ok] + reach]
    return out


def read_any_wav(spark: SparkSession, path: str, to: int = 16_000) -> DataFrame:
    """(path, rate, samples) of 8-, 16- and 32-bit WAV files of any rate: channels averaged, scaled, resampled."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[w.getsampwidth()]
                    raw = np.frombuffer(w.readframes(w.getnframes()), dtype=kind).reshape(-1, w.getnchannels()).astype(float)
                    scaled = (raw - 128) / 128 if kind is np.uint8 else raw / 2.0 ** (8 * w.getsampwidth() - 1)
                    out.append((p, to, resampled(scaled.mean(axis=1), w.getframerate(), to).astype(np.float32)))
            yield pd.DataFrame(out, columns=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")
