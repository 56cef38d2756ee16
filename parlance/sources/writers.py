"""Writers of manifests, logs, releases and summaries."""

from __future__ import annotations

import io
import os
import wave

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """JSON lines with keys in sorted order and nulls kept; ``one_file`` only for small ordered manifests."""
    out = df.orderBy(*order) if order else df
    out = out.select(*sorted(df.columns))
    (out.coalesce(1) if one_file else out).write.option("ignoreNullFields", "false").json(path)


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated with a header; arrays are joined by commas, other columns left out."""
    arrays = {c for c, t in df.dtypes if t.startswith("array")}
    df.select(*[F.array_join(c, ",").alias(c) if c in arrays else c for c in columns]).write.option("sep", "\t").option("header", True).csv(path)


def write_change_log(df: DataFrame, path: str, keys: list[str], changes: str = "normalization_changes") -> None:
    """One line per row and rule with its count."""
    write_tsv(df.select(*keys, F.explode(changes).alias("rule", "count")), path, [*keys, "rule", "count"])


def write_release(df: DataFrame, path: str) -> None:
    """A CSV folder per split; an existing target is an error."""
    df.write.mode("errorifexists").option("header", True).partitionBy("split").csv(path)


def summary_json(df: DataFrame) -> str:
    """One-row summaries as indented JSON with sorted keys."""
    import json

    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    return json.dumps(rows[0].asDict(recursive=True), indent=2, sort_keys=True, ensure_ascii=False, default=str)


def write_texts(texts: DataFrame, folder: str, ending: str) -> DataFrame:
    """Writes (name, body) as files of their own into a shared folder; returns (name, bytes)."""
    folder = folder.removeprefix("file:")
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for name, body in zip(b["name"], b["body"], strict=True):
                data, target = body.encode("utf-8"), os.path.join(folder, f"{name}{ending}")
                _put(target, data)
                out.append((name, len(data)))
            yield pd.DataFrame(out, columns=["name", "bytes"])

    return texts.select("name", "body").mapInPandas(run, "name string, bytes long")


def _put(target: str, data: bytes) -> None:
    """Written beside and renamed, so that a task that runs twice leaves whole files."""
    with open(f"{target}.{os.getpid()}", "wb") as f:
        f.write(data)
    os.replace(f"{target}.{os.getpid()}", target)


def write_wav(clips: DataFrame, folder: str) -> DataFrame:
    """Writes (example_id, rate, samples) as 16-bit WAV files into a shared folder; returns (example_id, bytes)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for key, rate, samples in zip(b["example_id"], b["rate"], b["samples"], strict=True):
                pcm = np.rint(np.clip(np.asarray(samples, dtype=np.float64), -1, 32767 / 32768) * 32768).astype("<i2")
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(int(rate))
                    w.writeframes(pcm.tobytes())
                _put(os.path.join(folder, f"{key}.wav"), buffer.getvalue())
                out.append((key, len(buffer.getvalue())))
            yield pd.DataFrame(out, columns=["example_id", "bytes"])

    return clips.select("example_id", "rate", "samples").mapInPandas(run, "example_id string, bytes long")
