"""Session helpers: shipping the package to executors and cutting lineage reliably."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, whatever their working folder.

    The archive is served by the driver to every executor, those started later included.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(suffix=".zip", prefix="parlance-")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder, as in tests; on a cluster that is an error, since
    executors would write to folders of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="parlance-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which an execution removes its own shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, and the shuffle files that led to the rows are gone: nothing reads them again."""
    spark = df.sparkSession
    shared_folder(spark)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        # the setting counts for plans made under it
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, was)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0):
            yield from pa.ipc.open_stream(x.as_buffer())


def packed(df: DataFrame) -> DataFrame:
    """Like ``settled``, the rows kept as compressed Arrow batches, in their order: texts take a quarter of the disk."""
    return settled(df.mapInArrow(_pack, "packed binary")).mapInArrow(_unpack, df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Partitions for work that is costly for its bytes: all cores, and as many as the session shuffles into."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
