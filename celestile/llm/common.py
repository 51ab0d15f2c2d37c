"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_SCRATCH: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that leaves it unset gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="celestile-")
    return _OWN_DIR[app]


def _scratch(spark: SparkSession) -> str:
    """The application's folder for tables between steps, deleted when its driver ends."""
    path = f"{shared_dir(spark)}/celestile/{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
        _SCRATCH.add(path)
    return path


def save(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to ``path``, or the shared folder, and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    own = path is None
    path = path or f"{_scratch(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if own:
        out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that save() wrote to the shared folder once no later step reads them."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def unit_hash(*cols) -> Column:
    """A hash of the columns as a double in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (bits + F.lit(0.5)) * F.lit(2.0**-53)


def blank_text(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at the end of a task the worker, which lives on, gives its free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, **options)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than GNU's
        pass
