"""What the operators of this subpackage share: tables, scratch storage, word hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Stands for a null id in keys; nulls count as the smallest id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where the input is fewer files than there are cores (a
    file of one row group is one task's work, however it is split)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    small = df.rdd.getNumPartitions() <= 4 * n and len(df.inputFiles()) < n
    return df.repartition(n) if small else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where none is named, a local master (tests, one machine) gets a temporary
    folder; on a cluster that would be another folder on every machine, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        named = f"file://{tempfile.gettempdir()}/skein-checkpoints"
    return named.rstrip("/")


#: Folders of the tables written and not dropped yet.
_tables: list = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the
    lineage, survives the loss of executors, and is computed once. The table goes
    when `drop` or `kept_only` say so, or when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _drop(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)
    _tables.remove(path)


def drop(*frames: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in frames:
        if (path := getattr(df, "_written_at", None)) in _tables:
            _drop(df.sparkSession, path)


@contextmanager
def kept_only(spark: SparkSession):
    """Deletes, at the end of a block, every table written in it but those the
    block appends to the list it gets. For blocks that write all they return."""
    before, kept = set(_tables), []
    yield kept
    stay = before | {getattr(df, "_written_at", None) for df in kept}
    for path in [p for p in _tables if p not in stay]:
        _drop(spark, path)


def shielded(df: DataFrame, kept: tuple = ()):
    """(df, restore): columns that begin like the operators' own (two low lines), but
    for those kept, go by other names until restore gives them their names back."""
    names: dict = {}
    for c in df.columns:
        if c.startswith("__") and c not in kept:
            other = f"in{c}"
            while other.lower() in {x.lower() for x in (*df.columns, *names.values())}:
                other = f"in_{other}"
            names[c] = other
    return df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(__id, __th): what tells rows apart. Repeated rows share a key and so a
    result; rows that share an id but not a text do not."""
    return [
        F.coalesce(df[id_col].cast("long"), F.lit(NULL_ID)).alias("__id"),
        F.xxhash64(df[text_col]).alias("__th"),
    ]


def hash_words(words: list) -> np.ndarray:
    """64-bit hashes of bytes or str, the same in every process."""
    if not words:
        return np.empty(0, U64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lets no Arrow batch of the session hold more than `size` bytes, unless one row does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def release() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(scan):
    """A function over Arrow batches that leaves its worker small when it ends."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            release()

    return run


def texts_of(column) -> list:
    """Arrow string column to a list of bytes or None."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
