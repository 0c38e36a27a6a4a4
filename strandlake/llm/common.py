"""Helpers that the corpus operators share: tables, scratch space and word patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``; only where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="strandlake-")
        root = _own[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, and tells Spark the size,
    so that it broadcasts the table in a join only where the bytes on disk are below its own threshold."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts(spark: SparkSession) -> int:
    """The number of groups to deal data into: the cluster's shuffle partitions, which are set in proportion to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of texts that go to Python at once; Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch, so that rows of long texts do not fill a worker; a lower
    limit that the user gives as a number of bytes stays. What a batch holds does not change any result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower().rstrip("b")
    if not size.lstrip("-").isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def handed_back() -> None:
    """At the end of a task's work in Python: free memory goes back to the system, since workers wait for further tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
