"""Shared helpers of the training-data operators: tables, shared folder, words.

A *word* is a maximal run of bytes other than space and 0x09-0x0D; that is what
``bytes.split()`` yields, so the Python paths work on UTF-8 bytes.
Private columns start with ``__gw_`` and so cannot clash with extra input columns.
"""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a side that is broadcast; beyond it, operators shuffle instead.
BROADCAST_ROWS = 2_000_000

#: Rows of a batch that Python gets while a table is written; Spark's own 10,000 whole texts take some 150 MB more of each worker.
BATCH_ROWS = 1000

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def ship(name: str) -> None:
    """Send the functions of module `name` to executors by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="glyphward-"))
    return _own_dir[0]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back; executors may be lost after that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gw-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what materialize() has written; results that still read it must be written out before."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
            return


atexit.register(release)


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if counting shows at most `most` (narrow) rows, else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def wider(df: DataFrame, **fields: str) -> T.StructType:
    """df's schema with more fields at the end."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(kind)) for n, kind in fields.items())])
