"""Helpers shared by the corpus operators: durable tables, text columns, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the corpus contracts: space and the control characters tab to carriage return.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{WS}]+"

#: A side is broadcast only when its measured rows times this row width stay under the limit.
BROADCAST_BYTES = 32 << 20

_OWNED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or a temporary one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    own = getattr(spark.sparkContext, "_corpus_tmp", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext._corpus_tmp = "file://" + tempfile.mkdtemp(prefix="corpus-")
        _OWNED.add(own)
    return own


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone first; the folder belongs to this application alone
        pass


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder of this application in the shared folder; removed when the application ends."""
    home = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if home not in _OWNED:
        _OWNED.add(home)
        atexit.register(_forget, spark, home)
    return f"{home}/{label}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    _forget(spark, path)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only below BROADCAST_BYTES; otherwise Catalyst shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Rows of an Arrow batch at most: buffers of the JVM and of its Python workers stay small, whatever a partition holds.
ARROW_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ARROW_ROWS rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    name = base
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
