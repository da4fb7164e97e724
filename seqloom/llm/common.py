"""Helpers shared by the operators: the shared folder, materialised steps, table access."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_mine: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session (one machine, tests)
    uses its warehouse folder, which it creates itself anyway; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/steps"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends, or with drop()."""
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex[:12]}/{name}"
    _mine.append((spark, path.rpartition("/")[0]))
    return path


def write(df: DataFrame, name: str) -> str:
    """Writes df as Parquet to a fresh path (cuts lineage; survives lost executors) and returns the path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, folder in _mine:
        try:
            drop(spark, f"{folder}/x")
        except Exception:  # noqa: BLE001  the session may be gone already; nothing is lost but disk
            return


#: Bytes of an Arrow batch between Spark and Python, unless the session sets its own: rows alone bound nothing when texts are long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes unless the application was configured with a bound of its own."""
    key, value = BATCH_BYTES
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, or wanted with underscores if a column has that name already (case is ignored)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def crc_mod(col: str, mod: int) -> F.Column:
    """crc32 of a column as text, modulo mod; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
