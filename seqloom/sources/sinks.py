"""Text outputs, written by Spark's committed writers; where a format has an order, rows are range-partitioned by it first."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna


_mine: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session (one machine, tests)
    uses its warehouse folder; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/steps"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes with drop(), or when the driver ends."""
    folder = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex[:12]}"
    _mine.append((spark, folder))
    return f"{folder}/{name}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file system, whichever store holds it."""
    folder = path.rpartition("/")[0]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if (spark, folder) in _mine:
        _mine.remove((spark, folder))


@atexit.register
def _tidy() -> None:
    for spark, folder in list(_mine):
        try:
            drop(spark, f"{folder}/x")
        except Exception:  # noqa: BLE001  the session may be gone already; nothing is lost but disk
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later steps read it instead of computing it again, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_fasta(df: DataFrame, path: str) -> None:
    """name, seq."""
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(path)


def write_fastq(df: DataFrame, path: str, key: str) -> None:
    """name, seq in the order of key (which is not written), each base of quality I. A null sequence is written as an empty one."""
    seq = F.coalesce("seq", F.lit(""))
    df.orderBy(key).select(F.concat(F.lit("@"), "name", F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq)))).write.text(path)


def write_masked(df: DataFrame, path: str) -> None:
    """read_id, seq in id order."""
    write_fasta(df.orderBy("read_id").select(F.col("read_id").cast("string").alias("name"), "seq"), path)


def write_corrected(status: DataFrame, path: str) -> None:
    """read_id, status, seq: >id<Corrected, >id<Assigned or >id, in id order."""
    name = F.concat(F.col("read_id").cast("string"), F.when(F.col("status") != "", F.concat(F.lit("<"), "status")).otherwise(""))
    write_fasta(status.orderBy("read_id").select(name.alias("name"), "seq"), path)


def write_restored(restored: DataFrame, path: str) -> None:
    """name, status, seq: >name status; without the blank for reads that masking had dropped (null status)."""
    write_fasta(restored.orderBy("read_id").select(F.concat("name", F.coalesce(F.concat(F.lit(" "), "status"), F.lit(""))).alias("name"), "seq"), path)


def write_kmer_counts(counts: DataFrame, path: str, compression: str = "none") -> None:
    counts.select(F.concat_ws(" ", "kmer", "n")).write.text(path, compression=compression)


def contig_columns(columns: DataFrame, cap: int = 200) -> DataFrame:
    """cluster_id, cols: the first cap columns of each contig as structs (pos, cA, cC, cG, cT, entropy)."""
    cols = F.array_sort(F.collect_list(F.struct("pos", *(f"c{b}" for b in dna.BASES), "entropy")))
    return columns.groupBy("cluster_id").agg(F.slice(cols, 1, cap).alias("cols"))


def write_contigs(contigs: DataFrame, path: str) -> None:
    """core, n_reads, cols: length, core, reads, then counts and entropy of each column, separated by tabs."""
    flat = F.flatten(F.transform("cols", lambda c: F.array(*(c[f"c{b}"].cast("string") for b in dna.BASES), c["entropy"].cast("string"))))
    contigs.select(F.concat_ws("\t", F.length("core"), "core", "n_reads", flat)).write.text(path)


def write_corrections(corrections: DataFrame, path: str) -> None:
    """read_id, pos, kind, bases."""
    corrections.orderBy("read_id", "pos").select(F.concat_ws("\t", "read_id", "pos", "kind", "bases")).write.text(path)


def write_retrievals(counts: DataFrame, path: str) -> None:
    counts.orderBy("read_id").select(F.concat_ws(" ", "read_id", "n")).write.text(path)
