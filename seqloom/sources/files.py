"""The pipeline's own text files, read with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fastx


def read_kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    """kmer, n of lines "KMER count"; rows whose k-mer is not of A, C, G, T are rejected, a count that is no number is null."""
    x = spark.read.text(path).where(F.col("value").rlike("^[ACGTacgt]+( |$)"))
    end = F.instr("value", " ")
    count = F.substring_index(F.substring("value", end + 1, F.length("value")), " ", 1).try_cast("long")
    return x.select(F.substring_index("value", " ", 1).alias("kmer"), F.when(end > 0, count).alias("n"))


def read_masked(spark: SparkSession, path: str) -> DataFrame:
    """read_id, seq of a masked FASTA; gaps in the ids are dropped reads."""
    return fastx.read_fastx(spark, path).select(F.col("name").cast("long").alias("read_id"), "seq")


def read_corrected(spark: SparkSession, path: str) -> DataFrame:
    """read_id, status, seq of a corrected FASTA; the status is what follows < in the name."""
    x = fastx.read_fastx(spark, path)
    return x.select(F.regexp_extract("name", r"^(-?\d+)", 1).cast("long").alias("read_id"), F.regexp_extract("name", "<(.*)$", 1).alias("status"), "seq")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """read_id, one per line; lines that are no number are passed over."""
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("read_id")).where("read_id is not null")
