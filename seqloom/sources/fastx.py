"""FASTA and FASTQ through Spark's text reader: splittable files, exact record numbers, no driver-side reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (0-based), value.

    Inside a split, rows come in file order, so a line's number is its place in the split plus the lines of the splits
    before it. Only the splits' counts are gathered (one row for each split), and joined back."""
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = x.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    splits = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", before.alias("before"))
    return x.join(F.broadcast(splits), (x.file == splits.f) & (x.block == splits.b)).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def told_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record, part (0: name, 1: sequence), value of the lines that read_fastx() uses."""
    x = numbered_lines(spark, path)
    size = x.where("line = 0").select(F.col("file").alias("f"), F.when(F.startswith("value", F.lit("@")), 4).otherwise(2).alias("size"))
    x = x.join(F.broadcast(size), x.file == size.f)  # a row for each file
    part, record = F.col("line") % F.col("size"), F.floor(F.col("line") / F.col("size"))
    return x.where(part < 2).select("file", record.alias("record"), part.cast("int").alias("part"), F.regexp_replace("value", "\r$", "").alias("value"))


def in_pieces(lines: DataFrame, whole: bool) -> DataFrame:
    """file, record, name, seq of told_lines(): the records whose two lines follow each other in a task, or else the lines that are left, each with the other null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.RecordBatch] = []

        def put(t: pa.Table) -> Iterator[pa.RecordBatch]:
            part, record = t["part"].to_numpy(), t["record"].to_numpy()
            same = pc.equal(t["file"][:-1].combine_chunks(), t["file"][1:].combine_chunks()).to_numpy(zero_copy_only=False) if len(t) > 1 else np.zeros(0, bool)
            at = np.flatnonzero((part[:-1] == 0) & (part[1:] == 1) & (record[:-1] == record[1:]) & same.astype(bool))
            if whole:
                first = t.take(pa.array(at))
                out = [first["file"], first["record"], first["value"], t["value"].take(pa.array(at + 1))]
            else:
                left = np.ones(len(t), bool)
                left[at] = left[at + 1] = False
                t = t.filter(pa.array(left))
                name, none = pc.equal(t["part"], 0), pa.scalar(None, t.schema.field("value").type)
                out = [t["file"], t["record"], pc.if_else(name, t["value"], none), pc.if_else(name, none, t["value"])]
            yield from pa.table(out, ["file", "record", "name", "seq"]).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([*tail, b])
            tail = []
            if len(t) and t["part"][-1].as_py() == 0:  # its sequence may come with the next batch
                tail = t.slice(len(t) - 1).combine_chunks().to_batches()
                t = t.slice(0, len(t) - 1)
            yield from put(t)
        if tail:
            yield from put(pa.Table.from_batches(tail))

    return lines.mapInArrow(run, "file string, record long, name string, seq string")


def read_fastx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (0-based in its file), name, seq.

    A file whose first line begins with @ has records of four lines (the third and fourth, + and the qualities, are
    dropped), any other of two. The name loses its leading @ or >. Lines have no length limit; line ends may be \\n or \\r\\n.
    A record is put together where its lines lie; only those that the edge of a split cuts are shuffled."""
    lines = told_lines(spark, path)
    cut = in_pieces(lines, False).groupBy("file", "record").agg(F.max("name").alias("name"), F.max("seq").alias("seq"))
    g = in_pieces(lines, True).unionByName(cut)
    return g.where("name != '' or seq is not null").select("file", "record", F.regexp_replace("name", "^[@>]", "").alias("name"), F.coalesce("seq", F.lit("")).alias("seq"))


def in_one(records: DataFrame) -> DataFrame:
    """records of read_fastx() with record counted over all files, by the order of their names: a folder that Spark wrote reads as one file.

    Only each file's count is gathered and added up (a row for each file). An empty file has no records; no files, no rows."""
    n = records.groupBy("file").agg((F.max("record") + 1).alias("n"))
    before = n.select(F.col("file").alias("f"), (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))
    return records.join(F.broadcast(before), F.col("file") == F.col("f")).withColumn("record", F.col("record") + F.col("before")).drop("f", "before")


def read_store(spark: SparkSession, first: str, second: str | None = None) -> DataFrame:
    """read_id, mate, name, seq of comma-separated lists of files. File i of the second list pairs with file i of the first:
    read_id = 2 * pair + mate; without a second list it is the record's number. Pairs are numbered over the lists in order. A folder
    on a list counts as one file of all its parts."""
    lists = [x for x in (first, second) if x]
    files = [[f for f in x.split(",") if f] for x in lists]
    if len({len(x) for x in files}) != 1:
        raise ValueError("both lists need the same number of files")
    out, base = None, 0
    for group in zip(*files):
        counts = []
        for mate, f in enumerate(group):
            r = in_one(read_fastx(spark, f))
            counts.append(r.count())
            r = r.select(((F.col("record") + base) * len(lists) + mate).alias("read_id"), F.lit(mate).alias("mate"), "name", "seq")
            out = r if out is None else out.unionByName(r)
        if len(set(counts)) != 1:
            raise ValueError(f"paired files differ in their number of records: {group}")
        base += counts[0]
    return out
