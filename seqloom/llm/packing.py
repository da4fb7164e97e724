"""Packing into optimal length buckets: dynamic programming over the global histogram, token-budget batches inside each bucket."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens, words


@dataclass(frozen=True)
class Params:
    """tokenizer: the file whose ids count as a text's length, plus `extra` (an end id). buckets: at most so many.
    budget: padded tokens of a batch; a single longer row is a batch of its own. segment: about so many rows are numbered together. stretch: at
    most so many rows of one id and length are written out by one task."""

    tokenizer: str
    buckets: int = 16
    budget: int = 65_536
    extra: int = 1
    segment: int = 100_000
    stretch: int = 10_000


def optimal_bounds(histogram: list[tuple[int, int]], k: int) -> list[int]:
    """At most k upper bounds, ascending, that minimise the sum of bound - length over all rows, where each length goes to the least bound that holds it.

    histogram: (length, rows). Exact, in integers: layer by layer, the best cut before each length is a lower envelope of
    lines (convex hull trick), so that the work is k times the distinct lengths."""
    h = sorted((n, c) for n, c in histogram if c > 0)
    if not h:
        return []
    d, g = len(h), [n for n, _ in h]
    count, total = [0], [0]
    for n, c in h:
        count.append(count[-1] + c)
        total.append(total[-1] + n * c)
    inf = None
    best: list[int | None] = [0] + [inf] * d
    back: list[array] = []
    for _ in range(min(k, d)):
        new: list[int | None] = [inf] * (d + 1)
        frm = array("q", bytes(8 * (d + 1)))
        hull: list[tuple[int, int, int]] = []  # slope, intercept, cut
        at = 0
        for j in range(1, d + 1):
            i = j - 1
            if best[i] is not inf:
                m, b = -count[i], best[i] + total[i]
                while len(hull) >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, i))
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = g[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            m, b, i = hull[at]
            new[j], frm[j] = m * x + b + x * count[j] - total[j], i
        back.append(frm)
        best = new
    # fewer bounds never pad less, so the last layer that reaches the end is the best one
    j, out = d, []
    for frm in reversed(back):
        out.append(g[j - 1])
        j = frm[j]
    return out[::-1]


def counted(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens: the length of each whole text; a null counts as an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(p.tokenizer)
        for whole in batches:
            for part in words.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(enc.count(part.column("text")) + p.extra)], ["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, docs.select(F.col(id_col).alias("id")).schema.add("n_tokens", "long"))


def pack(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: <id_col>, n_tokens, bucket, padded_len, batch_id, slot.

    bucket counts the DP's buckets from 0, padded_len is its bound, batch_id is unique over all buckets and has
    max(1, budget // padded_len) rows at most, slot is the place in the batch from 0. All batches but a bucket's last are full.
    Null and empty texts have length p.extra; null and repeated ids are rows like others. No rows: no rows. Extra columns are ignored.

    Texts are read once; ids and lengths are written out. The histogram (a row for each distinct
    length) is grouped and its DP runs on the driver. Rows of a bucket are numbered in segments by hash, of about p.segment rows, and the
    segments' offsets come from their counts, so that a bucket with a third of all rows is no task of its own. Rows of one id (or of
    none) and one length are one row with a count there, however many they are.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    lengths = common.materialize(counted(docs, p, id_col, text_col), "lengths")
    histogram = [(r[0], r[1]) for r in lengths.groupBy("n_tokens").count().collect()]
    bounds = optimal_bounds(histogram, p.buckets)
    held = [0] * len(bounds)
    for n, c in histogram:
        held[bisect_left(bounds, n)] += c
    bucket, bound, segments, rows, first = F.lit(0), F.lit(0), F.lit(1), F.lit(1), F.lit(0)
    batches = 0
    for i, b in enumerate(bounds):
        each = max(1, p.budget // max(b, 1))
        here = F.col("n_tokens") > (bounds[i - 1] if i else -1)
        bucket, bound, segments, rows, first = (F.when(here, v).otherwise(x) for v, x in ((i, bucket), (b, bound), (-(-held[i] // p.segment), segments), (each, rows), (batches, first)))
        batches += -(-held[i] // each)
    # equal rows are interchangeable: one row with a count stands for them until places are known
    x = lengths.groupBy("id", "n_tokens").agg(F.count("*").alias("copies"))
    x = x.select("id", "n_tokens", "copies", bucket.cast("int").alias("bucket"), bound.cast("long").alias("padded_len"), segments.cast("long").alias("segments"), rows.cast("long").alias("each"), first.cast("long").alias("first"))
    x = x.withColumn("segment", F.pmod(F.xxhash64("id", "n_tokens"), F.col("segments")))
    before = x.groupBy("bucket", "segment").agg(F.sum("copies").alias("rows"))
    before = before.select(F.col("bucket").alias("b"), F.col("segment").alias("s"), (F.sum("rows").over(W.partitionBy("bucket").orderBy("segment")) - F.col("rows")).alias("before"))
    own = W.partitionBy("bucket", "segment").orderBy("id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("n", F.sum("copies").over(own) - F.col("copies"))
    x = x.join(before, (x.bucket == before.b) & (x.segment == before.s))
    # in two steps, dealt anew between them: no task makes more than `stretch` rows out of one
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(p.stretch).cast("long"))).alias("at"))
    x = x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "n_tokens", "at")
    x = x.select("*", F.explode(F.sequence(F.col("at"), F.least(F.col("copies"), F.col("at") + p.stretch) - 1)).alias("copy")).withColumn("n", F.col("n") + F.col("before") + F.col("copy"))
    return x.select(F.col("id").alias(id_col), "n_tokens", "bucket", "padded_len", (F.col("first") + F.floor(F.col("n") / F.col("each"))).cast("long").alias("batch_id"), (F.col("n") % F.col("each")).cast("int").alias("slot"))
