"""Importance resampling towards a target: hashed word features, log ratios of smoothed bucket shares, a draw without replacement by Gumbel keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Params:
    """buckets: features are hashed into so many. longest: features are runs of 1 to so many words. Of the documents with at least
    least_words words, drawn of out_of are drawn. seed: of the draw. range_rows: ranks are
    numbered in as many ranges as Spark has shuffle partitions, more if they would have over so many rows."""

    buckets: int = 10_000
    longest: int = 1
    least_words: int = 20
    drawn: int = 10
    out_of: int = 100
    seed: int = 2024
    range_rows: int = 500_000


#: What lies between words, after A-Z are lower-cased: ASCII but for digits and letters. All else belongs to words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucketed(rows: DataFrame, p: Params, text_col: str, *keep: Column) -> DataFrame:
    """The columns of keep, n_words, and buckets: the bucket of each feature of each whole text, repeats included. A null text has none.

    All by array functions: no row is multiplied."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    x = rows.select(*keep, F.filter(F.split(text, GAPS), lambda w: w != "").alias("w1"))
    for k in range(2, p.longest + 1):
        # runs of k words are runs of k - 1 words, each with the word that follows
        follow = F.slice("w1", k, F.greatest(F.size("w1") - (k - 1), F.lit(0)))
        x = x.withColumn(f"w{k}", F.filter(F.zip_with(f"w{k - 1}", follow, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull()))
    features = F.concat(*(F.col(f"w{k}") for k in range(1, p.longest + 1))) if p.longest > 1 else F.col("w1")
    own = [c for c in x.columns if c not in {f"w{k}" for k in range(1, p.longest + 1)}]
    return x.select(*own, F.size("w1").alias("n_words"), F.transform(features, lambda g: (F.crc32(g.cast("binary")) % p.buckets).cast("int")).alias("buckets"))


def totals(rows: DataFrame, p: Params) -> list[int]:
    """How many features lie in each bucket. Counts are added up in each task before they meet: at most a row a bucket leaves it."""
    out = [0] * p.buckets
    for b, n in rows.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():
        out[b] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log of each bucket's share of the target over its share of the source, each with one added to its count."""
    s, t, n = float(sum(source)), float(sum(target)), float(len(source))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source, target)]


def numbers(values: list[int]) -> Column:
    """A constant array; one text in the plan, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def resample(docs: DataFrame, target: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of docs: <id_col>, n_features, weight, score, rank (1, 2, ... by falling score, ties to the smaller id; null if not drawn).

    weight is the sum of the features' gains, score adds Gumbel noise that depends on seed and id alone, so a draw repeats. A null text
    has no features and weight 0. A null id counts as an empty text in the noise and comes last among ties; rows of one id share
    their noise and are drawn each on its own; equal rows have following ranks. An empty target has equal shares. No rows: no rows. Extra columns are ignored.

    Texts are read once: what is written out and read again are bucket numbers. Scores come from an array function over them and a
    constant array of gains; only totals by bucket are shuffled for that. Ranks: rows (ids and numbers) are dealt by ranges of score and id, so that
    no score, however frequent, is one task's; each range's rows are numbered and moved by the sizes of the ranges before."""
    spark = docs.sparkSession
    rows = common.materialize(bucketed(docs, p, text_col, F.col(id_col).alias("id")), "buckets")
    gain = numbers(gains(totals(rows, p), totals(bucketed(target, p, target_text), p)))
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + F.element_at(gain, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    x = rows.select("id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"), noise.cast("bigint").alias("noise"))
    x = common.materialize(x.select("id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")), "scored")
    eligible = x.where(F.col("n_words") >= p.least_words)
    order = F.col("score").desc(), F.col("id").asc_nulls_last()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-eligible.count() // p.range_rows))
    ranged = eligible.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = common.materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "ranged")
    sizes = dict(ranged.groupBy("part").agg(F.count("*")).collect())
    take = sum(sizes.values()) * p.drawn // p.out_of
    before, at = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(i, 0)
    place = F.element_at(numbers(before), F.col("part") + 1) + F.col("nth") + 1 if before else F.lit(None).cast("bigint")
    columns = F.col("id").alias(id_col), "n_features", "weight", "score"
    drawn = ranged.select(*columns, F.when(place <= take, place).alias("rank"))
    return drawn.unionByName(x.where(F.col("n_words") < p.least_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))
