"""Correction without gaps: reads against their columns' letters, as joins and grouped sums.

Bases whose column the profile lacks, and rows with a null cluster, are left out; a base other than A, C, G, T has no probability and stays as it
is. Rows of a read that repeat are one read of that many more bases. Empty tables give empty tables; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pileup


def compared(b: DataFrame, p: DataFrame, delta: float = 0.1) -> DataFrame:
    """Each placed base with its column: base, letter, its log probability, and fixed: the letter where the base is at most as probable as the letter less delta."""
    x = b.join(p.select("cluster_id", "pos", "letter", "pA", "pC", "pG", "pT"), ["cluster_id", "pos"])

    def of(base):
        return F.when(base == "A", F.col("pA")).when(base == "C", F.col("pC")).when(base == "G", F.col("pG")).when(base == "T", F.col("pT"))

    change = (F.col("base") != F.col("letter")) & (of(F.col("base")) <= of(F.col("letter")) - delta)
    return x.select("cluster_id", "read_id", "pos", "base", "letter", change.alias("change"), F.when(change, F.col("letter")).otherwise(F.col("base")).alias("fixed"), F.log(of(F.col("base"))).alias("lp"))


def attempts(cmp: DataFrame, limit: int = 5, llh: float = -1.0) -> DataFrame:
    """cluster_id, read_id, n_sub, llh (mean log probability), corrected (on the core's strand) of the reads that stay under the limits."""
    g = cmp.groupBy("cluster_id", "read_id").agg(
        F.sum(F.col("change").cast("int")).cast("int").alias("n_sub"), (F.sum(F.round("lp", 9).cast("decimal(20,9)")).cast("double") / F.count("*")).alias("llh"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fixed"))), lambda s: s["fixed"]), "").alias("corrected"),
    )
    return g.where((F.col("n_sub") < limit) & (F.col("llh") > llh))


def error_caps(errors: DataFrame, cores: DataFrame, max_core: int = 5, max_all: int = 10) -> DataFrame:
    """cluster_id, read_id, n_core, n_all, dropped: errors of each read that has any, inside the core and overall, against the caps."""
    x = errors.join(cores.select("cluster_id", "core_lo", "core_hi"), "cluster_id")
    inside = (F.col("pos") >= F.col("core_lo")) & (F.col("pos") < F.col("core_hi"))
    g = x.groupBy("cluster_id", "read_id").agg(F.sum(inside.cast("int")).cast("int").alias("n_core"), F.count("*").cast("int").alias("n_all"))
    return g.withColumn("dropped", (F.col("n_core") > max_core) | (F.col("n_all") >= max_all))


def positions(cmp: DataFrame, wins: DataFrame, gathered: DataFrame, length: int | None = None) -> DataFrame:
    """read_id, pos, kind M, bases for each substitution of a read's owner: place in the read as sequenced; bases on the core's strand, as the format has them."""
    w = wins.where("won").select("read_id", "cluster_id")
    g = gathered.select("cluster_id", "read_id", "loc", "rc", F.length("oseq").alias("len"))
    x = cmp.where("change").join(w, ["cluster_id", "read_id"]).join(g, ["cluster_id", "read_id"])
    at = F.col("pos") - F.col("loc")
    return x.select("read_id", F.when(F.col("rc"), F.col("len") - 1 - at).otherwise(at).cast("int").alias("pos"), F.lit("M").alias("kind"), F.concat("base", "fixed").alias("bases"))
