"""Per-position base counts of clusters, their profiles, error columns, and what is derived from them.

Reads with a null place or sequence have no bases, an empty sequence none either; a base other than A, C, G, T is in no count, so a column of
such bases alone has counts of 0. Repeated rows of a read are counted each, but err in a column once. Rows with a null cluster are
grouped by themselves and lost in joins. Empty tables give empty tables; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def bases(placed: DataFrame) -> DataFrame:
    """cluster_id, read_id, pos, base for each base of each placed read (cluster_id, read_id, loc, oseq)."""
    x = placed.where("length(oseq) > 0 and loc is not null").select("cluster_id", "read_id", "loc", "oseq", F.explode(F.sequence(F.lit(1), F.length("oseq"))).alias("j"))
    return x.select("cluster_id", "read_id", (F.col("loc") + F.col("j") - 1).alias("pos"), F.substring("oseq", F.col("j"), F.lit(1)).alias("base"))


def counts(b: DataFrame) -> DataFrame:
    """cluster_id, pos, cA, cC, cG, cT: partial sums before the shuffle."""
    return b.groupBy("cluster_id", "pos").agg(*(F.sum((F.col("base") == x).cast("int")).alias(f"c{x}") for x in dna.BASES))


def subtract(c: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts without those of the reads in gone (counts of the same shape); columns left empty go. One union and one group-by."""
    cols = [f"c{x}" for x in dna.BASES]
    minus = gone.select("cluster_id", "pos", *((-F.col(x)).alias(x) for x in cols))
    out = c.unionByName(minus).groupBy("cluster_id", "pos").agg(*(F.sum(x).alias(x) for x in cols))
    return out.where(sum(F.col(x) for x in cols) > 0)


def spans(c: DataFrame) -> DataFrame:
    """cluster_id, lo, hi: the columns from the first to the last that has a count."""
    return c.groupBy("cluster_id").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))


def profile(c: DataFrame, psi: float = 0.01) -> DataFrame:
    """counts with pA, pC, pG, pT, entropy and letter."""
    made = dna.column_profile(*(F.col(f"c{x}") for x in dna.BASES), psi=psi)
    return c.select("*", *(v.alias(k) for k, v in made.items()))


def carry_core(c: DataFrame, cores: DataFrame) -> DataFrame:
    """The rows inside each cluster's core [core_lo, core_hi): all that survives a round."""
    return c.join(cores.select("cluster_id", "core_lo", "core_hi"), "cluster_id").where((F.col("pos") >= F.col("core_lo")) & (F.col("pos") < F.col("core_hi"))).drop("core_lo", "core_hi")


def mismatches(b: DataFrame, p: DataFrame) -> DataFrame:
    """cluster_id, pos, read_id where a base is not its column's letter (ungapped errors)."""
    return b.join(p.select("cluster_id", "pos", "letter"), ["cluster_id", "pos"]).where(F.col("base") != F.col("letter")).select("cluster_id", "pos", "read_id")


def error_columns(errors: DataFrame, rare: int = 3) -> DataFrame:
    """cluster_id, pos, n_reads of the columns in which more than `rare` reads err."""
    return errors.groupBy("cluster_id", "pos").agg(F.countDistinct("read_id").alias("n_reads")).where(F.col("n_reads") > rare)


def column_similarity(errors: DataFrame, columns: DataFrame) -> DataFrame:
    """cluster_id, pos_i < pos_j, shared, v: reads that err in both columns of a cluster, and its logistic.

    Every pair of a cluster's error columns has a row, also those that share none. Each read brings the pairs of its
    own few error columns (a self-join on cluster and read); the zeros come from a self-join of the columns."""
    e = errors.join(columns.select("cluster_id", "pos"), ["cluster_id", "pos"]).distinct()
    a, b = e.alias("a"), e.alias("b")
    both = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.read_id") == F.col("b.read_id")) & (F.col("a.pos") < F.col("b.pos")))
    both = both.groupBy(F.col("a.cluster_id").alias("cluster_id"), F.col("a.pos").alias("pos_i"), F.col("b.pos").alias("pos_j")).agg(F.count("*").alias("shared"))
    c, d = columns.alias("c"), columns.alias("d")
    pairs = c.join(d, (F.col("c.cluster_id") == F.col("d.cluster_id")) & (F.col("c.pos") < F.col("d.pos"))).select(F.col("c.cluster_id").alias("cluster_id"), F.col("c.pos").alias("pos_i"), F.col("d.pos").alias("pos_j"))
    out = pairs.join(both, ["cluster_id", "pos_i", "pos_j"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumn("v", dna.logistic(F.col("shared").cast("double")))


def laplacian(similarity: DataFrame) -> DataFrame:
    """cluster_id, i, j, value of the normalised Laplacian: D / (D + 1) on the diagonal, -v / sqrt((D_i + 1)(D_j + 1)) off it."""
    s = similarity.select("cluster_id", "pos_i", "pos_j", "v")
    both = s.unionByName(s.select("cluster_id", F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), "v"))
    d = both.groupBy("cluster_id", "pos_i").agg(F.sum("v").alias("d"))
    di, dj = d.select("cluster_id", "pos_i", F.col("d").alias("d_i")), d.select("cluster_id", F.col("pos_i").alias("pos_j"), F.col("d").alias("d_j"))
    off = both.join(di, ["cluster_id", "pos_i"]).join(dj, ["cluster_id", "pos_j"]).select("cluster_id", F.col("pos_i").alias("i"), F.col("pos_j").alias("j"), (-F.col("v") / F.sqrt((F.col("d_i") + 1) * (F.col("d_j") + 1))).alias("value"))
    return off.unionByName(d.select("cluster_id", F.col("pos_i").alias("i"), F.col("pos_i").alias("j"), (F.col("d") / (F.col("d") + 1)).alias("value")))
