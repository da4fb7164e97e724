"""Gathering reads for clusters over the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from . import kmers


def hits(cores: DataFrame, posts: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """cluster_id, read_id, k_end, loc, rc for each k-mer that a core (cluster_id, core) shares with a read.

    k_end: the k-mer's end in the core. loc: where the read's first base lies relative to the core's, after turning the
    read if rc. A column `at`, if cores has one, is where the core's text begins, and is added to both. Equi-joins on k-mer and read id only.
    Null and short cores have no hits; repeated cores give repeated hits; empty tables give none."""
    keep = ("at",) if "at" in cores.columns else ()
    probe = kmers.windows(cores.select(F.col("cluster_id").alias("read_id"), F.col("core").alias("seq"), *keep), k, keep)
    base = F.col("at") if keep else F.lit(0)
    probe = probe.select(F.col("read_id").alias("cluster_id"), (F.col("end") + base).alias("k_end"), "kmer", F.col("forward").alias("core_forward"))
    lengths = reads.select("read_id", F.length("seq").alias("len"))
    x = probe.join(posts, "kmer").join(lengths, "read_id")
    e = F.abs("spos") - 1
    same = F.col("core_forward") == (F.col("spos") > 0)
    loc = F.when(same, F.col("k_end") - e).otherwise(F.col("k_end") - (k - 1) - (F.col("len") - e - 1))
    return x.select("cluster_id", "read_id", "k_end", loc.cast("int").alias("loc"), (~same).alias("rc"), "len")


def overhang(h: DataFrame, core_len: F.Column) -> DataFrame:
    """Hits of reads that stick out of the core; all of them while the core is empty."""
    return h.where((F.col("loc") < 0) | (F.col("loc") + F.col("len") > core_len))


def first_hits(h: DataFrame) -> DataFrame:
    """One row per cluster and read: its first hit (by place in the core) and multi, its number of hits from then on."""
    # place, loc and strand as one integer, so that the minimum is a hash aggregate without a sort
    code = F.col("k_end").cast("long") * (1 << 33) + (F.col("loc").cast("long") + (1 << 31)) * 2 + F.col("rc").cast("long")
    g = h.groupBy("cluster_id", "read_id").agg(F.min(code).alias("x"), F.count("*").cast("int").alias("multi"))
    rest = F.pmod(F.col("x"), F.lit(1 << 33))
    return g.select("cluster_id", "read_id", (F.floor(rest / 2) - (1 << 31)).cast("int").alias("loc"), (rest % 2 == 1).alias("rc"), "multi")


def first_places(places: DataFrame) -> DataFrame:
    """first_hits() of places: rows cluster_id, read_id, loc, rc with k_end, the first hit there, and n, the number of hits there."""
    code = F.col("k_end").cast("long") * (1 << 33) + (F.col("loc").cast("long") + (1 << 31)) * 2 + F.col("rc").cast("long")
    g = places.groupBy("cluster_id", "read_id").agg(F.min(code).alias("x"), F.sum("n").cast("int").alias("multi"))
    rest = F.pmod(F.col("x"), F.lit(1 << 33))
    return g.select("cluster_id", "read_id", (F.floor(rest / 2) - (1 << 31)).cast("int").alias("loc"), (rest % 2 == 1).alias("rc"), "multi")


def anchors(kept: DataFrame, gone: DataFrame) -> DataFrame:
    """cluster_id, anchor of each cluster that lost reads (gone: cluster_id, read_id) and has others left (kept: cluster_id, read_id, loc): the largest start of those."""
    thinned = gone.select("cluster_id").distinct()
    return kept.join(thinned, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.max("loc").alias("anchor"))


def anchored(live: DataFrame, kept: DataFrame, gone: DataFrame) -> DataFrame:
    """live (cluster_id, core_lo, core_hi and more) where a cluster without a core that lost reads begins at its anchor. Places stay as they
    are: taking the anchor for 0 and moving them all would give the same columns."""
    x = live.join(anchors(kept, gone), "cluster_id", "left")
    at = F.when(F.col("core_lo") == F.col("core_hi"), F.coalesce("anchor", "core_lo"))
    return x.withColumns({"core_lo": F.coalesce(at, "core_lo"), "core_hi": F.coalesce(at, "core_hi")}).drop("anchor")


def moved(rows: DataFrame, anchors: DataFrame, column: str) -> DataFrame:
    """rows (cluster_id and a column of places) with their clusters' anchors taken for 0; clusters without one stay as they are."""
    x = rows.join(anchors, "cluster_id", "left")
    return x.withColumn(column, (F.col(column) - F.coalesce("anchor", F.lit(0))).cast(rows.schema[column].dataType)).drop("anchor")


def spliced(live: DataFrame, columns: DataFrame) -> DataFrame:
    """cluster_id, core_lo, core_hi, core, old_lo, old_hi: each core (live: cluster_id, core_lo, core_hi, core) with the letters of the columns (cluster_id, pos, letter)
    that were added before and after it. A cluster without new columns stays as it is."""
    new = columns.groupBy("cluster_id").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("x"))
    side = lambda c: F.coalesce(F.array_join(F.transform(F.filter("x", c), lambda s: s["letter"]), ""), F.lit(""))
    text = F.concat(side(lambda s: s["pos"] < F.col("core_lo")), F.coalesce("core", F.lit("")), side(lambda s: s["pos"] >= F.col("core_hi")))
    # the text first: beside the new core_lo, a lambda's core_lo would be that one
    return live.join(new, "cluster_id", "left").withColumn("text", text).select(
        "cluster_id", F.coalesce(F.least("core_lo", "lo"), "core_lo").cast("int").alias("core_lo"), F.coalesce(F.greatest("core_hi", "hi"), "core_hi").cast("int").alias("core_hi"),
        F.col("text").alias("core"), F.col("core_lo").alias("old_lo"), F.col("core_hi").alias("old_hi"),
    )


def usable(h: DataFrame, claims: DataFrame, failures: DataFrame, failure_limit: int = 3, reuse: bool = True, strict: bool = False) -> DataFrame:
    """Hits of reads that a cluster may use. With reuse, a read below the failure limit may be used unless this very
    cluster owns it; any other read only while nobody owns it (strict also turns down reads past the limit)."""
    x = h.join(claims.select("read_id", F.col("cluster_id").alias("owner")), "read_id", "left").join(failures.select("read_id", F.col("n").alias("failed")), "read_id", "left")
    below = (F.coalesce("failed", F.lit(0)) < failure_limit) & F.lit(reuse)
    free = F.col("owner").isNull() & (~F.lit(strict) | (F.coalesce("failed", F.lit(0)) < failure_limit))
    ok = F.when(below, F.col("owner").isNull() | (F.col("owner") != F.col("cluster_id"))).otherwise(free)
    return x.where(ok).drop("owner", "failed")


def oriented(gathered: DataFrame, reads: DataFrame) -> DataFrame:
    """gathered with oseq, the read turned to the core's strand."""
    s = F.col("seq")
    return gathered.join(reads.select("read_id", "seq"), "read_id").withColumn("oseq", F.when(F.col("rc"), dna.revcomp(s)).otherwise(s)).drop("seq")


def retrieval_counts(gathered: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, n: how often each read was gathered, 0 included."""
    n = gathered.groupBy("read_id").agg(F.count("*").alias("n"))
    return reads.select("read_id").join(n, "read_id", "left").select("read_id", F.coalesce("n", F.lit(0)).alias("n"))


def core_prefix(profile: DataFrame, limit: float, start: F.Column, right: bool) -> DataFrame:
    """The columns that extend a core: from start on to the right (or from start - 1 on to the left) without a gap, up to
    the first whose entropy is over the limit. profile: cluster_id, pos, entropy and more. The window is a cluster's columns."""
    side = profile.where(F.col("pos") >= start) if right else profile.where(F.col("pos") < start)
    step = F.col("pos") - start if right else start - 1 - F.col("pos")
    w = W.partitionBy("cluster_id").orderBy("step")
    x = side.withColumn("step", step).withColumn("bad", F.max((F.col("entropy") > limit).cast("int")).over(w)).withColumn("nth", F.row_number().over(w))
    return x.where((F.col("bad") == 0) & (F.col("nth") == F.col("step") + 1)).drop("bad", "nth", "step")


def extension(profile: DataFrame, limit: float) -> DataFrame:
    """core_prefix() to both sides of [core_lo, core_hi) at once, which profile has in each row: one window over a cluster's sides."""
    right = F.col("pos") >= F.col("core_hi")
    x = profile.where(right | (F.col("pos") < F.col("core_lo"))).withColumn("right", right)
    x = x.withColumn("step", F.when(F.col("right"), F.col("pos") - F.col("core_hi")).otherwise(F.col("core_lo") - 1 - F.col("pos")))
    w = W.partitionBy("cluster_id", "right").orderBy("step")
    x = x.withColumn("bad", F.max((F.col("entropy") > limit).cast("int")).over(w)).withColumn("nth", F.row_number().over(w))
    return x.where((F.col("bad") == 0) & (F.col("nth") == F.col("step") + 1)).drop("bad", "nth", "step", "right")
