"""Ownership of reads, failures and counters.

Attempts with a null read or cluster get nothing and are left out of the counts; a null correction never counts as equal to another. Repeated
attempts of a cluster that wins all win. Empty tables give empty tables, and counters of 0; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_claim(attempts: DataFrame) -> DataFrame:
    """attempts (read_id, cluster_id, corrected) with won and, for the rest, matched: whether they would have corrected alike.

    The lowest cluster wins, whatever order attempts come in: a grouped minimum and a join back on the read."""
    attempts = attempts.where("read_id is not null and cluster_id is not null")
    low = attempts.groupBy("read_id").agg(F.min("cluster_id").alias("owner"))
    x = attempts.join(low, "read_id").withColumn("won", F.col("cluster_id") == F.col("owner"))
    winner = x.where("won").groupBy("read_id").agg(F.max("corrected").alias("kept"))
    return x.join(winner, "read_id").select("read_id", "cluster_id", "won", F.coalesce(F.col("corrected") == F.col("kept"), F.lit(False)).alias("matched"))


def saturate(reports: DataFrame, limit: int = 3) -> DataFrame:
    """read_id, n: failures of each read, at most limit."""
    return reports.where("read_id is not null").groupBy("read_id").agg(F.least(F.count("*"), F.lit(limit)).cast("int").alias("n"))


def status(reads: DataFrame, claims: DataFrame) -> DataFrame:
    """read_id, status, seq: Corrected (claimed and changed), Assigned (claimed, unchanged) or empty (unclaimed), with the sequence to write."""
    x = reads.select("read_id", "seq").join(claims.select("read_id", "corrected"), "read_id", "left")
    s = F.when(F.col("corrected").isNull(), "").when(F.col("corrected") != F.col("seq"), "Corrected").otherwise("Assigned")
    return x.select("read_id", s.alias("status"), F.coalesce("corrected", "seq").alias("seq"))


def positions(claims: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, pos, kind, bases of each edit of each claim (read_id, rc, edits): the place in the read as sequenced, bases on the cluster's strand.

    Kinds are M, D and I. Claims without edits and claims of reads that are not in reads have no rows; repeated claims have theirs each."""
    x = claims.join(reads.select("read_id", F.length("seq").alias("len")), "read_id").select("read_id", "rc", "len", F.explode("edits").alias("e"))
    return x.select("read_id", F.when(F.col("rc"), F.col("len") - 1 - F.col("e.pos")).otherwise(F.col("e.pos")).alias("pos"), F.col("e.kind").alias("kind"), F.col("e.bases").alias("bases"))


def restore(originals: DataFrame, masked: DataFrame, corrected: DataFrame) -> DataFrame:
    """name, status, seq for each original read (read_id, name, seq): the corrected read if there is one; a read that masking
    dropped comes back as it was, with a null status; one that is in the masked set but unclaimed keeps the masked sequence."""
    m = masked.select("read_id", F.col("seq").alias("m_seq"))
    c = corrected.select("read_id", "status", F.col("seq").alias("c_seq"))
    x = originals.join(m, "read_id", "left").join(c, "read_id", "left")
    return x.select("read_id", "name", F.when(F.col("m_seq").isNotNull(), F.coalesce("status", F.lit(""))).alias("status"), F.coalesce("c_seq", "m_seq", "seq").alias("seq"))


def summary(attempts: DataFrame, claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row of counters: accepted, corrected, collided, bad_collided, n_sub, n_del, n_ins."""
    a = first_claim(attempts).agg(F.sum((~F.col("won")).cast("long")).alias("collided"), F.sum((~F.col("won") & ~F.col("matched")).cast("long")).alias("bad_collided"))
    c = claims.agg(F.count("*").alias("accepted"), F.sum((F.col("corrected") != F.col("seq")).cast("long")).alias("corrected"))
    e = corrections.agg(*(F.sum((F.col("kind") == k).cast("long")).alias(n) for n, k in (("n_sub", "M"), ("n_del", "D"), ("n_ins", "I"))))
    one = F.lit(1).alias("one")
    joined = c.select("*", one).join(a.select("*", one), "one").join(e.select("*", one), "one").drop("one")
    return joined.select(*(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("accepted", "corrected", "collided", "bad_collided", "n_sub", "n_del", "n_ins")))


def summary_of(attempts: DataFrame, claims: DataFrame, reads: DataFrame, corrections: DataFrame) -> DataFrame:
    """summary() of a run over several rounds: attempts (read_id, cluster_id, corrected, won), claims (read_id, corrected), reads
    (read_id, seq), corrections (kind). Empty tables count as zeros."""
    kept = claims.select("read_id", F.col("corrected").alias("kept"))
    lost = attempts.where("not won").join(kept, "read_id")
    a = lost.agg(F.count("*").alias("collided"), F.sum((F.col("corrected") != F.col("kept")).cast("long")).alias("bad_collided"))
    changed = (F.col("kept") != F.col("seq")).cast("long")
    c = kept.join(reads, "read_id").agg(F.count("*").alias("accepted"), F.sum(changed).alias("corrected"))
    e = corrections.agg(*(F.sum((F.col("kind") == k).cast("long")).alias(n) for n, k in (("n_sub", "M"), ("n_del", "D"), ("n_ins", "I"))))
    one = F.lit(1).alias("one")
    joined = c.select("*", one).join(a.select("*", one), "one").join(e.select("*", one), "one")
    return joined.select(*(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("accepted", "corrected", "collided", "bad_collided", "n_sub", "n_del", "n_ins")))
