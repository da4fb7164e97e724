"""Removal of outlier reads by spectral clustering of columns in which the same reads err."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import Params


def pivoted_qr(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, pivots) of Householder QR with column pivoting: each step takes the column of the largest remaining norm."""
    r = x.astype(float).copy()
    rows, cols = r.shape
    piv = np.arange(cols)
    for k in range(min(rows, cols)):
        j = k + int(np.argmax((r[k:, k:] ** 2).sum(0)))
        r[:, [k, j]], piv[[k, j]] = r[:, [j, k]], piv[[j, k]]
        v = r[k:, k].copy()
        norm = np.linalg.norm(v)
        if norm > 0:
            v[0] += norm if v[0] >= 0 else -norm
            v /= np.linalg.norm(v)
            r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
    return r, piv


def column_groups(shared: np.ndarray) -> list[list[int]]:
    """Groups of error columns. shared: how many reads err in both of two columns.

    Normalised Laplacian of the logistic similarities, as many eigenvectors as stand before the largest gap, then
    assignment to the columns that pivoted QR picks, where the coefficient exceeds one half."""
    size = len(shared)
    v = 1 / (1 + np.exp(3 - shared.astype(float)))
    np.fill_diagonal(v, 0)
    d = v.sum(1) + 1
    lap = -v / np.sqrt(np.outer(d, d))
    np.fill_diagonal(lap, (d - 1) / d)
    w, e = np.linalg.eigh(lap)
    n = int(np.argmax(np.diff(w))) + 1
    r, piv = pivoted_qr(e[:, :n].T)
    groups = [[int(c)] for c in piv[:n]]
    r11 = r[:, :n]
    for k in range(n, size):
        t = np.abs(np.linalg.lstsq(r11, r[:, k], rcond=None)[0])
        if t.max() > 0.5:
            groups[int(t.argmax())].append(int(piv[k]))
    return [sorted(g) for g in groups]


def capped(aligned: DataFrame, cores: DataFrame, spans: DataFrame, p: Params = Params()) -> DataFrame:
    """cluster_id, read_id, pos, n_core, n_all, dropped: the error steps of each read that count, with the read's totals.

    aligned: cluster_id, read_id, errors (positions in the read's order, with repeats); spans (cluster_id, lo, hi): the columns that
    reads or the core cover. A step outside the span does not count. A path is walked from the read's end; the step that
    makes more than max_core_errors inside the core ends it, and what comes after is not looked at. dropped: that happened, or
    max_pre_corrected_errors or more steps counted. Reads without errors, null errors and clusters without a span have no rows."""
    steps = aligned.select("cluster_id", "read_id", F.posexplode(F.reverse("errors")).alias("step", "pos")).join(spans.select("cluster_id", "lo", "hi"), "cluster_id")
    steps = steps.where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).join(cores.select("cluster_id", "core_lo", "core_hi"), "cluster_id", "left")
    inside = F.coalesce((F.col("pos") >= F.col("core_lo")) & (F.col("pos") < F.col("core_hi")), F.lit(False)).cast("int")
    read = W.partitionBy("cluster_id", "read_id")
    steps = steps.withColumn("n_core", F.sum(inside).over(read.orderBy("step")))
    over = F.max("n_core").over(read) > p.max_core_errors
    n_all = F.sum((F.col("n_core") <= p.max_core_errors).cast("int")).over(read)
    x = steps.select("cluster_id", "read_id", "pos", "n_core", F.least(F.max("n_core").over(read), F.lit(p.max_core_errors + 1)).cast("int").alias("core_total"), n_all.cast("int").alias("n_all"), over.alias("over"))
    x = x.withColumn("dropped", F.col("over") | (F.col("n_all") >= p.max_pre_corrected_errors))
    return x.select("cluster_id", "read_id", F.when(F.col("n_core") <= p.max_core_errors, F.col("pos")).alias("pos"), F.col("core_total").alias("n_core"), "n_all", "dropped")


def grouped_columns(similarity: DataFrame) -> DataFrame:
    """cluster_id, pos, grp, size: the groups of two and more of each cluster's error columns. similarity: cluster_id, pos_i, pos_j, shared: how
    many reads err in both; pairs that share none may be missing, each column has a row with itself. What one task holds at a time is one
    cluster's columns, bounded by its span, not by its reads. Repeated pairs count once; no rows, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows: list[tuple[int, int, int, int]] = []

        def group(c: int, pos_i: np.ndarray, pos_j: np.ndarray, n: np.ndarray) -> None:
            cols = np.unique(np.concatenate([pos_i, pos_j]))
            if len(cols) < 2:
                return
            shared = np.zeros((len(cols), len(cols)))
            i, j = np.searchsorted(cols, pos_i), np.searchsorted(cols, pos_j)
            shared[i, j] = shared[j, i] = n
            for k, members in enumerate(column_groups(shared)):
                if len(members) > 1:
                    rows.extend((c, int(cols[m]), k, len(members)) for m in members)

        def flush() -> Iterator[pa.RecordBatch]:
            names = ["cluster_id", "pos", "grp", "size"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names)
            rows.clear()

        def solve(last: bool) -> None:
            c, i, j, n = (np.concatenate(x) for x in zip(*held))
            cut = np.flatnonzero(np.diff(c)) + 1
            ends = [*cut.tolist(), *([len(c)] if last else [])]
            a = 0
            for b in ends:
                group(int(c[a]), i[a:b], j[a:b], n[a:b])
                a = b
            held[:] = [(c[a:], i[a:], j[a:], n[a:])] if a < len(c) else []

        for b in batches:
            held.append(tuple(b.column(x).to_numpy() for x in ("cluster_id", "pos_i", "pos_j", "shared")))
            solve(False)
            yield from flush()
        if held:
            solve(True)
            yield from flush()

    x = similarity.select("cluster_id", F.col("pos_i").cast("long"), F.col("pos_j").cast("long"), F.col("shared").cast("long")).repartition("cluster_id").sortWithinPartitions("cluster_id")
    return x.mapInArrow(run, "cluster_id long, pos long, grp int, size int")


def filter_reads(aligned: DataFrame, cores: DataFrame, spans: DataFrame, p: Params = Params()) -> DataFrame:
    """cluster_id, read_id, reason (caps or spectral) of the reads to leave out; see capped() for the inputs.

    A cluster of at most thin_over reads stays as it is. Reads over the error caps go first; the columns that they err in up to there
    still count. A cluster of fewer than three other reads or two error columns loses no more. Columns in which more than rare_column reads
    err are grouped by the reads that they share, and a read goes if it errs in more than three columns, or more than half, of a group.
    Counts, pairs and the last step are joins and grouped sums; only a cluster's matrix of columns goes to Python."""
    n = aligned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return outliers(capped(aligned, cores, spans, p), n, p)


def outliers(x: DataFrame, n: DataFrame, p: Params = Params()) -> DataFrame:
    """filter_reads() from capped()'s rows and the number of reads of each cluster (cluster_id, n)."""
    thick = n.where(F.col("n") > p.thin_over)
    if p.thin_over > 0:
        x = x.join(thick.select("cluster_id"), "cluster_id", "left_semi")
    gone = x.where("dropped").select("cluster_id", "read_id").distinct()
    lost = gone.groupBy("cluster_id").agg(F.count("*").alias("lost"))
    enough = thick.join(lost, "cluster_id", "left").where(F.col("n") - F.coalesce("lost", F.lit(0)) > 2).select("cluster_id")
    e = x.where("pos is not null").select("cluster_id", "pos", "read_id").distinct().join(enough, "cluster_id", "left_semi")
    busy = e.withColumn("reads", F.count("*").over(W.partitionBy("cluster_id", "pos"))).where(F.col("reads") > p.rare_column).drop("reads")
    # a read's pairs of its own few error columns, each column with itself too
    own = busy.groupBy("cluster_id", "read_id").agg(F.collect_list("pos").alias("own"))
    pairs = own.select("cluster_id", "own", F.explode("own").alias("pos_i")).select("cluster_id", "pos_i", F.explode("own").alias("pos_j")).where("pos_i <= pos_j")
    groups = grouped_columns(pairs.groupBy("cluster_id", "pos_i", "pos_j").agg(F.count("*").alias("shared")))
    met = busy.join(groups, ["cluster_id", "pos"]).groupBy("cluster_id", "grp", "read_id").agg(F.count("*").alias("m"), F.max("size").alias("size"))
    out = met.where(F.col("m") > F.least(F.lit(3), F.floor(F.col("size") / 2))).select("cluster_id", "read_id").distinct()
    spectral = out.join(gone, ["cluster_id", "read_id"], "left_anti").withColumn("reason", F.lit("spectral"))
    return gone.withColumn("reason", F.lit("caps")).unionByName(spectral)
