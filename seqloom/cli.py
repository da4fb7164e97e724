"""The four steps from files to files: mask, count, correct, restore.

    python -m seqloom.cli -t WORK [options] reads1 [reads2]

Every step writes under WORK, so that -s N begins again at step N.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import claims, gather, kmers, mask
from .params import Params
from .plans.correct import Correction
from .sources import fastx, files, sinks


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="seqloom")
    a.add_argument("reads1", help="FASTA or FASTQ, several separated by commas")
    a.add_argument("reads2", nargs="?", help="the mates, in the same order")
    a.add_argument("-t", "--work", required=True, help="folder for all outputs; must be shared by the cluster")
    a.add_argument("-s", "--step", type=int, default=1, choices=(1, 2, 3, 4), help="begin with this step")
    a.add_argument("--kmer", type=int, default=17)
    a.add_argument("-k", "--kmerCount", help="k-mer count file to use instead of counting")
    a.add_argument("-E", "--entropy", type=float, default=0.6)
    a.add_argument("-C", "--clusterLLH", type=float, default=-1.0)
    a.add_argument("--doEM", action="store_true")
    a.add_argument("--rthgTh", type=int, default=0, help="thin clusters of more reads than this")
    a.add_argument("--no-reuse-reads", action="store_true")
    a.add_argument("--allow-failures", action="store_true")
    a.add_argument("--failureTh", type=int, default=3)
    a.add_argument("--maxCorrections", type=int, default=5)
    a.add_argument("--pseudocount", type=float, default=0.01)
    a.add_argument("--eDelta", type=float, default=0.1)
    a.add_argument("--start", type=int)
    a.add_argument("--end", type=int)
    a.add_argument("--contigFn", help="also write contigs here")
    a.add_argument("--corPosFn", help="also write correction places here")
    a.add_argument("--stats_suffix", help="also write retrieval counts to nretrievals_SUFFIX under the work folder")
    a.add_argument("--ctrlFn", help="stop admitting work once this path exists")
    a.add_argument("-o", "--output", help="the corrected reads go here instead of corrected.fa under the work folder")
    a.add_argument("--dbReads", help="a list of read ids, one a line: their corrected rows also go to reads_of_interest.fa under the work folder")
    a.add_argument("--max-rounds", type=int)
    return a


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def report(s) -> None:
    """The run's counters: all on the error stream, accepted and corrected reads on the output."""
    print(f"Accepted: {s.accepted} Corrected: {s.corrected}\nCollidedReads: {s.collided} BadCollided: {s.bad_collided}\nSubstitutions: {s.n_sub} Deletions: {s.n_del} Insertions: {s.n_ins}", file=sys.stderr)
    print(s.accepted, s.corrected)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqloom").getOrCreate()
    p = Params(
        k=o.kmer, entropy=o.entropy, cluster_llh=o.clusterLLH, do_em=o.doEM, thin_over=o.rthgTh, reuse_reads=not o.no_reuse_reads, restrict_failures=not o.allow_failures,
        failure_limit=o.failureTh, max_corrections=o.maxCorrections, pseudocount=o.pseudocount, emission_delta=o.eDelta, start=o.start, end=o.end,
    )
    masked, counted, corrected, restored = (f"{o.work}/{x}" for x in ("masked.fa", "kmers.txt", "corrected.fa", "restored.fa"))
    corrected = o.output or corrected
    if o.step <= 1:
        raw = fastx.read_store(spark, o.reads1, o.reads2)
        sinks.write_masked(mask.mask_pairs(raw.withColumn("pair", F.floor(F.col("read_id") / (2 if o.reads2 else 1)))), masked)
    reads = files.read_masked(spark, masked)
    if o.step <= 2 and not o.kmerCount:
        sinks.write_kmer_counts(kmers.as_text(kmers.spectrum(reads, p.k, p.min_count), p.k), counted)
    if o.step <= 3:
        stop = (lambda: exists(spark, o.ctrlFn)) if o.ctrlFn else (lambda: False)
        c = Correction(reads, p, stop, kmers.as_codes(files.read_kmer_counts(spark, o.kmerCount or counted))).run(o.max_rounds)
        sinks.write_corrected(c.status(), corrected)
        if o.dbReads:
            sinks.write_corrected(c.status().join(files.read_ids(spark, o.dbReads).distinct(), "read_id", "left_semi"), f"{o.work}/reads_of_interest.fa")
        if o.contigFn:
            sinks.write_contigs(c.contigs().join(sinks.contig_columns(c.contig_columns(), p.column_cap), "cluster_id"), o.contigFn)
        if o.corPosFn:
            sinks.write_corrections(c.corrections(), o.corPosFn)
        if o.stats_suffix:
            sinks.write_retrievals(gather.retrieval_counts(c.gathered, c.usable), f"{o.work}/nretrievals_{o.stats_suffix}")
        report(c.summary().first())
    originals = fastx.read_store(spark, o.reads1, o.reads2).select("read_id", "name", "seq")
    sinks.write_restored(claims.restore(originals, reads, files.read_corrected(spark, corrected).where("status != ''")), restored)


if __name__ == "__main__":
    main()
