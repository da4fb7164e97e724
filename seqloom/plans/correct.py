"""De novo correction in bulk-synchronous rounds: every active cluster advances together, the lowest cluster wins a read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import claims as own
from ..operators import em, gather, kmers, pileup, spectral, viterbi
from ..params import Params
from ..sources import sinks

EDITS = "array<struct<pos:int,kind:string,bases:string>>"
#: What each round adds to the state, kept for the whole run under the round's number. All else is derived from these tables.
STATE = {
    "seeds": "read_id long",
    "gone": "cluster_id long, read_id long, reason string",
    "columns": "cluster_id long, pos long, letter string, cA double, cC double, cG double, cT double, entropy double",
    "outcome": f"read_id long, cluster_id long, ok boolean, bad boolean, corrected string, edits {EDITS}, rc boolean, won boolean",
    "after": "cluster_id long, core_lo int, core_hi int, core string, old_lo int, old_hi int, active boolean",
}
#: Seeds are taken in the order of this number of their id, so that they lie spread over the reads.
SPREAD = 1 << 40
#: By so much the reads that may be seeds together on a k-mer grow from round to round.
FASTER = 2
#: Bases, about, that one task aligns.
TASK_BASES = 3_000_000
#: Index rows, about, of one partition.
PART_POSTS = 2_000_000


def seed_order() -> F.Column:
    """A long from 1, by a hash of the id, then the id itself: a random order that is the same on every run."""
    return F.pmod(F.xxhash64("read_id"), F.lit(SPREAD)) + 1


def probes_of(clusters: DataFrame, k: int) -> DataFrame:
    """cluster_id, core, at: the parts of grown cores that are probed again, each with its place: the added columns of either end and k - 1 more,
    or the whole core where these two meet. clusters: cluster_id, core, core_lo, core_hi, and old_lo, old_hi from before it grew."""
    size = F.length("core")
    left = F.least(F.col("old_lo") - F.col("core_lo") + (k - 1), size)
    right = F.greatest(size - (F.col("core_hi") - F.col("old_hi")) - (k - 1), F.lit(0))
    piece = lambda a, b: F.struct(F.substring("core", a + 1, b - a).alias("core"), (F.col("core_lo") + a).cast("int").alias("at"))
    parts = F.when(right <= left, F.array(piece(F.lit(0), size))).otherwise(F.array(piece(F.lit(0), left), piece(right, size)))
    return clusters.select("cluster_id", F.explode(parts).alias("p")).select("cluster_id", "p.core", "p.at").where(F.length("core") >= k)


def regather(
    probes: DataFrame, live: DataFrame, posts: DataFrame, usable: DataFrame, p: Params, claims: DataFrame | None = None, failures: DataFrame | None = None,
    members: DataFrame | None = None, counts: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda x: x, parts: Callable[[DataFrame], int | None] = lambda x: None,
) -> DataFrame:
    """cluster_id, read_id, loc, rc, multi, oseq of the reads that clusters (live: cluster_id, core_lo, core_hi) gather by probing the index.

    probes: cluster_id, core, at; each end of a cluster is a probe of its own, shifted to its place. A read must stick out of a core that is
    there. In the first round the four tables are left out; later a read that failed too often, or that another holds, is not used (claims,
    failures; see gather.usable), nor one that the cluster has already (members: cluster_id, read_id), and its overlap with the core,
    without the core's outer two columns, must align to the carried counts with fewer errors than the cap. Empty tables give none; the
    lookups are equi-joins on k-mer and read."""
    h = gather.hits(probes, posts, usable, p.k).join(live.select("cluster_id", "core_lo", "core_hi"), "cluster_id")
    h = h.where((F.col("core_lo") == F.col("core_hi")) | (F.col("loc") < F.col("core_lo")) | (F.col("loc") + F.col("len") > F.col("core_hi")))
    if claims is not None:
        h = gather.usable(h, claims, failures, p.failure_limit, p.reuse_reads, p.strict_failures)
        h = h.join(members.select("cluster_id", "read_id"), ["cluster_id", "read_id"], "left_anti")
    # one row for each place of a read; places before 0 are possible, so the hit order is shifted to stay positive
    places = h.groupBy("cluster_id", "read_id", "loc", "rc", "core_lo", "core_hi").agg(F.min(F.col("k_end") + (1 << 24)).alias("k_end"), F.count("*").alias("n"))
    if claims is not None:
        cols = places.columns
        size = F.col("core_hi") - F.col("core_lo")
        infix = F.when(size > 0, dna.overlap_infix(F.col("oseq"), F.col("loc") - F.col("core_lo"), size)).otherwise("")
        s = keep(gather.oriented(places, usable).withColumn("part", infix).drop("oseq"))
        start = F.greatest(F.lit(0), F.lit(2) - (F.col("loc") - F.col("core_lo")))
        tested = s.where("part != ''").select("cluster_id", "read_id", (F.col("loc") + start).cast("int").alias("loc"), F.col("part").alias("oseq"), F.struct(*cols).alias("place"))
        near = viterbi.align_reads(tested, counts, p, carry=("place",), parts=parts(s)).where(F.size("errors") < p.max_core_errors)
        places = near.select("place.*").unionByName(s.where("part = ''").select(*cols))
    return gather.oriented(gather.first_places(places), usable)


class Correction:
    """The state of a run (one table for each kind of thing, a round's rows under its number) and one round over it.

    Each round is one plan over all active clusters: probe the index with new seeds and with the ends that the last round added, place
    and check the reads found, pile up, thin out, extend, align, claim. Only steps that end in a shuffle and that several others read are
    written, to the shared folder, which cuts lineage and survives lost executors. Claims, failures, members, carried
    counts and the ends to probe are derived from what rounds have written; the index of possible seeds shrinks with each round. Equal input gives equal output for any parallelism.

    Seeds come in random order. In the first round seeds share no k-mer; from round to round more reads may be seeds together, twice as
    many on a k-mer each time, so that the number of rounds grows with the logarithm of the most frequent k-mer. Seeds that
    meet compete for reads like clusters that touch: the lowest number wins, and a cluster that lost a read stops.

    reads: read_id, seq, one row each. A null sequence passes through and is never indexed, like one with an N. No rows: no rounds."""

    def __init__(self, reads: DataFrame, p: Params = Params(), stop: Callable[[], bool] = lambda: False, counts: DataFrame | None = None):
        self.p, self.spark, self.stop = p, reads.sparkSession, stop
        self._paths: dict[str, str] = {}
        self._read: dict[str, DataFrame] = {}
        self.reads = sinks.materialize(reads.select("read_id", "seq"), "reads")
        self.usable = kmers.indexed(self.reads, p.read_low_complexity)
        posts = kmers.postings(self.usable, p.k, counts if counts is not None else kmers.spectrum(self.reads, p.k, p.min_count), p.kmer_low_complexity)
        posts = sinks.materialize(posts, "posts")
        # dealt by k-mer while run() lasts: each round's minima and joins on the k-mer then need no shuffle of the index
        self.posts = posts.repartition(max(self.spark.sparkContext.defaultParallelism, posts.count() // PART_POSTS), "kmer")
        self.rounds = 0

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STATE:
            raise AttributeError(name)
        if name not in self._read:
            kind = f"{STATE[name]}, round int"
            self._read[name] = self.spark.read.schema(kind).parquet(self._paths[name]) if name in self._paths else self.spark.createDataFrame([], kind)
        return self._read[name]

    def _add(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a round's rows of the state and reads them back."""
        kind = self.spark.createDataFrame([], STATE[name]).schema
        if name not in self._paths:
            self._paths[name] = sinks.scratch(self.spark, name)
        path = self._paths[name]
        df.select(*(F.col(f.name).cast(f.dataType) for f in kind.fields)).write.mode("overwrite").parquet(f"{path}/round={self.rounds}")
        self._read.pop(name, None)
        return self.spark.read.schema(kind).parquet(f"{path}/round={self.rounds}")

    def _keep(self, df: DataFrame) -> DataFrame:
        """A step that several others read, written to the shared folder until the round ends."""
        path = sinks.scratch(self.spark, "step")
        df.write.parquet(path)
        self._old.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _replace(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table of which only the last round's is needed; the one before stays until the round ends."""
        path = sinks.scratch(self.spark, name)
        df.write.parquet(path)
        self._old += [self._paths[name]] if name in self._paths else []
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    @property
    def attempts(self) -> DataFrame:
        """read_id, cluster_id, corrected, won of every accepted read of every cluster."""
        return self.outcome.where("ok").select("read_id", "cluster_id", "corrected", "won")

    @property
    def claims(self) -> DataFrame:
        return self.outcome.where("won").select("read_id", "cluster_id", "corrected", "edits", "rc")

    @property
    def failures(self) -> DataFrame:
        """read_id, n: thinned reads, and fitted ones that are unlikely though they need few edits; at most the limit."""
        if not self.p.restrict_failures:
            return self.spark.createDataFrame([], "read_id long, n int")
        return own.saturate(self.gone.select("read_id").unionByName(self.outcome.where("bad").select("read_id")), self.p.failure_limit)

    @property
    def tried(self) -> DataFrame:
        return self.seeds.select("read_id")

    @property
    def gathered(self) -> DataFrame:
        """cluster_id, read_id over all rounds, repeats included."""
        return self.gone.select("cluster_id", "read_id").unionByName(self.outcome.select("cluster_id", "read_id"))

    @property
    def clusters(self) -> DataFrame:
        """The active ones."""
        return self.after.where((F.col("round") == self.rounds - 1) & F.col("active"))

    @property
    def ended(self) -> DataFrame:
        return self.after.where("not active")

    @property
    def frontier(self) -> DataFrame:
        return probes_of(self.clusters, self.p.k)

    def _carried(self) -> DataFrame:
        """The counts inside the cores of active clusters."""
        kind = "cluster_id long, pos long, cA double, cC double, cG double, cT double"
        if "counts" not in self._paths:
            return self.spark.createDataFrame([], kind)
        return pileup.carry_core(self.spark.read.schema(kind).parquet(self._paths["counts"]), self.clusters)

    def _closed(self) -> DataFrame:
        """read_id of reads that are no seeds any more: tried, claimed, or failed too often."""
        return self.tried.unionByName(self.outcome.where("won").select("read_id")).unionByName(self.failures.where(F.col("n") >= self.p.failure_limit).select("read_id"))

    @property
    def open(self) -> DataFrame:
        """kmer, read_id of reads that may still be seeds."""
        if "open" in self._paths:
            return self.spark.read.schema("kmer long, read_id long").parquet(self._paths["open"])
        return self.posts.select("kmer", "read_id")

    def admitted(self) -> DataFrame:
        """read_id of untried free reads within start and end, away from all active ends, whose order on each of their k-mers is at most
        FASTER ** rounds times the smallest there: the smallest alone in the first round."""
        p, posts = self.p, self.open
        if p.start is not None:
            posts = posts.where(F.col("read_id") >= p.start)
        if p.end is not None:
            posts = posts.where(F.col("read_id") < p.end)
        seeds = kmers.admit(posts, seed_order(), FASTER ** min(self.rounds, 22))
        if self.rounds == 0:
            return seeds
        ends = kmers.windows(self.frontier.select(F.col("cluster_id").alias("read_id"), F.col("core").alias("seq")), p.k).select("kmer").distinct()
        return seeds.join(posts.join(ends, "kmer", "left_semi").select("read_id").distinct(), "read_id", "left_anti")

    def round(self) -> bool:
        """One round; False if nothing was left to do."""
        self._old: list[str] = []
        try:
            return self._round()
        finally:
            for path in self._old:
                sinks.drop(self.spark, path)

    def _parts(self, placed: DataFrame) -> int:
        """How many tasks align reads: by their number, not fewer than there are cores unless reads are few."""
        n = placed.count()
        return max(1, min(self.spark.sparkContext.defaultParallelism, n // 200), n * 100 // TASK_BASES)

    def _round(self) -> bool:
        p, keep = self.p, self._keep
        if self.stop():
            return False
        if self.rounds:
            self._replace("open", self.open.join(self._closed(), "read_id", "left_anti"))
        seeds = self._add("seeds", self.admitted())
        active = self.clusters
        if seeds.isEmpty() and active.isEmpty():
            return False
        new = seeds.join(self.usable, "read_id").select(F.col("read_id").alias("cluster_id"), F.col("seq").alias("core"), F.lit(0).alias("at"))
        live = active.select("cluster_id", "core_lo", "core_hi", "core").unionByName(new.select("cluster_id", F.lit(0).alias("core_lo"), F.lit(0).alias("core_hi"), F.lit("").alias("core")))
        known = {"claims": self.claims, "failures": self.failures, "members": self.outcome, "counts": self._carried()} if self.rounds else {}
        placed = keep(regather(self.frontier.unionByName(new), live, self.posts, self.usable, p, **known, keep=keep, parts=self._parts))
        parts = self._parts(placed)
        # pile up on what the core carries over, thin out, and count again
        here = pileup.counts(pileup.bases(placed)).select("cluster_id", F.col("pos").cast("long").alias("pos"), *(F.col(f"c{b}").cast("double").alias(f"c{b}") for b in dna.BASES))
        hard = keep(here.unionByName(self._carried()).groupBy("cluster_id", "pos").agg(*(F.sum(f"c{b}").alias(f"c{b}") for b in dna.BASES)))
        caps = keep(spectral.capped(viterbi.align_reads(placed, hard, p, parts=parts), live, pileup.spans(hard), p))
        gone = self._add("gone", spectral.outliers(caps, placed.groupBy("cluster_id").agg(F.count("*").alias("n")), p))
        kept = placed.join(gone, ["cluster_id", "read_id"], "left_anti")
        left = pileup.subtract(hard, pileup.counts(pileup.bases(placed.join(gone, ["cluster_id", "read_id"], "left_semi"))))
        if p.do_em:
            left = em.em_profiles(kept, keep(left), live, p).toDF("cluster_id", "pos", *(f"c{b}" for b in dna.BASES))
        left = self._replace("counts", left)
        # extend both ends, from the largest start that was kept where a new cluster lost reads
        live = gather.anchored(live, kept, gone)
        prof = pileup.profile(left, p.pseudocount).join(live.select("cluster_id", "core_lo", "core_hi"), "cluster_id")
        grown = gather.spliced(live, self._add("columns", gather.extension(prof, p.entropy)))
        # align the kept reads to the thinned profile, correct them to the core, and claim
        cores = keep(grown)
        tries = viterbi.accepted(viterbi.align_reads(kept, left, p, cores, ("rc",), parts), cores, p).select("read_id", "cluster_id", "ok", "fitted", "rc", "corrected", "edits", (F.col("n_sub") + F.col("n_del") + F.col("n_ins") < p.max_corrections).alias("few"))
        if self.rounds:
            tries = tries.join(self.claims.select("read_id", F.lit(True).alias("taken")), "read_id", "left")
        else:
            tries = tries.withColumn("taken", F.lit(None).cast("boolean"))
        free = F.col("ok") & F.col("taken").isNull()
        owner = F.min(F.when(free, F.col("cluster_id"))).over(W.partitionBy("read_id"))
        text = F.when(F.col("ok"), F.when(F.col("rc"), dna.revcomp(F.col("corrected"))).otherwise(F.col("corrected")))
        outcome = self._add("outcome", tries.select(
            "read_id", "cluster_id", "ok", (~F.col("ok") & F.col("fitted") & F.col("few")).alias("bad"), text.alias("corrected"), F.when(F.col("ok"), F.col("edits")).alias("edits"), "rc",
            F.coalesce(free & (F.col("cluster_id") == owner), F.lit(False)).alias("won"),
        ))
        by = outcome.where("ok").groupBy("cluster_id").agg(F.max("won").alias("some"), F.min("won").alias("all"))
        grew = (F.col("core_lo") < F.col("old_lo")) | (F.col("core_hi") > F.col("old_hi"))
        self._add("after", cores.join(by, "cluster_id", "left").withColumn("active", F.coalesce(F.col("some") & F.col("all"), F.lit(False)) & grew))
        self.rounds += 1
        return True

    def run(self, max_rounds: int | None = None) -> Correction:
        """Rounds until no cluster is active and no seed can be admitted, or max_rounds; unclaimed reads pass through unchanged."""
        self.posts.persist()
        try:
            while (max_rounds is None or self.rounds < max_rounds) and self.round():
                pass
        finally:
            self.posts.unpersist()
        return self

    def status(self) -> DataFrame:
        """read_id, status, seq of every read."""
        return own.status(self.reads, self.claims)

    def contigs(self) -> DataFrame:
        """cluster_id, core, n_reads of contigs longer than k; n_reads counts every accepted read, also those that another cluster had or got."""
        n = self.attempts.groupBy("cluster_id").agg(F.count("*").alias("n_reads"))
        all_ = self.ended.select("cluster_id", "core").unionByName(self.clusters.select("cluster_id", "core"))
        return all_.where(F.length("core") > self.p.k).join(n, "cluster_id", "left").select("cluster_id", "core", F.coalesce("n_reads", F.lit(0)).alias("n_reads"))

    def contig_columns(self) -> DataFrame:
        """cluster_id, pos, cA, cC, cG, cT, entropy of each contig column, as it stood when it was added."""
        shown = self.columns.select("cluster_id", "pos", *(F.round(f"c{b}").cast("long").alias(f"c{b}") for b in dna.BASES), "entropy")
        return shown.join(self.contigs().select("cluster_id"), "cluster_id")

    def corrections(self) -> DataFrame:
        """read_id, pos, kind, bases: places in the read as sequenced, bases on the cluster's strand."""
        return own.positions(self.claims, self.reads)

    def summary(self) -> DataFrame:
        """One row: accepted, corrected, collided, bad_collided (those that would have been corrected otherwise), n_sub, n_del, n_ins."""
        return own.summary_of(self.attempts, self.claims, self.reads, self.corrections())
