"""The registered queries of the read-correction engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import dna
from .operators import claims, em, gather, kmers, mask, pileup, spectral, ungapped, viterbi
from .params import Params
from .sources import sinks

P = Params()
K = P.k


def once(step):
    """A step that many others read: written out the first time."""

    def get(self: Flow) -> DataFrame:
        if step.__name__ not in self.made:
            self.made[step.__name__] = sinks.materialize(step(self), step.__name__)
        return self.made[step.__name__]

    return get


class Flow:
    """The steps of one round from first seeds, from a folder's documents. The index, the gathered reads, the profile and
    the attempts are written to the shared folder once; all else is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}
        self.lazy = fixtures.reads(spark, sf_dir, clean=False)

    @property
    def reads(self) -> DataFrame:
        """Tiled once: filters and joins on a sequence then read it instead of making it again."""
        if "reads" not in self.made:
            self.made["reads"] = sinks.materialize(self.lazy, "reads")
        return self.made["reads"]

    @property
    def usable(self) -> DataFrame:
        return kmers.indexed(self.made.get("reads", self.lazy).select("read_id", "seq"), P.read_low_complexity)

    def counts(self) -> DataFrame:
        """k-mers as codes."""
        return kmers.spectrum(self.made.get("reads", self.lazy), K, P.min_count)

    def texts(self) -> DataFrame:
        return kmers.spectrum(self.made.get("reads", self.lazy), K, P.min_count, text=True)

    @once
    def postings(self) -> DataFrame:
        return kmers.postings(self.usable, K, self.counts(), P.kmer_low_complexity)

    @once
    def candidates(self) -> DataFrame:
        """read_id, seq: all rows of the usable reads that may be seeds."""
        ids = sinks.materialize(kmers.seed_candidates(self.told(), K, P.min_count, P.kmer_low_complexity), "candidates")
        return kmers.among(self.usable, kmers.marks(ids, "read_id", ids.count())).join(ids, "read_id", "left_semi")

    def told(self) -> DataFrame:
        """read_id, seq and use: whether the read is usable."""
        return self.lazy.select("read_id", "seq", (~dna.discard_read(F.col("seq"), P.read_low_complexity)).alias("use"))

    @once
    def seed_kmers(self) -> DataFrame:
        """read_id, kmers: the seeds of the first round, as kmers.admit() finds them on the whole index, with their k-mers that are on it (one that a read holds twice, twice). Only the k-mers of
        candidates are counted, over all reads; neither the reads nor the index are written."""
        c = self.candidates()
        own = kmers.marked(c, K).select("kmer", "read_id")
        seen = kmers.marks(own, "kmer", c.agg(F.sum(F.length("seq") - (K - 1))).first()[0] or 0)
        low = kmers.marked(self.told(), K, seen, "use").groupBy("kmer").agg(F.count("*").alias("n"), F.min(F.when(F.col("use"), F.col("read_id"))).alias("low"))
        low = low.where((F.col("n") >= P.min_count) & ~kmers.low_complexity(F.col("kmer"), K, P.kmer_low_complexity))
        over = F.col("low") < F.col("read_id")  # a k-mer that rules its read out need not be named
        x = own.join(low, "kmer").groupBy("read_id").agg(F.max(over.cast("int")).alias("over"), F.collect_list(F.when(~over, F.col("kmer"))).alias("kmers"))
        return x.where("over = 0").drop("over")

    def seeds(self) -> DataFrame:
        return self.seed_kmers().select("read_id")

    @once
    def met(self) -> DataFrame:
        """postings() of the seeds' k-mers: the part of the index that these meet is all that is made of it."""
        s = self.seed_kmers()
        wanted = s.select(F.explode("kmers").alias("kmer"))
        seen = kmers.marks(wanted, "kmer", s.agg(F.sum(F.size("kmers"))).first()[0] or 0)
        return kmers.first_windows(kmers.marked(self.usable, K, seen).join(wanted, "kmer", "left_semi"))

    @once
    def near(self) -> DataFrame:
        """read_id, seq: all rows of the usable reads that hold a seed's k-mer, and few others."""
        found = self.met()
        return kmers.among(self.usable, kmers.marks(found, "read_id", found.agg(F.approx_count_distinct("read_id")).first()[0]))

    def hits(self) -> DataFrame:
        cores = self.candidates().join(self.seeds(), "read_id").select(F.col("read_id").alias("cluster_id"), F.col("seq").alias("core"))
        return gather.overhang(gather.hits(cores, self.met(), self.near(), K), F.lit(0))

    @once
    def first_hits(self) -> DataFrame:
        return gather.first_hits(self.hits())

    @once
    def oriented(self) -> DataFrame:
        return gather.oriented(self.first_hits(), self.near())

    def gathered(self) -> DataFrame:
        return self.oriented().drop("oseq")

    def bases(self) -> DataFrame:
        return pileup.bases(self.oriented())

    def counted(self) -> DataFrame:
        return pileup.counts(self.bases())

    @once
    def profile(self) -> DataFrame:
        return pileup.profile(self.counted(), P.pseudocount)

    def errors(self) -> DataFrame:
        return pileup.mismatches(self.bases(), self.profile())

    def extension(self, right: bool) -> DataFrame:
        return gather.core_prefix(self.profile(), P.entropy, F.lit(0), right)

    def cores(self) -> DataFrame:
        x = self.extension(True).unionByName(self.extension(False))
        return x.groupBy("cluster_id").agg(F.min("pos").alias("core_lo"), (F.max("pos") + 1).alias("core_hi"))

    def contigs(self) -> DataFrame:
        x = self.extension(True).unionByName(self.extension(False))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda s: s["letter"]), "")
        return x.groupBy("cluster_id").agg(text.alias("core")).withColumn("length", F.length("core")).where(F.col("length") > K)

    def compared(self) -> DataFrame:
        return ungapped.compared(self.bases(), self.profile(), P.emission_delta)

    @once
    def attempts(self) -> DataFrame:
        return ungapped.attempts(self.compared(), P.max_corrections, P.cluster_llh)

    @once
    def aligned(self) -> DataFrame:
        return viterbi.align_reads(self.oriented(), self.counted(), P)

    def won(self) -> DataFrame:
        return claims.first_claim(self.attempts())

    def claims(self) -> DataFrame:
        """Owned reads with the corrected sequence on the read's own strand."""
        x = self.attempts().join(self.won().where("won").select("read_id", "cluster_id"), ["read_id", "cluster_id"]).join(self.gathered().select("read_id", "cluster_id", "rc"), ["read_id", "cluster_id"])
        own = F.when(F.col("rc"), dna.revcomp(F.col("corrected"))).otherwise(F.col("corrected"))
        return x.select("read_id", "cluster_id", own.alias("corrected"))

    def failures(self) -> DataFrame:
        """Reads that were gathered and compared but fell to a limit, once for each cluster."""
        tried = self.gathered().select("cluster_id", "read_id").join(self.attempts().select("cluster_id", "read_id"), ["cluster_id", "read_id"], "left_anti")
        return claims.saturate(tried, P.failure_limit)

    def substitutions(self) -> DataFrame:
        return ungapped.positions(self.compared(), self.won(), self.oriented())

    @once
    def thinned(self) -> DataFrame:
        """The reads that the error caps leave while there is no core."""
        none = self.oriented().select("cluster_id").distinct().select("cluster_id", F.lit(0).alias("core_lo"), F.lit(0).alias("core_hi"))
        gone = spectral.capped(self.aligned(), none, pileup.spans(self.counted()), P).where("dropped").select("cluster_id", "read_id").distinct()
        return self.oriented().join(gone.withColumn("gone", F.lit(True)), ["cluster_id", "read_id"], "left").withColumn("gone", F.col("gone").isNotNull())

    def kept(self) -> DataFrame:
        return self.thinned().where("not gone").drop("gone")

    def anchors(self) -> DataFrame:
        return gather.anchors(self.kept(), self.thinned().where("gone"))

    @once
    def fitted(self) -> DataFrame:
        """Gapped alignments of the first round's reads within the caps, whether they are accepted, and the strand."""
        return viterbi.accepted(self.aligned(), self.cores(), P).join(self.kept().select("cluster_id", "read_id", "rc"), ["cluster_id", "read_id"])

    @once
    def gapped_claims(self) -> DataFrame:
        ok = self.fitted().where("ok")
        x = claims.first_claim(ok).where("won").join(ok.select("cluster_id", "read_id", "rc", "corrected", "edits"), ["cluster_id", "read_id"])
        return x.withColumn("corrected", F.when(F.col("rc"), dna.revcomp(F.col("corrected"))).otherwise(F.col("corrected"))).select("read_id", "cluster_id", "corrected", "edits", "rc")

    @once
    def going(self) -> DataFrame:
        """The clusters of the first round that go on: those that lost no read. As gather.spliced() gives them."""
        new = self.extension(True).unionByName(self.extension(False))
        live = self.cores().select("cluster_id", F.lit(0).alias("core_lo"), F.lit(0).alias("core_hi"), F.lit("").alias("core"))
        lost = self.won().where("not won").select("cluster_id")
        return gather.spliced(live, new).join(self.won().select("cluster_id").distinct(), "cluster_id", "left_semi").join(lost, "cluster_id", "left_anti")

    @once
    def regathered(self) -> DataFrame:
        """The reads that the second round gathers."""
        from .plans import correct

        go = self.going()
        counts = pileup.carry_core(self.counted(), go).select("cluster_id", "pos", *(F.col(f"c{b}").cast("double") for b in dna.BASES))
        return correct.regather(correct.probes_of(go, K), go, self.postings(), self.usable, P, self.claims(), self.failures(), self.gathered(), counts, lambda x: sinks.materialize(x, "places"))

    def second_profile(self) -> DataFrame:
        """The second round's counts over what the cores carry, as a profile."""
        both = pileup.carry_core(self.counted(), self.going()).unionByName(pileup.counts(pileup.bases(self.regathered())))
        return pileup.profile(both.groupBy("cluster_id", "pos").agg(*(F.sum(f"c{b}").alias(f"c{b}") for b in dna.BASES)), P.pseudocount)

    def masked(self) -> DataFrame:
        return mask.mask(self.reads.select("read_id", "seq"))


#: The log transition probabilities in billionths, from the first letter's state to the second's.
_T = {"MM": round(math.log(0.94) * 1e9), "MD": round(math.log(0.03) * 1e9), "MI": round(math.log(0.03) * 1e9), "DM": round(math.log(0.95) * 1e9), "DD": round(math.log(0.05) * 1e9), "IM": round(math.log(0.95) * 1e9), "II": round(math.log(0.05) * 1e9)}
_T |= {"DI": -(10**15), "ID": -(10**15)}
_EVEN = round(math.log(0.25) * 1e9)


def _viterbi_chain(p: str, source: str, pro: str = "pro") -> list[tuple[str, str]]:
    """Banded alignment of (cluster_id, read_id, loc, oseq) to the profile pro as recursive steps: {p}f fills one base of all reads at a time, a row with
    the 15 scores and a list of choices; {p}t walks back; {p}o has the results."""
    best = lambda m, d, i: f"greatest({m}, {d}, {i})"
    code = lambda m, d, i: f"CASE WHEN {m} > {d} AND {m} > {i} THEN 0 WHEN {d} > {i} THEN 1 ELSE 2 END"
    cols, picks = [], []
    for o in range(5):
        x = [f"{s}{o} + {_T[t]}" for s, t in (("m", "MM"), ("d", "DM"), ("x", "IM"))]
        cols.append(f"e[i + {1 + o}] + {best(*x)} AS nm{o}")
        picks.append((3 * o, code(*x)))
        if o < 4:
            x = [f"{s}{o + 1} + {_T[t]}" for s, t in (("m", "MI"), ("d", "DI"), ("x", "II"))]
            cols.append(f"{_EVEN} + {best(*x)} AS nx{o}")
            picks.append((3 * o + 2, code(*x)))
        else:
            cols.append(f"CAST({-10**15} AS BIGINT) AS nx{o}")
    cols.insert(0, f"CAST({-10**15} AS BIGINT) AS nd0")
    later = []
    for o in range(1, 5):
        x = [f"n{s}{o - 1} + {_T[t]}" for s, t in (("m", "MD"), ("d", "DD"), ("x", "ID"))]
        later.append(f"{best(*x)} AS nd{o}")
        picks.append((3 * o + 1, code(*x)))
    packed = " + ".join(f"(({c}) << {2 * k})" for k, c in picks)
    low = f"CAST({-10**15} AS BIGINT)"
    start = ", ".join([f"CAST({v} AS BIGINT) AS m{o}" for o, v in enumerate((2 * _T["MD"], _T["MD"], 0, _T["MI"], 2 * _T["MI"]))] + [f"{low} AS {s}{o}" for s in "dx" for o in range(5)])
    scores = ", ".join(f"n{s}{o} AS {s}{o}" for s in "mdx" for o in range(5))
    all15 = "[" + ", ".join(f"{s}{o}" for o in range(5) for s in "mdx") + "]"
    lists = ", ".join(f"list(coalesce(CAST(round(ln(p{b}) * 1e9) AS BIGINT), {_EVEN}) ORDER BY j) AS e{b}, list(p{b} ORDER BY j) AS p{b}" for b in "ACGT")
    of = lambda x, c: f"CASE {c} WHEN 'A' THEN {x}A WHEN 'C' THEN {x}C WHEN 'G' THEN {x}G ELSE {x}T END"
    return [
        (f"{p}l", f"SELECT s.cluster_id, s.read_id, any_value(s.loc) AS loc, any_value(s.oseq) AS oseq, CAST(any_value(length(s.oseq)) AS INT) AS n, list(q.letter ORDER BY j) AS lt, {lists} FROM ({source}) s JOIN (SELECT CAST(unnest(range(0, {fixtures.READ + 4})) AS INT) AS j) ON j < length(s.oseq) + 4 LEFT JOIN {pro} q ON q.cluster_id = s.cluster_id AND q.pos = s.loc - 2 + j GROUP BY s.cluster_id, s.read_id"),
        (f"{p}f", f"""SELECT cluster_id, read_id, 0 AS i, {start}, CAST([] AS BIGINT[]) AS tr FROM {p}l
      UNION ALL SELECT cluster_id, read_id, i + 1 AS i, {scores}, list_append(tr, CAST({packed} AS BIGINT)) AS tr FROM (SELECT *, {', '.join(later)} FROM (SELECT *, {', '.join(cols)} FROM (
        SELECT f.*, {of('l.e', 'substr(l.oseq, f.i + 1, 1)')} AS e FROM {p}f f JOIN {p}l l ON l.cluster_id = f.cluster_id AND l.read_id = f.read_id WHERE f.i < l.n)))"""),
        (f"{p}t", f"""SELECT cluster_id, read_id, i, o, s, tr, llh, i AS n_left, CAST(loc + i - 1 + o - 2 AS INT) AS last, CAST(NULL AS INT) AS first, 0 AS n_sub, 0 AS n_del, 0 AS n_ins, '' AS corrected, CAST([] AS INT[]) AS errs, CAST([] AS STRUCT(pos INT, kind VARCHAR, bases VARCHAR)[]) AS eds FROM (
        SELECT *, k // 3 AS o, k % 3 AS s FROM (SELECT f.cluster_id, f.read_id, f.i, f.tr, l.loc, list_max({all15}) / 1e9 / l.n AS llh, list_position({all15}, list_max({all15})) - 1 AS k FROM {p}f f JOIN {p}l l ON l.cluster_id = f.cluster_id AND l.read_id = f.read_id WHERE f.i = l.n))
      UNION ALL SELECT cluster_id, read_id, CASE WHEN s = 1 THEN i ELSE i - 1 END AS i, CASE s WHEN 0 THEN o WHEN 1 THEN o - 1 ELSE o + 1 END AS o, (tr[i] >> (2 * (3 * o + s))) & 3 AS s, tr, llh, n_left, last, here AS first, n_sub + CAST(s = 0 AND change AS INT) AS n_sub, n_del + CAST(s = 1 AS INT) AS n_del, n_ins + CAST(s = 2 AS INT) AS n_ins,
        CASE s WHEN 0 THEN CASE WHEN change THEN letter ELSE b END WHEN 1 THEN coalesce(letter, '') ELSE '' END || corrected AS corrected, CASE WHEN s > 0 OR coalesce(b <> letter, false) THEN list_append(errs, here) ELSE errs END AS errs,
        CASE WHEN s > 0 OR change THEN list_append(eds, struct_pack(pos := CAST(i - 1 AS INT), kind := CASE s WHEN 0 THEN 'M' WHEN 1 THEN 'D' ELSE 'I' END, bases := CASE s WHEN 0 THEN b || letter WHEN 1 THEN coalesce(letter, 'N') ELSE b END)) ELSE eds END AS eds FROM (
        SELECT *, coalesce(b <> letter AND pb <= pl - {P.emission_delta}::DOUBLE, false) AS change FROM (SELECT *, {of('q', 'b')} AS pb, {of('q', 'letter')} AS pl FROM (
          SELECT t.*, CAST(l.loc + t.i - 1 + t.o - 2 AS INT) AS here, substr(l.oseq, t.i, 1) AS b, l.lt[t.i + t.o] AS letter, {', '.join(f'l.p{b}[t.i + t.o] AS q{b}' for b in 'ACGT')}
          FROM {p}t t JOIN {p}l l ON l.cluster_id = t.cluster_id AND l.read_id = t.read_id WHERE t.i > 0)))"""),
        (f"{p}o", f"SELECT * FROM {p}t WHERE i = 0"),
    ]


def _posterior_chain(p: str, v: str) -> list[tuple[str, str]]:
    """Forward ({p}f) and backward ({p}b) sums over the band for the reads of {v}l, scaled to 1 at each base with the logarithm of what was
    divided (ls), and {p}q: the probability that base i is matched at offset o."""
    emit = [f"coalesce(CASE substr(l.oseq, i, 1) WHEN 'A' THEN l.pA[i + {o}] WHEN 'C' THEN l.pC[i + {o}] WHEN 'G' THEN l.pG[i + {o}] ELSE l.pT[i + {o}] END, 0.25::DOUBLE)" for o in range(5)]
    num = lambda x: f"{x!r}::DOUBLE"
    mm, md, sm, ss, q = num(0.94), num(0.03), num(0.95), num(0.05), num(0.25)
    names = [f"{s}{o}" for s in "mdx" for o in range(5)]
    scaled = ", ".join(f"n{x} / s AS {x}" for x in names)
    every = " + ".join(f"n{x}" for x in names)
    # forward: row i has the sums after i bases
    fwd = ", ".join([f"e{o} * (m{o} * {mm} + (d{o} + x{o}) * {sm}) AS nm{o}" for o in range(5)] + [f"{q} * (m{o + 1} * {md} + x{o + 1} * {ss}) AS nx{o}" for o in range(4)] + ["0.0::DOUBLE AS nx4", "0.0::DOUBLE AS nd0"])
    dels = [f"nm{o - 1} * {md} + nd{o - 1} * {ss} AS nd{o}" for o in range(1, 5)]
    at_zero = ", ".join([f"{num(0.03 ** abs(o - 2))} AS m{o}" for o in range(5)] + [f"0.0::DOUBLE AS {s}{o}" for s in "dx" for o in range(5)])
    # backward: row i has the sums after i bases, to the read's end; deletions may follow at any base but before the first
    back = ", ".join([f"e{o} * m{o} AS t{o}" for o in range(5)] + ["0.0::DOUBLE AS u0"] + [f"{q} * x{o - 1} AS u{o}" for o in range(1, 5)])
    raw = ", ".join([f"t{o} * {mm} + u{o} * {md} AS rm{o}, t{o} * {sm} AS rd{o}, t{o} * {sm} + u{o} * {ss} AS nx{o}" for o in range(5)])
    close = "rm4 AS nm4, rd4 AS nd4"
    down = [f"CASE WHEN i > 0 THEN rm{o} + nd{o + 1} * {md} ELSE rm{o} END AS nm{o}, CASE WHEN i > 0 THEN rd{o} + nd{o + 1} * {ss} ELSE rd{o} END AS nd{o}" for o in (3, 2, 1, 0)]
    ones = ", ".join(f"1.0::DOUBLE AS rm{o}, 1.0::DOUBLE AS rd{o}, 1.0::DOUBLE AS nx{o}" for o in range(5))
    return [
        (f"{p}f", f"""SELECT cluster_id, read_id, 0 AS i, {at_zero}, 0.0::DOUBLE AS ls FROM {v}l
      UNION ALL SELECT cluster_id, read_id, i, {scaled}, ls + ln(s) AS ls FROM (SELECT *, {every} AS s FROM (SELECT *, {', '.join(dels)} FROM (SELECT *, {fwd} FROM (
        SELECT l.oseq, {', '.join(f'{e} AS e{o}' for o, e in enumerate(emit))}, z.* FROM (SELECT f.* REPLACE (f.i + 1 AS i) FROM {p}f f) z JOIN {v}l l ON l.cluster_id = z.cluster_id AND l.read_id = z.read_id WHERE z.i <= l.n))))"""),
        (f"{p}b", f"""SELECT cluster_id, read_id, n AS i, {scaled}, ln(s) AS ls FROM (SELECT *, {every} AS s FROM (SELECT *, {', '.join(down)} FROM (SELECT *, {close} FROM (SELECT cluster_id, read_id, n, n AS i, {ones} FROM {v}l))))
      UNION ALL SELECT cluster_id, read_id, i, {scaled}, ls + ln(s) AS ls FROM (SELECT *, {every} AS s FROM (SELECT *, {', '.join(down)} FROM (SELECT *, {close} FROM (SELECT cluster_id, read_id, i - 1 AS i, ls, {raw} FROM (SELECT *, {back} FROM (
        SELECT z.*, {', '.join(f"{e.replace('i, 1', 'z.i, 1').replace('[i +', '[z.i +')} AS e{o}" for o, e in enumerate(emit))} FROM {p}b z JOIN {v}l l ON l.cluster_id = z.cluster_id AND l.read_id = z.read_id WHERE z.i > 0))))))"""),
        (f"{p}s", f"SELECT f.cluster_id, f.read_id, f.ls + ln({' + '.join(f'f.{x}' for x in names)}) AS llh FROM {p}f f JOIN {v}l l ON l.cluster_id = f.cluster_id AND l.read_id = f.read_id WHERE f.i = l.n"),
        (f"{p}q", f"""SELECT cluster_id, read_id, i, CAST(unnest(range(0, 5)) AS INT) AS o, unnest([{', '.join(f'fm{o} * bm{o} * exp(fs + bs - llh)' for o in range(5))}]) AS post FROM (
        SELECT f.cluster_id, f.read_id, f.i, f.ls AS fs, b.ls AS bs, s.llh, {', '.join(f'f.m{o} AS fm{o}, b.m{o} AS bm{o}' for o in range(5))} FROM {p}f f JOIN {p}b b ON b.cluster_id = f.cluster_id AND b.read_id = f.read_id AND b.i = f.i JOIN {p}s s ON s.cluster_id = f.cluster_id AND s.read_id = f.read_id WHERE f.i > 0)"""),
    ]


_COUNTED = ", ".join(f"CAST(sum(CAST(base = '{b}' AS INT)) AS BIGINT) AS c{b}" for b in "ACGT")


def _profile_sql(counts: str) -> str:
    """Counts with probabilities, entropy and letter."""
    prob = ", ".join(f"(c{b} + {P.pseudocount}::DOUBLE) / (cA + cC + cG + cT + 4 * {P.pseudocount}::DOUBLE) AS p{b}" for b in "ACGT")
    return f"SELECT *, -(pA * ln(pA) + pC * ln(pC) + pG * ln(pG) + pT * ln(pT)) AS entropy, CASE greatest(cA, cC, cG, cT) WHEN cA THEN 'A' WHEN cC THEN 'C' WHEN cG THEN 'G' ELSE 'T' END AS letter FROM (SELECT *, {prob} FROM ({counts}))"


def _extension_sql(p: str, columns: str) -> list[tuple[str, str]]:
    """{p}e: the columns that extend a core to both sides. columns: profile rows with rel, their distance from the core: from 0 on to the right, from -1 on to the left."""
    side = lambda where, order, nth: f"SELECT * FROM (SELECT *, max(CAST(entropy > {P.entropy} AS INT)) OVER w AS bad, row_number() OVER w AS nth FROM {p}c WHERE {where} WINDOW w AS (PARTITION BY cluster_id ORDER BY {order})) WHERE bad = 0 AND nth = {nth}"
    return [(f"{p}c", columns), (f"{p}e", f"{side('rel >= 0', 'rel', 'rel + 1')} UNION ALL {side('rel < 0', 'rel DESC', '-rel')}")]


# The same steps as common table expressions, in order.
_CHAIN = [
    ("idx", f"SELECT read_id, seq FROM reads WHERE instr(seq, 'N') = 0 AND length(seq) - length(replace(seq, 'A', '')) <= 0.7 * length(seq) AND length(seq) - length(replace(seq, 'T', '')) <= 0.7 * length(seq)"),
    # k-mers are numbers of as many digits as bases (A, C, G, T are 1, 2, 3, 4), so that order is that of the text
    ("aw", f"SELECT * FROM (SELECT read_id, translate(seq, 'ACGTN', '12340') AS ds, reverse(translate(seq, 'ACGTN', '43210')) AS rc, instr(seq, 'N') > 0 AS odd, CAST(length(seq) AS INT) AS n FROM reads WHERE length(seq) >= {K}), (SELECT CAST(unnest(range(1, {fixtures.READ - K + 2})) AS INT) AS i) WHERE i <= n - {K - 1}"),
    ("ak", f"SELECT read_id, CAST(i + {K - 2} AS INT) AS \"end\", CAST(substr(ds, i, {K}) AS BIGINT) AS km, CAST(substr(rc, n - i - {K - 2}, {K}) AS BIGINT) AS rv FROM aw WHERE NOT odd OR NOT contains(substr(ds, i, {K}), '0')"),
    ("win", "SELECT read_id, \"end\", least(km, rv) AS kmer, km <= rv AS forward FROM ak"),
    ("cnt", f"SELECT kmer, count(*) AS n FROM win GROUP BY kmer HAVING count(*) >= {P.min_count}"),
    ("good", f"SELECT kmer, n FROM (SELECT kmer, n, CAST(kmer AS VARCHAR) AS t FROM cnt) WHERE {K} - length(replace(t, '1', '')) <= 0.9 * {K} AND {K} - length(replace(t, '4', '')) <= 0.9 * {K}"),
    ("post", "SELECT kmer, read_id, CAST(CASE WHEN x % 2 = 0 THEN x // 2 + 1 ELSE -(x // 2) - 1 END AS INT) AS spos FROM (SELECT kmer, read_id, min(\"end\" * 2 + CAST(NOT forward AS INT)) AS x FROM win WHERE read_id IN (SELECT read_id FROM idx) AND kmer IN (SELECT kmer FROM good) GROUP BY kmer, read_id)"),
    ("seeds", "SELECT read_id FROM post JOIN (SELECT kmer, min(read_id) AS low FROM post GROUP BY kmer) USING (kmer) GROUP BY read_id HAVING bool_and(read_id = low)"),
    ("hits", f"""SELECT p.read_id AS cluster_id, q.read_id, p."end" AS k_end, CAST(CASE WHEN p.forward = (q.spos > 0) THEN p."end" - (abs(q.spos) - 1) ELSE p."end" - {K - 1} - (length(r.seq) - abs(q.spos)) END AS INT) AS loc, p.forward <> (q.spos > 0) AS rc, length(r.seq) AS len
      FROM win p JOIN seeds s ON s.read_id = p.read_id JOIN post q ON q.kmer = p.kmer JOIN idx r ON r.read_id = q.read_id"""),
    ("gat", "SELECT cluster_id, read_id, arg_min(loc, k_end) AS loc, arg_min(rc, k_end) AS rc, CAST(count(*) AS INT) AS multi FROM hits GROUP BY cluster_id, read_id"),
    ("ori", "SELECT cluster_id, read_id, loc, rc, multi, CASE WHEN rc THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS oseq FROM gat JOIN idx USING (read_id)"),
    ("bas", f"SELECT cluster_id, read_id, loc + j - 1 AS pos, substr(oseq, j, 1) AS base FROM ori, (SELECT CAST(unnest(range(1, {fixtures.READ + 1})) AS INT) AS j) WHERE j <= length(oseq)"),
    ("pil", "SELECT cluster_id, pos, " + ", ".join(f"CAST(sum(CAST(base = '{b}' AS INT)) AS BIGINT) AS c{b}" for b in "ACGT") + " FROM bas GROUP BY cluster_id, pos"),
    ("pro", "SELECT *, -(pA * ln(pA) + pC * ln(pC) + pG * ln(pG) + pT * ln(pT)) AS entropy, CASE greatest(cA, cC, cG, cT) WHEN cA THEN 'A' WHEN cC THEN 'C' WHEN cG THEN 'G' ELSE 'T' END AS letter FROM (SELECT *, "
      + ", ".join(f"(c{b} + {P.pseudocount}::DOUBLE) / (cA + cC + cG + cT + 4 * {P.pseudocount}::DOUBLE) AS p{b}" for b in "ACGT") + " FROM pil)"),
    ("err", "SELECT cluster_id, pos, read_id FROM bas JOIN pro USING (cluster_id, pos) WHERE base <> letter"),
    ("exr", f"SELECT * FROM (SELECT *, max(CAST(entropy > {P.entropy} AS INT)) OVER w AS bad, row_number() OVER w AS nth FROM pro WHERE pos >= 0 WINDOW w AS (PARTITION BY cluster_id ORDER BY pos)) WHERE bad = 0 AND nth = pos + 1"),
    ("exl", f"SELECT * FROM (SELECT *, max(CAST(entropy > {P.entropy} AS INT)) OVER w AS bad, row_number() OVER w AS nth FROM pro WHERE pos < 0 WINDOW w AS (PARTITION BY cluster_id ORDER BY pos DESC)) WHERE bad = 0 AND nth = -pos"),
    ("ext", "SELECT * FROM exr UNION ALL SELECT * FROM exl"),
    ("cor", "SELECT cluster_id, min(pos) AS core_lo, max(pos) + 1 AS core_hi FROM ext GROUP BY cluster_id"),
    ("con", f"SELECT cluster_id, string_agg(letter, '' ORDER BY pos) AS core, CAST(count(*) AS INT) AS length FROM ext GROUP BY cluster_id HAVING count(*) > {K}"),
    ("cmp", f"""SELECT *, CASE WHEN change THEN letter ELSE base END AS fixed FROM (SELECT *, base <> letter AND pb <= pl - {P.emission_delta}::DOUBLE AS change, ln(pb) AS lp FROM (
      SELECT cluster_id, read_id, pos, base, letter, CASE base WHEN 'A' THEN pA WHEN 'C' THEN pC WHEN 'G' THEN pG ELSE pT END AS pb, CASE letter WHEN 'A' THEN pA WHEN 'C' THEN pC WHEN 'G' THEN pG ELSE pT END AS pl FROM bas JOIN pro USING (cluster_id, pos)))"""),
    ("att", f"SELECT * FROM (SELECT cluster_id, read_id, CAST(sum(CAST(change AS INT)) AS INT) AS n_sub, CAST(sum(CAST(round(lp, 9) AS DECIMAL(20,9))) AS DOUBLE) / count(*) AS llh, string_agg(fixed, '' ORDER BY pos) AS corrected FROM cmp GROUP BY cluster_id, read_id) WHERE n_sub < {P.max_corrections} AND llh > {P.cluster_llh}"),
    ("own", "SELECT read_id, min(cluster_id) AS owner FROM att GROUP BY read_id"),
    ("won", "SELECT a.read_id, a.cluster_id, a.cluster_id = o.owner AS won, a.corrected = k.corrected AS matched FROM att a JOIN own o ON o.read_id = a.read_id JOIN att k ON k.read_id = o.read_id AND k.cluster_id = o.owner"),
    ("clm", "SELECT a.read_id, a.cluster_id, CASE WHEN g.rc THEN reverse(translate(a.corrected, 'ACGT', 'TGCA')) ELSE a.corrected END AS corrected FROM att a JOIN won w ON w.read_id = a.read_id AND w.cluster_id = a.cluster_id AND w.won JOIN gat g ON g.read_id = a.read_id AND g.cluster_id = a.cluster_id"),
    ("fai", f"SELECT read_id, CAST(least(count(*), {P.failure_limit}) AS INT) AS n FROM gat g WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.cluster_id = g.cluster_id AND a.read_id = g.read_id) GROUP BY read_id"),
    ("sub", "SELECT c.read_id, CAST(CASE WHEN o.rc THEN length(o.oseq) - 1 - (c.pos - o.loc) ELSE c.pos - o.loc END AS INT) AS pos, 'M' AS kind, concat(c.base, c.fixed) AS bases FROM cmp c JOIN won w ON w.cluster_id = c.cluster_id AND w.read_id = c.read_id AND w.won JOIN ori o ON o.cluster_id = c.cluster_id AND o.read_id = c.read_id WHERE c.change"),
    ("mch", "SELECT read_id, seq, length(regexp_extract(upper(seq), '^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)', 1)) - 1 AS cut_at FROM reads"),
    ("msk", "SELECT read_id, array_to_string(list_transform(range(0, length(m)), lambda i: CASE WHEN upper(substr(m, i + 1, 1)) = 'N' THEN substr('ACGT', CAST((read_id * 31 + i * 7 + read_id // 13) % 4 + 1 AS INT), 1) ELSE substr(m, i + 1, 1) END), '') AS seq FROM (SELECT read_id, CASE WHEN cut_at < 0 THEN seq WHEN cut_at > 35 THEN substr(seq, 1, cut_at) END AS m FROM mch) WHERE m IS NOT NULL"),
    ("sta", "SELECT r.read_id, CASE WHEN c.corrected IS NULL THEN '' WHEN c.corrected <> r.seq THEN 'Corrected' ELSE 'Assigned' END AS status, coalesce(c.corrected, r.seq) AS seq FROM reads r LEFT JOIN clm c ON c.read_id = r.read_id"),
    ("inf", "SELECT o.cluster_id, o.read_id, o.loc, o.oseq, greatest(0, 2 - (o.loc - c.core_lo)) AS a, least(length(o.oseq), c.core_hi - o.loc - 2) AS b FROM ori o JOIN cor c ON c.cluster_id = o.cluster_id"),
    ("ecs", f"SELECT cluster_id, pos, count(DISTINCT read_id) AS n_reads FROM err GROUP BY cluster_id, pos HAVING count(DISTINCT read_id) > {P.rare_column}"),
    ("sim", """SELECT p.cluster_id, p.pos_i, p.pos_j, coalesce(b.shared, 0) AS shared FROM (SELECT c.cluster_id, c.pos AS pos_i, d.pos AS pos_j FROM ecs c JOIN ecs d ON c.cluster_id = d.cluster_id AND c.pos < d.pos) p LEFT JOIN (
      SELECT a.cluster_id, a.pos AS pos_i, b.pos AS pos_j, count(*) AS shared FROM err a JOIN err b ON a.cluster_id = b.cluster_id AND a.read_id = b.read_id AND a.pos < b.pos GROUP BY 1, 2, 3) b USING (cluster_id, pos_i, pos_j)"""),
    *_viterbi_chain("v", "SELECT cluster_id, read_id, loc, oseq FROM ori"),
    *_viterbi_chain("w", "SELECT cluster_id, read_id, loc + a AS loc, substr(oseq, a + 1, b - a) AS oseq FROM inf WHERE b > a"),
    *_posterior_chain("z", "v"),
    # the reads over the caps while there is no core, what is left without them, and where a thinned cluster's extension begins
    ("gon", f"SELECT e.cluster_id, e.read_id FROM (SELECT cluster_id, read_id, unnest(errs) AS pos FROM vo) e JOIN (SELECT cluster_id, min(pos) AS lo, max(pos) + 1 AS hi FROM pil GROUP BY cluster_id) s ON s.cluster_id = e.cluster_id AND e.pos >= s.lo AND e.pos < s.hi GROUP BY e.cluster_id, e.read_id HAVING count(*) >= {P.max_pre_corrected_errors}"),
    ("kpt", "SELECT o.* FROM ori o ANTI JOIN gon g ON g.cluster_id = o.cluster_id AND g.read_id = o.read_id"),
    ("anc", "SELECT cluster_id, max(loc) AS anchor FROM kpt WHERE cluster_id IN (SELECT cluster_id FROM gon) GROUP BY cluster_id"),
    ("kpr", _profile_sql("SELECT cluster_id, pos, " + _COUNTED + " FROM bas b WHERE NOT EXISTS (SELECT 1 FROM gon g WHERE g.cluster_id = b.cluster_id AND g.read_id = b.read_id) GROUP BY cluster_id, pos")),
    *_extension_sql("ka", "SELECT q.*, q.pos - coalesce(a.anchor, 0) AS rel FROM kpr q LEFT JOIN anc a ON a.cluster_id = q.cluster_id"),
    # gapped claims: what is accepted, who gets it, what was changed where
    ("gat2", f"SELECT o.cluster_id, o.read_id, o.corrected, o.eds, o.n_sub + o.n_del + o.n_ins < {P.max_corrections} AS few, o.first >= c.core_lo AND o.last < c.core_hi AS fitted, o.llh > {P.cluster_llh} AS likely FROM vo o JOIN cor c ON c.cluster_id = o.cluster_id JOIN kpt k ON k.cluster_id = o.cluster_id AND k.read_id = o.read_id"),
    ("gatt", "SELECT cluster_id, read_id, corrected, eds FROM gat2 WHERE few AND fitted AND likely"),
    ("gclm", "SELECT a.read_id, a.cluster_id, g.rc, a.eds, CASE WHEN g.rc THEN reverse(translate(a.corrected, 'ACGT', 'TGCA')) ELSE a.corrected END AS corrected FROM gatt a JOIN (SELECT read_id, min(cluster_id) AS owner FROM gatt GROUP BY read_id) o ON o.read_id = a.read_id AND o.owner = a.cluster_id JOIN gat g ON g.read_id = a.read_id AND g.cluster_id = a.cluster_id"),
    ("gpos", "SELECT c.read_id, CAST(CASE WHEN c.rc THEN length(r.seq) - 1 - c.e.pos ELSE c.e.pos END AS INT) AS pos, c.e.kind AS kind, c.e.bases AS bases FROM (SELECT read_id, rc, unnest(eds) AS e FROM gclm) c JOIN reads r ON r.read_id = c.read_id"),
    # the second round: clusters that lost no read probe their cores' ends
    ("go", "SELECT c.cluster_id, c.core_lo, c.core_hi, string_agg(x.letter, '' ORDER BY x.pos) AS core, greatest(0, -c.core_lo - 16) AS r0, least(16 - c.core_lo, c.core_hi - c.core_lo) AS l1 FROM cor c JOIN ext x ON x.cluster_id = c.cluster_id WHERE c.cluster_id IN (SELECT cluster_id FROM won GROUP BY cluster_id HAVING bool_and(won)) GROUP BY c.cluster_id, c.core_lo, c.core_hi".replace("16", str(K - 1))),
    ("prb", "SELECT cluster_id, core_lo, core_hi, 0 AS a, CASE WHEN r0 <= l1 THEN core ELSE substr(core, 1, l1) END AS x FROM go UNION ALL SELECT cluster_id, core_lo, core_hi, r0 AS a, substr(core, r0 + 1) AS x FROM go WHERE r0 > l1"),
    ("prw", f"SELECT cluster_id, core_lo, core_hi, CAST(core_lo + a + i + {K - 2} AS INT) AS k_end, CAST(substr(translate(x, 'ACGT', '1234'), i, {K}) AS BIGINT) AS km, CAST(substr(reverse(translate(x, 'ACGT', '4321')), length(x) - i - {K - 2}, {K}) AS BIGINT) AS rv FROM (SELECT *, unnest(range(1, length(x) - {K - 2})) AS i FROM prb WHERE length(x) >= {K})"),
    ("rht", f"""SELECT * FROM (SELECT w.cluster_id, w.core_lo, w.core_hi, q.read_id, w.k_end, CAST(CASE WHEN (km <= rv) = (q.spos > 0) THEN k_end - (abs(q.spos) - 1) ELSE k_end - {K - 1} - (length(r.seq) - abs(q.spos)) END AS INT) AS loc, (km <= rv) <> (q.spos > 0) AS rc, length(r.seq) AS len
      FROM prw w JOIN post q ON q.kmer = least(km, rv) JOIN idx r ON r.read_id = q.read_id) WHERE loc < core_lo OR loc + len > core_hi"""),
    ("rpl", f"""SELECT row_number() OVER () AS pid, * FROM (SELECT h.cluster_id, h.read_id, h.core_lo, h.core_hi, h.loc, h.rc, min(h.k_end) AS k_end, count(*) AS n FROM rht h LEFT JOIN clm c ON c.read_id = h.read_id LEFT JOIN fai f ON f.read_id = h.read_id
      WHERE CASE WHEN coalesce(f.n, 0) < {P.failure_limit} THEN c.cluster_id IS NULL OR c.cluster_id <> h.cluster_id ELSE c.cluster_id IS NULL END AND NOT EXISTS (SELECT 1 FROM gat g WHERE g.cluster_id = h.cluster_id AND g.read_id = h.read_id) GROUP BY 1, 2, 3, 4, 5, 6)"""),
    ("rin", "SELECT p.cluster_id, p.pid, p.loc, CASE WHEN p.rc THEN reverse(translate(r.seq, 'ACGT', 'TGCA')) ELSE r.seq END AS oseq, greatest(0, 2 - (p.loc - p.core_lo)) AS a, least(length(r.seq), p.core_hi - p.loc - 2) AS b FROM rpl p JOIN idx r ON r.read_id = p.read_id"),
    ("prc", "SELECT q.* FROM pro q JOIN cor c ON c.cluster_id = q.cluster_id WHERE q.pos >= c.core_lo AND q.pos < c.core_hi"),
    *_viterbi_chain("y", "SELECT cluster_id, pid AS read_id, loc + a AS loc, substr(oseq, a + 1, b - a) AS oseq FROM rin WHERE b > a", "prc"),
    ("rga", f"SELECT p.cluster_id, p.read_id, arg_min(p.loc, p.k_end * 2 + CAST(p.rc AS INT)) AS loc, arg_min(p.rc, p.k_end * 2 + CAST(p.rc AS INT)) AS rc, CAST(sum(p.n) AS INT) AS multi FROM rpl p LEFT JOIN yo o ON o.read_id = p.pid WHERE coalesce(len(o.errs), 0) < {P.max_core_errors} GROUP BY p.cluster_id, p.read_id"),
    ("rba", f"SELECT g.cluster_id, g.loc + j - 1 AS pos, substr(CASE WHEN g.rc THEN reverse(translate(r.seq, 'ACGT', 'TGCA')) ELSE r.seq END, j, 1) AS base FROM rga g JOIN idx r ON r.read_id = g.read_id, (SELECT CAST(unnest(range(1, {fixtures.READ + 1})) AS INT) AS j) WHERE j <= length(r.seq)"),
    ("rpr", _profile_sql("SELECT cluster_id, pos, " + ", ".join(f"CAST(sum(c{b}) AS BIGINT) AS c{b}" for b in "ACGT") + " FROM (SELECT cluster_id, pos, cA, cC, cG, cT FROM prc WHERE cluster_id IN (SELECT cluster_id FROM go) UNION ALL SELECT cluster_id, pos, " + _COUNTED + " FROM rba GROUP BY cluster_id, pos) GROUP BY cluster_id, pos")),
    *_extension_sql("ra", "SELECT q.*, CASE WHEN q.pos >= g.core_hi THEN q.pos - g.core_hi ELSE q.pos - g.core_lo END AS rel FROM rpr q JOIN go g ON g.cluster_id = q.cluster_id WHERE q.pos >= g.core_hi OR q.pos < g.core_lo"),
    ("rco", "SELECT g.cluster_id, CAST(coalesce(least(g.core_lo, min(x.pos)), g.core_lo) AS INT) AS core_lo, CAST(coalesce(greatest(g.core_hi, max(x.pos) + 1), g.core_hi) AS INT) AS core_hi, concat(coalesce(string_agg(x.letter, '' ORDER BY x.pos) FILTER (x.pos < g.core_lo), ''), g.core, coalesce(string_agg(x.letter, '' ORDER BY x.pos) FILTER (x.pos >= g.core_hi), '')) AS core FROM go g LEFT JOIN rae x ON x.cluster_id = g.cluster_id GROUP BY g.cluster_id, g.core_lo, g.core_hi, g.core"),
    ("siv", "SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(3.0::DOUBLE - shared)) AS v FROM sim"),
]
#: Steps that several others read.
_OFTEN = {"reads", "idx", "win", "post", "gat", "ori", "bas", "pil", "pro", "cmp", "att", "ext", "vl", "wl", "yl", "vo", "gon", "kpr", "gat2", "gclm", "gpos", "go", "rpl", "rpr", "clm", "fai"}


def _sql(last: str, raw: bool = False) -> str:
    """A query over the chain, with the steps that it uses."""
    text, used = last, []
    for name, body in reversed(_CHAIN):
        if re.search(rf"\b{name}\b", text):
            used.append(f"{name} AS {'MATERIALIZED ' if name in _OFTEN else ''}({body})")
            text += " " + body
    views = [v for v, on in ((fixtures.READS_SQL, re.search(r"\breads\b", text)), (fixtures.RAW_SQL, raw)) if on]
    return "WITH RECURSIVE " + ",\n".join([*views, *reversed(used)]) + "\n" + last


def _text(x: str) -> str:
    """The text of a k-mer in the chain's numbers."""
    return f"translate(CAST({x} AS VARCHAR), '1234', 'ACGT')"


def _r(x: str, digits: int = 9) -> F.Column:
    return F.round(F.col(x), digits).alias(x)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _sql(sql, raw)
        return f

    return add


@query("SELECT cluster_id, core, length FROM con")
def consensus_contig(spark, d):
    """Reads to first-round contigs: k-mers, postings, seeds, gather, pileup, extension."""
    return Flow(spark, d).contigs()


@query("SELECT read_id, CAST(length(regexp_extract(upper(seq), '^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)', 1)) - 1 AS INT) AS cut_at, CASE WHEN length(regexp_extract(upper(seq), '^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)', 1)) = 0 THEN seq WHEN length(regexp_extract(upper(seq), '^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)', 1)) > 36 THEN substr(seq, 1, length(regexp_extract(upper(seq), '^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)', 1)) - 1) END AS masked FROM raw_reads", raw=True)
def mask_ncut(spark, d):
    return mask.cut(fixtures.raw_reads(spark, d).select("read_id", "seq")).select("read_id", "cut_at", "masked")


_MASK_RAW = """, rc AS (SELECT *, length(regexp_extract(upper(seq), '^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)', 1)) - 1 AS cut_at FROM raw_reads),
rm AS (SELECT *, CASE WHEN cut_at < 0 THEN seq WHEN cut_at > 35 THEN substr(seq, 1, cut_at) END AS m FROM rc)"""
_CHOICE = "array_to_string(list_transform(range(0, length(m)), lambda i: CASE WHEN upper(substr(m, i + 1, 1)) = 'N' THEN substr('ACGT', CAST((read_id * 31 + i * 7 + read_id // 13) % 4 + 1 AS INT), 1) ELSE substr(m, i + 1, 1) END), '')"


def _raw_sql(last: str) -> str:
    return "WITH " + fixtures.RAW_SQL + _MASK_RAW + "\n" + last


@query()
def mask_substitute(spark, d):
    return mask.mask(fixtures.raw_reads(spark, d).select("read_id", "seq"))


_SQL["mask_substitute"] = _raw_sql(f"SELECT read_id, {_CHOICE} AS seq FROM rm WHERE m IS NOT NULL")


@query()
def mask_pair_filter(spark, d):
    """Neighbouring tiles of a document are mates."""
    r = fixtures.raw_reads(spark, d)
    pair = F.col("doc_id") * 10_000_000 + F.floor(F.col("pos") / (2 * fixtures.STEP))
    return mask.mask_pairs(r.select("read_id", "seq", pair.alias("pair")))


_SQL["mask_pair_filter"] = _raw_sql(f"SELECT read_id, pair, {_CHOICE} AS seq FROM (SELECT *, bool_and(m IS NOT NULL) OVER (PARTITION BY pair) AS ok FROM (SELECT *, doc_id * 10000000 + pos // 30 AS pair FROM rm)) WHERE ok")


@query("SELECT read_id, translate(seq, 'ACGT', 'TGCA') AS comp, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def revcomp(spark, d):
    return fixtures.reads(spark, d).select("read_id", dna.complement(F.col("seq")).alias("comp"), dna.revcomp(F.col("seq")).alias("rc"))


@query("SELECT read_id, seq FROM idx")
def discard_reads(spark, d):
    return Flow(spark, d).usable


@query(f"SELECT {_text('kmer')} AS kmer, n FROM good")
def discard_kmers(spark, d):
    return kmers.as_text(Flow(spark, d).counts().where(~kmers.low_complexity(F.col("kmer"), K, P.kmer_low_complexity)), K)


@query(f"SELECT {_text('kmer')} AS kmer, n FROM cnt")
def kmer_spectrum(spark, d):
    return Flow(spark, d).texts()


@query(f"SELECT {_text('kmer')} AS kmer, CAST(list_sum(list_transform(range(1, {K + 1}), lambda i: CAST(substr(CAST(kmer AS VARCHAR), i, 1) AS BIGINT) - 1 << (2 * ({K} - i)))) AS BIGINT) AS code FROM cnt")
def kmer_encode(spark, d):
    return Flow(spark, d).texts().select("kmer", kmers.encoded(F.col("kmer")).alias("code"))


@query(f"SELECT {_text('kmer')} AS text, n FROM cnt")
def kmer_decode(spark, d):
    return Flow(spark, d).texts().select(kmers.decoded(kmers.encoded(F.col("kmer")), K).alias("text"), "n")


@query(f"SELECT {_text('kmer')} AS kmer, n_reads FROM (SELECT kmer, count(*) AS n_reads FROM (SELECT DISTINCT kmer, read_id FROM win) GROUP BY kmer)")
def kmer_doc_freq(spark, d):
    return kmers.document_frequency(Flow(spark, d).lazy, K, text=True)


@query(f"SELECT {_text('kmer')} AS kmer, read_id, spos FROM post")
def postings(spark, d):
    f = Flow(spark, d)
    return kmers.as_text(kmers.postings(f.usable, K, f.counts(), P.kmer_low_complexity), K)  # read once, so not written


@query("SELECT CAST(max(length(seq)) AS INT) AS max_len FROM idx")
def max_read_length(spark, d):
    return Flow(spark, d).usable.agg(F.max(F.length("seq")).alias("max_len"))


@query("SELECT read_id FROM seeds")
def seed_admission(spark, d):
    return Flow(spark, d).seeds()


@query(f"SELECT read_id, seq FROM reads WHERE read_id >= {100 * fixtures.ID_STEP} AND read_id < {200 * fixtures.ID_STEP}")
def seed_range(spark, d):
    """The half-open id range of the start and end options is the feature here."""
    r = Flow(spark, d).reads
    return r.where((F.col("read_id") >= 100 * fixtures.ID_STEP) & (F.col("read_id") < 200 * fixtures.ID_STEP)).select("read_id", "seq")


@query("SELECT cluster_id, read_id, loc, rc, multi FROM gat")
def gather_first_hit(spark, d):
    return Flow(spark, d).gathered()


@query("SELECT read_id, CAST(sum(multi) AS BIGINT) AS hits, count(*) AS clusters, CAST(count(*) AS DOUBLE) AS weight FROM gat GROUP BY read_id")
def gather_multiplicity(spark, d):
    g = Flow(spark, d).gathered().withColumn("w", dna.multi_weight(F.col("multi")))
    return g.groupBy("read_id").agg(F.sum("multi").alias("hits"), F.count("*").alias("clusters"), F.sum("w").alias("weight"))


@query("SELECT read_id, coalesce(n, 0) AS n FROM idx LEFT JOIN (SELECT read_id, count(*) AS n FROM gat GROUP BY read_id) USING (read_id)")
def retrieval_counts(spark, d):
    f = Flow(spark, d)
    return gather.retrieval_counts(f.gathered(), f.usable)


@query(f"SELECT h.cluster_id, h.read_id, k_end, loc, rc FROM hits h LEFT JOIN clm c ON c.read_id = h.read_id LEFT JOIN fai f ON f.read_id = h.read_id WHERE CASE WHEN coalesce(f.n, 0) < {P.failure_limit} THEN c.cluster_id IS NULL OR c.cluster_id <> h.cluster_id ELSE c.cluster_id IS NULL END")
def claim_anti_join(spark, d):
    f = Flow(spark, d)
    return gather.usable(f.hits(), f.claims(), f.failures(), P.failure_limit, P.reuse_reads, P.strict_failures).select("cluster_id", "read_id", "k_end", "loc", "rc")


@query("SELECT cluster_id, read_id, loc, rc, multi, oseq FROM ori")
def orient_reads(spark, d):
    return Flow(spark, d).oriented()


@query("SELECT * FROM pil")
def pileup_counts(spark, d):
    return Flow(spark, d).counted()


@query("SELECT * FROM (SELECT cluster_id, pos, " + ", ".join(f"CAST(sum(CAST(base = '{b}' AS INT)) AS BIGINT) AS c{b}" for b in "ACGT") + " FROM bas b WHERE read_id NOT IN (SELECT read_id FROM fai) GROUP BY cluster_id, pos)")
def pileup_subtract(spark, d):
    """The counts of reads that failed anywhere are taken out."""
    f = Flow(spark, d)
    return pileup.subtract(f.counted(), pileup.counts(f.bases().join(f.failures(), "read_id", "left_semi")))


@query("SELECT cluster_id, pos, round(pA, 9) AS pA, round(pC, 9) AS pC, round(pG, 9) AS pG, round(pT, 9) AS pT, round(entropy, 9) AS entropy, letter FROM pro")
def column_profile(spark, d):
    return Flow(spark, d).profile().select("cluster_id", "pos", *(_r(x) for x in ("pA", "pC", "pG", "pT", "entropy")), "letter")


@query("SELECT cluster_id, pos, letter, round(entropy, 9) AS entropy FROM exr")
def extend_right(spark, d):
    return Flow(spark, d).extension(True).select("cluster_id", "pos", "letter", _r("entropy"))


@query("SELECT cluster_id, pos, letter, round(entropy, 9) AS entropy FROM exl")
def extend_left(spark, d):
    return Flow(spark, d).extension(False).select("cluster_id", "pos", "letter", _r("entropy"))


@query(f"SELECT cluster_id, pos, cA, cC, cG, cT, round(entropy, 9) AS entropy FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS nth FROM ext JOIN con USING (cluster_id)) WHERE nth <= {P.column_cap}")
def contig_columns_top200(spark, d):
    """The format keeps a contig's first 200 columns; the cap is the feature."""
    f = Flow(spark, d)
    x = f.extension(True).unionByName(f.extension(False)).join(f.contigs().select("cluster_id"), "cluster_id")
    return sinks.contig_columns(x, P.column_cap).select("cluster_id", F.explode("cols").alias("c")).select("cluster_id", "c.pos", "c.cA", "c.cC", "c.cG", "c.cT", F.round("c.entropy", 9).alias("entropy"))


@query("SELECT p.* FROM pil p JOIN cor c ON c.cluster_id = p.cluster_id WHERE p.pos >= c.core_lo AND p.pos < c.core_hi")
def carry_core_only(spark, d):
    f = Flow(spark, d)
    return pileup.carry_core(f.counted(), f.cores())


@query("SELECT cluster_id, pos, n_reads FROM ecs")
def error_columns(spark, d):
    return pileup.error_columns(Flow(spark, d).errors(), P.rare_column)


@query("SELECT cluster_id, pos_i, pos_j, shared, round(v, 9) AS v FROM siv")
def column_similarity(spark, d):
    f = Flow(spark, d)
    e = f.errors()
    return pileup.column_similarity(e, pileup.error_columns(e, P.rare_column)).select("cluster_id", "pos_i", "pos_j", "shared", _r("v"))


@query("""SELECT cluster_id, i, j, round(value, 9) AS value FROM (
WITH b AS (SELECT cluster_id, pos_i AS i, pos_j AS j, v FROM siv UNION ALL SELECT cluster_id, pos_j, pos_i, v FROM siv), d AS (SELECT cluster_id, i, sum(v) AS d FROM b GROUP BY 1, 2)
SELECT b.cluster_id, b.i, b.j, -b.v / sqrt((x.d + 1) * (y.d + 1)) AS value FROM b JOIN d x ON x.cluster_id = b.cluster_id AND x.i = b.i JOIN d y ON y.cluster_id = b.cluster_id AND y.i = b.j
UNION ALL SELECT cluster_id, i, i, d / (d + 1) FROM d)""")
def laplacian_entries(spark, d):
    f = Flow(spark, d)
    e = f.errors()
    return pileup.laplacian(pileup.column_similarity(e, pileup.error_columns(e, P.rare_column))).select("cluster_id", "i", "j", _r("value"))


@query(f"SELECT cluster_id, read_id, n_core, n_all, n_core > {P.max_core_errors} OR n_all >= {P.max_pre_corrected_errors} AS dropped FROM (SELECT e.cluster_id, e.read_id, CAST(sum(CAST(e.pos >= c.core_lo AND e.pos < c.core_hi AS INT)) AS INT) AS n_core, CAST(count(*) AS INT) AS n_all FROM err e JOIN cor c ON c.cluster_id = e.cluster_id GROUP BY 1, 2)")
def error_caps(spark, d):
    f = Flow(spark, d)
    return ungapped.error_caps(f.errors(), f.cores(), P.max_core_errors, P.max_pre_corrected_errors)


@query("SELECT cluster_id, read_id, n_sub, round(llh, 6) AS llh, corrected FROM att")
def correct_ungapped(spark, d):
    return Flow(spark, d).attempts().select("cluster_id", "read_id", "n_sub", _r("llh", 6), "corrected")


@query("SELECT read_id, pos, kind, bases FROM sub")
def correction_positions(spark, d):
    return Flow(spark, d).substitutions()


@query("SELECT read_id, cluster_id, won, matched FROM won")
def first_claim_wins(spark, d):
    return Flow(spark, d).won()


@query("SELECT read_id, n FROM fai")
def failure_saturation(spark, d):
    return Flow(spark, d).failures()


@query("SELECT read_id, status, seq, status <> '' AS claimed FROM sta")
def read_status(spark, d):
    f = Flow(spark, d)
    return claims.status(f.reads, f.claims()).withColumn("claimed", F.col("status") != "").orderBy("read_id")


@query("SELECT r.read_id, concat('read', r.read_id) AS name, CASE WHEN m.seq IS NULL THEN NULL WHEN c.corrected IS NULL THEN '' WHEN c.corrected <> r.seq THEN 'Corrected' ELSE 'Assigned' END AS status, CASE WHEN m.seq IS NULL THEN r.seq ELSE coalesce(c.corrected, m.seq) END AS seq FROM reads r LEFT JOIN msk m ON m.read_id = r.read_id LEFT JOIN clm c ON c.read_id = r.read_id")
def restore_ids(spark, d):
    f = Flow(spark, d)
    originals = f.reads.select("read_id", F.concat(F.lit("read"), "read_id").alias("name"), "seq")
    done = claims.status(f.reads, f.claims()).where("status != ''")
    return claims.restore(originals, f.masked(), done)


@query("SELECT (SELECT count(*) FROM clm) AS accepted, (SELECT count(*) FROM sta WHERE status = 'Corrected') AS corrected, (SELECT count(*) FROM won WHERE NOT won) AS collided, (SELECT count(*) FROM won WHERE NOT won AND NOT matched) AS bad_collided, (SELECT count(*) FROM sub) AS n_sub, CAST(0 AS BIGINT) AS n_del, CAST(0 AS BIGINT) AS n_ins")
def summary_counters(spark, d):
    f = Flow(spark, d)
    return claims.summary(f.attempts(), f.claims().join(f.reads.select("read_id", "seq"), "read_id"), f.substitutions())


@query(f"SELECT {_text('kmer')} AS kmer, n FROM cnt")
def kmer_counts_file(spark, d):
    """The spectrum written as a count file and read back."""
    from .sources import files

    path = sinks.scratch(spark, "kmers.txt")
    sinks.write_kmer_counts(Flow(spark, d).texts(), path, "gzip")  # lines take many times the space of the texts
    return files.read_kmer_counts(spark, path)


@query("SELECT read_id, doc_id FROM reads WHERE doc_id IN (SELECT item_id FROM benchmark)")
def interesting_reads(spark, d):
    """Reads on a list: those of documents whose number is also an item's."""
    chosen = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"))
    return Flow(spark, d).reads.select("read_id", "doc_id").join(chosen, "doc_id", "left_semi")


@query("SELECT cluster_id, pos, round(CASE WHEN cA = 0 THEN ln(cC + 1) WHEN cC = 0 THEN ln(cA + 1) ELSE greatest(ln(cA), ln(cC)) + ln(1 + exp(-abs(ln(cA) - ln(cC)))) END, 6) AS x FROM (SELECT cluster_id, pos, CAST(cA AS DOUBLE) AS cA, CAST(cC AS DOUBLE) AS cC FROM pil)")
def logsumexp(spark, d):
    """ln(e^a + e^b) of a column's log counts; minus infinity stands for none."""
    low = F.lit(float("-inf"))
    x = Flow(spark, d).counted().select("cluster_id", "pos", F.col("cA").cast("double"), F.col("cC").cast("double"))
    a = F.when(F.col("cA") == 0, low).when(F.col("cC") == 0, F.log(F.col("cA") + 1)).otherwise(F.log("cA"))
    b = F.when(F.col("cC") == 0, low).when(F.col("cA") == 0, F.log(F.col("cC") + 1)).otherwise(F.log("cC"))
    v = dna.log_sum_exp(a, b)
    return x.select("cluster_id", "pos", F.round(F.when(v == low, 0.0).otherwise(v), 6).alias("x"))


@query("SELECT read_id, concat('read', read_id) AS name, seq FROM reads")
def fastx_roundtrip(spark, d):
    """Reads written as FASTA and read back with their names."""
    from .sources import fastx

    path = sinks.scratch(spark, "reads.fa")
    sinks.write_fasta(fixtures.reads(spark, d).select(F.concat(F.lit("read"), "read_id").alias("name"), "seq"), path)
    back = fastx.read_fastx(spark, path)
    return back.select(F.regexp_extract("name", r"^read(-?\d+)$", 1).cast("long").alias("read_id"), "name", "seq")


@query()
def paired_store(spark, d):
    """Mates written as FASTQ, two folders for each, read back as one paired store, masked in pairs, written with their numbers and read back: dropped
    pairs leave gaps. A read's mate is the read backwards."""
    from .sources import fastx, files

    r = fixtures.raw_reads(spark, d).select("read_id", (F.col("doc_id") % 2).alias("half"), F.concat(F.lit("p"), "read_id").alias("name"), "seq")
    r = sinks.materialize(r, "mates")
    lists = []
    for mate in (0, 1):
        paths = [sinks.scratch(spark, f"mate{mate}_{half}.fq") for half in (0, 1)]
        for half, path in enumerate(paths):
            x = r.where(F.col("half") == half).select("read_id", F.concat("name", F.lit(f"/{mate + 1}")).alias("name"), F.reverse("seq").alias("seq") if mate else "seq")
            sinks.write_fastq(x, path, "read_id")
        lists.append(",".join(paths))
    store = sinks.materialize(fastx.read_store(spark, *lists), "store")
    path = sinks.scratch(spark, "masked.fa")
    sinks.write_masked(mask.mask_pairs(store.select("read_id", "seq", F.floor(F.col("read_id") / 2).alias("pair"))), path)
    return files.read_masked(spark, path).join(store.select("read_id", "mate", "name"), "read_id").select("read_id", "mate", "name", "seq")


_SQL["paired_store"] = f"""WITH {fixtures.RAW_SQL},
num AS (SELECT *, row_number() OVER (ORDER BY doc_id % 2, read_id) - 1 AS pair FROM raw_reads),
sto AS (SELECT 2 * pair AS read_id, 0 AS mate, 'p' || read_id || '/1' AS name, seq FROM num UNION ALL SELECT 2 * pair + 1, 1, 'p' || read_id || '/2', reverse(seq) FROM num),
cuts AS (SELECT *, length(regexp_extract(upper(seq), '^(.*?N[^N]{{0,3}}N[^N]{{0,3}}N[^N]{{0,3}}N)', 1)) - 1 AS cut_at FROM sto),
mas AS (SELECT read_id, mate, name, CASE WHEN cut_at < 0 THEN seq WHEN cut_at > 35 THEN substr(seq, 1, cut_at) END AS m FROM cuts)
SELECT read_id, mate, name, {_CHOICE} AS seq FROM (SELECT *, bool_and(m IS NOT NULL) OVER (PARTITION BY read_id // 2) AS ok FROM mas) WHERE ok"""


@query(f"SELECT o.cluster_id, o.read_id, round(o.llh, 9) AS llh, o.corrected, o.n_sub, o.n_del, o.n_ins, o.first >= c.core_lo AND o.last < c.core_hi AS fitted, o.first >= c.core_lo AND o.last < c.core_hi AND o.llh > {P.cluster_llh} AND o.n_sub + o.n_del + o.n_ins < {P.max_corrections} AS ok FROM vo o JOIN cor c ON c.cluster_id = o.cluster_id")
def viterbi_correct(spark, d):
    """Gapped correction of the first round's gathered reads: banded alignment, then the caps."""
    f = Flow(spark, d)
    out = viterbi.accepted(f.aligned(), f.cores(), P)
    return out.select("cluster_id", "read_id", _r("llh"), "corrected", "n_sub", "n_del", "n_ins", "fitted", "ok")


@query(f"SELECT i.cluster_id, i.read_id, CAST(coalesce(len(o.errs), 0) AS INT) AS n_errors, coalesce(len(o.errs), 0) < {P.max_core_errors} AS near FROM inf i LEFT JOIN wo o ON o.cluster_id = i.cluster_id AND o.read_id = i.read_id")
def estimate_errors(spark, d):
    """How many errors, gaps included, the part of each gathered read over its cluster's core has (without the core's outer two
    columns; none if nothing is left), and whether that is under the cap."""
    f = Flow(spark, d)
    x = f.oriented().join(f.cores(), "cluster_id")
    loc, size = F.col("loc") - F.col("core_lo"), F.col("core_hi") - F.col("core_lo")
    start = F.greatest(F.lit(0), 2 - loc)
    part = x.select("cluster_id", "read_id", (F.col("loc") + start).cast("int").alias("loc"), dna.overlap_infix(F.col("oseq"), loc, size).alias("oseq"))
    part = sinks.materialize(part, "infix")
    out = viterbi.align_reads(part.where("oseq != ''"), f.counted(), P).select("cluster_id", "read_id", F.size("errors").alias("n_errors"))
    out = out.unionByName(part.where("oseq = ''").select("cluster_id", "read_id", F.lit(0).alias("n_errors")))
    return out.withColumn("near", F.col("n_errors") < P.max_core_errors)


@query(f"""SELECT cluster_id, read_id, CAST(least(max(n_core), {P.max_core_errors + 1}) AS INT) AS n_core, CAST(sum(CAST(n_core <= {P.max_core_errors} AS INT)) AS INT) AS n_all, max(n_core) > {P.max_core_errors} OR sum(CAST(n_core <= {P.max_core_errors} AS INT)) >= {P.max_pre_corrected_errors} AS dropped FROM (
  SELECT e.cluster_id, e.read_id, sum(CAST(coalesce(e.pos >= c.core_lo AND e.pos < c.core_hi, false) AS INT)) OVER (PARTITION BY e.cluster_id, e.read_id ORDER BY e.step) AS n_core
  FROM (SELECT cluster_id, read_id, generate_subscripts(errs, 1) AS step, unnest(errs) AS pos FROM vo) e JOIN (SELECT cluster_id, min(pos) AS lo, max(pos) + 1 AS hi FROM pil GROUP BY cluster_id) s ON s.cluster_id = e.cluster_id AND e.pos >= s.lo AND e.pos < s.hi LEFT JOIN cor c ON c.cluster_id = e.cluster_id) GROUP BY cluster_id, read_id""")
def gapped_error_caps(spark, d):
    """The error caps over gapped alignments: errors inside the core up to one more than the cap, errors that count, and whether the read goes."""
    f = Flow(spark, d)
    x = spectral.capped(f.aligned(), f.cores(), pileup.spans(f.counted()), P)
    return x.select("cluster_id", "read_id", "n_core", "n_all", "dropped").distinct()


@query("SELECT k.cluster_id, k.read_id, CAST(k.loc - coalesce(a.anchor, 0) AS INT) AS loc, k.rc, k.multi FROM kpt k LEFT JOIN anc a ON a.cluster_id = k.cluster_id")
def reanchored_placements(spark, d):
    """The reads that the caps leave, each thinned cluster moved so that its largest start is 0."""
    f = Flow(spark, d)
    return gather.moved(f.kept().drop("oseq"), f.anchors(), "loc")


@query("SELECT cluster_id, CAST(rel AS INT) AS pos, cA, cC, cG, cT, round(entropy, 9) AS entropy, letter FROM kac")
def reanchored_profile(spark, d):
    """The profile of what the caps leave, moved with the placements."""
    f = Flow(spark, d)
    prof = pileup.profile(pileup.subtract(f.counted(), pileup.counts(pileup.bases(f.thinned().where("gone")))), P.pseudocount)
    return gather.moved(prof, f.anchors(), "pos").select("cluster_id", "pos", *(f"c{b}" for b in dna.BASES), _r("entropy"), "letter")


@query(f"SELECT cluster_id, CAST(min(rel) AS INT) AS core_lo, CAST(max(rel) + 1 AS INT) AS core_hi, string_agg(letter, '' ORDER BY pos) AS core FROM kae GROUP BY cluster_id HAVING count(*) > {K}")
def reanchored_contig(spark, d):
    """First-round contigs after thinning: extended from the anchor, places counted from it."""
    f = Flow(spark, d)
    ids = f.oriented().select("cluster_id").distinct()
    live = gather.anchored(ids.select("cluster_id", F.lit(0).alias("core_lo"), F.lit(0).alias("core_hi"), F.lit("").alias("core")), f.kept(), f.thinned().where("gone"))
    left = pileup.subtract(f.counted(), pileup.counts(pileup.bases(f.thinned().where("gone"))))
    prof = pileup.profile(left, P.pseudocount).join(live.select("cluster_id", "core_lo", "core_hi"), "cluster_id")
    new = gather.extension(prof, P.entropy)
    x = gather.spliced(live, new).where(F.length("core") > K)
    return x.select("cluster_id", (F.col("core_lo") - F.col("old_lo")).cast("int").alias("core_lo"), (F.col("core_hi") - F.col("old_lo")).cast("int").alias("core_hi"), "core")


@query("SELECT read_id, cluster_id, corrected, CAST(len(eds) AS INT) AS n_edits FROM gclm")
def assign_gapped(spark, d):
    """Reads with the cluster that gets them, after gapped alignment, on their own strand."""
    return Flow(spark, d).gapped_claims().select("read_id", "cluster_id", "corrected", F.size("edits").alias("n_edits"))


@query("SELECT read_id, pos, kind, bases FROM gpos")
def correction_positions_gapped(spark, d):
    """Substitutions, deletions and insertions of the reads that a cluster got, at places of the read as sequenced."""
    f = Flow(spark, d)
    return claims.positions(f.gapped_claims(), f.reads)


@query(f"SELECT read_id, CAST(least(count(*), {P.failure_limit}) AS INT) AS n FROM (SELECT read_id FROM gon UNION ALL SELECT read_id FROM gat2 WHERE few AND fitted AND NOT likely) GROUP BY read_id")
def failures_gapped(spark, d):
    """Failure reports of the first round: reads over the caps, and fitted ones with few edits that are unlikely."""
    f = Flow(spark, d)
    few = F.col("n_sub") + F.col("n_del") + F.col("n_ins") < P.max_corrections
    bad = f.fitted().where(~F.col("ok") & F.col("fitted") & few).select("read_id")
    return claims.saturate(f.thinned().where("gone").select("read_id").unionByName(bad), P.failure_limit)


@query("""SELECT (SELECT count(*) FROM gclm) AS accepted, (SELECT count(*) FROM gclm c JOIN reads r ON r.read_id = c.read_id WHERE c.corrected <> r.seq) AS corrected, (SELECT count(*) FROM gatt) - (SELECT count(*) FROM gclm) AS collided,
  (SELECT count(*) FROM gatt a JOIN gclm c ON c.read_id = a.read_id JOIN gatt b ON b.read_id = c.read_id AND b.cluster_id = c.cluster_id WHERE a.cluster_id <> c.cluster_id AND a.corrected <> b.corrected) AS bad_collided,
  (SELECT count(*) FROM gpos WHERE kind = 'M') AS n_sub, (SELECT count(*) FROM gpos WHERE kind = 'D') AS n_del, (SELECT count(*) FROM gpos WHERE kind = 'I') AS n_ins""")
def summary_gapped(spark, d):
    f = Flow(spark, d)
    return claims.summary(f.fitted().where("ok").select("read_id", "cluster_id", "corrected"), f.gapped_claims().join(f.reads.select("read_id", "seq"), "read_id"), claims.positions(f.gapped_claims(), f.reads))


@query("SELECT cluster_id, read_id, loc, rc, multi FROM rga")
def regather_reads(spark, d):
    """The second round's reads: found by the ends of grown cores, free to be used, sticking out, and near the core where they overlap it."""
    return Flow(spark, d).regathered().select("cluster_id", "read_id", "loc", "rc", "multi")


@query("SELECT cluster_id, core_lo, core_hi, core FROM rco")
def regather_contig(spark, d):
    """Round two's clusters: carried counts and the new reads' bases, extended from the first round's cores, which stay as they are."""
    f = Flow(spark, d)
    go = f.going().select("cluster_id", "core_lo", "core_hi", "core")
    prof = f.second_profile().join(go.select("cluster_id", "core_lo", "core_hi"), "cluster_id")
    new = gather.extension(prof, P.entropy)
    return gather.spliced(go, new).select("cluster_id", "core_lo", "core_hi", "core")


@query()
def spectral_filter(spark, d):
    """Reads that the error caps or the spectral clustering of error columns leave out."""
    f = Flow(spark, d)
    return spectral.filter_reads(f.aligned(), f.cores(), pileup.spans(f.counted()), P)


@query("SELECT p.cluster_id, p.pos, " + ", ".join(f"round(coalesce(sum(z.post) FILTER (z.base = '{b}'), 0), 6) AS v{b}" for b in "ACGT") + """ FROM (SELECT cluster_id, unnest(range(min(pos), max(pos) + 1)) AS pos FROM pil GROUP BY cluster_id) p
  LEFT JOIN (SELECT q.cluster_id, l.loc + q.i - 1 + q.o - 2 AS pos, substr(l.oseq, CAST(q.i AS INT), 1) AS base, q.post FROM zq q JOIN vl l ON l.cluster_id = q.cluster_id AND l.read_id = q.read_id) z ON z.cluster_id = p.cluster_id AND z.pos = p.pos GROUP BY p.cluster_id, p.pos""")
def expected_counts(spark, d):
    """Posteriors over all alignments in the band, added up: the expected bases of each column (the E step of the learning)."""
    f = Flow(spark, d)
    out = em.expected_counts(f.oriented(), f.counted(), P)
    return out.select("cluster_id", "pos", *(F.round(f"v{b}", 6).alias(f"v{b}") for b in dna.BASES))


@query()
def em_profile(spark, d):
    """Soft counts of each column after stepwise EM."""
    f = Flow(spark, d)
    out = em.em_profiles(f.oriented(), f.counted(), f.cores(), P)
    return out.select("cluster_id", "pos", *(F.round(f"v{b}", 6).alias(f"v{b}") for b in dna.BASES))


@query()
def correct_reads(spark, d):
    """Correction of all reads, in rounds until no cluster is active and no seed is admissible; reads that no cluster claims pass through."""
    from .plans.correct import Correction

    return Correction(fixtures.reads(spark, d), P).run().status()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
