"""Banded alignment, spectral filter and EM against slow scalar versions and planted cases."""

import itertools
import math
import random

import numpy as np
import pytest

from seqloom.operators import em, spectral
from seqloom.operators import viterbi as v
from seqloom.params import Params

LOW = float("-inf")


def profile_of(core, depth=8, start=0):
    c = np.zeros((len(core), 4))
    for i, b in enumerate(core):
        c[i, "ACGT".index(b)] = depth
    return v.make_profile(start, c, 0.01)


def best_by_recursion(p, seq, est):
    """The recurrences, one cell at a time."""
    t = v.T
    cell = {}
    for o, s in itertools.product(range(5), range(3)):
        cell[0, o, s] = LOW
    cell[0, 2, 0] = 0.0
    for j in (1, 2):
        cell[0, 2 - j, 0], cell[0, 2 + j, 0] = j * t[0, 1], j * t[0, 2]
    for i in range(1, len(seq) + 1):
        for o in range(5):
            pos = est + i - 1 + o - 2
            at = pos - p.start
            emit = p.logp[at, "ACGT".index(seq[i - 1])] if 0 <= at < len(p.logp) else math.log(0.25)
            cell[i, o, 0] = emit + max(cell[i - 1, o, s] + t[s, 0] for s in range(3))
            cell[i, o, 2] = math.log(0.25) + max(cell[i - 1, o + 1, s] + t[s, 2] for s in range(3)) if o < 4 else LOW
        for o in range(5):
            cell[i, o, 1] = max(cell[i, o - 1, s] + t[s, 1] for s in range(3)) if o else LOW
    return max(cell[len(seq), o, s] for o in range(5) for s in range(3))


@pytest.mark.parametrize("seed", range(12))
def test_score_equals_recursion(seed):
    r = random.Random(seed)
    core = "".join(r.choice("ACGT") for _ in range(40))
    seq = list(core[5:30])
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(seq))
        seq[k : k + 1] = r.choice([[], [r.choice("ACGT")], [seq[k], "A"]])
    seq = "".join(seq)
    p = profile_of(core)
    a = v.align(p, [seq], [5])[0]
    assert a.llh * len(seq) == pytest.approx(best_by_recursion(p, seq, 5), abs=1e-6)


def replay(seq, edits):
    """Edits applied to the read give the corrected read."""
    out, dels = [], {}
    subs, drop = {}, set()
    for pos, kind, bases in edits:
        if kind == "M":
            subs[pos] = bases[1]
        elif kind == "I":
            drop.add(pos)
        else:
            dels.setdefault(pos, []).append(bases)
    out += dels.get(-1, [])
    for i in range(len(seq)):
        if i not in drop:
            out.append(subs.get(i, seq[i]))
        out += dels.get(i, [])
    return "".join(out)


def test_planted_edits_are_undone():
    r = random.Random(7)
    core = "".join(r.choice("ACGT") for _ in range(60))
    p = profile_of(core)
    clean = core[10:45]
    sub = clean[:17] + ("A" if clean[17] != "A" else "C") + clean[18:]
    for seq in (clean, sub, clean[:17] + clean[18:], clean[:17] + ("G" if clean[17] != "G" else "T") + clean[17:]):
        a = v.align(p, [seq], [10])[0]
        assert a.corrected == clean and replay(seq, a.edits) == clean
    assert v.align(p, [clean], [10])[0].edits == []


def test_shifted_place_within_the_band():
    r = random.Random(8)
    core = "".join(r.choice("ACGT") for _ in range(60))
    core = core[:18] + "ACGTA" + core[23:]  # no other way to begin is cheaper
    p = profile_of(core)
    for shift in (-2, -1, 1, 2):
        a = v.align(p, [core[20:45]], [20 + shift])[0]
        assert a.corrected == core[20:45] and (a.first, a.last) == (20, 44)


def test_similar_probabilities_are_left_alone():
    c = np.full((5, 4), 0.0)
    c[:, 0], c[:, 1] = 10, 9.5
    p = v.make_profile(0, c, 0.01)
    assert v.align(p, ["ACAAA"], [0])[0].edits == []
    c[:, 1] = 3
    assert v.align(v.make_profile(0, c, 0.01), ["ACAAA"], [0], 0.1)[0].corrected == "AAAAA"


def test_reads_of_several_lengths_and_none():
    p = profile_of("ACGTACGTAC")
    out = v.align(p, ["ACGT", "", "CGTACG"], [0, 0, 1])
    assert [a.corrected for a in out] == ["ACGT", "", "CGTACG"]
    assert v.align(v.make_profile(0, np.zeros((0, 4)), 0.01), ["AC"], [0])[0].corrected == "AC"


def test_pivoted_qr_reconstructs():
    x = np.random.default_rng(1).normal(size=(4, 9))
    r, piv = spectral.pivoted_qr(x)
    assert np.allclose(np.abs(np.linalg.det(r[:, :4])), np.abs(np.linalg.det(x[:, piv[:4]])))
    assert np.allclose(r.T @ r, x[:, piv].T @ x[:, piv]) and np.allclose(np.tril(r[:, :4], -1), 0)


def outliers(errors, rare=3):
    """Reads to drop, from {column: reads that err there}: the filter in plain Python."""
    cols = sorted(c for c, r in errors.items() if len(r) > rare)
    if len(cols) < 2:
        return set()
    sets = [errors[c] for c in cols]
    gone = set()
    for g in spectral.column_groups(np.array([[len(a & b) for b in sets] for a in sets])):
        if len(g) > 1:
            count = {}
            for c in g:
                for r in sets[c]:
                    count[r] = count.get(r, 0) + 1
            gone |= {r for r, n in count.items() if n > min(3, len(g) // 2)}
    return gone


def test_two_haplotypes_split():
    """Reads 0-5 err together in columns 1-6, reads 10-15 in 11-16; both groups are outliers of one consensus."""
    errors = {c: set(range(6)) for c in range(1, 7)} | {c: set(range(10, 16)) for c in range(11, 17)}
    assert outliers(errors) == set(range(6)) | set(range(10, 16))
    groups = spectral.column_groups(np.array([[len(a & b) for b in errors.values()] for a in errors.values()]))
    assert sorted(map(tuple, groups)) == [tuple(range(6)), tuple(range(6, 12))]


def walked(errors, lo, hi, core, p):
    """(columns that count, dropped) of one read: its path walked from the end, step by step."""
    seen, in_core, total = [], 0, 0
    for pos in reversed(errors):
        if lo <= pos < hi:
            if core and core[0] <= pos < core[1]:
                in_core += 1
                if in_core > p.max_core_errors:
                    return seen, True
            seen.append(pos)
            total += 1
    return seen, total >= p.max_pre_corrected_errors


@pytest.mark.parametrize("seed,thin", [(1, 0), (2, 0), (3, 12)])
def test_filter_equals_plain_python(spark, seed, thin):
    """Planted haplotypes, reads over the caps (repeats count, the margin does not), small clusters, clusters without a core."""
    r = random.Random(seed)
    p = Params(thin_over=thin)
    rows, cores, spans = [], {}, {}
    for c in range(6):
        n = r.choice([2, 9, 25])
        spans[c] = (-20, 100)
        if c != 3:
            cores[c] = (0, 70)
        for i in range(n):
            e = []
            if i % 3 == 0:
                e += r.sample([5, 12, 18, 27, 33], 5 if i % 2 else 3)
            if i % 3 == 1:
                e += [80, 84, 88, 92]
            e += [r.randrange(-24, 104) for _ in range(r.choice([0, 0, 1, 2, 9, 14]))]
            rows.append((c, 100 * c + i, sorted(e + e[:1] if i % 7 == 0 else e)))
    want = set()
    for c in range(6):
        own = [x for x in rows if x[0] == c]
        if len(own) <= thin:
            continue
        told = {rid: walked(e, *spans[c], cores.get(c), p) for _, rid, e in own}
        over = {rid for rid, (_, bad) in told.items() if bad}
        want |= {(c, rid, "caps") for rid in over}
        if len(own) - len(over) > 2:
            columns = {}
            for rid, (seen, _) in told.items():
                for pos in seen:
                    columns.setdefault(pos, set()).add(rid)
            want |= {(c, rid, "spectral") for rid in outliers(columns) - over}
    df = spark.createDataFrame([(*x, "z") for x in rows], "cluster_id long, read_id long, errors array<int>, pos string")
    core = spark.createDataFrame([(c, *x) for c, x in cores.items()], "cluster_id long, core_lo int, core_hi int")
    span = spark.createDataFrame([(c, *x) for c, x in spans.items()], "cluster_id long, lo int, hi int")
    assert {tuple(x) for x in spectral.filter_reads(df, core, span, p).collect()} == want and any(x[2] == "spectral" for x in want)
    assert spectral.filter_reads(df.where("false"), core, span, p).isEmpty()
    none = spark.createDataFrame([(0, 1, None), (0, 2, []), (0, 3, [1])], "cluster_id long, read_id long, errors array<int>")
    assert spectral.filter_reads(none, core, span, p).isEmpty()


def test_rare_and_single_columns_change_nothing():
    assert outliers({1: {1, 2, 3}, 2: {1, 2, 3}}) == set()
    assert outliers({1: {1, 2, 3, 4}}) == set() and outliers({}) == set()


def placed_rows(seed):
    r = random.Random(seed)
    rows, counts, cores = [], {}, {}
    for c in range(5):
        genome = "".join(r.choice("ACGT") for _ in range(90))
        cores[c] = (10, genome[10:70])
        for i in range(r.choice([3, 30])):
            at = r.randrange(60)
            s = list(genome[at : at + r.choice([12, 25, 30])])
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[s[k]], [r.choice("ACGT")], [], [s[k], "A"]])
            rows.append((c, 1000 * c + i, at + r.choice([0, 0, 0, 1, -2]), "".join(s)))
            for j, b in enumerate(s):
                counts.setdefault((c, at + j), [0, 0, 0, 0])["ACGT".index(b)] += 1
    return rows, counts, cores


@pytest.mark.parametrize("share", [5000, 7])
def test_align_reads_equals_one_by_one(spark, monkeypatch, share):
    """Reads of several clusters, with and without cores, whole clusters or shares of seven reads; a cluster without counts; awkward rows."""
    monkeypatch.setattr(v, "SHARE", share)
    monkeypatch.setattr(v, "HELD", 11)
    rows, counts, cores = placed_rows(4)
    rows += [(77, 5, 3, "ACGT"), (0, 999, 4, ""), (0, 998, 4, None)]
    rows += [rows[0]]
    placed = spark.createDataFrame([(*x, "z") for x in rows], "cluster_id long, read_id long, loc int, oseq string, corrected string").repartition(5)
    table = spark.createDataFrame([(c, pos, *n) for (c, pos), n in counts.items()], "cluster_id long, pos long, cA long, cC long, cG long, cT long")
    core = spark.createDataFrame([(c, lo, text) for c, (lo, text) in cores.items() if c != 2], "cluster_id long, core_lo int, core string")
    for with_core in (False, True):
        got = sorted((x.cluster_id, x.read_id, x.llh, x.first, x.last, x.corrected, x.n_sub, x.n_del, x.n_ins, tuple(tuple(e) for e in x.edits), tuple(x.errors)) for x in v.align_reads(placed, table, Params(), core if with_core else None).collect())
        want = []
        for c, rid, loc, s in rows:
            if s is None:
                continue
            own = {pos: n for (k, pos), n in counts.items() if k == c}
            lo = min(own, default=0)
            p = v.make_profile(lo, np.array([own.get(lo + i, [0] * 4) for i in range(max(own) - lo + 1)], float) if own else np.zeros((0, 4)), 0.01)
            if with_core and c in cores and c != 2:
                p.core_lo, p.core = cores[c][0], np.array(["ACGT".index(b) for b in cores[c][1]], np.int8)
            a = v.align(p, [s], [loc])[0]
            kinds = [k for _, k, _ in a.edits]
            want.append((c, rid, a.llh, a.first, a.last, a.corrected, kinds.count("M"), kinds.count("D"), kinds.count("I"), tuple(a.edits), tuple(a.errors)))
        assert got == sorted(want)
    assert v.align_reads(placed.where("false"), table).isEmpty()
    fit = spark.createDataFrame([(c, 10, 70) for c in cores], "cluster_id long, core_lo int, core_hi int")
    out = v.accepted(v.align_reads(placed, table), fit).collect()
    assert all(x.fitted == (x.first >= 10 and x.last < 70) and x.ok == (x.fitted and x.llh > -1 and x.n_sub + x.n_del + x.n_ins < 5) for x in out)
    assert 77 not in {x.cluster_id for x in out}


def test_correction_goes_to_the_core_and_errors_to_the_letter():
    """A column whose letter has changed since it became core: the read is corrected to the core, and its error is against the letter."""
    core = "GATTACAGATCCGTACAAGT"
    c = profile_of(core).prob * 8
    c[9] = [0, 0, 3, 9]
    p = v.make_profile(0, c, 0.01)
    p.core_lo, p.core = 0, np.array(["ACGT".index(b) for b in core], np.int8)
    p.core[9] = 2  # the column's letter was G when it became core, now it is T
    a, = v.align(p, [core[2:18]], [2])
    assert (a.corrected, a.edits, a.errors) == (core[2:18], [], [])  # T is likelier than the core's G: it stays, and is no error
    read = core[2:9] + "C" + core[10:18]
    a, = v.align(p, [read], [2])
    assert (a.corrected, a.edits, a.errors) == (core[2:9] + "G" + core[10:18], [(7, "M", "CG")], [9])


def test_insertion_at_the_edge_counts_for_containment():
    core = "GATTACAGATCCGTA"
    p = profile_of(core)
    a, = v.align(p, ["C" + core[3:12]], [3])
    assert a.first <= 3 and a.last == 11


def test_posteriors_sum_to_at_most_one_and_match_likelihood():
    p = profile_of("ACGTTGCAACGGTACC")
    seq = np.array(["ACGT".index(b) for b in "GTTGCAAC"])
    post, total = em.posteriors(p, np.stack([seq, seq]), np.array([2, 3]))
    assert (post.sum(2) <= 1 + 1e-9).all() and post[0].sum(1).min() > 0.8
    one = em.posteriors(p, seq[None, :], np.array([3]))
    assert np.allclose(one[0][0], post[1]) and np.isclose(one[1][0], total[1])
    assert total[0] >= best_by_recursion(p, "GTTGCAAC", 2)


def all_paths(p, seq, est):
    """(log likelihood, matched (base, offset)) of every path through the band: M, D and I steps that the recurrences allow."""
    t, out = v.T, []
    logp = lambda pos, b: p.logp[pos - p.start, "ACGT".index(b)] if 0 <= pos - p.start < len(p.logp) else math.log(0.25)

    def go(i, o, s, total, met):
        if i == len(seq):
            out.append((total, tuple(met)))
        if i > 0 and s != 2 and o < 4:
            go(i, o + 1, 1, total + t[s, 1], met)
        if i < len(seq):
            go(i + 1, o, 0, total + t[s, 0] + logp(est + i + o - 2, seq[i]), [*met, (i, o)])
            if s != 1 and o > 0:
                go(i + 1, o - 1, 2, total + t[s, 2] + math.log(0.25), met)

    for o in range(5):
        start = 0.0 if o == 2 else (2 - o) * t[0, 1] if o < 2 else (o - 2) * t[0, 2]
        go(0, o, 0, start, [])
    return out


def test_posteriors_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    p = v.make_profile(0, rng.integers(0, 6, (9, 4)).astype(float), 0.01)
    for est, seq in ((1, "GAT"), (2, "AC"), (-1, "TTG")):
        paths = all_paths(p, seq, est)
        total = np.logaddexp.reduce([x for x, _ in paths])
        want = np.zeros((len(seq), 5))
        for x, met in paths:
            for i, o in met:
                want[i, o] += math.exp(x - total)
        post, llh = em.posteriors(p, np.array([["ACGT".index(b) for b in seq]]), np.array([est]))
        assert llh[0] == pytest.approx(total) and np.allclose(post[0], want)


def test_em_equals_a_plain_replay():
    """Mini-batches of two, the same order of reads, one read and one base at a time."""
    r = random.Random(3)
    core = "ACGTTGCAACGG"
    seqs, est = [], []
    for _ in range(5):
        a = r.randrange(4)
        s = list(core[a : a + 7])
        s[r.randrange(7)] = r.choice("ACGT")
        seqs.append("".join(s))
        est.append(a)
    counts = np.zeros((12, 4))
    for s, a in zip(seqs, est):
        for j, b in enumerate(s):
            counts[a + j, "ACGT".index(b)] += 1
    codes = [np.array(["ACGT".index(b) for b in s]) for s in seqs]
    got = em.learn(0, counts, codes, est, (4, 6), 0.01, batch=2, sweeps=2)
    soft, rng, k, since, before = counts.copy(), np.random.default_rng(0), 0, 0, None
    done = False
    for sweep in range(2):
        order = rng.permutation(5)
        for at in range(0, 5, 2):
            if done:
                break
            p, stats = v.make_profile(0, soft, 0.01), np.zeros((12, 4))
            pick = order[at : at + 2]
            for i in pick:
                post, _ = em.posteriors(p, codes[i][None, :], np.array([est[i]]))
                for j in range(7):
                    for o in range(5):
                        pos = est[i] + j + o - 2
                        if 0 <= pos < 12:
                            stats[pos, codes[i][j]] += post[0, j, o]
            rate = (k + 2) ** -0.5
            soft = (1 - rate) * soft + rate * stats * (5 / len(pick))
            k += 1
            since += len(pick)
            if sweep and since >= 5:
                since, prob = 0, np.exp(v.make_profile(0, soft, 0.01).logp)
                if before is not None and np.abs(prob - before)[[0, 1, 2, 3, 6, 7, 8, 9, 10, 11]].mean() < 0.01:
                    done = True
                before = prob
    assert np.allclose(got, soft)


def test_em_profiles_of_awkward_rows(spark):
    placed = spark.createDataFrame([(1, 1, 0, "ACGTACGT"), (1, 2, 1, "CGTACGTA"), (1, 2, 1, "CGTACGTA"), (2, 3, 0, "AC"), (3, 4, 0, None)], "cluster_id long, read_id long, loc int, oseq string")
    from pyspark.sql import functions as F

    from seqloom.operators import pileup

    counts = pileup.counts(pileup.bases(placed.where(F.col("oseq").isNotNull())))
    cores = spark.createDataFrame([(1, 0, 3)], "cluster_id long, core_lo int, core_hi int")
    out = em.em_profiles(placed, counts, cores).collect()
    assert {x.cluster_id for x in out} == {1, 2} and all(min(x.vA, x.vC, x.vG, x.vT) >= 0 for x in out)
    assert em.em_profiles(placed.where("false"), counts, cores).isEmpty()


def test_em_sharpens_a_column():
    core = "ACGTTGCAACGGTACCATGA"
    seqs = [np.array(["ACGT".index(b) for b in core]) for _ in range(10)]
    seqs[0] = seqs[0].copy()
    seqs[0][9] = (seqs[0][9] + 1) % 4
    counts = np.zeros((20, 4))
    for s in seqs:
        counts[np.arange(20), s] += 1
    soft = em.learn(0, counts, seqs, [0] * 10, (0, 0), 0.01)
    assert "".join("ACGT"[i] for i in soft.argmax(1)) == core
    assert np.array_equal(soft, em.learn(0, counts, seqs, [0] * 10, (0, 0), 0.01))


def test_groups_over_many_small_batches(spark):
    """Clusters that lie in several Arrow batches, pairs that share none left out, one column alone."""
    r = np.random.default_rng(6)
    want, rows = set(), []
    for c in range(40):
        n = int(r.integers(1, 7))
        cols = sorted(r.choice(90, n, replace=False).tolist())
        shared = np.triu(r.integers(0, 9, (n, n)), 1)
        shared = shared + shared.T
        rows += [(c, cols[i], cols[j], int(shared[i, j]) if i != j else 5) for i in range(n) for j in range(i, n) if i == j or shared[i, j]]
        if n > 1:
            want |= {(c, cols[m], len(g)) for g in spectral.column_groups(shared) if len(g) > 1 for m in g}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = spectral.grouped_columns(spark.createDataFrame(rows, "cluster_id long, pos_i long, pos_j long, shared long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(x.cluster_id, x.pos, x.size) for x in got} == want and len(got) == len(want)
    assert spectral.grouped_columns(spark.createDataFrame([], "cluster_id long, pos_i long, pos_j long, shared long")).isEmpty()


def test_em_of_many_clusters_equals_one_by_one(monkeypatch):
    """Clusters of different spans, numbers and lengths of reads, with and without a core, that end after different numbers of sweeps."""
    r = np.random.default_rng(9)
    made, want = [], []
    for c in range(12):
        width, start = int(r.integers(20, 60)), int(r.integers(-30, 5))
        truth = r.integers(0, 4, width)
        seqs, est = [], []
        for _ in range(int(r.integers(0 if c == 5 else 1, 70))):
            size = int(r.choice([6, 9, 12]))
            at = int(r.integers(0, width - size))
            s = truth[at : at + size].copy()
            if r.random() < 0.4:
                s[r.integers(size)] = r.integers(4)
            seqs.append(s)
            est.append(start + at)
        if c == 5:
            seqs, est = [], []
        counts = np.zeros((width, 4))
        for s, e in zip(seqs, est):
            counts[e - start + np.arange(len(s)), s] += 1
        core = [(0, 0), (start, start + width), (start + 4, start + width - 6)][c % 3]
        made.append(em.Cluster(start, counts, seqs, est, core))
        want.append(em.learn(start, counts, seqs, est, core, 0.01, sweeps=30))
    monkeypatch.setattr(em, "READS_AT_ONCE", 50)
    for got in (em.learn_many(made, 0.01, sweeps=30), [em.learn_many([x], 0.01, sweeps=30)[0] for x in made]):
        assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(got, want))
    assert em.learn_many([], 0.01) == []
