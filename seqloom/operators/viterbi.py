"""Banded alignment of reads to a cluster's profile: states match, delete, insert; offsets -2 .. 2; vectorised over reads of many clusters.

Log probabilities are integers, in billionths, so that sums, ties and results are the same on every machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params

BAND, MID = 5, 2
M, D, I = 0, 1, 2
#: Log transition probabilities, from (row) M, D, I to (column) M, D, I.
with np.errstate(divide="ignore"):
    T = np.log(np.array([[0.94, 0.03, 0.03], [0.95, 0.05, 0.0], [0.95, 0.0, 0.05]]))
UNIFORM = float(np.log(0.25))
#: Integers of log probabilities: one unit is 1e-9; LOW stands for minus infinity.
UNIT, LOW = 10**9, -(10**15)


def whole(x: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(x), LOW, np.rint(np.where(np.isneginf(x), 0, x) * UNIT)).astype(np.int64)


STEP, UNIFORM_STEP = whole(T), int(whole(np.array(UNIFORM)))
_LUT = np.full(256, 0, np.int8)
for _i, _b in enumerate("ACGT"):
    _LUT[ord(_b)] = _i
_BASES = np.frombuffer(b"ACGTN", np.uint8)


@dataclass
class Profile:
    """Columns start .. start + len(logp) - 1; a position outside has no reads: uniform, letter -1. core: the codes of the bases from core_lo on that reads are corrected to; without it, the letters."""

    start: int
    logp: np.ndarray  # (columns, 4)
    letter: np.ndarray  # (columns,), -1 if no read covers it
    prob: np.ndarray
    core_lo: int = 0
    core: np.ndarray | None = None


def make_profile(start: int, counts: np.ndarray, psi: float) -> Profile:
    n = counts.sum(1, keepdims=True)
    prob = (counts + psi) / (n + 4 * psi)
    return Profile(start, np.log(prob), np.where(n[:, 0] > 0, counts.argmax(1), -1), prob)


def column(p: Profile, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logp, letter) at positions."""
    at = pos - p.start
    ok = (at >= 0) & (at < len(p.logp))
    at = np.where(ok, at, 0)
    if not len(p.logp):
        return np.full((*pos.shape, 4), UNIFORM), np.full(pos.shape, -1)
    return np.where(ok[..., None], p.logp[at], UNIFORM), np.where(ok, p.letter[at], -1)


class Stack:
    """The columns of several profiles, one after the other, and last one without reads for all positions outside."""

    def __init__(self, profiles: list[Profile]):
        n = np.array([len(p.logp) for p in profiles], np.int64)
        self.size, self.first = n, np.cumsum(n) - n
        self.start = np.array([p.start for p in profiles], np.int64)
        self.score = np.concatenate([*(whole(p.logp) for p in profiles), np.full((1, 4), UNIFORM_STEP)])
        self.prob = np.concatenate([*(p.prob for p in profiles), np.full((1, 4), 0.25)])
        self.letter = np.concatenate([*(p.letter for p in profiles), [-1]]).astype(np.int8)
        goal = []
        for p in profiles:
            x = p.letter.astype(np.int8)
            if p.core is not None:
                x = np.full(len(p.letter), -1, np.int8)
                a, b = max(p.core_lo - p.start, 0), min(p.core_lo - p.start + len(p.core), len(x))
                if b > a:
                    x[a:b] = p.core[a - (p.core_lo - p.start) : b - (p.core_lo - p.start)]
            goal.append(x)
        self.goal = np.concatenate([*goal, np.array([-1], np.int8)])

    def at(self, profile: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The rows of positions; profile has one number for each row of pos."""
        shape = (-1,) + (1,) * (pos.ndim - 1)
        k = pos - self.start[profile].reshape(shape)
        return np.where((k >= 0) & (k < self.size[profile].reshape(shape)), self.first[profile].reshape(shape) + k, len(self.score) - 1)


def _pick(m: np.ndarray, d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best of three and which; ties prefer insert, then delete."""
    which = np.where((m > d) & (m > i), M, np.where(d > i, D, I)).astype(np.int8)
    return np.maximum(np.maximum(m, d), i), which


def fill(stack: Stack, profile: np.ndarray, seqs: np.ndarray, est: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last scores (reads, offsets, states), from (reads, length + 1, offsets, states)) of reads of one length. seqs: (reads, length) base codes.

    A score after i bases is the best log likelihood of the first i bases, the last of them (or, for a deletion, the column) at
    position est + i - 1 + o - 2."""
    n, size = seqs.shape
    frm = np.zeros((n, size + 1, BAND, 3), np.int8)
    prev = np.full((n, BAND, 3), LOW, np.int64)
    prev[:, MID, M] = 0
    for j in (1, 2):
        prev[:, MID - j, M] = j * STEP[M, D]
        prev[:, MID + j, M] = j * STEP[M, I]
    offsets = np.arange(BAND)[None, :] - MID
    for i in range(1, size + 1):
        rows = stack.at(profile, est[:, None] + i - 1 + offsets)
        emit = stack.score[rows, seqs[:, i - 1][:, None]]
        cur = np.full((n, BAND, 3), LOW, np.int64)
        best, which = _pick(prev[:, :, M] + STEP[M, M], prev[:, :, D] + STEP[D, M], prev[:, :, I] + STEP[I, M])
        cur[:, :, M], frm[:, i, :, M] = emit + best, which
        best, which = _pick(prev[:, 1:, M] + STEP[M, I], prev[:, 1:, D] + STEP[D, I], prev[:, 1:, I] + STEP[I, I])
        cur[:, :-1, I], frm[:, i, :-1, I] = UNIFORM_STEP + best, which
        for o in range(1, BAND):
            best, which = _pick(cur[:, o - 1, M] + STEP[M, D], cur[:, o - 1, D] + STEP[D, D], cur[:, o - 1, I] + STEP[I, D])
            cur[:, o, D], frm[:, i, o, D] = best, which
        prev = np.maximum(cur, LOW)
    return prev, frm


@dataclass
class Traces:
    """The best paths of reads of one length, step by step from the read's end; kind -1 after a path's beginning."""

    llh: np.ndarray
    kind: np.ndarray  # (reads, steps): M, D, I or -1
    pos: np.ndarray
    place: np.ndarray  # in the read
    base: np.ndarray  # the read's base there
    goal: np.ndarray  # the base that the column is corrected to, -1 if unknown
    fixed: np.ndarray  # whether a match is replaced
    error: np.ndarray  # whether the step is an error against the column's letter


def trace(stack: Stack, profile: np.ndarray, seqs: np.ndarray, est: np.ndarray, last: np.ndarray, frm: np.ndarray, delta: float) -> Traces:
    """All paths side by side. A base is replaced by its column's goal where its probability is at most the goal's less delta."""
    n, size = seqs.shape
    flat = last.reshape(n, -1)
    best = flat.argmax(1) if n else np.zeros(0, np.int64)
    o, s = np.divmod(best, 3)
    llh = flat[np.arange(n), best] / UNIT / max(size, 1) if n else np.zeros(0)
    i = np.full(n, size)
    row = np.arange(n)
    out: list[tuple] = []
    while (i > 0).any():
        on = i > 0
        go = frm[row, i, np.minimum(o, BAND - 1), s]
        out.append((np.where(on, s, -1), est + i - 1 + o - MID, i - 1))
        o = np.where(on, o - (s == D) + (s == I), o)
        i = np.where(on & (s != D), i - 1, i)
        s = np.where(on, go, s)
    if not out:
        none = np.zeros((n, 0), np.int64)
        return Traces(llh, none, none, none, none, none, none.astype(bool), none.astype(bool))
    kind, pos, place = (np.stack([x[j] for x in out], 1) for j in range(3))
    rows = stack.at(profile, pos)
    base = np.take_along_axis(seqs, np.maximum(place, 0), 1)
    goal, letter = stack.goal[rows], stack.letter[rows]
    matched = kind == M
    fixed = matched & (goal >= 0) & (base != goal)
    fixed &= stack.prob[rows, base] <= stack.prob[rows, np.maximum(goal, 0)] - delta
    return Traces(llh, kind, pos, place, base, goal, fixed, (kind > M) | matched & (letter >= 0) & (base != letter))


ALIGNED = "cluster_id long, read_id long, llh double, first int, last int, corrected string, n_sub int, n_del int, n_ins int, edits array<struct<pos:int,kind:string,bases:string>>, errors array<int>"
_PAIRS = [a + b for a in "ACGT" for b in "ACGT"] + list("ACGTN")


def _lists(on: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(on.sum(1))]), pa.int32()), values)


def columns_of(t: Traces, est: np.ndarray) -> dict[str, pa.Array]:
    """The columns of ALIGNED after the ids. first and last: the positions of the path's first and last step, or the estimate for an empty read.

    Edits come in the read's order: place, kind (M, D, I), bases (read's and goal's; goal's or N; read's). A deletion's place is that of
    the base before it. errors: the positions of the erroneous steps in the read's order, with repeats."""
    n = len(est)
    back = slice(None, None, -1)
    kind, pos, place, base, goal, fixed = (x[:, back] for x in (t.kind, t.pos, t.place, t.base, t.goal, t.fixed))
    live = kind >= 0
    steps = live.sum(1)
    first = last = est
    if kind.shape[1]:
        first = np.where(steps > 0, pos[np.arange(n), np.minimum(kind.shape[1] - steps, kind.shape[1] - 1)], est)
        last = np.where(steps > 0, t.pos[:, 0], est)
    told = np.where((kind == M) & ~fixed, base, np.where((kind == M) | (kind == D), goal, -1))
    said = live & (told >= 0)
    text = _BASES[told[said]]
    ends = np.concatenate([[0], np.cumsum(said.sum(1))]).astype(np.int32)
    corrected = pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))
    edit = fixed | (kind > M)
    what = np.where(kind == M, base * 4 + np.maximum(goal, 0), 16 + np.where(kind == I, base, np.where(goal < 0, 4, goal)))[edit]
    edits = pa.StructArray.from_arrays([pa.array(place[edit], pa.int32()), pa.array(list("MDI")).take(pa.array(kind[edit])), pa.array(_PAIRS).take(pa.array(what))], ["pos", "kind", "bases"])
    error = t.error[:, back]
    return {
        "llh": pa.array(t.llh), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()), "corrected": corrected,
        "n_sub": pa.array(fixed.sum(1), pa.int32()), "n_del": pa.array((kind == D).sum(1), pa.int32()), "n_ins": pa.array((kind == I).sum(1), pa.int32()),
        "edits": _lists(edit, edits), "errors": _lists(error, pa.array(pos[error], pa.int32())),
    }


#: Bases aligned at a time.
CELLS = 400_000


def align_many(profiles: list[Profile], which: list[int], seqs: list[str], est: list[int], delta: float) -> tuple[np.ndarray, pa.Table]:
    """(numbers of the reads, rows as in ALIGNED without ids) of reads of any lengths; which: each read's profile."""
    stack = Stack(profiles)
    by: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        by.setdefault(len(s), []).append(i)
    order, parts = [], []
    for size, members in by.items():
        for k in range(0, len(members), max(1, CELLS // max(size, 1))):
            m = members[k : k + max(1, CELLS // max(size, 1))]
            code = _LUT[np.frombuffer("".join(seqs[i] for i in m).encode(), np.uint8)].reshape(len(m), size).astype(np.int64)
            e, prof = np.array([est[i] for i in m], np.int64), np.array([which[i] for i in m], np.int64)
            t = trace(stack, prof, code, e, *fill(stack, prof, code, e), delta)
            parts.append(pa.table(columns_of(t, e)))
            order += m
    return np.array(order, np.int64), pa.concat_tables(parts) if parts else None


@dataclass
class Aligned:
    llh: float  # log likelihood per base
    first: int
    last: int
    corrected: str
    edits: list[tuple[int, str, str]]
    errors: list[int]


def align(p: Profile, seqs: list[str], est: list[int], delta: float = 0.1) -> list[Aligned]:
    """All reads of one profile."""
    order, rows = align_many([p], [0] * len(seqs), seqs, est, delta)
    out: list[Aligned | None] = [None] * len(seqs)
    for i, r in zip(order.tolist(), rows.to_pylist() if rows is not None else []):
        out[i] = Aligned(r["llh"], r["first"], r["last"], r["corrected"], [(e["pos"], e["kind"], e["bases"]) for e in r["edits"]], r["errors"])
    return out


def profile_arrays(counts: DataFrame) -> DataFrame:
    """cluster_id, columns: a cluster's counts as one array; its length is bounded by the span of the reads on it."""
    return counts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cA", "cC", "cG", "cT"))).alias("columns"))


def from_columns(cols, psi: float) -> Profile:
    """A profile from an array of structs (pos, cA, cC, cG, cT); gaps have no reads."""
    pos = np.array([c["pos"] for c in cols], int)
    counts = np.zeros((pos[-1] - pos[0] + 1, 4)) if len(pos) else np.zeros((0, 4))
    if len(pos):
        counts[pos - pos[0]] = [[c["cA"], c["cC"], c["cG"], c["cT"]] for c in cols]
    return make_profile(int(pos[0]) if len(pos) else 0, counts, psi)


#: Reads of a cluster that one task aligns; more are dealt to several, each with the profile.
SHARE = 5000
#: Reads that a task holds at a time.
HELD = 4096


def align_reads(placed: DataFrame, counts: DataFrame, p: Params = Params(), cores: DataFrame | None = None, carry: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Aligns each placed read (cluster_id, read_id, loc, oseq) to its cluster's profile; rows as in ALIGNED, then the columns of placed named in carry.

    cores (cluster_id, core_lo, core): reads are corrected to the core's bases, else to the columns' letters; errors are against the
    letters. Reads of clusters without counts meet columns without reads. Null sequences are left out; repeated rows are aligned each; no
    rows, no rows. Extra columns are ignored.

    Reads and profiles are dealt by cluster (a cluster of more than SHARE reads by parts, each with the profile) and sorted, so a profile
    travels once for each part and is held while that part's reads stream by; reads of many clusters are aligned side by side. parts: into
    how many tasks they are dealt, by default as many as Spark has shuffle partitions."""
    spark = placed.sparkSession
    reads = placed.select("cluster_id", "read_id", "loc", "oseq", *carry).where("oseq is not null")
    prof = profile_arrays(counts)
    if cores is not None:
        prof = prof.join(cores.select("cluster_id", F.col("core_lo").cast("long").alias("core_lo"), "core"), "cluster_id", "left")
    else:
        prof = prof.select("*", F.lit(None).cast("long").alias("core_lo"), F.lit(None).cast("string").alias("core"))
    # a cluster's number of parts is known on both sides from the same grouped count
    many = reads.groupBy("cluster_id").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("parts"))
    reads = reads.join(many, "cluster_id").withColumn("part", F.pmod(F.xxhash64("read_id"), F.col("parts"))).drop("parts")
    prof = prof.join(many, "cluster_id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    flat = [F.col(f"columns.{x}").cast("array<double>").alias(f"x{x}") for x in ("pos", "cA", "cC", "cG", "cT")]
    nothing = [F.lit(None).cast("array<double>").alias(f"x{x}") for x in ("pos", "cA", "cC", "cG", "cT")]
    kinds = {c: reads.schema[c].dataType for c in carry}
    both = prof.select("cluster_id", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("read_id"), F.col("core_lo").alias("loc"), F.col("core").alias("oseq"), *flat, *(F.lit(None).cast(k).alias(f"y{c}") for c, k in kinds.items()))
    both = both.union(reads.select("cluster_id", "part", F.lit(1).alias("kind"), "read_id", F.col("loc").cast("long").alias("loc"), "oseq", *nothing, *(F.col(c).alias(f"y{c}") for c in carry)))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "cluster_id", "part").sortWithinPartitions("cluster_id", "part", "kind", "read_id")
    psi, delta = p.pseudocount, p.emission_delta
    none = make_profile(0, np.zeros((0, 4)), psi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, profiles = None, [none]
        held: tuple[list, ...] = ([], [], [], [], [])
        rest: list[pa.RecordBatch] = []

        def solve() -> Iterator[pa.RecordBatch]:
            nonlocal held, profiles, rest
            cids, rids, which, seqs, locs = held
            if rids:
                order, rows = align_many(profiles, which, seqs, locs, delta)
                ids = [pa.array(np.array(x, np.int64)[order]) for x in (cids, rids)]
                more = pa.Table.from_batches(rest).take(pa.array(order)) if carry else None
                yield from pa.table([*ids, *rows.columns, *(more.columns if carry else [])], ["cluster_id", "read_id", *rows.column_names, *carry]).combine_chunks().to_batches()
            held, profiles, rest = ([], [], [], [], []), [none, profiles[-1]], []

        for b in batches:
            lists = [b.column(f"x{x}") for x in ("pos", "cA", "cC", "cG", "cT")]
            extra = b.select([f"y{c}" for c in carry]) if carry else None
            fresh = 0  # the batch's rows before this one are held already
            for row, (cid, part, kind, rid, loc, seq) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cluster_id", "part", "kind", "read_id", "loc", "oseq")))):
                if kind == 0:
                    pos, *c = (x[row].values.to_numpy(zero_copy_only=False) for x in lists)
                    at = pos.astype(np.int64)
                    table = np.zeros((int(at[-1] - at[0]) + 1, 4))
                    table[at - at[0]] = np.stack(c, 1)
                    made = make_profile(int(at[0]), table, psi)
                    if loc is not None and seq is not None:
                        made.core_lo, made.core = loc, _LUT[np.frombuffer(seq.encode(), np.uint8)]
                    profiles.append(made)
                    now = (cid, part)
                    if carry:
                        rest.append(extra.slice(fresh, row - fresh))
                        fresh = row + 1
                    continue
                for x, v in zip(held, (cid, rid, len(profiles) - 1 if now == (cid, part) else 0, seq, loc)):
                    x.append(v)
                if len(held[0]) >= HELD:
                    if carry:
                        rest.append(extra.slice(fresh, row + 1 - fresh))
                        fresh = row + 1
                    yield from solve()
            if carry:
                rest.append(extra.slice(fresh))
        yield from solve()

    return dealt.mapInArrow(run, ", ".join([ALIGNED, *(f"{c} {k.simpleString()}" for c, k in kinds.items())]))


def accepted(aligned: DataFrame, cores: DataFrame, p: Params = Params()) -> DataFrame:
    """aligned with fitted (wholly inside the core) and ok (fitted, likely enough, fewer edits than the cap). Clusters without a core have no rows."""
    x = aligned.join(cores.select("cluster_id", "core_lo", "core_hi"), "cluster_id")
    fitted = (F.col("first") >= F.col("core_lo")) & (F.col("last") < F.col("core_hi"))
    edits = F.col("n_sub") + F.col("n_del") + F.col("n_ins")
    return x.withColumn("fitted", fitted).withColumn("ok", fitted & (F.col("llh") > p.cluster_llh) & (edits < p.max_corrections)).drop("core_lo", "core_hi")
