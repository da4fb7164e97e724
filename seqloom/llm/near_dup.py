"""MinHash near-duplicate detection: universal hash minima, banding, verification on full sets, star components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .components import connected_components


@dataclass(frozen=True)
class Params:
    """threshold: per cent of the union that two sets must share. bands * rows hash minima; at 85 % a pair meets in no
    band with probability (1 - 0.85 ** rows) ** bands, 9e-7 here. slack: how far the estimate from minima may fall short of
    the threshold before a pair is dropped unverified (0.15: over six standard deviations for 252 minima).
    block: documents of one block where what is still apart is compared block against block. spread: tasks that a pivot's
    star goes to at most. broadcast_ids: up to so many ids of grouped documents are broadcast (16 bytes each); more are joined
    by a shuffle."""

    threshold: int = 85
    bands: int = 36
    rows: int = 7
    slack: float = 0.15
    block: int = 400
    spread: int = 64
    broadcast_ids: int = 500_000
    shingle: int = words.SHINGLE

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the universal hashes a * x + b on 32 bits: odd a, any b."""
    x = words.numbers(11, 2 * n)
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def minima(s: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """(sets, n) smallest values of n universal hashes over each set; an empty set has the largest value throughout."""
    out = np.full((len(off) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        x, start = (s >> np.uint64(32)).astype(np.uint32), off[full]
        a, b = coefficients(n)
        y = np.empty_like(x)
        cols = np.empty((n, len(full)), np.uint32)
        for k in range(n):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            cols[k] = np.minimum.reduceat(y, start)
        out[full] = cols.T
    return out


def band_keys(m: np.ndarray, p: Params) -> np.ndarray:
    """(sets, bands) 64-bit bucket keys, each of a band's minima and its number."""
    with np.errstate(over="ignore"):
        x = m.reshape(len(m), p.bands, p.rows).astype(np.uint64) * (words.numbers(12, p.rows) | np.uint64(1))
        return words.mix(x.sum(axis=2, dtype=np.uint64) + words.numbers(13, p.bands)).view(np.int64)


SIGNED = "id long, n_shingles long, set_a long, set_b long, buckets array<long>"


def _sign(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in words.slices(whole, "text"):
                s, off = words.shingle_sets(part.column("text"), p.shingle)
                keys = band_keys(minima(s, off, p.minima), p)
                n = np.diff(off)
                with np.errstate(over="ignore"):
                    a, b = words.run_sums(s, off), words.run_sums(words.mix(s ^ np.uint64(0x5555)), off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], ["id", "n_shingles", "set_a", "set_b", "buckets"])

    return run


def _pairs_in(sets: list[np.ndarray], mine: np.ndarray, classes: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (by place) of different classes. mine: which of the two sides each is on (0 or 1); if both sides occur, only pairs across them count.

    Estimates from minima drop pairs that fall short by more than the slack; what stays is counted on full sets."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(sets)
    sig = minima(flat, off, p.minima)
    left, right = np.flatnonzero(mine == 0), np.flatnonzero(mine == 1)
    within = not (len(left) and len(right))
    if within:
        left = right = np.arange(n)
    least = p.threshold / 100 - p.slack
    maybe_i, maybe_j, est = [], [], []
    for i in left.tolist():
        js = right[right > i] if within else right
        js = js[classes[js] != classes[i]]
        small, large = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
        js = js[100 * small >= p.threshold * large]
        e = (sig[js] == sig[i]).mean(axis=1) if len(js) else np.zeros(0)
        js, e = js[e >= least], e[e >= least]
        maybe_i.append(np.full(len(js), i)), maybe_j.append(js), est.append(e)
    i, j, e = np.concatenate(maybe_i), np.concatenate(maybe_j), np.concatenate(est)
    if not len(i):
        return []
    first: dict[int, int] = {}
    parent = [first.setdefault(c, k) for k, c in enumerate(classes.tolist())]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    order = np.argsort(-e, kind="stable")
    table = None
    if len(i) > 256:  # so many that counting all at once is cheaper: one product of 0/1 matrices over shared shingles
        table = _intersections(flat, off, left, right)
        at_l, at_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at_l[left], at_r[right] = np.arange(len(left)), np.arange(len(right))
        both = table[at_l[i], at_r[j]].astype(np.int64)
        order = order[(100 * both >= p.threshold * (size[i] + size[j] - both))[order]]
    for k in order.tolist():
        x, y = int(i[k]), int(j[k])
        rx, ry = root(x), root(y)
        if rx == ry:
            continue
        if table is None:
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both < p.threshold * (size[x] + size[y] - both):
                continue
        parent[rx] = ry
        out.append((x, y))
    return out


def _intersections(flat: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """(left, right) sizes of intersections, width shingles at a time."""
    value, code = np.unique(flat, return_inverse=True)
    shared = np.flatnonzero(np.bincount(code, minlength=len(value)) > 1)
    place = np.full(len(value), -1)
    place[shared] = np.arange(len(shared))
    col, row = place[code], np.repeat(np.arange(len(off) - 1), np.diff(off))
    row, col = row[col >= 0], col[col >= 0]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), width):
        a, b = np.searchsorted(col, [start, start + width])
        x = np.zeros((len(off) - 1, min(width, len(shared) - start)), np.float32)
        x[row[a:b], col[a:b] - start] = 1
        total += x[left] @ x[right].T
    return total


def _links(p: Params):
    def solve(key: list | None, rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
        rows = sorted(dict((r[0], r) for r in rows).values())  # an id's repeated rows hold the same set
        if len(rows) < 2 or key[1] != key[2] and len({r[1] for r in rows}) < 2:
            return []
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        return [(rows[x][0], rows[y][0]) for x, y in _pairs_in(sets, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell (group, block, block); a cell is at most two blocks."""
        cell, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for *key, rid, side, cls, data in zip(*(batch.column(c).to_pylist() for c in ("gid", "bi", "bj", "id", "side", "class", "shingles"))):
                if key != cell:
                    out += solve(cell, held)
                    cell, held = key, []
                held.append((rid, side, cls, data))
            yield _edges(out)
        yield _edges(solve(cell, held))

    return run


def _stars(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pivot, the pivot's own set first; one set is held at a time."""
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for pivot, rid, data in zip(*(batch.column(c).to_pylist() for c in ("pivot", "id", "shingles"))):
                if rid == pivot:
                    now, own = pivot, np.frombuffer(data, np.uint64)
                    continue
                x = np.frombuffer(data, np.uint64)
                if pivot != now or 100 * min(len(x), len(own)) < p.threshold * max(len(x), len(own)):
                    continue
                both = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum())
                if 100 * both >= p.threshold * (len(x) + len(own) - both):
                    out.append((pivot, rid))
            yield _edges(out)

    return run


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _sets(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in words.slices(whole, "text"):
                s, off = words.shingle_sets(part.column("text"), p.shingle)
                data = pa.array([s[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
                own = pa.array(words.run_sums(s, off).view(np.int64) == part.column("set_a").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("id"), data], ["id", "shingles"]).filter(own)

    return run


def confirm_stars(stars: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(a, b): the links of stars (id, pivot) whose sets are similar enough. A pivot's set travels once for each part of its star, any other set once for each of its pivots."""
    n = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stars.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(p.spread)).cast("int")).withColumnRenamed("id", "member")
    hubs = dealt.select("pivot", "part").distinct().join(sets, F.col("pivot") == F.col("id")).select("pivot", "part", F.lit(0).alias("kind"), "id", "shingles")
    others = dealt.join(sets, F.col("member") == F.col("id")).select("pivot", "part", F.lit(1).alias("kind"), "id", "shingles")
    return hubs.union(others).repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", "kind").mapInArrow(_stars(p), "a long, b long")


def cells_of(wanted: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """gid, bi, bj, id, side, class: which documents of groups that are still apart meet in which pairs of blocks.

    Blocks of documents outside the group's largest class come first and meet all blocks; those of the largest class meet only these."""
    nodes = wanted.select(F.col("wid").alias("id"), "gid").join(classes, F.col("id") == F.col("node"), "left").select("id", "gid", F.coalesce("component", "id").alias("class"))
    sizes = nodes.groupBy("gid", "class").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("gid").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("total")).where("classes > 1")
    apart = apart.select(F.col("gid").alias("g"), F.col("main.class").alias("main"), F.ceil((F.col("total") - F.col("main.n")) / p.block).alias("outer"), F.ceil(F.col("main.n") / p.block).alias("inner"))
    outside, h = F.col("class") != F.col("main"), F.xxhash64("id")
    mine = F.when(outside, F.pmod(h, F.col("outer"))).otherwise(F.col("outer") + F.pmod(h, F.col("inner")))
    met = F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    x = nodes.join(apart, F.col("gid") == F.col("g")).withColumn("mine", mine)
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)).alias("other"))
    return x.select("gid", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "id", F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "class")


def compare_rest(wanted: DataFrame, classes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(a, b): a spanning forest of the links between the classes of each group."""
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells_of(wanted, classes, p).withColumnRenamed("id", "cid").join(sets, F.col("cid") == F.col("id")).drop("cid")
    return cells.repartition(n, "gid", "bi", "bj").sortWithinPartitions("gid", "bi", "bj").mapInArrow(_links(p), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """One row per distinct id: <id_col>, n_shingles, component_id, kept.

    A set is a text's distinct word shingles (see words). Sets are linked if 100 * intersection >= threshold * union;
    component_id is the smallest id reachable over links, kept says whether that is the id itself.

    1. One pass over whole texts gives set size, a 128-bit fingerprint of the set, and bucket keys.
    2. Equal sets collapse to their smallest id, so copies never meet again (a group-by with partial minimum).
    3. Per bucket only its smallest id, and in a quarter of the buckets its largest, link to the others: linear in the
       bucket, however hot. The components of these candidate links are groups that no link can leave, but for pairs that
       share no bucket. Groups of two and more get their full sets, recomputed from the texts and written out once.
    4. The candidate links themselves are confirmed on full sets: a pivot's star goes to up to p.spread tasks, each with the pivot's
       set and a part of the others. The components of what is confirmed are classes.
    5. A group of several classes is compared once more: all outside its largest class against each other and
       against the largest class, in blocks, each pair of blocks a task's cell: estimates from minima, then full sets; pairs of
       one class are passed over. What travels is the number outside times the group's size over p.block, which is
       nothing for a group that its stars confirm. No cap applies anywhere.
    6. The components of all confirmed links, joined back to all ids.

    Null text, empty text and white space: empty set, linked with nothing. Rows with a null id are left out; an id
    that occurs more than once counts once, with the text that is smallest. Extra columns are ignored. No rows in: no rows out.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = base.mapInArrow(_sign(p), SIGNED)
    path = common.write(signed, "signed")
    s = spark.read.parquet(path)
    # an id's rows: one, or its smallest set by size and fingerprint
    one = s.groupBy("id").agg(F.min(F.struct("n_shingles", "set_a", "set_b")).alias("x")).select("id", "x.*")
    # sets held by several ids, as a table of their own: the join on them can then split a hot one
    twice = one.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep != top")
    twice = common.materialize(twice.select(F.col("n_shingles").alias("rn"), F.col("set_a").alias("ra"), F.col("set_b").alias("rb"), "rep"), "twice")
    same = (one.n_shingles == twice.rn) & (one.set_a == twice.ra) & (one.set_b == twice.rb)
    member_path = common.write(one.join(twice, same, "left").select("id", "n_shingles", "set_a", F.coalesce("rep", "id").alias("rep")), "members")
    members = spark.read.parquet(member_path)
    # buckets of representatives only
    own = members.where("id = rep and n_shingles > 0").select(F.col("id").alias("rid"), F.col("set_a").alias("own_a"))
    rows = s.join(own, (s.id == own.rid) & (s.set_a == own.own_a)).select("id", F.explode("buckets").alias("bucket"))
    row_path = common.write(rows, "buckets")
    rows = spark.read.parquet(row_path)
    pivots = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low != top").select(F.col("bucket").alias("key"), "low", "top")
    ends = F.when(F.pmod("bucket", F.lit(4)) == 0, F.array("low", "top")).otherwise(F.array("low"))
    stars = rows.join(pivots, rows.bucket == pivots.key).select("id", F.explode(ends).alias("pivot")).where("id != pivot").distinct()
    stars = common.materialize(stars, "stars")
    common.drop(spark, row_path)
    groups = connected_components(stars.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    wanted = common.materialize(groups.select(F.col("node").alias("wid"), F.col("component").alias("gid")).join(own, F.col("wid") == own.rid).select("wid", "gid", F.col("own_a").alias("set_a")), "groups")
    few = wanted.count() <= p.broadcast_ids
    grouped = base.join(F.broadcast(wanted) if few else wanted, base.id == wanted.wid).select("id", "set_a", "text")
    sets = grouped.mapInArrow(_sets(p), "id long, shingles binary")
    if s.count() != members.count():  # an id's repeated rows hold the same set
        sets = sets.groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = common.materialize(sets, "sets")
    confirmed = common.materialize(confirm_stars(stars, sets, p), "confirmed")
    classes = connected_components(confirmed)
    more = common.materialize(compare_rest(wanted, classes, sets, p), "more")
    found = classes if more.isEmpty() else connected_components(confirmed.union(more))
    comp = found.select(F.col("node").alias("rep"), "component")
    out = members.join(comp, "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    # the smallest id of a component is that of its smallest representative, as each stands for its copies by the smallest
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """The rows of docs whose id is kept, with all their columns; rows with a null id stay, as nothing can be said of them.

    Of one id's repeated rows all stay or go together. The ids that go are written out and counted; up to
    p.broadcast_ids are broadcast, more are anti-joined by a shuffle."""
    gone = common.materialize(near_duplicates(docs, id_col, text_col, p).where("not kept").select(F.col(id_col).alias("__gone")), "gone")
    few = gone.count() <= p.broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
