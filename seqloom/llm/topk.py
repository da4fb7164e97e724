"""Exact top-k inner-product search with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Params:
    """scale: a component x becomes floor(scale * x). block: vectors of a block; shard: vectors that a task holds at once;
    chunk: queries that visit a shard together. sample: so many vectors by hash, at about, fit the order (cluster
    centres) and give each query a first lower bound; they decide about speed only. step: blocks of each query between two
    looks at its bound. bounds_bytes: of the shards' bounds, which the driver gathers and sends to tasks."""

    k: int = 20
    scale: int = 64
    block: int = 32
    shard: int = 16_384
    chunk: int = 1024
    sample: int = 4096
    centres: int = 64
    step: int = 16
    bounds_bytes: int = 64_000_000


#: Inner products below these are exact in float32, float64 and int64; beyond, Python's integers are used.
F4, F8, I8 = 2.0**24, 2.0**53, 2.0**62
#: Scaled components of this size or more are placed, and searched, apart from the others.
LARGE = 2.0**24
LONGS = -(1 << 63), (1 << 63) - 1


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, data, n, big = [], [], [], []
            for vid, x in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                values = x.values if x.is_valid else None
                if vid is None or values is None or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(scale * v), -np.finfo(np.float64).max, np.finfo(np.float64).max) + 0.0
                ids.append(vid)
                data.append(v.astype("<f8").tobytes())
                n.append(len(v))
                big.append(float(np.abs(v).max()) if len(v) else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(n, pa.int32()), pa.array(big, pa.float64())], ["vec_id", "data", "dim", "top"])

    return run


def matrix(data: list[bytes], dim: int) -> np.ndarray:
    """The vectors as rows of float64, all integers; shorter ones end in zeros."""
    out = np.zeros((len(data), dim))
    if len({len(x) for x in data}) == 1 and len(data[0]) == 8 * dim:
        out[:] = np.frombuffer(b"".join(data), "<f8").reshape(len(data), dim)
    else:
        for i, x in enumerate(data):
            out[i, : len(x) // 8] = np.frombuffer(x, "<f8")
    return out


def upper_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, exact: bool) -> np.ndarray:
    """(queries, blocks): sums over components of query value times the block's largest or, for negative values, least value.
    Not exact: raised by more than the sum can have been rounded down by."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        if not exact:
            out = out + (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * 2.0**-40
            out = np.where(np.isnan(out), np.inf, out)
    return out


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """A few rounds of Lloyd's algorithm from evenly spaced rows."""
    x = x.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(8):
        near = (x @ c.T - (c**2).sum(1) / 2).argmax(1) if len(x) else np.zeros(0, int)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(0)
    return c


def _place(centres: np.ndarray, dim: int):
    """The nearest centre and the distance from it; vectors with large components come after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("data").to_pylist(), dim)
            large = np.abs(x).max(1) >= LARGE if len(x) else np.zeros(0, bool)
            x = np.clip(x, -(2.0**40), 2.0**40)
            d = x @ centres.T - (centres**2).sum(1) / 2
            near = d.argmax(1) if len(x) else np.zeros(0, int)
            far = (x**2).sum(1) - 2 * d.max(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("data"), pa.array((near + large * len(centres)).astype(np.int32)), pa.array(far)], ["vec_id", "data", "near", "far"])

    return run


PACKED = "shard long, kind int, part int, ids binary, data binary, low binary, high binary"
BLOCK, CHUNK, BOUNDS = 0, 1, 2


def _blocks(dim: int, p: Params):
    """Blocks of consecutive vectors of a range, each with its forward index (data) and the least and largest value of each
    component; and a row with those of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, ids, data, out = TaskContext.get().partitionId() << 32, 0, [], [], []
        per = max(1, p.shard // p.block)
        edge: list[np.ndarray] = []

        def close() -> None:
            nonlocal n, ids, data, edge
            x = matrix(data, dim)
            low, high = x.min(0), x.max(0)
            out.append((base + n // per, BLOCK, n, np.array(ids, "<i8").tobytes(), x.tobytes(), low.tobytes(), high.tobytes()))
            edge = [np.minimum(edge[0], low), np.maximum(edge[1], high)] if edge else [low, high]
            n, ids, data = n + 1, [], []
            if n % per == 0:
                ends()

        def ends() -> None:
            nonlocal edge
            out.append((base + (n - 1) // per, BOUNDS, 0, b"", b"", edge[0].tobytes(), edge[1].tobytes()))
            edge = []

        for b in batches:
            for vid, x in zip(b.column("vec_id").to_pylist(), b.column("data").to_pylist()):
                ids.append(vid)
                data.append(x)
                if len(ids) == p.block:
                    close()
            yield _packed(out)
            out = []
        if ids:
            close()
        if edge:
            ends()
        yield _packed(out)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PACKED.split(", ")])


def _chunks(dim: int, sample_ids: np.ndarray, sample: np.ndarray, shards: tuple[np.ndarray, np.ndarray, np.ndarray], p: Params):
    """Query chunks with each query's lower bound: the k-th best score over the sample, its own id left out. A chunk goes to
    the shards whose bound reaches that of any of its queries, with just those queries."""
    number, s_low, s_high = shards

    def rows(ids: list[int], data: list[bytes]) -> Iterator[tuple]:
        q, own = matrix(data, dim), np.array(ids, "<i8")
        low = np.full(len(ids), -np.inf)
        usual = np.flatnonzero(np.abs(q).max(1) < LARGE)
        if len(sample) > p.k and len(usual):
            s = q[usual] @ sample.T
            s[own[usual][:, None] == sample_ids[None, :]] = -np.inf
            low[usual] = np.partition(s, len(sample) - p.k, axis=1)[:, len(sample) - p.k]
        bound = upper_bounds(q, s_low, s_high, False)
        for j in range(len(number)):
            on = np.flatnonzero(bound[:, j] >= low)
            if len(on):
                yield (int(number[j]), CHUNK, 0, own[on].tobytes(), q[on].tobytes(), low[on].tobytes(), b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []
        for b in batches:
            ids += b.column("vec_id").to_pylist()
            data += b.column("data").to_pylist()
            while len(ids) >= p.chunk:
                for row in rows(ids[: p.chunk], data[: p.chunk]):
                    yield _packed([row])
                ids, data = ids[p.chunk :], data[p.chunk :]
        if ids:
            for row in rows(ids, data):
                yield _packed([row])

    return run


class Shard:
    """The blocks of one shard; search() visits each query's blocks by falling bound and stops below its k-th score. scored: pairs of query and block whose scores were computed."""

    def __init__(self, blocks: list[tuple[bytes, bytes, bytes, bytes]], dim: int, k: int):
        self.k, self.dim, self.scored = k, dim, 0
        self.ids = [np.frombuffer(b[0], "<i8") for b in blocks]
        self.data = [np.frombuffer(b[1], "<f8").reshape(-1, dim) for b in blocks]
        self.low = np.stack([np.frombuffer(b[2], "<f8") for b in blocks])
        self.high = np.stack([np.frombuffer(b[3], "<f8") for b in blocks])
        self.top = np.maximum(np.abs(self.low), np.abs(self.high)).max(1) if dim else np.zeros(len(blocks))
        self._as: dict[str, list[np.ndarray]] = {}

    def typed(self, kind: str) -> list[np.ndarray]:
        if kind not in self._as:
            limit = {"f4": 2.0**24, "f8": np.inf, "i8": 2.0**62, "O": np.inf}[kind]
            turn = integers if kind == "O" else (lambda x: x.astype(kind))
            self._as[kind] = [turn(x) if t <= limit else x for x, t in zip(self.data, self.top)]
        return self._as[kind]

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vector id, score) of each query's k best here that reach its floor; scores are Python integers if any is beyond a long."""
        with np.errstate(over="ignore"):
            most = np.abs(q).max(1)[:, None] * self.top[None, :] * max(self.dim, 1) if self.dim else np.zeros((len(q), len(self.ids)))
        kinds = ("f4", "f8", "i8", "O")
        rank = np.searchsorted([F4, F8, I8], most, "right")
        if rank.max(initial=0) <= 1:
            rank[:] = rank.max(initial=0)
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = floor.copy()
        for r in np.unique(rank).tolist():
            kind = kinds[r]
            bound = np.where(rank == r, upper_bounds(q, self.low, self.high, r < 2), -np.inf)
            found = self._visit(qid, q.astype(kind) if kind != "O" else integers(q), bound, rank == r, floor, step, kind, found)
        return found

    def _visit(self, qid, q, bound, mine, floor, step, kind, found):
        data = self.typed(kind)
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(q))
        for start in range(0, order.shape[1], step):
            # bounds fall along order: once the first of a step is below the k-th score, all that follow are
            live = live[bound[live, order[live, start]] >= floor[live]]
            if not len(live):
                break
            take = order[live, start : start + step]
            who, which = np.repeat(live, take.shape[1]), take.ravel()
            ok = mine[who, which] & (bound[who, which] >= floor[who])
            who, which = who[ok], which[ok]
            self.scored += len(who)
            by = np.argsort(which, kind="stable")
            who, which = who[by], which[by]
            edge = np.flatnonzero(np.diff(which, prepend=-1))
            new_q, new_v, new_s = ([x] for x in found)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(which)]):
                queries, block = who[a:b], which[a]
                s = q[queries] @ data[block].T
                i, j = np.nonzero((s >= floor[queries][:, None]) & (self.ids[block][None, :] != qid[queries][:, None]))
                new_q.append(queries[i])
                new_v.append(self.ids[block][j])
                got = s[i, j]
                new_s.append(got if kind == "O" else got.astype(np.int64))
            found = best(np.concatenate(new_q), np.concatenate(new_v), np.concatenate(new_s), self.k)
            n = np.bincount(found[0], minlength=len(q))
            full = n >= self.k
            last = found[2][np.cumsum(n) - 1][full] if len(found[0]) else np.zeros(0)
            floor[full] = np.maximum(floor[full], [below(x) for x in last.tolist()])
        return found


def integers(x: np.ndarray) -> np.ndarray:
    """float64 integers as Python's."""
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel().tolist()]
    return out


def below(x: int) -> float:
    """A float that is no larger than an integer."""
    if abs(x) < 1 << 53:
        return float(x)
    try:
        return float(np.nextafter(float(x), -np.inf))
    except OverflowError:
        return float(np.finfo(np.float64).max) if x > 0 else -np.inf


def beyond(x: int) -> bytes | None:
    """Of an integer beyond a long: bytes that are in the same order, among those of one sign."""
    if LONGS[0] <= x <= LONGS[1]:
        return None
    size = (abs(x).bit_length() + 7) // 8
    out = size.to_bytes(4, "big") + abs(x).to_bytes(size, "big")
    return out if x > 0 else bytes(255 - c for c in out)


def best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by query, then falling score, then id."""
    if s.dtype == object:
        order = np.array(sorted(range(len(q)), key=lambda i: (int(q[i]), -int(s[i]), int(v[i]))), np.int64)
    else:
        order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def _search(dim: int, p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, blocks before queries; one shard is held at a time."""
        now, held, shard = None, [], None
        for b in batches:
            out: list[list] = [[], [], [], []]
            for key, kind, ids, data, low, high in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "ids", "data", "low", "high"))):
                if key != now:
                    now, held, shard = key, [], None
                if kind == BLOCK:
                    held.append((ids, data, low, high))
                    continue
                if held and shard is None:
                    shard, held = Shard(held, dim, p.k), [()]
                if shard is None:
                    continue
                qid = np.frombuffer(ids, "<i8")
                n, v, s = shard.search(qid, np.frombuffer(data, "<f8").reshape(-1, dim), np.frombuffer(low, "<f8"), p.step)
                wide = s.dtype == object
                for o, x in zip(out, (qid[n], v, np.array([min(max(int(x), LONGS[0]), LONGS[1]) for x in s], np.int64) if wide else s)):
                    o.append(x)
                out[3] += [beyond(int(x)) for x in s] if wide else [None] * len(s)
            cols = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out[:3]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out[3], pa.binary())], ["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", p: Params = Params()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by integer inner product, ties to the smaller id.

    Components x become floor(scale * x), beyond the range of a double its largest value. Rows with a null id, a null
    vector, or a null or non-finite component take no part; all others do, and ranks are exact however large the products
    are. A score beyond a long is shown as the long's end. Shorter vectors count as ending in zeros. is_query is a SQL condition on
    vec_id; a query id that occurs more than once asks once (with its smallest vector by bytes), and a query's own id is never its
    candidate. Repeated rows of other ids are candidates of their own. Queries with fewer candidates than k get all; no rows, no
    rows. Extra columns are ignored.

    Vectors are ordered by cluster and distance and cut into ranges, shards and blocks (a hot vector spreads over many by id).
    Query chunks go to the shards whose bound reaches the score of the query's k-th best in a sample; blocks stay where they are, and
    each task holds one shard and one chunk. Within a shard a query takes blocks by falling upper bound (the sum over components of
    query value times the block's largest or, for negative values, least value) until the bound is below its k-th score so far.
    """
    spark = vectors.sparkSession
    common.bound_batches(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    ints = common.materialize(base.mapInArrow(_integers(p.scale), "vec_id long, data binary, dim int, top double"), "ints")
    n, dim = ints.agg(F.count("*"), F.max("dim")).first()
    dim = max(dim or 1, 1)
    room = 1 << 30
    share = room if n <= p.sample else int(room * p.sample / n)
    some = ints.where((F.col("top") < LARGE / dim**0.5) & (F.pmod(F.xxhash64("vec_id", "data"), F.lit(room)) < share)).select("vec_id", "data").distinct()
    some = sorted((r[0], bytes(r[1])) for r in some.collect())[: 2 * p.sample]
    sample = matrix([x for _, x in some], dim) if some else np.zeros((0, dim))
    sample_ids = np.array([i for i, _ in some], np.int64)
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // p.shard)))
    placed = ints.select("vec_id", "data").mapInArrow(_place(_centres(sample, p.centres), dim), "vec_id long, data binary, near int, far double")
    packed = common.materialize(placed.repartitionByRange(ranges, "near", "far", "vec_id").sortWithinPartitions("near", "far", "vec_id").mapInArrow(_blocks(dim, p), PACKED), "blocks")
    blocks = packed.where(F.col("kind") == BLOCK)
    shards = _shards(packed.where(F.col("kind") == BOUNDS), dim, p)
    asking = ints.where(is_query).groupBy("vec_id").agg(F.min("data").alias("data"))
    visits = asking.coalesce(max(1, -(-n // (20 * p.chunk)))).mapInArrow(_chunks(dim, sample_ids, sample, shards, p), PACKED)
    cells = blocks.unionByName(visits).repartition(max(1, len(shards[0])), "shard").sortWithinPartitions("shard", "kind", "part")
    found = cells.mapInArrow(_search(dim, p), "query_id long, vec_id long, score long, beyond binary")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= p.k)


def _shards(rows: DataFrame, dim: int, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, least, largest values) of each shard, one for p.shard vectors. Beyond p.bounds_bytes only the numbers, so that every chunk goes everywhere."""
    if rows.count() * dim * 16 <= p.bounds_bytes:
        got = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in rows.select("shard", "low", "high").collect())
        return np.array([r[0] for r in got], np.int64), matrix([r[1] for r in got], dim) if got else np.zeros((0, dim)), matrix([r[2] for r in got], dim) if got else np.zeros((0, dim))
    number = np.array(sorted(r[0] for r in rows.select("shard").collect()), np.int64)
    return number, np.full((len(number), 1), -np.inf).repeat(dim, 1), np.full((len(number), 1), np.inf).repeat(dim, 1)
