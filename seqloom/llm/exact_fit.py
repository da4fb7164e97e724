"""Packing into the fewest sequences of a fixed capacity: gaps are filled exactly by one, two or three lengths, then what is left by best fit.

Equal lengths are interchangeable, so that the plan is made over the counts of lengths (at most `capacity` of them, however many
documents there are); it says, for stretches of the rows of each length, which sequences and places they take."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens, words


@dataclass(frozen=True)
class Params:
    """tokenizer: its file. capacity: tokens of a sequence. end_id: follows each document. segment: about so many rows of a length are numbered together."""

    tokenizer: str
    capacity: int = 2048
    end_id: int = 0
    segment: int = 8192


class Sums:
    """Which lengths are at hand, and for each sum how many pairs and how many triples of lengths at hand (one may repeat) make it.

    A length that comes or goes changes the pairs that hold it by a shift of the lengths, the triples that hold it by a shift of the pairs."""

    def __init__(self, capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        self.have = np.zeros(capacity + 1, bool)
        self.pairs, self.triples = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)

    def add(self, n: int, count: int) -> None:
        self.count[n] = count
        self.have[n] = True
        room = len(self.have) - n
        self.pairs[n:] += self.have[:room]
        self.triples[n:] += self.pairs[:room]

    def take(self, n: int, count: int) -> None:
        self.count[n] -= count
        if not self.count[n]:
            room = len(self.have) - n
            self.triples[n:] -= self.pairs[:room]
            self.pairs[n:] -= self.have[:room]
            self.have[n] = False

    def _left(self, n: int, used: list[int]) -> int:
        return int(self.count[n]) - used.count(n)

    def one(self, gap: int, used: list[int]) -> list[int] | None:
        return [gap] if self.have[gap] and self._left(gap, used) > 0 else None

    def two(self, gap: int, used: list[int]) -> list[int] | None:
        """The pair with the largest length at hand."""
        if not self.pairs[gap]:
            return None
        both = np.flatnonzero(self.have[: gap + 1] & self.have[gap::-1])
        for a in both[both >= gap - gap // 2][::-1].tolist():
            b = gap - a
            if self._left(a, used) > 0 and self._left(b, [*used, a]) > 0:
                return [a, b]
        return None

    def three(self, gap: int, used: list[int]) -> list[int] | None:
        """The triple with the largest length at hand."""
        if not self.triples[gap]:
            return None
        for a in np.flatnonzero(self.have[: gap + 1] & (self.pairs[gap::-1] > 0))[::-1].tolist():
            if self._left(a, used) > 0 and (rest := self.two(gap - a, [*used, a])):
                return [a, *rest]
        return None

    def largest(self, gap: int, used: list[int]) -> int | None:
        """The largest length at hand that a gap holds."""
        return next((n for n in np.flatnonzero(self.have[: gap + 1])[::-1].tolist() if self._left(n, used) > 0), None)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(stretches, number of sequences). A stretch (length, first, each, sequence, offset): the rows of a length from number `first` on, up to the
    next stretch, go `each` to a sequence, one sequence after the other from `sequence` on, at `offset` and following places.

    Exact fillings come first: of a sequence that begins with a length, from the largest on, by one more length, then by pairs, then
    by triples; where no triple fills the gap, the largest length that fits goes in and triples are tried again. As many such
    sequences are made at once as the counts allow. What is left over goes, largest first, each where the gap is smallest, equal sequences together."""
    sums, done, out, sequences = Sums(capacity), dict.fromkeys(counts, 0), [], 0
    for n, c in counts.items():
        if c > 0:
            sums.add(n, c)

    def put(n: int, each: int, number: int, first: int, offset: int) -> None:
        out.append((n, done[n], each, first, offset))
        done[n] += each * number

    def make(lengths: list[int], number: int) -> None:
        nonlocal sequences
        offset = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            put(n, each, number, sequences, offset)
            sums.take(n, each * number)
            offset += each * n
        sequences += number

    def exact(n: int, fill: Callable[[int, list[int]], list[int] | None]) -> list[int] | None:
        """A full sequence that begins with n: more of the largest that fit, as long as nothing fills the gap (only where triples are tried), then what fills it."""
        used, gap = [n], capacity - n
        while gap:
            if (filled := fill(gap, used)) is not None:
                return used + filled
            more = sums.largest(gap, used) if fill == sums.three else None
            if more is None:
                return None
            used, gap = [*used, more], gap - more
        return used

    for fill in (sums.one, sums.two, sums.three):
        for largest in np.flatnonzero(sums.have)[::-1].tolist():
            while sums.have[largest]:
                used = exact(largest, fill)
                if used is None:
                    break
                make(used, min(int(sums.count[n]) // used.count(n) for n in used))
    rest = {n: int(sums.count[n]) for n in np.flatnonzero(sums.have).tolist()}

    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence, number of sequences
    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                each, number = capacity // n, left // (capacity // n)
                if not number:
                    each, number = left, 1
                gap, first = capacity, sequences
                sequences += number
            else:
                first, held = gaps[gap].pop()
                each, number = gap // n, min(held, left // (gap // n))
                if not number:
                    each, number = left, 1
                if number < held:
                    gaps[gap].append((first + number, held - number))
                if not gaps[gap]:
                    del gaps[gap]
            put(n, each, number, first, capacity - gap)
            left -= each * number
            gaps.setdefault(gap - each * n, []).append((first, number))
        gaps.pop(0, None)
    return np.array(sorted(out), np.int64).reshape(-1, 5), sequences


PIECES = ("piece int", "start long", "length long", "ids_crc32 long")


def pieces(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids: each whole text's ids and the end id, cut after every `capacity` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(p.tokenizer)
        for whole in batches:
            for part in words.slices(whole, "text"):
                made, off = enc.encode(part.column("text"))
                n = np.diff(off)
                flat = np.insert(made, off[1:], p.end_id).astype("<u4")
                size = n + 1
                number = -(-size // p.capacity)
                owner = np.repeat(np.arange(len(n)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * p.capacity
                length = np.minimum(size[owner] - start, p.capacity)
                at = (np.cumsum(size) - size)[owner] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                columns = [part.column("id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *PIECES, *(["ids array<int>"] if ids else [])]))


def pack(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A document is its ids and the end id; only one longer than the capacity is cut, into pieces of the capacity and a last one of what is
    left. Sequences are filled from 0 without gaps. Null and empty texts are the end id alone; null and repeated ids are rows like others,
    equal rows interchangeable; extra columns are ignored; no rows, no rows.

    Texts are read and encoded once; pieces are written out. The counts of lengths (at most `capacity` rows) reach the driver, which
    plans; the stretches of the plan go to all tasks. Rows of one length are numbered in segments by hash, so that a length that a third
    of all rows has is many tasks' work."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    x = common.materialize(pieces(docs, p, id_col, text_col, ids), "pieces")
    counts = dict(x.groupBy("length").agg(F.count("*")).collect())
    stretches, _ = plan(counts, p.capacity)
    many = F.lit(1).cast("long")
    if split := sorted((n, -(-c // p.segment)) for n, c in counts.items() if c > p.segment):
        table = F.map_from_arrays(F.split(F.lit(",".join(str(n) for n, _ in split)), ",").cast("array<bigint>"), F.split(F.lit(",".join(str(s) for _, s in split)), ",").cast("array<bigint>"))
        many = F.coalesce(F.try_element_at(table, F.col("length")), many)
    x = x.withColumn("segment", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), many))
    sizes = x.groupBy("length", "segment").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("length").alias("of"), F.col("segment").alias("in"), (F.sum("n").over(W.partitionBy("length").orderBy("segment")) - F.col("n")).alias("before"))
    own = W.partitionBy("length", "segment").orderBy("id", "piece", "ids_crc32")
    x = x.withColumn("nth", F.row_number().over(own)).join(sizes, (F.col("length") == F.col("of")) & (F.col("segment") == F.col("in")))
    x = x.select("id", *(c.split(" ")[0] for c in PIECES), *(["ids"] if ids else []), (F.col("before") + F.col("nth") - 1).alias("number"))
    key = stretches[:, 0] << 48 | stretches[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, number = (b.column(c).to_numpy() for c in ("length", "number"))
            row = stretches[np.searchsorted(key, n << 48 | number, "right") - 1] if len(n) else np.zeros((0, 5), np.int64)
            nth = number - row[:, 1]
            sequence = row[:, 3] + nth // np.maximum(row[:, 2], 1)
            offset = row[:, 4] + nth % np.maximum(row[:, 2], 1) * n
            keep = [c for c in b.schema.names if c not in ("number", "ids")]
            columns = [*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset), *([b.column("ids")] if ids else [])]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "sequence_id", "offset", *(["ids"] if ids else [])])

    kind = ", ".join([f"id {x.schema['id'].dataType.simpleString()}", *PIECES, "sequence_id long", "offset long", *(["ids array<int>"] if ids else [])])
    return x.mapInArrow(place, kind).withColumnRenamed("id", id_col)
