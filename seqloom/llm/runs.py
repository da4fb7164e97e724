"""Runs of repeated words (maximal periodic stretches) from Lyndon arrays over an ordered alphabet, and their removal.

Words become numbers in the order of the words; from there on numbers are only compared. A run of exponent two or more holds, for the
order or for its reverse, a word's Lyndon factor: the stretch from a place to the next place whose suffix is smaller is the run's period. So one
pass for each order over next-smaller-suffix edges gives all runs: an edge of length p whose suffixes agree over r words, extended to the left."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words


@dataclass(frozen=True)
class Params:
    """A run counts if it has at least min_length words and at least exponent (an integer from 2) times its period."""

    min_length: int = 6
    exponent: int = 4

    def __post_init__(self) -> None:
        if self.exponent < 2:
            raise ValueError("exponent must be 2 or more")


#: From so many words on, arrays of four-byte integers hold what lists of Python integers hold below: memory differs, results do not.
COMPACT = 200_000


def edges(w: Sequence[int]) -> tuple[Sequence[int], Sequence[int]]:
    """(next, agree) of each place: where the next smaller suffix begins (the text's length if none is), and over how many words it agrees.

    w ends with a number below all others, which is not a place. Time is linear: places are taken from left to right against the chain of
    smaller suffixes before them. How far two suffixes agree comes from three sources, none of which reads a word twice: from
    the chain, where two known lengths differ; inside the last matched extension (from `begin` to `end`, equal to what lies `shift` before),
    from the same pair `shift` to the left, if that ends before `end`; else by reading on at `end`, which makes the matched extension longer."""
    n = len(w) - 1
    make = list if n < COMPACT else lambda x: array("i", x)
    nxt, agree = make([n]) * n, make([0]) * n
    prev, agree_prev = make([-1]) * (n + 1), make([0]) * (n + 1)
    begin = end = shift = 0
    for i in range(1, n):
        x = i - 1
        same = 0
        if i < end:
            k = i - shift
            while True:
                # the pair (x, i) shift to the left, or, where x lies before the extension, the pair (x, i - shift)
                smaller = x >= begin and nxt[x - shift] == k
                r = agree[x - shift] if smaller else agree_prev[k]
                if i + r >= end:
                    same = end - i
                    break
                if smaller:
                    nxt[x], agree[x] = i, r
                    x = prev[x]
                    if x < 0:
                        break
                else:
                    prev[i], agree_prev[i] = x, r
                    break
            if not same:
                continue
        here = w[i + same]
        there = w[x + same]
        while True:
            if here == there:
                same += 1
                while w[x + same] == w[i + same]:
                    same += 1
                here, there = w[i + same], w[x + same]
            if same:
                begin, shift, end = i, i - x, i + same
            if there < here:
                prev[i], agree_prev[i] = x, same
                break
            # suffix i is smaller than that of x, and of all in the chain that agree with x over more words than i does
            while True:
                nxt[x] = i
                if same:
                    agree[x] = same
                r, x = agree_prev[x], prev[x]
                if r <= same:
                    break
            if x < 0:
                break
            if r < same:
                prev[i], agree_prev[i] = x, r
                break
            there = w[x + same]
    return nxt, agree


def runs_of(ranks: np.ndarray, p: Params = Params()) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a text of ranked words, by start, then period. period is the smallest one."""
    n = len(ranks)
    if n < p.min_length:
        return []
    found: set[tuple[int, int, int]] = set()
    top = int(ranks.max()) + 1
    place = np.arange(n)
    for order in (ranks, top - 1 - ranks):
        w = np.append(order, -1)
        w = w.tolist() if n < COMPACT else array("i", w.astype(np.int32).tobytes())
        nxt, agree = (np.array(x, np.int64) for x in edges(w))
        period = nxt - place
        # the first Lyndon factor after a run's start leaves exponent - 2 periods and more to its right
        for i in np.flatnonzero((agree >= (p.exponent - 2) * period) & (nxt < n)).tolist():
            q, r = int(period[i]), int(agree[i])
            if i >= q and nxt[i - q] == i and agree[i - q] == r + q:
                continue  # the factor before belongs to the same run
            start = i
            while start > 0 and w[start - 1] == w[start - 1 + q]:
                start -= 1  # at most q steps, else the factor before would have been found
            length = i + q + r - start
            if length >= max(p.min_length, p.exponent * q):
                found.add((start, length, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


RUNS = "array<struct<start:long,length:long,period:long>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", places: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, n_words, runs (start, length, period of each, by start, then period), collapsed.

    Words are runs of characters other than ASCII white space, as written. collapsed: the words, joined by one space, without those that a
    run holds after its first period. places(id, n), if given, names for each of a text's n words the word that stands there instead (None: as they
    are). A null text is an empty one: no words, no runs, empty collapsed text. Null and repeated ids are rows like others; extra columns are
    ignored; no rows, no rows. Texts are worked on whole, each alone in its task, in time linear in its words: nothing is shuffled."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in words.slices(whole, "text"):
                codes, off, uniques = words.split(part.column("text"), lower=False)
                rank = np.zeros(0, np.int64)
                if len(uniques):
                    rank = pc.rank(uniques, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
                all_runs, kept, size = [], [], []
                for doc, a, b in zip(part.column("id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    code = codes[a:b]
                    if places is not None and (at := places(doc, b - a)) is not None:
                        code = code[at]
                    mine = runs_of(rank[code], p)
                    if mine:
                        gone = np.zeros(b - a, bool)
                        for s, n, q in mine:
                            gone[s + q : s + n] = True
                        code = code[~gone]
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                    kept.append(code)
                    size.append(len(code))
                cut = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(cut, uniques.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))), " ")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off)), pa.array(all_runs, _KIND), text], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """What detect() found, with digests in place of texts: id, n_runs, then start, length, period and exponent_milli of the run with the
    greatest length over period (ties: smallest start, then period; nulls without runs), runs_sha256, collapsed_sha256."""
    id_col = found.columns[0]
    # exact: of two runs that with the greater product of its length and the other's period comes first; both stay below 2 ** 63
    lead = F.array_sort("runs", lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1)
                        .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    x = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.get(lead, F.lit(0)).alias("best"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return x.select(
        id_col, "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
