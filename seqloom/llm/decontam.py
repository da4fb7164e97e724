"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words
from .near_dup import minima


@dataclass(frozen=True)
class Params:
    """threshold: per cent of an item's shingles that a document must hold. minima: universal hashes; an item at the
    threshold shares each minimum with its window with probability over 0.19 (see Index), so that all of 64 miss with
    probability under 2e-6. part_bytes: benchmark text in one broadcast index; a larger benchmark is searched in parts."""

    threshold: int = 80
    minima: int = 64
    part_bytes: int = 16_000_000
    shingle: int = words.SHINGLE


class Index:
    """Items by size: partition i holds items of 2 ** (i - 1) < size <= 2 ** i = u shingles, and is searched with windows of
    2u document shingles that begin every u, so that any passage of u shingles lies inside one. Window and item then
    differ in size by a factor of 4 at most, which bounds their Jaccard similarity from below by the containment:
    J >= 0.8 q / (q + 4 q - 0.8 q) = 0.19, however long the document is. That holds for a passage inside one window; an item
    whose shingles are spread further has a weaker bound."""

    def __init__(self, items: list[tuple[int, str]], p: Params):
        items = sorted(set(items))
        s, off = words.shingle_sets(pa.array([t for _, t in items], pa.string()), p.shingle)
        keep = np.flatnonzero(np.diff(off))
        self.p, self.ids = p, [items[i][0] for i in keep.tolist()]
        self.sets = [s[off[i] : off[i + 1]] for i in keep.tolist()]
        self.all = np.unique(s)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.all & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        size = np.array([len(x) for x in self.sets], np.int64)
        part = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        self.parts: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]] = []
        for i in sorted(set(part.tolist())):
            own = np.flatnonzero(part == i)
            m = minima(np.concatenate([self.sets[k] for k in own.tolist()]), np.concatenate([[0], np.cumsum(size[own])]), p.minima)
            by = []
            for k in range(p.minima):
                order = np.argsort(m[:, k], kind="stable")
                by.append((m[order, k], own[order]))
            self.parts.append((1 << i, by))

    def candidates(self, s: np.ndarray, off: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minimum in some window. s: shingles in order. Windows without any item's shingle are skipped: their containment is 0."""
        maybe = np.flatnonzero(self.bits[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe):
            return set()
        at = np.minimum(np.searchsorted(self.all, s[maybe]), len(self.all) - 1)
        hit = maybe[self.all[at] == s[maybe]]
        text = np.searchsorted(off, hit, "right") - 1
        out: set[tuple[int, int]] = set()
        for u, by in self.parts:
            # the windows that hold a hit: of those beginning every u shingles, the one at its place and the one before
            w = (hit - off[text]) // u
            key = np.unique(np.concatenate([np.stack([text, w], 1), np.stack([text, np.maximum(w - 1, 0)], 1)]), axis=0)
            for base in range(0, len(key), 20_000):
                t, k = key[base : base + 20_000].T
                a = off[t] + k * u
                n = np.minimum(off[t + 1] - a, 2 * u)
                flat = s[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                m = minima(flat, np.concatenate([[0], np.cumsum(n)]), self.p.minima)
                for h, (value, item) in enumerate(by):
                    lo, hi = np.searchsorted(value, m[:, h]), np.searchsorted(value, m[:, h], "right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        out.update((int(t[i]), int(x)) for x in item[lo[i] : hi[i]])
        return out

    def matches(self, texts: pa.Array) -> list[dict[int, tuple[int, int]]]:
        """Of each text: {item id: (its shingles, how many of them the text holds)} for those at the threshold."""
        codes, off, uniques = words.split(texts)
        s, o = words.shingles(words.hash_strings(uniques)[codes], off, self.p.shingle)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(texts))]
        held: dict[int, np.ndarray] = {}
        for t, i in sorted(self.candidates(s, o)):
            if t not in held:
                held = {t: np.unique(s[o[t] : o[t + 1]])}
            q, x = self.sets[i], held[t]
            at = np.minimum(np.searchsorted(x, q), len(x) - 1)
            both = int((x[at] == q).sum())
            if 100 * both >= self.p.threshold * len(q):
                old = out[t].get(self.ids[i])
                if old is None or both * old[0] > old[1] * len(q):
                    out[t][self.ids[i]] = (len(q), both)
        return out


def _parts(benchmark: DataFrame, p: Params, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in lists of about p.part_bytes of text, one list at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // p.part_bytes))
    for i in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)).collect()]


MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())]))


def with_matches(docs: DataFrame, items: list[tuple[int, str]], p: Params, text_col: str, out_col: str) -> DataFrame:
    """docs with an array of (item_id, n_item, n_shared) added, empty for clean rows. One map pass; only the index is broadcast."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((items, p))
    made: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Index(*shared.value))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())]))
        for whole in batches:
            for part in words.slices(whole, text_col):
                found = made[0].matches(part.column(text_col)) if made[0].ids else [{}] * len(part)
                rows = [[{"item_id": i, "n_item": a, "n_shared": b} for i, (a, b) in sorted(x.items())] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, MATCHES)]))


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: one row for each row of docs and item whose distinct word
    shingles the row's whole text holds to at least p.threshold per cent.

    Words and shingles as in near_dup: a text or item of 1 to 4 words is one shingle, its whole sequence, so that it matches
    only its like. Null, empty and white-space texts and items match nothing; items with a null id are left out;
    repeated items count once (of one id's texts the best match holds); repeated documents are each reported. No rows on
    either side: no rows out. Extra columns are ignored. Documents are never shuffled."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _parts(benchmark, p, item_id, item_text):
        got = with_matches(base, items, p, "text", "found").select("doc_id", F.explode("found").alias("x")).select(
            "doc_id", F.col("x.item_id").alias("item_id"), F.col("x.n_item").alias("n_item_shingles"), F.col("x.n_shared").alias("n_shared"), (F.col("x.n_shared") / F.col("x.n_item")).alias("containment")
        )
        out = got if out is None else out.union(got)
    return out


def stage(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; all columns stay, none are added.

    Null, empty and white-space texts hold none and stay; repeated rows stay or go alike; no items, no row goes; no rows: no rows."""
    name = common.free_name("__found", docs.columns)
    for items in _parts(benchmark, p, "item_id", "text"):
        docs = with_matches(docs, items, p, text_col, name).where(F.size(name) == 0).drop(name)
    return docs
