"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling over whole texts.

A word's vector is the sum of the hashed embeddings of the word and of its beginnings, so that words of one stem share
what is learned. The hash space is large (few words share a bucket) and stored sparsely: only buckets that several
training texts hold have an embedding, all others are zero. All weights start at random values. In training the maximum
over a text is a softmax-weighted mean that sharpens from epoch to epoch, so that at first every word of a text gets a
gradient; scores use the maximum itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import kmers
from . import common, langid, near_dup, words
from .tokens import gather


@dataclass(frozen=True)
class Params:
    """epochs: how often a small table is gone through; a table of more than `visits` / 2 rows is gone through twice, by several tasks side by side that meet
    about so many rows each. turn, turn_bytes: so many rows, or bytes of text, are learned from in a task before the tasks' weights are averaged. calibrate_rest:
    rows whose crc32 has this remainder choose the bias and the thresholds and are not trained on. stems: the lengths of a word's
    beginnings that have embeddings of their own. sharpness: of the softmax pooling in the first and the last epoch."""

    visits: int = 25_600
    turn: int = 1600
    turn_bytes: int = 16 << 20
    buckets: int = 1 << 24
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    stems: tuple[int, ...] = (3, 4, 5, 6)
    epochs: int = 8
    sharpness: tuple[float, float] = (0.3, 4.0)
    batch: int = 32
    rate: float = 0.08
    seed: int = 5
    held_mod: int = 5
    held_rest: int = 0
    calibrate_rest: int = 1
    least_rows: int = 30
    least_texts: int = 3


@dataclass
class Model:
    p: Params
    keys: np.ndarray  # the buckets that have an embedding, ascending
    embed: np.ndarray  # (keys + 1, dim); the last row is that of all other buckets
    conv: list[np.ndarray]  # per width (width, dim, filters)
    bias: list[np.ndarray]  # per width (filters,)
    out: np.ndarray  # (widths * filters,)
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """The embedding row of each bucket."""
        if not len(self.keys):
            return np.zeros(buckets.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, buckets), len(self.keys) - 1)
        return np.where(self.keys[at] == buckets, at, len(self.keys))


def word_buckets(texts: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((distinct words, 1 + stems) buckets, codes, offsets); -1 where a word is no longer than a stem. See langid.clean_words."""
    codes, off, strings = langid.clean_words(texts)
    out = np.full((len(strings), 1 + len(p.stems)), -1, np.int64)
    if len(strings):
        out[:, 0] = (words.hash_strings(strings) >> np.uint64(32)).astype(np.int64) % p.buckets
        size = pc.utf8_length(strings).to_numpy(zero_copy_only=False)
        for i, k in enumerate(p.stems, 1):
            longer = np.flatnonzero(size > k)
            begun = pc.utf8_slice_codeunits(strings.take(pa.array(longer)), 0, k)
            out[longer, i] = (words.hash_strings(begun, words.OTHER_STEP) >> np.uint64(32)).astype(np.int64) % p.buckets
    return out, codes, off


def _starts(off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows of each text, their offsets). A text shorter than the width has no window."""
    n = np.maximum(np.diff(off) - width + 1, 0)
    new = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(off[:-1] - new[:-1], n) + np.arange(new[-1]), new


#: Windows whose responses are held at a time; a longer text is pooled in pieces.
AT_ONCE = 200_000


def pooled(vectors: np.ndarray, conv: list[np.ndarray], bias: list[np.ndarray], ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, widths * filters): each filter's maximum over all windows, after the rectifier; 0 for a text without a window.

    vectors: of the distinct words, ids: the words of the texts."""
    out = []
    for c, b in zip(conv, bias):
        resp = [(vectors @ f).astype(np.float32) for f in c]
        start, wo = _starts(off, len(c))
        best = np.full((len(off) - 1, c.shape[2]), -np.inf, np.float32)
        for base in range(0, len(start), AT_ONCE):
            s = start[base : base + AT_ONCE]
            y = sum(r[ids[s + j]] for j, r in enumerate(resp))
            first = int(np.searchsorted(wo, base, "right")) - 1
            last = int(np.searchsorted(wo, base + len(s), "left"))
            edge = np.maximum(wo[first:last] - base, 0)
            full = np.flatnonzero(np.diff(np.append(edge, len(s))))
            best[first + full] = np.maximum(best[first + full], np.maximum.reduceat(y, edge[full], axis=0))
        out.append(np.where(np.isneginf(best), 0, np.maximum(best + b, 0)))
    return np.concatenate(out, 1)


def soft_pooled(vectors: np.ndarray, conv: np.ndarray, bias: np.ndarray, ids: np.ndarray, off: np.ndarray, sharpness: float):
    """What training uses in place of one width's maximum: (features, where the rectifier lets through, weight of each window, window starts, offsets).

    The weights are the softmax of a filter's responses over a text; they are taken as constants by the gradient."""
    start, wo = _starts(off, len(conv))
    n = np.diff(wo)
    full = np.flatnonzero(n)
    mean = np.zeros((len(n), conv.shape[2]))
    if len(full):
        y = sum((vectors @ f)[ids[start + j]] for j, f in enumerate(conv))
        seg, at = np.repeat(np.arange(len(full)), n[full]), wo[:-1][full]
        weight = np.exp(sharpness * (y - np.maximum.reduceat(y, at, axis=0)[seg]))
        weight /= np.add.reduceat(weight, at, axis=0)[seg]
        mean[full] = np.add.reduceat(weight * y, at, axis=0)
    else:
        weight = np.zeros((0, conv.shape[2]))
    z = np.where(n[:, None] > 0, mean + bias, 0)
    return np.maximum(z, 0), z > 0, weight, start, wo


def gradients(vectors: np.ndarray, conv: np.ndarray, ids: np.ndarray, soft: tuple, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one width, from g, the loss's gradient by its features: those by its filters, its bias and the word vectors."""
    _, on, weight, start, wo = soft
    g = np.where(on, g, 0)
    each = np.repeat(g, np.diff(wo), axis=0) * weight
    by_conv, by_word = np.zeros_like(conv), np.zeros_like(vectors)
    for j in range(len(conv)):
        word = ids[start + j]
        total = np.stack([np.bincount(word, each[:, f], len(vectors)) for f in range(conv.shape[2])], 1)
        by_conv[j] = vectors.T @ total
        by_word += total @ conv[j].T
    return by_conv, g.sum(0), by_word


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _unlike(texts: list[str], at_once: int = 200) -> list[int]:
    """The numbers of texts that resemble no earlier one: copies of a text teach once."""
    p = near_dup.Params()
    seen: set[int] = set()
    keep = []
    for base in range(0, len(texts), at_once):
        s, off = words.shingle_sets(pa.array(texts[base : base + at_once], pa.string()))
        for i, row in enumerate(near_dup.band_keys(near_dup.minima(s, off, p.minima), p).tolist()):
            if off[i + 1] == off[i] or seen.isdisjoint(row):
                keep.append(base + i)
            seen.update(row)
    words.give_back()
    return keep


def _text_counts(h: np.ndarray, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ascending, how many texts hold each); one kind of bucket at a time."""
    text = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))
    parts = []
    for i in range(h.shape[1]):
        one = h[codes, i]
        ok = one >= 0
        parts.append((np.unique(text[ok] << 32 | one[ok]) & 0xFFFFFFFF).astype(np.uint32))
    return np.unique(np.concatenate(parts), return_counts=True)


def _held_by(h: np.ndarray, codes: np.ndarray, off: np.ndarray, least: int) -> np.ndarray:
    """The buckets, ascending, that at least so many texts hold."""
    key, n_texts = _text_counts(h, codes, off)
    return key[n_texts >= least].astype(np.int64)


def _start(p: Params, rng: np.random.Generator) -> Model:
    """A model of random filters, as yet without embeddings."""
    k = len(p.widths) * p.filters
    conv = [rng.normal(0, 0.3, (w, p.dim, p.filters)) for w in p.widths]
    return Model(p, np.zeros(0, np.int64), np.zeros((1, p.dim)), conv, [np.full(p.filters, 0.1) for _ in p.widths], np.abs(rng.normal(0, 0.2, k)), 0.0)


def _embedded(m: Model, keys: np.ndarray, rng: np.random.Generator) -> dict:
    """Gives the buckets random embeddings; the sums of squared gradients of all weights, as they begin."""
    p = m.p
    m.keys = keys
    m.embed = np.concatenate([rng.normal(0, 0.05, (len(keys), p.dim)), np.zeros((1, p.dim))]).astype(np.float32)
    return {"e": np.full(m.embed.shape, 1e-3, np.float32), "o": np.full(m.out.shape, 1e-3), "b": 1e-3, "c": [np.full(c.shape, 1e-3) for c in m.conv], "d": [np.full(p.filters, 1e-3) for _ in p.widths]}


def _sharpness(p: Params, done: int, of: int) -> float:
    first, last = p.sharpness
    return first * (last / first) ** (done / max(of - 1, 1))


def _learn(m: Model, acc: dict, of_word: np.ndarray, codes: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray, sharpness: float, rng: np.random.Generator) -> None:
    """One pass over texts in random order; m and acc are changed. of_word: each word's rows of m.embed."""
    p, none = m.p, len(m.embed) - 1
    order = rng.permutation(len(y))
    for s in range(0, len(y), p.batch):
        pick = order[s : s + p.batch]
        n = np.diff(off)[pick]
        so = np.concatenate([[0], np.cumsum(n)])
        used, ids = np.unique(codes[gather(off[:-1][pick], n)], return_inverse=True)
        rows_of = of_word[used]
        vectors = m.embed[rows_of].sum(1, dtype=np.float64)
        soft = [soft_pooled(vectors, c, b, ids, so, sharpness) for c, b in zip(m.conv, m.bias)]
        feats = np.concatenate([x[0] for x in soft], 1)
        g = (_sigmoid(feats @ m.out + m.out_bias) - y[pick]) * weight[pick] / len(pick)
        gf = g[:, None] * m.out[None, :]
        _adagrad(m.out, feats.T @ g + 1e-4 * m.out, acc["o"], p.rate)
        np.maximum(m.out, 0, out=m.out)  # a window can only speak for a text's being of class 1, so no length of clean text hides it
        acc["b"] += g.sum() ** 2
        m.out_bias -= p.rate * g.sum() / acc["b"] ** 0.5
        by_word = np.zeros_like(vectors)
        for q, x in enumerate(soft):
            by_conv, by_bias, part = gradients(vectors, m.conv[q], ids, x, gf[:, q * p.filters : (q + 1) * p.filters])
            by_word += part
            _adagrad(m.conv[q], by_conv, acc["c"][q], p.rate)
            _adagrad(m.bias[q], by_bias, acc["d"][q], p.rate)
        met, place = np.unique(rows_of, return_inverse=True)
        place = place.ravel()
        ge = np.stack([np.bincount(place, np.repeat(by_word[:, d], rows_of.shape[1]), len(met)) for d in range(p.dim)], 1) + 1e-5 * m.embed[met]
        ge[met == none] = 0
        a = acc["e"][met] + ge**2
        acc["e"][met] = a
        m.embed[met] -= p.rate * ge / np.sqrt(a)


def fit(rows: list[tuple[int, str]], p: Params) -> Model:
    """Trains on (label, text) in this process. Without rows of both classes the score is a constant (the label that is there, or 0)."""
    rng = np.random.default_rng(p.seed)
    m = _start(p, rng)
    rows = [rows[i] for i in _unlike([t for _, t in rows])] if rows else []
    y = np.array([label for label, _ in rows], float)
    if not len(y) or y.min() == y.max():
        m.out[:] = 0
        m.out_bias = 6.0 if len(y) and y[0] else -6.0
        return m
    h, codes, off = word_buckets(pa.array([t for _, t in rows], pa.string()), p)
    del rows
    codes = codes.astype(np.int32)
    # a bucket that occurs in few texts could only be learned by heart: it stays at zero, like all that training never sees
    acc = _embedded(m, _held_by(h, codes, off, p.least_texts), rng)
    of_word = m.rows(h).astype(np.int32)
    del h
    words.give_back()
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(p.epochs):
        _learn(m, acc, of_word, codes, off, y, weight, _sharpness(p, epoch, p.epochs), rng)
    del acc, codes, of_word
    words.give_back()
    return m


def _adagrad(x: np.ndarray, g: np.ndarray, acc: np.ndarray, rate: float) -> None:
    acc += g**2
    x -= rate * g / np.sqrt(acc)


def _logits(m: Model, texts: pa.Array) -> np.ndarray:
    h, codes, off = word_buckets(texts, m.p)
    vectors = m.embed[m.rows(h)].sum(1) if len(h) else np.zeros((1, m.p.dim))
    return pooled(vectors, m.conv, m.bias, codes, off) @ m.out + m.out_bias


def score_texts(m: Model, texts: pa.Array) -> np.ndarray:
    return _sigmoid(_logits(m, texts))


def _best_cut(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the fewest (weighted) mistakes; in the middle of its gap."""
    order = np.argsort(score, kind="stable")
    s, y, weight = score[order], y[order], weight[order]
    miss = np.concatenate([[0], np.cumsum(weight * (y == 1))]) + np.concatenate([np.cumsum((weight * (y == 0))[::-1])[::-1], [0]])
    edge = np.concatenate([[True], s[1:] > s[:-1], [True]])
    miss = np.where(edge, miss, np.inf)
    ends = np.concatenate([[0], s, [1]])
    mid = (ends[:-1] + ends[1:]) / 2
    best = np.flatnonzero(miss == miss.min())
    gap = (ends[1:] - ends[:-1])[best]
    return float(mid[best[gap.argmax()]])


def _labelled(docs: DataFrame, labels: DataFrame, p: Params, id_col: str, text_col: str, lang_col: str | None) -> str:
    """The path of id, h, text, lang, y, rest of every labelled row that isn't held out. A bitmap of the labels' ids keeps most other texts from being shuffled; the join decides."""
    known = labels.select(F.col(id_col).alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    known = known.where(common.crc_mod("k", p.held_mod) != p.held_rest).select(F.col("k").cast("string").alias("key"), "y")
    seen = kmers.marks(known.select(F.xxhash64("key").alias("h")), "h", known.count())
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rest = common.crc_mod(id_col, p.held_mod)
    got = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (rest != p.held_rest))
    got = got.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"), lang.alias("lang"), rest.cast("long").alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(kmers.met(seen.value, b.column("h").to_numpy())))

    got = got.mapInArrow(run, "id string, h long, text string, lang string, rest long")
    got = got.join(known, got.id == known.key)
    one = got.groupBy("id", "h").agg(F.min(F.struct("text", "lang", "y", "rest")).alias("x")).select("id", "h", "x.*")  # one text for each id, however often it repeats
    return common.write(one, "labelled")


def _copies(rows: DataFrame) -> DataFrame:
    """h of the rows whose text resembles one of a smaller h: copies of a text teach once. As _unlike(), over all rows."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = near_dup.Params()
        for whole in batches:
            for part in words.slices(whole, "text"):
                s, off = words.shingle_sets(part.column("text"))
                full = np.flatnonzero(np.diff(off))
                keys = near_dup.band_keys(near_dup.minima(s, off, p.minima), p)[full]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("h").to_numpy()[full], p.bands))], ["key", "h"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a key's smallest h comes first
        for b in batches:
            if len(b):
                key, h = (b.column(c).to_numpy() for c in ("key", "h"))
                lead = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
                at = np.maximum.accumulate(np.where(lead, np.arange(len(h)), -1))
                low = np.where(at < 0, last[1] if last else 0, h[np.maximum(at, 0)])
                last = (key[-1], low[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[h > low]))], ["h"])

    signed = rows.select("h", "text").mapInArrow(sign, "key long, h long")
    return common.materialize(signed.repartition("key").sortWithinPartitions("key", "h").mapInArrow(later, "h long").distinct(), "copies")


_PIECE = "unit int, y binary, codes binary, off binary, buckets binary, turn int"


def _pieces(rows: DataFrame, copies: DataFrame, units: int, turns: int, p: Params) -> str:
    """The path of rows as in _PIECE: what one unit learns from in one turn, as arrays. Which rows those are depends on their ids alone."""
    piece = F.pmod(F.xxhash64("h"), F.lit(units * turns)).cast("int").alias("piece")
    both = rows.select(piece, "h", F.lit(1).alias("kind"), "y", "text").union(copies.select(piece, "h", F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            kind, h = (t.column(c).to_numpy() for c in ("kind", "h"))
            t = t.filter(pa.array((kind == 1) & ~np.isin(h, h[kind == 0])))
            buckets, codes, off = word_buckets(pa.concat_arrays([pa.array([], pa.string()), *t.column("text").chunks]), p)
            used, codes = np.unique(codes, return_inverse=True)
            raw = [t.column("y").to_numpy().astype(np.int8), codes.astype(np.int32), off.astype(np.int64), buckets[used].astype(np.int32)]
            held.clear()
            words.give_back()
            return pa.RecordBatch.from_arrays([pa.array([now // turns], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in raw), pa.array([now % turns], pa.int32())], [x.split()[0] for x in _PIECE.split(", ")])

        for b in batches:
            of = b.column("piece").to_numpy()
            cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for i, j in zip(cut, cut[1:]):
                if j > i:
                    if held and of[i] != now:
                        yield made()
                    now = int(of[i])
                    held.append(b.slice(i, j - i))
        if held:
            yield made()

    path = common.scratch(rows.sparkSession, "pieces")
    both.repartition("piece").sortWithinPartitions("piece", "h").mapInArrow(run, _PIECE).write.partitionBy("turn").parquet(path)
    return path


def _arrays(b: pa.RecordBatch, i: int, p: Params) -> tuple[np.ndarray, ...]:
    """(y, codes, offsets, buckets of the words) of a piece."""
    y, codes, off, h = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in (("y", np.int8), ("codes", np.int32), ("off", np.int64), ("buckets", np.int32)))
    return y.astype(float), codes, off, h.reshape(-1, 1 + len(p.stems))


def _all_held_by(pieces: DataFrame, p: Params) -> np.ndarray:
    """The buckets, ascending, that at least p.least_texts of all texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                _, codes, off, h = _arrays(b, i, p)
                key, n = _text_counts(h, codes, off)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n)], ["key", "n"])

    found = pieces.mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least_texts)
    return np.sort(found.select("key").toArrow().column(0).to_numpy()).astype(np.int64)  # at most p.buckets numbers


def _dense(m: Model, acc: dict) -> list[np.ndarray]:
    """All weights but the embeddings, with their sums."""
    return [m.out, *m.conv, *m.bias, acc["o"], *acc["c"], *acc["d"], np.array([m.out_bias, acc["b"]])]


def _set_dense(m: Model, acc: dict, flat: np.ndarray) -> None:
    at = 0
    for x in _dense(m, acc)[:-1]:
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    m.out_bias, acc["b"] = float(flat[at]), float(flat[at + 1])


#: Embeddings that are averaged at a time.
BLOCK = 1 << 15


def _turn(pieces: DataFrame, m: Model, acc: dict, weights: tuple[float, float], seed: list[int], sharpness: list[float]) -> None:
    """Each unit learns from its piece, beginning with m; then m and acc are the means over the units, for an embedding over those that met it."""
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast((m, acc))
    clean, toxic = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, sums = shared.value
        p = whole.p
        for b in batches:
            for i, unit in enumerate(b.column("unit").to_pylist()):
                y, codes, off, h = _arrays(b, i, p)
                met, of_word = np.unique(whole.rows(h), return_inverse=True)
                met = met[met < len(whole.keys)]  # the row of all other buckets is the last, here as there
                own = Model(p, met, np.concatenate([whole.embed[met], whole.embed[-1:]]), [c.copy() for c in whole.conv], [c.copy() for c in whole.bias], whole.out.copy(), whole.out_bias)
                acc_ = {"e": np.concatenate([sums["e"][met], sums["e"][-1:]]), "o": sums["o"].copy(), "b": sums["b"], "c": [c.copy() for c in sums["c"]], "d": [c.copy() for c in sums["d"]]}
                rng = np.random.default_rng([*seed, unit])
                for x in sharpness:
                    _learn(own, acc_, of_word.reshape(h.shape), codes, off, y, np.where(y == 1, toxic, clean), x, rng)
                out = [(-1, b"", np.concatenate([x.ravel() for x in _dense(own, acc_)]).tobytes())]
                cut = np.flatnonzero(np.diff(met // BLOCK, prepend=-1))
                for a, z in zip(cut, np.append(cut[1:], len(met))):
                    out.append((int(met[a]) // BLOCK, (met[a:z] % BLOCK).astype(np.int32).tobytes(), np.concatenate([own.embed[a:z], acc_["e"][a:z]], 1).astype(np.float32).tobytes()))
                block, at, values = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([unit] * len(out), pa.int32()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["block", "unit", "at", "weights"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n, width = None, None, None, 2 * shared.value[0].p.dim

        def out() -> pa.RecordBatch:
            on = np.flatnonzero(n)
            at, x = (b"", total / n[0]) if now < 0 else (on.astype(np.int32).tobytes(), (total[on] / n[on, None]).astype(np.float32))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "at", "weights"])

        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                at, x = np.frombuffer(b.column("at")[i].as_buffer(), np.int32), b.column("weights")[i].as_buffer()
                if block != now:
                    if now is not None:
                        yield out()
                    now, total, n = block, np.zeros(len(x) // 8 if block < 0 else (BLOCK, width)), np.zeros(1 if block < 0 else BLOCK)
                if block < 0:
                    total += np.frombuffer(x, np.float64)
                    n += 1
                else:
                    total[at] += np.frombuffer(x, np.float32).reshape(-1, width)
                    n[at] += 1
        if now is not None:
            yield out()

    learned = pieces.mapInArrow(run, "block int, unit int, at binary, weights binary").repartition("block").sortWithinPartitions("block", "unit")
    for r in learned.mapInArrow(mean, "block int, at binary, weights binary").collect():  # at most the model's size
        if r.block < 0:
            _set_dense(m, acc, np.frombuffer(r.weights, np.float64))
        else:
            at, x = np.frombuffer(r["at"], np.int32) + r.block * BLOCK, np.frombuffer(r.weights, np.float32).reshape(-1, 2 * m.p.dim)
            m.embed[at], acc["e"][at] = x[:, : m.p.dim], x[:, m.p.dim :]
    shared.destroy()


def plan(n: int, size: int, p: Params) -> tuple[int, int, int]:
    """(passes, units, turns) for n rows of size bytes."""
    passes = min(p.epochs, max(2, round(p.visits / n)))
    units = max(1, round(n * passes / p.visits))
    return passes, units, max(-(-n // (units * p.turn)), -(-size // (units * p.turn_bytes)), 1)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> Model:
    """A model from all labelled rows that aren't held out (crc32 of the id as text, modulo held_mod).

    Rows with a null id, text or label take no part; of an id's conflicting labels the larger holds, of its several texts the
    smallest is used. Rows are dealt to units and turns by id; in a turn the units learn side by side, each from some rows, and their weights are averaged. The rows of
    calibrate_rest then choose the bias, so that 0.5 makes the fewest mistakes, and a threshold for each language."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    path = _labelled(docs, labels, p, id_col, text_col, lang_col)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # else the shuffles of all turns stay until the driver collects its garbage
    try:
        return _trained(spark, path, p)
    finally:
        spark.conf.set(_CLEANUP, before)
        common.drop(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _trained(spark: SparkSession, path: str, p: Params) -> Model:
    rows = spark.read.schema("id string, h long, text string, lang string, y int, rest long").parquet(path)
    taught = rows.where(F.col("rest") != p.calibrate_rest)
    copies = _copies(taught)
    n, toxic, size = taught.select("h", "y", F.octet_length("text").alias("size")).join(copies, "h", "left_anti").agg(F.count("*"), F.sum("y"), F.sum("size")).first()
    if not toxic or toxic == n:
        return fit([(int(bool(toxic)), "")] if n else [], p)
    passes, units, turns = plan(n, size, p)
    where = _pieces(taught, copies, units, turns, p)
    pieces = spark.read.schema(_PIECE).parquet(where)
    rng = np.random.default_rng(p.seed)
    m = _start(p, rng)
    acc = _embedded(m, _all_held_by(pieces, p), rng)
    weights = 0.5 / (1 - toxic / n), 0.5 / (toxic / n)
    if units == turns == 1:
        _turn(pieces, m, acc, weights, [p.seed, 0], [_sharpness(p, e, passes) for e in range(passes)])
    else:
        for r in range(passes * turns):
            _turn(pieces.where(F.col("turn") == r % turns), m, acc, weights, [p.seed, r], [_sharpness(p, r, passes * turns)])
    del acc
    common.drop(spark, where)
    _calibrate(m, rows.where(F.col("rest") == p.calibrate_rest))
    words.give_back()
    return m


#: Steps of a logit that scores are counted by.
STEPS = 1000


def _calibrate(m: Model, held: DataFrame) -> None:
    """Sets the bias and the thresholds from all rows of held; their scores are counted, by language, in steps of 1/STEPS of a logit."""
    p, shared = m.p, held.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in words.slices(whole, "text"):
                step = np.rint(np.clip(_logits(shared.value, part.column("text")), -40, 40) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("y"), pa.array(step)], ["lang", "y", "step"])

    got = held.select("lang", "y", "text").mapInArrow(run, "lang string, y int, step int").groupBy("lang", "y", "step").count().orderBy("step", "y", "lang").collect()
    shared.destroy()
    y, n, logit = np.array([r.y for r in got]), np.array([r["count"] for r in got], float), np.array([r.step / STEPS for r in got])
    if len(set(y.tolist())) < 2 or not m.out.any():
        return
    cut = min(max(_best_cut(_sigmoid(logit), y, n), 1e-6), 1 - 1e-6)
    by = float(np.log(cut / (1 - cut)))
    m.out_bias -= by
    score = _sigmoid(logit - by)
    langs = np.array([r.lang or "" for r in got])
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if n[own].sum() >= p.least_rows and len(set(y[own].tolist())) == 2:
            t = _best_cut(score[own], y[own], n[own])
            m.thresholds[lang] = t if n[own][(score[own] >= t) != y[own]].sum() < n[own][(score[own] >= 0.5) != y[own]].sum() else 0.5


def classify(docs: DataFrame, m: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs with score, predicted (score >= 0.5), threshold and flagged (score >= threshold) added; underscores follow taken names.

    The score reads the whole text alone; the threshold is that of the row's language, 0.5 where the language is null or
    was not calibrated. Null and empty texts, and texts without letters, have no window and get the score of the bias.
    Repeated rows get the same answer. One map pass, no shuffle; the model is of fixed size and broadcast."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    names: list[str] = []
    for wanted in ("score", "predicted", "threshold", "flagged"):
        names.append(common.free_name(wanted, [*docs.columns, *names]))
    shared = spark.sparkContext.broadcast(m)
    column = text_col
    by = lang_col if lang_col and lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for part in words.slices(whole, column):
                score = score_texts(model, part.column(column)).astype(float)
                langs = part.column(by).to_pylist() if by else [None] * len(part)
                t = np.array([model.thresholds.get(x, model.threshold) for x in langs], float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(t), pa.array(score >= t)], [*part.schema.names, *names])

    kinds = (T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def stage(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that are not flagged as toxic; all columns stay, none are added.

    Rows with a null, empty or letterless text have the score of the bias, so they stay unless the threshold is below that. Repeated rows
    stay or go alike, null ids are judged like others. No rows: no rows. Without labels of both classes everything gets the
    one label there is (none: clean)."""
    tagged = classify(docs, train(docs, labels, p))
    return tagged.where(~F.col(tagged.columns[-1])).select(*docs.columns)
