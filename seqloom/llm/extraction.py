"""HTML main-text extraction: a bidirectional LSTM in numpy labels every leaf block of a page with the whole page as context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common, langid, made_pages, words
from .html_blocks import Page, blocks


@dataclass(frozen=True)
class Params:
    """pages: how many made pages train the labeller (their labels are known, see made_pages). least_pages: words of fewer
    pages have no vector, so that nothing is learned by heart from words that mean nothing."""

    pages: int = 1400
    epochs: int = 5
    hidden: int = 20
    path_buckets: int = 1 << 12
    word_buckets: int = 1 << 15
    least_pages: int = 30
    path_dim: int = 20
    word_dim: int = 6
    batch: int = 32
    rate: float = 0.012
    seed: int = 3


NUMBERS = 4


@lru_cache(maxsize=100_000)
def _bucket(text: str, n: int) -> int:
    h = 2166136261
    for c in text.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % n


@dataclass
class Features:
    """Of the blocks of some pages. A block's path vector is the mean over the words of its elements' entries (each once) and the
    words of its own; sums run down the tree of elements, so the work is in proportion to the page however deep it is."""

    parent: np.ndarray  # of each element, -1 at the top
    levels: list[np.ndarray]  # the elements of each depth
    words_of: np.ndarray  # buckets of the elements' fresh words
    words_off: np.ndarray
    n_path: np.ndarray  # words on the way down to each element
    node: np.ndarray  # of each block
    own: np.ndarray  # buckets of the blocks' own words
    own_off: np.ndarray
    words: np.ndarray
    word_off: np.ndarray
    numbers: np.ndarray


def _runs(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x for y in lists for x in y], np.int64), np.concatenate([[0], np.cumsum([len(y) for y in lists], dtype=np.int64)])


def features(pages: list[Page], p: Params) -> Features:
    parent: list[int] = []
    depth: list[int] = []
    n_path: list[int] = []
    fresh: list[list[int]] = []
    node: list[int] = []
    own: list[list[int]] = []
    for page in pages:
        base = len(parent)
        for up, words_ in zip(page.parent, page.fresh):
            parent.append(up + base if up >= 0 else -1)
            depth.append(depth[up + base] + 1 if up >= 0 else 0)
            fresh.append([_bucket(t, p.path_buckets) for t in words_])
            n_path.append(len(words_) + (n_path[up + base] if up >= 0 else 0))
        leaf: dict[int, list[int]] = {}
        for b in page.blocks:
            if b.node not in leaf:
                told = [f"leaf {t}" for t in page.entry[b.node]] if b.node >= 0 else ["leaf"]
                if b.node >= 0 and page.parent[b.node] >= 0:
                    told.append(f"{page.entry[page.parent[b.node]][0]}>{page.entry[b.node][0]}")
                leaf[b.node] = [_bucket(t, p.path_buckets) for t in told]
            node.append(b.node + base if b.node >= 0 else -1)
            own.append(leaf[b.node])
    bs = [b for page in pages for b in page.blocks]
    codes, off, uniques = langid.clean_words(pa.array([b.text for b in bs], pa.string()))  # marks between words tell nothing
    ids = ((words.hash_strings(uniques) >> np.uint64(44)).astype(np.int64) % p.word_buckets)[codes]
    n = np.array([len(b.text) for b in bs], float)
    link = np.array([b.linked for b in bs], float) / np.maximum(n, 1)
    ends = np.array([b.text[-1:] in ".!?" for b in bs], float)
    numbers = np.stack([np.log1p(n) / 5, np.minimum(link, 1), ends, np.log1p(np.diff(off)) / 4], 1) if bs else np.zeros((0, NUMBERS))
    deep = np.array(depth, np.int64)
    order = np.argsort(deep, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(deep[order])) + 1) if len(order) else []
    return Features(np.array(parent, np.int64), levels, *_runs(fresh), np.array(n_path, np.int64), np.array(node, np.int64), *_runs(own), ids, off, numbers)


def _sums(table: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros((len(off) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(table[ids], off[:-1][full], axis=0)
    return out


def path_means(table: np.ndarray, f: Features) -> tuple[np.ndarray, np.ndarray]:
    """(the blocks' path vectors, the number of words in each)."""
    down = _sums(table, f.words_of, f.words_off)
    for at in f.levels[1:]:
        down[at] += down[f.parent[at]]
    total, count = _sums(table, f.own, f.own_off), np.diff(f.own_off).astype(float)
    inside = f.node >= 0
    total[inside] += down[f.node[inside]]
    count[inside] += f.n_path[f.node[inside]]
    return total / np.maximum(count, 1)[:, None], count


def path_gradient(g: np.ndarray, f: Features, d: np.ndarray, count: np.ndarray) -> None:
    """Adds to g the gradient by the table of path_means(), from that by the vectors."""
    d = d / np.maximum(count, 1)[:, None]
    np.add.at(g, f.own, np.repeat(d, np.diff(f.own_off), axis=0))
    up = np.zeros((len(f.parent), d.shape[1]))
    inside = f.node >= 0
    np.add.at(up, f.node[inside], d[inside])
    for at in f.levels[:0:-1]:
        np.add.at(up, f.parent[at], up[at])
    np.add.at(g, f.words_of, np.repeat(up, np.diff(f.words_off), axis=0))


def _means(table: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    return _sums(table, ids, off) / np.maximum(np.diff(off), 1)[:, None]


@dataclass
class Model:
    p: Params
    w: dict[str, np.ndarray]

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([path_means(self.w["path"], f)[0] * 3, _means(self.w["word"], f.words, f.word_off), f.numbers], 1)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool):
    """An LSTM over x (time, pages, inputs): hidden states, and with keep what the gradient needs. Padding stands at the end, so it disturbs nothing before it."""
    t, n, _ = x.shape
    k = wh.shape[0]
    pre = x @ wx + b
    h, c = np.zeros((n, k)), np.zeros((n, k))
    hs, cs, gates = np.zeros((t, n, k)), np.zeros((t, n, k)), np.zeros((t, n, 4 * k)) if keep else None
    for i in range(t):
        a = pre[i] + h @ wh
        s = _sig(a[:, : 3 * k])
        g = np.tanh(a[:, 3 * k :])
        c = s[:, k : 2 * k] * c + s[:, :k] * g
        h = s[:, 2 * k :] * np.tanh(c)
        hs[i], cs[i] = h, c
        if keep:
            gates[i, :, : 3 * k], gates[i, :, 3 * k :] = s, g
    return hs, cs, gates


def _back(x, wx, wh, hs, cs, gates, dh_all):
    t, n, k = hs.shape
    da_all = np.zeros((t, n, 4 * k))
    dh, dc = np.zeros((n, k)), np.zeros((n, k))
    for i in range(t - 1, -1, -1):
        dh = dh + dh_all[i]
        s, g = gates[i, :, : 3 * k], gates[i, :, 3 * k :]
        th = np.tanh(cs[i])
        prev = cs[i - 1] if i else np.zeros((n, k))
        dc = dc + dh * s[:, 2 * k :] * (1 - th**2)
        da_all[i, :, :k] = dc * g
        da_all[i, :, k : 2 * k] = dc * prev
        da_all[i, :, 2 * k : 3 * k] = dh * th
        da_all[i, :, : 3 * k] *= s * (1 - s)
        da_all[i, :, 3 * k :] = dc * s[:, :k] * (1 - g**2)
        dc = dc * s[:, k : 2 * k]
        dh = da_all[i] @ wh.T
    before = np.concatenate([np.zeros((1, n, k)), hs[:-1]])
    flat = da_all.reshape(-1, 4 * k)
    return x.reshape(-1, x.shape[2]).T @ flat, before.reshape(-1, k).T @ flat, flat.sum(0), da_all @ wx.T


def _order(lengths: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, page) place of each block in reading order, and of the blocks read backwards."""
    i = np.arange(t)[:, None]
    on = i < lengths[None, :]
    return on, np.where(on, lengths[None, :] - 1 - i, i)


def logits(m: Model, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """(time, pages) scores for padded inputs (time, pages, inputs)."""
    on, back = _order(lengths, len(x))
    cols = np.arange(x.shape[1])[None, :]
    rx = x[back, cols]
    f = _run(x, m.w["fx"], m.w["fh"], m.w["fb"], keep)
    r = _run(rx, m.w["rx"], m.w["rh"], m.w["rb"], keep)
    h = np.concatenate([f[0], r[0][back, cols], x], 2)
    return h @ m.w["o"] + m.w["ob"], (on, back, cols, rx, f, r, h)


def labelled(html: str) -> tuple[Page, np.ndarray]:
    """A made page without its marks, and which of its blocks are main text."""
    page = blocks(html)
    page.blocks = [b for b in page.blocks if made_pages.MAIN in b.text or made_pages.OTHER in b.text]
    y = np.array([made_pages.MAIN in b.text for b in page.blocks], float)
    for b in page.blocks:
        b.text = b.text.replace(made_pages.MAIN, "").replace(made_pages.OTHER, "").strip() or "-"
    return page, y


def fit(p: Params = Params()) -> Model:
    rng = np.random.default_rng(p.seed)
    size = p.path_dim + p.word_dim + NUMBERS
    k = p.hidden
    w = {"path": rng.normal(0, 0.15, (p.path_buckets, p.path_dim)), "word": np.zeros((p.word_buckets, p.word_dim)), "o": rng.normal(0, 0.1, 2 * k + size), "ob": np.zeros(1)}
    for d in "fr":
        w[f"{d}x"], w[f"{d}h"], w[f"{d}b"] = rng.normal(0, size**-0.5, (size, 4 * k)), rng.normal(0, k**-0.5, (k, 4 * k)), np.zeros(4 * k)
        w[f"{d}b"][k : 2 * k] = 1
    m = Model(p, w)
    data = [x for x in map(labelled, made_pages.pages(p.pages, p.seed)) if x[0].blocks]
    feats = [features([page], p) for page, _ in data]
    counts = [path_means(w["path"], f)[1] for f in feats]
    known = np.bincount(np.concatenate([np.unique(f.words) for f in feats]), minlength=p.word_buckets) >= p.least_pages
    one = {k_: np.zeros_like(v) for k_, v in w.items()}
    two = {k_: np.zeros_like(v) for k_, v in w.items()}
    step = 0
    total = p.epochs * -(-len(data) // p.batch)
    for _ in range(p.epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), p.batch):
            pick = order[s : s + p.batch].tolist()
            n = np.array([len(data[i][1]) for i in pick])
            t = int(n.max())
            x, y = np.zeros((t, len(pick), size)), np.zeros((t, len(pick)))
            for j, i in enumerate(pick):
                x[: n[j], j], y[: n[j], j] = m.inputs(feats[i]), data[i][1]
            z, (on, back, cols, rx, f, r, h) = logits(m, x, n, True)
            dz = np.where(on, _sig(z) - y, 0) / on.sum()
            g = {k_: np.zeros_like(v) for k_, v in w.items()}
            g["o"], g["ob"] = np.tensordot(h, dz, ([0, 1], [0, 1])), dz.sum(keepdims=True).reshape(1)
            dh = dz[:, :, None] * w["o"]
            g["fx"], g["fh"], g["fb"], dx = _back(x, w["fx"], w["fh"], *f, dh[:, :, :k])
            dr = dh[:, :, k : 2 * k][back, cols]
            g["rx"], g["rh"], g["rb"], drx = _back(rx, w["rx"], w["rh"], *r, dr)
            dx = dx + drx[back, cols] + dh[:, :, 2 * k :]
            for j, i in enumerate(pick):
                q, d = feats[i], dx[: n[j], j]
                nw = np.diff(q.word_off)
                path_gradient(g["path"], q, d[:, : p.path_dim] * 3, counts[i])
                np.add.at(g["word"], q.words, np.repeat(d[:, p.path_dim : p.path_dim + p.word_dim] / np.maximum(nw, 1)[:, None], nw, axis=0))
            g["word"][~known] = 0
            step += 1
            rate = p.rate * (1 - step / (total + 1))
            for k_ in w:
                one[k_] += 0.1 * (g[k_] - one[k_])
                two[k_] += 0.01 * (g[k_] ** 2 - two[k_])
                w[k_] -= rate * (one[k_] / (1 - 0.9**step)) / (np.sqrt(two[k_] / (1 - 0.99**step)) + 1e-8)
    return m


def label(m: Model, found: list[Page]) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length are read together; a page is never cut."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(found)
    size = np.array([len(page.blocks) for page in found], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    start = 0
    while start < len(order):
        end = start + 1  # as many pages as make about 20,000 padded blocks
        while end < len(order) and (end + 1 - start) * size[order[end]] <= 20_000:
            end += 1
        pick = order[start:end].tolist()
        n = size[pick]
        flat = m.inputs(features([found[i] for i in pick], m.p))
        x = np.zeros((int(n.max()), len(pick), flat.shape[1]))
        off = np.concatenate([[0], np.cumsum(n)])
        for j in range(len(pick)):
            x[: n[j], j] = flat[off[j] : off[j + 1]]
        z = logits(m, x, n)[0]
        for j, i in enumerate(pick):
            out[i] = z[: n[j], j] > 0
        start = end
    return out


def main_texts(m: Model, pages: list[str | None]) -> list[str]:
    found = [blocks(h or "") for h in pages]
    return ["\n\n".join(b.text for b, keep in zip(page.blocks, on.tolist()) if keep) for page, on in zip(found, label(m, found))]


def extract(pages: DataFrame, m: Model, html_col: str = "html", text_out: str = "text", chars_out: str = "n_chars") -> DataFrame:
    """pages, without html_col, with text_out (main blocks joined by an empty line) and chars_out (its code points) added; underscores follow taken names.

    Null, empty and text-less pages have an empty text. Pages are read whole, however long; repeated rows get the same
    answer; no rows, no rows. One map pass, no shuffle; the model is of fixed size and broadcast."""
    common.bound_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(m)
    rest = [f for f in pages.schema.fields if f.name != html_col]
    text_out = common.free_name(text_out, [f.name for f in rest])
    chars_out = common.free_name(chars_out, [*(f.name for f in rest), text_out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in words.slices(whole, html_col):
                texts = main_texts(shared.value, part.column(html_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(f.name for f in rest), text_out, chars_out])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(text_out, T.StringType()), T.StructField(chars_out, T.LongType())]))
