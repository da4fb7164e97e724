"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sampling, words

#: Words of more characters are handled with rescaled sums, many of them side by side; nothing is cut.
LONG = 40
#: Characters between two rescalings. A step costs a factor of 1e-7 at most, so that sums stay far from the smallest number.
RESCALE = 8
#: Characters of long words side by side.
CELLS = 200_000
#: Long words are passed in blocks of so many characters, and about so many blocks side by side.
BLOCK, SIDE_BY_SIDE = 256, 1024
TRIM = "0123456789.,;:!?%*&$#@~^_+=|/\\<>()[]{}'\"`-"


@dataclass(frozen=True)
class Params:
    """vocabulary: a sentencepiece model file, of which only the list of pieces is used. docs_per_lang: None to learn from all
    documents, or at most so many documents of each language (whole texts); every language is learned. smoothing: the
    pseudo-count of each piece. floor: the probability of a character that no piece holds.
    min_score: below this the pipeline's stage rejects a document."""

    vocabulary: str
    docs_per_lang: int | None = None
    em_rounds: int = 3
    smoothing: float = 0.1
    floor: float = 1e-7
    min_score: float = 0.5
    held_mod: int = 4
    held_rest: int = 2


def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces that hold a letter, no upper-case letter and no digit."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in found if p == p.lower() and any(c.isalpha() for c in p) and not any(c.isdigit() for c in p)]


#: Whole numbers count uses in units of one over this, so that their sums do not depend on how words are dealt out.
UNITS = 1 << 24


def _add(total: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Adds x to total at numbers that may repeat; in units if total has whole numbers."""
    np.add.at(total, at, np.rint(x * UNITS).astype(np.int64) if total.dtype == np.int64 else x)


class Lattice:
    """Which pieces match where in words; words are runs of code points that begin with the word mark."""

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        arr = pa.array(vocabulary, pa.string())
        code, off = code_points(arr)
        h = self._hash(code, off)
        order = np.argsort(h, kind="stable")
        self.keys, self.ids = h[order], order.astype(np.int32)
        # a first table by the low bits says fast that a substring is no piece
        self.table = np.zeros(1 << 20, bool)
        self.table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.longest = int(np.diff(off).max()) if len(off) > 1 else 1

    _MULT = np.uint64(0x9E3779B97F4A7C15)

    def _step(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ c.astype(np.uint64)) * self._MULT
            return x ^ (x >> np.uint64(29))

    def _hash(self, code: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, n = np.full(len(off) - 1, 7, np.uint64), np.diff(off)
        for j in range(int(n.max()) if len(n) else 0):
            on = n > j
            h[on] = self._step(h[on], code[off[:-1][on] + j])
        return h

    def starting(self, code: np.ndarray, i: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """[l]: (word numbers, piece numbers) of the pieces of l + 1 characters that begin at i. code: (words, n) code points, 0 after a word's end."""
        m, n = code.shape
        h, row = np.full(m, 7, np.uint64), []
        for j in range(min(self.longest, n - i)):
            h = self._step(h, code[:, i + j])
            w = np.flatnonzero(self.table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(w):
                at = np.searchsorted(self.keys, h[w])
                at[at == len(self.keys)] = 0
                ok = self.keys[at] == h[w]
                row.append((w[ok], self.ids[at[ok]]))
            else:
                row.append(None)
        return row

    def match(self, code: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray] | None]]:
        """starting() at every place of words of equal length."""
        return [self.starting(code, i) for i in range(code.shape[1])]

    def forward(self, code: np.ndarray, prob: np.ndarray, floor: float, arcs=None) -> np.ndarray:
        """(n + 1, words, languages) sums over all segmentations of each prefix. prob: (pieces, languages). A single
        character always may stand alone, at the floor's probability, whether or not a piece matches it."""
        m, n = code.shape
        arcs = arcs or self.match(code)
        alpha = np.zeros((n + 1, m, prob.shape[1]))
        alpha[0] = 1
        for i in range(n):
            alpha[i + 1] += floor * alpha[i]
            for j, found in enumerate(arcs[i]):
                if found is not None and len(found[0]):
                    w, p = found
                    alpha[i + j + 1][w] += alpha[i][w] * prob[p]
        return alpha

    def expected(self, code: np.ndarray, weight: np.ndarray, prob: np.ndarray, floor: float, total: np.ndarray) -> None:
        """Adds the expected uses of each piece over all segmentations of words that occur weight times (one language)."""
        m, n = code.shape
        arcs = self.match(code)
        alpha = self.forward(code, prob[:, None], floor, arcs)[:, :, 0]
        beta = np.zeros((n + 1, m))
        beta[n] = 1
        for i in range(n - 1, -1, -1):
            beta[i] += floor * beta[i + 1]
            for j, found in enumerate(arcs[i]):
                if found is not None and len(found[0]):
                    w, p = found
                    beta[i][w] += prob[p] * beta[i + j + 1][w]
        scale = weight / alpha[n]
        for i in range(n):
            for j, found in enumerate(arcs[i]):
                if found is not None and len(found[0]):
                    w, p = found
                    _add(total, p, alpha[i][w] * prob[p] * beta[i + j + 1][w] * scale[w])

    def _cut(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first block of each word, sizes of the blocks): words are cut into blocks of BLOCK characters and a last one of what is left."""
        n = -(-size // BLOCK)
        first = np.cumsum(n) - n
        number = np.arange(int(n.sum())) - np.repeat(first, n)
        return np.append(first, n.sum()), np.minimum(np.repeat(size, n) - number * BLOCK, BLOCK)

    def _codes(self, code: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The characters of blocks, and as many that follow as the longest piece has; 0 after a word's end."""
        owner = np.searchsorted(first, which, "right") - 1
        at = ((which - first[owner]) * BLOCK)[:, None] + np.arange(BLOCK + self.longest)
        return np.where(at < code.shape[1], code[owner[:, None], np.minimum(at, code.shape[1] - 1)], 0)

    def _through(self, code: np.ndarray, size: np.ndarray, states: int, prob: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(sums (blocks, longest, states, languages), log scales (blocks, states, languages)): what arrives at the places from each block's
        end on, by pieces that begin in it, if 1 arrives at its place `state` by pieces from before."""
        m, k, width = len(code), prob.shape[1], self.longest + 1
        ring = np.zeros((width, m, states, k))
        for s in range(states):
            ring[s, :, s] = 1
        scale, out, told = np.zeros((m, states, k)), np.zeros((m, self.longest, states, k)), np.zeros((m, states, k))
        for i in range(int(size.max()) + 1):
            if i and i % RESCALE == 0:
                top = ring.max(0)
                ring /= top
                scale += np.log(top)
            done = np.flatnonzero(size == i)
            if len(done):
                out[done] = ring[(i + np.arange(self.longest)) % width][:, done].transpose(1, 0, 2, 3)
                told[done] = scale[done]
            here = ring[i % width].copy()
            ring[i % width] = 0
            ring[(i + 1) % width] += floor * here
            for j, found in enumerate(self.starting(code, i)) if i < BLOCK else ():
                if found is not None and len(found[0]):
                    w, p = found
                    ring[(i + j + 1) % width, w] += here[w] * prob[p][:, None, :]
        return out, told

    def _transfers(self, code: np.ndarray, size: np.ndarray, prob: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(words, blocks, sums, log scales) in rounds: the next blocks of all words that have some left, a bounded number at a time.

        A word's first block has one state, as nothing comes from before it."""
        first, sizes = self._cut(size)
        many = np.diff(first)
        at, held = 0, max(1, SIDE_BY_SIDE // max(1, len(size)))
        while (on := np.flatnonzero(many > at)).size:
            step = 1 if at == 0 else held
            which = np.concatenate([np.arange(first[w] + at, min(first[w] + at + step, first[w + 1])) for w in on.tolist()])
            yield on, which, *self._through(self._codes(code, first, which), sizes[which], 1 if at == 0 else self.longest, prob, floor)
            at += step

    def long_forward(self, code: np.ndarray, size: np.ndarray, prob: np.ndarray, floor: float):
        """(words, languages) logarithms of the sums over all segmentations of words of any lengths (size; code has 0 after a word's end).

        Blocks of words are worked on side by side: a piece crosses a block's end only into the next `longest` places, so a block is a
        matrix from the sums that arrive there to those that leave; a word's matrices are multiplied in order. Work is linear in a word's length."""
        first, _ = self._cut(size)
        state = np.zeros((len(size), self.longest, prob.shape[1]))
        state[:, 0] = 1
        logs = np.zeros((len(size), prob.shape[1]))
        for _, which, sums, scale in self._transfers(code, size, prob, floor):
            owner = np.searchsorted(first, which, "right") - 1
            turn = which - which[np.searchsorted(owner, owner)]
            for t in range(int(turn.max()) + 1):
                b = np.flatnonzero(turn == t)
                state[owner[b]], more = _applied(sums[b], scale[b], state[owner[b]])
                logs[owner[b]] += more
        with np.errstate(divide="ignore"):
            return np.log(state[:, 0]) + logs

    def long_expected(self, code: np.ndarray, size: np.ndarray, weight: np.ndarray, prob: np.ndarray, floor: float, total: np.ndarray) -> None:
        """expected() for words of any lengths: what arrives at each block from the left and what each of its end's places is worth to the
        right come from products of the blocks' matrices; then all blocks are passed side by side in both directions."""
        first, sizes = self._cut(size)
        n, k = len(sizes), self.longest
        matrix, scale = np.zeros((n, k, k)), np.zeros((n, k))
        for _, which, sums, s in self._transfers(code, size, prob[:, None], floor):
            matrix[which[:, None], np.arange(k), :] = 0
            matrix[which, :, : sums.shape[2]] = sums[..., 0]
            scale[which, : s.shape[1]] = s[..., 0]
        many = np.diff(first)
        left, left_log, right, right_log = np.zeros((n, k)), np.zeros(n), np.zeros((n, k)), np.zeros(n)
        left[first[:-1], 0] = 1
        right[first[1:] - 1, 0] = 1
        whole = np.zeros(len(size))
        for t in range(int(many.max(initial=0))):
            w = np.flatnonzero(many > t)
            b = first[w] + t
            after, more = _applied(matrix[b][..., None], scale[b][..., None], left[b][..., None])
            go = many[w] > t + 1
            left[b[go] + 1], left_log[b[go] + 1] = after[go, :, 0], left_log[b[go]] + more[go, 0]
            whole[w[~go]] = np.log(after[~go, 0, 0]) + left_log[b[~go]] + more[~go, 0]
            w = np.flatnonzero(many > t + 1)
            b = first[w + 1] - 1 - t
            with np.errstate(divide="ignore"):
                worth = np.log(np.einsum("bj,bjs->bs", right[b], matrix[b])) + scale[b]
            top = worth.max(1)
            right[b - 1], right_log[b - 1] = np.exp(worth - top[:, None]), right_log[b] + top
        owner = np.repeat(np.arange(len(size)), many)
        for a in range(0, n, 4096):
            which = np.arange(a, min(a + 4096, n))
            base = left_log[which] + right_log[which] - whole[owner[which]]
            self._count(self._codes(code, first, which), sizes[which], left[which], right[which], base, weight[owner[which]], prob, floor, total)

    def _count(self, code, size, left, right, base, weight, prob, floor, total) -> None:
        """Adds the expected uses of pieces that begin in blocks. left, right: sums at the first places from before, worth of those from the end on; base: their log scales less the word's."""
        m, width = len(code), self.longest + 1
        ring, scale = np.zeros((width, m)), np.zeros(m)
        ring[: self.longest] = left.T
        alpha, scales = np.zeros((BLOCK, m)), np.zeros((BLOCK, m))
        arcs = []
        for i in range(BLOCK):
            if i and i % RESCALE == 0:
                top = ring.max(0)
                ring /= top
                scale += np.log(top)
            here = ring[i % width].copy()
            alpha[i], scales[i] = here, scale
            ring[i % width] = 0
            ring[(i + 1) % width] += floor * here
            arcs.append(self.starting(code, i))
            for j, found in enumerate(arcs[i]):
                if found is not None and len(found[0]):
                    w, p = found
                    ring[(i + j + 1) % width, w] += here[w] * prob[p]
        ring, scale = np.zeros((width, m)), np.zeros(m)
        for i in range(BLOCK, -1, -1):
            at = np.flatnonzero(size == i)
            ring[(i + np.arange(self.longest)[:, None]) % width, at] = right[at].T
            if i == BLOCK:
                continue
            now = floor * ring[(i + 1) % width]
            share = weight * np.exp(np.minimum(scales[i] + scale + base, 700)) * alpha[i]
            for j, found in enumerate(arcs[i]):
                if found is not None and len(found[0]):
                    w, p = found
                    step = prob[p] * ring[(i + j + 1) % width, w]
                    now[w] += step
                    _add(total, p, np.where(size[w] > i, share[w] * step, 0))
            on = size > i
            ring[i % width, on] = now[on]
            if i % RESCALE == 0:
                top = np.where(on, ring.max(0), 1)
                ring /= top
                scale += np.log(top)


def _applied(sums: np.ndarray, scale: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states after blocks (blocks, longest, languages), with 1 as the largest; the logarithms of what they were divided by)."""
    with np.errstate(divide="ignore"):
        x = np.log(state[:, : sums.shape[2]]) + scale
    top = x.max(1)
    out = np.einsum("bjsk,bsk->bjk", sums, np.exp(x - top[:, None]))
    most = out.max(1)
    return out / most[:, None], top + np.log(most)


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of strings."""
    raw, off = words.string_bytes(strings)
    first = (raw & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(first)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), count[off]


MARK = 0x2581


def _by_length(strings: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of strings, (strings, n) code points) of the strings of each length up to LONG; each word gets the mark U+2581 before it."""
    code, off = code_points(strings)
    n = np.diff(off)
    for size in np.unique(n[(n > 0) & (n <= LONG)]).tolist():
        which = np.flatnonzero(n == size)
        for k in range(0, len(which), 50_000):
            w = which[k : k + 50_000]
            yield w, np.concatenate([np.full((len(w), 1), MARK, np.uint32), code[off[:-1][w][:, None] + np.arange(size)]], 1)


def _long(strings: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of strings, code points with the mark, zeros after the end, lengths) of the strings of more than LONG characters, those of like length side by side."""
    which = np.flatnonzero(pc.utf8_length(strings).to_numpy(zero_copy_only=False) > LONG)
    code, off = code_points(strings.take(pa.array(which)))
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    at = 0
    while at < len(order):
        longest = int(n[order[at]]) + 1
        pick = order[at : at + max(1, CELLS // longest)]
        at += len(pick)
        out = np.zeros((len(pick), longest), np.uint32)
        out[:, 0] = MARK
        for r, k in enumerate(pick.tolist()):
            out[r, 1 : n[k] + 1] = code[off[k] : off[k + 1]]
        yield which[pick], out, n[pick] + 1


def clean_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words.split, lower-cased throughout, with digits and ASCII marks off both ends and words without a letter left out."""
    codes, off, uniques = words.split(texts)
    coded = pc.utf8_lower(pc.utf8_trim(uniques, characters=TRIM)).dictionary_encode()
    base, strings = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    raw, o = words.string_bytes(strings)
    low = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    letter = low[o[1:]] > low[o[:-1]]
    rest = np.flatnonzero(~letter)
    if len(rest):
        letter[rest] = pc.match_substring_regex(strings.take(pa.array(rest)), r"\p{L}").to_numpy(zero_copy_only=False)
    place = base[codes]
    keep = letter[place] if len(letter) else np.zeros(0, bool)
    return place[keep], np.concatenate([[0], np.cumsum(keep)])[off], strings


@dataclass(frozen=True)
class Model:
    langs: list[str]
    vocabulary: list[str]
    prob: np.ndarray  # (pieces, languages)
    floor: float


def _uses(lattice: Lattice, strings: pa.Array, weight: np.ndarray, prob: np.ndarray, floor: float, total: np.ndarray) -> None:
    """Adds the expected uses of each piece over all segmentations of words that occur weight times (one language)."""
    for w, code in _by_length(strings):
        lattice.expected(code, weight[w], prob, floor, total)
    for w, code, size in _long(strings):
        lattice.long_expected(code, size, weight[w], prob, floor, total)


def fit(sample: list[tuple[str, str]], p: Params) -> Model:
    """Each language's piece probabilities by expectation-maximisation over all segmentations of the sample's words."""
    vocab = pieces(p.vocabulary)
    lattice = Lattice(vocab)
    langs = sorted({lang for lang, _ in sample})
    prob = np.zeros((len(vocab), len(langs)))
    for k, lang in enumerate(langs):
        codes, _, strings = clean_words(pa.array([t for x, t in sample if x == lang], pa.string()))
        weight = np.bincount(codes, minlength=len(strings)).astype(float)
        used = np.flatnonzero(weight)
        strings, weight = strings.take(pa.array(used)), weight[used]
        q = np.full(len(vocab), 1 / len(vocab))
        for _ in range(p.em_rounds):
            total = np.full(len(vocab), p.smoothing)
            _uses(lattice, strings, weight, q, p.floor, total)
            q = total / total.sum()
        prob[:, k] = q
    words.give_back()
    return Model(langs, vocab, prob, p.floor)


def score_texts(model: Model, lattice: Lattice, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, probability) of each text: the posterior under equal priors; -1 and 0 without a letter."""
    codes, off, strings = clean_words(texts)
    logp = np.zeros((len(strings), len(model.langs)))
    used = np.unique(codes)
    if len(used) and model.langs:
        met = strings.take(pa.array(used))
        for w, code in _by_length(met):
            logp[used[w]] = np.log(lattice.forward(code, model.prob, model.floor)[-1])
        for w, code, size in _long(met):
            logp[used[w]] = lattice.long_forward(code, size, model.prob, model.floor)
    n = np.diff(off)
    best, score = np.full(len(n), -1), np.zeros(len(n))
    if not model.langs or not len(codes):
        return best, score
    total = np.zeros((len(n), len(model.langs)))
    full = np.flatnonzero(n)
    for k in range(len(model.langs)):
        total[full, k] = np.add.reduceat(logp[:, k][codes], off[:-1][full])
    total -= total.max(axis=1, keepdims=True)
    post = np.exp(total)
    post /= post.sum(axis=1, keepdims=True)
    best[full], score[full] = post.argmax(axis=1)[full], post.max(axis=1)[full]
    return best, score


#: Words, and bytes of them, whose uses a task finds at a time.
WORDS_HELD, BYTES_HELD = 200_000, 8 << 20


def word_counts(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, n: how often the texts of each language hold each of clean_words(). Nulls in either take no part; repeated rows count each.

    A batch's words are counted in the task before they are added up."""
    common.bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in words.slices(whole, "text"):
                codes, off, strings = clean_words(part.column("text"))
                lang = part.column("lang").dictionary_encode()
                owner = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(off))
                pair, n = np.unique(owner * max(len(strings), 1) + codes, return_counts=True)
                owner, code = np.divmod(pair, max(len(strings), 1))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(owner)), strings.take(pa.array(code)).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    some = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return some.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_all(rows: DataFrame, p: Params, lang_col: str = "lang", text_col: str = "text") -> Model:
    """fit() of all rows: words are counted once over the whole table; in each round of the expectation-maximisation tasks find the uses of
    their words, which are added up by language and piece. What reaches the driver is at most a number for each language and piece.
    Uses are whole numbers of small units, so that the model is the same however rows are dealt out."""
    spark, vocab = rows.sparkSession, pieces(p.vocabulary)
    langs = sorted(r[0] for r in rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col).distinct().collect())
    # a few small rows are much work: they are spread by count, not by bytes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    path = common.write(word_counts(rows, lang_col, text_col).repartition(parts, "word"), "words")
    counts = spark.read.schema("lang string, word string, n long").parquet(path)
    prob = np.full((len(vocab), len(langs)), 1 / len(vocab))
    for _ in range(p.em_rounds if langs else 0):
        shared = spark.sparkContext.broadcast((vocab, langs, prob))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, langs, prob = shared.value
            lattice, numbers = Lattice(vocab), pa.array(langs, pa.string())
            total: dict[int, np.ndarray] = {}

            def count(held: list[pa.RecordBatch]) -> None:
                t = pa.Table.from_batches(held).combine_chunks()
                owner = pc.index_in(t.column("lang"), numbers).to_numpy()
                for k in np.unique(owner).tolist():
                    mine = t.filter(pa.array(owner == k)).combine_chunks()
                    strings = mine.column("word").combine_chunks()
                    _uses(lattice, strings, mine.column("n").to_numpy().astype(float), prob[:, k], p.floor, total.setdefault(k, np.zeros(len(vocab), np.int64)))

            held: list[pa.RecordBatch] = []
            for b in batches:
                held.append(b)
                if sum(map(len, held)) >= WORDS_HELD or sum(x.nbytes for x in held) >= BYTES_HELD:
                    count(held)
                    held = []
            if held:
                count(held)
            for k, x in total.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["k", "piece", "uses"])

        found = counts.mapInArrow(run, "k int, piece int, uses long").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.full(prob.shape, p.smoothing)
        total[found.column("piece").to_numpy(), found.column("k").to_numpy()] += found.column("uses").to_numpy() / UNITS
        prob = total / total.sum(0)
        shared.unpersist()
    common.drop(spark, path)
    return Model(langs, vocab, prob, p.floor)


def train(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows that aren't held out, or, with p.docs_per_lang, from so many whole documents of each language."""
    rows = docs.where(common.crc_mod(id_col, p.held_mod) != p.held_rest)
    if p.docs_per_lang is None:
        return fit_all(rows, p, lang_col, text_col)
    return fit(sampling.labelled(rows, lang_col, text_col, id_col, p.docs_per_lang), p)


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out and score_out added (underscores follow a name that is taken).

    Only the whole text is read for it. lang_out: the language of the largest posterior, ties to the first by name;
    'und' with score 0 if the text is null, empty or without a letter, or no language was learned. Repeated rows get the
    same answer. One map pass over Arrow batches, no shuffle; the model (vocabulary x languages) is broadcast and of
    fixed size."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    lang_out, score_out = common.free_name(lang_out, docs.columns), common.free_name(score_out, docs.columns)
    shared = spark.sparkContext.broadcast(model)
    column = text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lattice = Lattice(m.vocabulary)
        names = pa.array([*m.langs, "und"], pa.string())
        for whole in batches:
            for part in words.slices(whole, column):
                best, score = score_texts(m, lattice, part.column(column))
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(pa.array(np.where(best < 0, len(m.langs), best))), pa.array(score)], [*part.schema.names, lang_out, score_out])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def stage(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is found with a score of at least p.min_score; all columns stay, none are added.

    Rows with a null, empty or letterless text go (their language is und). Repeated rows stay or go alike, null ids are judged like
    others; without a row that has both text and language nothing is learned and all rows go. No rows: no rows."""
    tagged = identify(docs, train(docs, p, id_col, text_col), text_col, "__lang", "__score")
    lang, score = tagged.columns[-2:]
    return tagged.where((F.col(lang) != "und") & (F.col(score) >= p.min_score)).select(*docs.columns)
