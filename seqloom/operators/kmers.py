"""k-mer spectrum, document frequency and the inverted index, as grouped explodes over two-bit codes.

A k-mer is a BIGINT, two bits a base in the order A, C, G, T, so that a smaller code is a smaller text. Null sequences and sequences
shorter than k have no k-mer; a character other than A, C, G, T is in none. Repeated rows of a read id count once per row in
spectrum(), and are one read in postings() and document_frequency(). Empty tables give empty tables; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..sources import sinks

#: Bases of a chunk that is turned into one number; a window is then a shift and a mask.
CHUNK = 31


def _number(digits: Column) -> Column:
    return F.conv(digits, 4, 10).cast("long")


def _shift(code: Column, bits: Column) -> Column:
    return F.call_function("shiftright", code, bits.cast("int"))


def windows(reads: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each k-mer of each read (read_id, seq): read_id, end (0-based), kmer (canonical), forward, and the columns of keep.

    A read is cut into overlapping chunks of 31 bases, each turned into a number once for either strand; the windows of a
    chunk are shifts of it. A palindrome counts as forward. All expressions are generated code; the explodes multiply rows only inside the task."""
    per, mask = CHUNK + 1 - k, (1 << 2 * k) - 1
    s = F.col("seq")
    odd = ~s.rlike("^[ACGT]*$")
    digits, turned = F.translate(s, "ACGT", "0123"), F.reverse(F.translate(s, "ACGT", "3210"))

    def clean(x: Column) -> Column:
        return F.when(odd, F.regexp_replace(x, "[^0-3]", "0")).otherwise(x)

    spots = F.when(odd, F.regexp_replace(F.regexp_replace(s, "[^ACGT]", "3"), "[ACGT]", "0"))
    r = reads.where(F.length(s) >= k).select("read_id", *keep, F.length(s).alias("n"), clean(digits).alias("f"), clean(turned).alias("t"), spots.alias("m"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - k) / per).cast("int"))).alias("j")).withColumn("a", F.col("j") * per).withColumn("l", F.least(F.lit(CHUNK), F.col("n") - F.col("a")))
    r = r.select(
        "read_id", *keep, "n", "a", "l", _number(F.substring("f", F.col("a") + 1, F.col("l"))).alias("f"), _number(F.substring("t", F.col("n") - F.col("a") - F.col("l") + 1, F.col("l"))).alias("t"),
        F.coalesce(_number(F.substring("m", F.col("a") + 1, F.col("l"))), F.lit(0).cast("long")).alias("m"),
    )
    x = r.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(per), F.col("l") - (k - 1)) - 1)).alias("o"))
    back = 2 * (F.col("l") - k - F.col("o"))
    bits = F.lit(mask).cast("long")
    x = x.where((F.col("m") == 0) | (_shift(F.col("m"), back).bitwiseAND(bits) == 0))
    x = x.select("read_id", *keep, (F.col("a") + F.col("o") + (k - 1)).alias("end"), _shift(F.col("f"), back).bitwiseAND(bits).alias("fw"), _shift(F.col("t"), 2 * F.col("o")).bitwiseAND(bits).alias("rv"))
    return x.select("read_id", *keep, "end", F.least("fw", "rv").alias("kmer"), (F.col("fw") <= F.col("rv")).alias("forward"))


def low_complexity(kmer: Column, k: int, share: float) -> Column:
    """dna.low_complexity of a code: too many As or too many Ts, by counting bits."""
    low = F.lit(((1 << 2 * k) - 1) // 3).cast("long")  # the lower bit of each base

    def count(x: Column) -> Column:
        return F.bit_count(x.bitwiseAND(_shift(x, F.lit(1))).bitwiseAND(low))

    return (count(kmer) > share * k) | (count(F.bitwise_not(kmer)) > share * k)


def indexed(reads: DataFrame, share: float = 0.7) -> DataFrame:
    """The reads that take part: no N, not of low complexity. Null sequences take no part."""
    return reads.where(~dna.discard_read(F.col("seq"), share))


_LUT = np.full(256, 4, np.uint8)
_LUT[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_BASE = np.frombuffer(b"ACGT", np.uint8)
#: Bases whose windows a task makes at a time (few, so that its arrays stay in the cache), and windows that it adds up before they go on.
AT_ONCE, HELD = 1 << 16, 1 << 22


def codes(seqs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """windows() of an array of ASCII texts, in their order: (number of the text, end, kmer, forward). A window's number is put together from halves."""
    seqs = pa.concat_arrays([seqs.cast(pa.large_string())])
    off = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    flat = _LUT[np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]] if len(seqs) else np.zeros(0, np.uint8)
    m = len(flat) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), size)
    bad = np.concatenate([[0], np.cumsum(flat > 3)])
    ok = np.flatnonzero((text[:m] == text[k - 1 :]) & (bad[k:] == bad[:m]))
    one = (flat & 3).astype(np.int64)
    fw = rv = np.zeros(len(one), np.int64)
    part = one, 3 - one  # of windows of `bits` bases
    have, bits = 0, 1
    while have < k:
        if k & bits:
            n = len(part[0]) - have
            fw, rv = fw[:n] << 2 * bits | part[0][have:][:n], rv[:n] | part[1][have:][:n] << 2 * have
            have += bits
        part = part[0][:-bits] << 2 * bits | part[0][bits:], part[1][:-bits] | part[1][bits:] << 2 * bits
        bits *= 2
    fw, rv = fw[ok], rv[ok]
    number = text[ok]
    return number, ok - (off[number] - off[0]) + k - 1, np.minimum(fw, rv), fw <= rv


_ANY_CASE = np.full(256, 4, np.uint8)
_ANY_CASE[np.frombuffer(b"ACGTacgt", np.uint8)] = np.tile(np.arange(4), 2)


def encoded(kmer: Column) -> Column:
    """dna.encode() for many rows: whole batches of texts are turned into numbers as arrays. Null too for texts of more than 31 bases, which no number holds."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        flat = _ANY_CASE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]] if len(texts) else np.zeros(0, np.uint8)
        size, begin = np.diff(off), off[:-1] - off[:1]
        bad = np.concatenate([[0], np.cumsum(flat > 3)])
        ok = (size > 0) & (size <= 31) & (bad[begin + size] == bad[begin]) & texts.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for k in np.unique(size[ok]).tolist():
            at = np.flatnonzero(ok & (size == k))
            x = np.zeros(len(at), np.int64)
            for j in range(k):
                x = x << 2 | flat[begin[at] + j]
            out[at] = x
        return pa.array(out, mask=~ok)

    return run(kmer)


def _plain(seq: Column) -> Column:
    """The sequence for codes(): null as empty, any other character as one N."""
    return F.when(seq.rlike("^[ACGT]*$"), seq).otherwise(F.regexp_replace(F.coalesce(seq, F.lit("")), "(?s)[^ACGT]", "N"))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """b in pieces of at most AT_ONCE bases, or one row."""
    ends, base = np.cumsum(pc.binary_length(b.column("seq")).to_numpy(zero_copy_only=False)), 0
    while base < len(b):
        n = max(1, int(np.searchsorted(ends, (ends[base - 1] if base else 0) + AT_ONCE, "right")) - base)
        yield b.slice(base, n)
        base += n


#: Bits of the share of all k-mers that spectrum() sends as one row and adds up at a time.
SHARE = 13
#: A k-mer is mixed by an odd factor before it is dealt and mixed back afterwards.
_MIX = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """Numbers of so many bits, an even count, dealt out evenly; a bijection, whose inverse is back."""
    mask = np.uint64((1 << bits) - 1)
    x = x.astype(np.uint64)
    half = np.uint64(bits // 2)
    if back:
        x = x * np.uint64(pow(_MIX, -1, 1 << 64)) & mask
        return (x ^ x >> np.uint64(bits - bits // 2)).astype(np.int64)
    x = (x ^ x >> np.uint64(bits) - half) * np.uint64(_MIX) & mask
    return x.astype(np.int64)


def _packed(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each of the stretches that begin there ends) of numbers from 0 on, seven bits a byte from the lowest on, the eighth set but in a number's last."""
    size = np.ones(len(x), np.int64)
    for j in range(1, 10):
        more = x >> 7 * j > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(x) else 0, np.uint8)
    at = ends - size
    on = np.arange(len(x))
    for j in range(10):
        out[at[on] + j] = (x[on] >> 7 * j & 127) | (size[on] > j + 1) * 128
        on = on[size[on] > j + 1]
        if not len(on):
            break
    return out, np.append(ends[begin[1:] - 1], ends[-1:]) if len(begin) else ends[:0]


def _unpacked(b: np.ndarray) -> np.ndarray:
    """The numbers of _packed()."""
    last = np.flatnonzero(b < 128)
    size = np.diff(last, prepend=-1)
    x, at, on = np.zeros(len(last), np.int64), last - size + 1, np.arange(len(last))
    j = 0
    while len(on):
        x[on] |= (b[at[on] + j] & 127).astype(np.int64) << 7 * j
        j += 1
        on = on[size[on] > j]
    return x


def _binary(b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all values one after the other, where each value begins and the last ends)."""
    off = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(b.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off - off[0]


def _halves(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each of the stretches that begin there ends) of numbers below 16, two a byte."""
    n = np.diff(np.append(begin, len(x)))
    ends = np.cumsum(n + 1 >> 1)
    j = np.arange(len(x)) - np.repeat(begin, n)
    at = np.repeat(ends - (n + 1 >> 1), n) + (j >> 1)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    odd = (j & 1).astype(bool)
    out[at[~odd]] = x[~odd]
    out[at[odd]] |= (x[odd] << 4).astype(np.uint8)
    return out, ends


def _unhalved(b: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of _halves(): n of them in each stretch, which begin at off."""
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (b[np.repeat(off[:-1], n) + (j >> 1)] >> (j & 1) * 4 & 15).astype(np.int64)


def _values(b: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(b)])


#: K-mers with counts that a task of spectrum() holds before they go on, and windows that it counts at a time.
MERGED, LOT = 3 << 21, 1 << 20


def _summed(kmer: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both with equal k-mers (of so many bits) added up, by k-mer."""
    room = 63 - bits
    if len(n) and int(n.max()) >> room == 0:  # in one word they are sorted much faster
        x = kmer << room
        x |= n
        x.sort()
        kmer, n = x >> room, x & (1 << room) - 1
    else:
        order = np.argsort(kmer)
        kmer, n = kmer[order], n[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]])[: len(kmer)])
    return kmer[start], np.add.reduceat(n, start) if len(start) else n


def _shares(kmer: np.ndarray, n: np.ndarray, low: int) -> Iterator[pa.RecordBatch]:
    """Rows of shares: the gaps between the k-mers, and the counts less one, 15 and more in two parts. About a million k-mers at a time."""
    share = kmer >> low
    cuts = np.flatnonzero(np.diff(share, prepend=-1))
    some = np.unique(np.searchsorted(cuts, np.append(np.arange(0, len(kmer), 1 << 20), len(kmer))))
    for a, b in zip(some[:-1].tolist(), some[1:].tolist()):
        begin, end = cuts[a], cuts[b] if b < len(cuts) else len(kmer)
        cut, x, c = cuts[a:b] - begin, kmer[begin:end], n[begin:end] - 1
        gap = np.diff(x, prepend=0)
        gap[cut] = x[cut] & (1 << low) - 1
        large = np.flatnonzero(c >= 15)
        rest, ends = _packed(c[large] - 15, np.arange(len(large)))
        upto = np.append(0, ends)[np.searchsorted(large, np.append(cut[1:], len(x)))]
        yield pa.RecordBatch.from_arrays([pa.array(share[begin:end][cut].astype(np.int32)), _values(*_packed(gap, cut)), _values(*_halves(np.minimum(c, 15), cut)), _values(rest, upto)], ["share", "kmers", "counts", "more"])


def _of_shares(b: pa.RecordBatch, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shares, where each row's k-mers begin and the last end, the k-mers, their counts) of rows of _shares()."""
    share = b.column(0).to_numpy()
    flat, off = _binary(b.column(1))
    gap = _unpacked(flat)
    cut = np.append(0, np.cumsum(flat < 128))[off]  # a row holds as many numbers as bytes without the eighth bit
    size = np.diff(cut)
    kmer = np.cumsum(gap)
    kmer += np.repeat((share.astype(np.int64) << low) - (kmer - gap)[cut[:-1]], size)
    n = _unhalved(*_binary(b.column(2)), size)
    n[n == 15] += _unpacked(_binary(b.column(3))[0])
    return share, cut, kmer, n + 1


def _added(reads: DataFrame, k: int, min_count: int, per_read: bool, text: bool) -> DataFrame:
    """kmer (a code, or a text), n: canonical occurrences in all reads (rows with seq), or per_read the rows that have it. Neighbouring reads are counted in the
    task, by sorting their k-mers, and these counts merged; what they have together is dealt by shares of the k-mers: a task's part of a share is one
    row, and shares (which can spill) are added up one after the other."""
    low = max(2 * k - SHARE, 0)  # bits of a mixed k-mer within its share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        lots: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            x = _mixed(np.concatenate(held), 2 * k)
            held.clear()
            if per_read:
                first = np.cumsum([0] + [int(y[-1]) + 1 if len(y) else 0 for y in numbers])
                number = np.concatenate([y + f for y, f in zip(numbers, first)])
                numbers.clear()
                x, number = _sorted_pairs(x, number, k, int(first[-1]) + 1)
                x = x[np.concatenate([[True], (x[1:] != x[:-1]) | (number[1:] != number[:-1])])[: len(x)]]
            else:
                x.sort()
            start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
            lots.append((x[start], np.diff(np.append(start, len(x))).astype(np.int32)))

        def merged() -> Iterator[pa.RecordBatch]:
            x, n = (np.concatenate(y) for y in zip(*lots))
            lots.clear()
            yield from _shares(*_summed(x, n, 2 * k), low)

        for b in batches:
            for piece in _slices(b):
                number, _, kmer, _ = codes(piece.column("seq"), k)
                held.append(kmer)
                if per_read:
                    numbers.append(number.astype(np.int32))
                if sum(map(len, held)) >= LOT:
                    count()
                    if sum(len(x) for x, _ in lots) >= MERGED:
                        yield from merged()
        if held:
            count()
        if lots:
            yield from merged()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the rows so far of one share

        def total() -> Iterator[pa.RecordBatch]:
            kmer, n = _summed(*(np.concatenate(x) for x in zip(*held)), 2 * k)
            on = np.flatnonzero(n >= min_count)
            for at in range(0, len(on), AT_ONCE):
                some = on[at : at + AT_ONCE]
                code = _mixed(kmer[some], 2 * k, True)
                yield pa.RecordBatch.from_arrays([_text(code, k) if text else pa.array(code), pa.array(n[some])], ["kmer", "n"])

        for b in batches:
            if not len(b):
                continue
            share, cut, kmer, n = _of_shares(b, low)
            last = int(np.searchsorted(share, share[-1], "left"))
            if last or share[-1] != now:
                held.append((kmer[: cut[last]], n[: cut[last]]))
                yield from total()
                held.clear()
            held.append((kmer[cut[last] :].copy(), n[cut[last] :].copy()))
            now = share[-1]
        if held:
            yield from total()

    part = reads.select(_plain(F.col("seq")).alias("seq")).mapInArrow(run, "share int, kmers binary, counts binary, more binary")
    return part.repartition("share").sortWithinPartitions("share").mapInArrow(add, f"kmer {'string' if text else 'long'}, n long")


def spectrum(reads: DataFrame, k: int, min_count: int = 1, text: bool = False) -> DataFrame:
    """kmer (with text the text in place of its code), n: canonical occurrences in all reads."""
    return _added(reads, k, min_count, False, text)


def _low_complexity(kmer: np.ndarray, k: int, share: float) -> np.ndarray:
    low = ((1 << 2 * k) - 1) // 3
    return np.maximum(*(np.bitwise_count(x & x >> 1 & low) for x in (kmer, ~kmer))) > share * k


def _sorted_pairs(kmer: np.ndarray, number: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Both by k-mer, then number (below most). In one word they are sorted much faster, and in place: kmer may be written over."""
    bits = max(most - 1, 0).bit_length()
    if 2 * k + bits < 64:
        kmer <<= bits
        kmer |= number
        kmer.sort()
        number = (kmer & (1 << bits) - 1).astype(np.int32 if bits < 32 else np.int64)
        kmer >>= bits
        return kmer, number
    order = np.lexsort((number, kmer))
    return kmer[order], number[order]


def seed_candidates(reads: DataFrame, k: int, min_count: int = 1, share: float = 0.9) -> DataFrame:
    """read_id of the reads (read_id, seq, use: whether it takes part) that may be seeds as admit() finds them: all seeds, and few others.

    Left out is a read that shares a k-mer with one of a smaller id of the same task, if that task's reads alone hold the k-mer
    often enough: it is on the index then, whatever other tasks hold. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def left() -> pa.RecordBatch:
            first = np.cumsum([0] + [len(x[0]) for x in held])
            ids, use = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            rank = np.empty(len(ids), np.int32)
            rank[np.lexsort((ids, ~use))] = np.arange(len(ids))
            number, kmer = np.concatenate([rank[x[2] + f] for x, f in zip(held, first)]), np.concatenate([x[3] for x in held])
            held.clear()
            kmer, at = _sorted_pairs(kmer, number, k, len(ids))
            del number
            start = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]])[: len(kmer)])
            n = np.diff(np.append(start, len(kmer)))
            by = np.empty(len(ids), np.int64)
            by[rank] = np.arange(len(ids))
            ids, use = ids[by], use[by]  # in the order of ranks
            good = (n >= min_count) & ~_low_complexity(kmer[start], k, share) & use[at[start]]
            del kmer
            # usable reads come first and by id, so all but the lowest id's lie behind it
            lowest = np.repeat(np.where(good, ids[at[start]], np.iinfo(np.int64).max), n)
            out = ~use
            out[at[ids[at] > lowest]] = True
            return pa.RecordBatch.from_arrays([pa.array(ids[~out])], ["read_id"])

        for b in batches:
            for piece in _slices(b):
                number, _, kmer, _ = codes(piece.column("seq"), k)
                held.append((piece.column("read_id").to_numpy(), piece.column("use").to_numpy(zero_copy_only=False).astype(bool), number.astype(np.int32), kmer))
                if sum(len(x[3]) for x in held) >= HELD:
                    yield left()
        if held:
            yield left()

    rows = reads.where("read_id is not null").select("read_id", _plain(F.col("seq")).alias("seq"), F.coalesce("use", F.lit(False)).alias("use"))
    return rows.mapInArrow(run, "read_id long").distinct()


#: Bits of marks(): so many for each key, at most MOST; of one segment.
PER_KEY, MOST, SEGMENT = 16, 30, 19


def _spots(keys: np.ndarray, log: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - log)).astype(np.int64)


def marks(keys: DataFrame, column: str, n: int) -> Broadcast:
    """A bitmap with a bit for each of about n keys (longs), broadcast. It is put together by segments in tasks; what meets it has to be joined with the
    keys yet, so its size (at most 128 MB) changes speed only."""
    log = min(max((n * PER_KEY).bit_length(), SEGMENT), MOST)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(keys: list[np.ndarray]) -> pa.RecordBatch:
            x = np.unique(np.concatenate(keys))
            cut = np.flatnonzero(np.diff(x >> SEGMENT, prepend=-1))
            spots = [(y & (1 << SEGMENT) - 1).astype(np.uint32).tobytes() for y in np.split(x, cut[1:])] if len(x) else []
            return pa.RecordBatch.from_arrays([pa.array(x[cut] >> SEGMENT, pa.int64()), pa.array(spots, pa.binary())], ["segment", "bits"])

        held: list[np.ndarray] = []
        for b in batches:
            held.append(_spots(b.column(0).drop_null().to_numpy(), log))
            if sum(map(len, held)) >= LOT:
                yield dealt(held)
                held.clear()
        if held:
            yield dealt(held)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                m = maps.setdefault(s, np.zeros(1 << SEGMENT - 3, np.uint8))
                at = np.frombuffer(x.as_buffer(), np.uint32)
                np.bitwise_or.at(m, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for s, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([m.tobytes()], pa.binary())], ["segment", "bits"])

    out = np.zeros(1 << log - 3, np.uint8)
    parts = keys.select(F.col(column).cast("long")).mapInArrow(deal, "segment long, bits binary").repartition("segment").mapInArrow(put, "segment long, bits binary")
    # written first, so that all segments are put together at once: the iterator runs one task after the other
    path = sinks.scratch(keys.sparkSession, "marks")
    parts.write.parquet(path)
    for row in keys.sparkSession.read.schema(parts.schema).parquet(path).toLocalIterator():
        out[row.segment << SEGMENT - 3 : row.segment + 1 << SEGMENT - 3] = np.frombuffer(row.bits, np.uint8)
    sinks.drop(keys.sparkSession, path)
    return keys.sparkSession.sparkContext.broadcast((log, out))


def met(seen: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether marks() has each key."""
    at = _spots(keys, seen[0])
    return (seen[1][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def marked(reads: DataFrame, k: int, seen: Broadcast | None = None, keep: str | None = None) -> DataFrame:
    """windows() whose k-mers marks() has (and some that it has not), or all, with a boolean column keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _slices(b):
                number, end, kmer, forward = codes(piece.column("seq"), k)
                on = np.flatnonzero(met(seen.value, kmer)) if seen else np.arange(len(kmer))
                at = pa.array(number[on])
                yield pa.RecordBatch.from_arrays([piece.column("read_id").take(at), *([piece.column(keep).take(at)] if keep else []), pa.array(end[on].astype(np.int32)), pa.array(kmer[on]), pa.array(forward[on])], names)

    names = ["read_id", *([keep] if keep else []), "end", "kmer", "forward"]
    rows = reads.select("read_id", _plain(F.col("seq")).alias("seq"), *([keep] if keep else []))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ["long", *(["boolean"] if keep else []), "int", "long", "boolean"])))


def among(reads: DataFrame, seen: Broadcast, inside: bool = True) -> DataFrame:
    """read_id, seq of the reads whose id marks() has, and some others; or, not inside, of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(met(seen.value, b.column("read_id").to_numpy()) == inside))

    return reads.where("read_id is not null").select("read_id", "seq").mapInArrow(run, "read_id long, seq string")


def _text(x: np.ndarray, k: int) -> pa.Array:
    flat = np.empty((len(x), k), np.uint8)
    for j in range(k):
        flat[:, j] = _BASE[x >> 2 * (k - 1 - j) & 3]
    return pa.StringArray.from_buffers(len(x), pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * k), pa.py_buffer(flat))


def decoded(code: Column, k: int) -> Column:
    """dna.decode() for many rows: whole batches of numbers are turned into texts as arrays."""

    @F.arrow_udf("string")
    def run(codes: pa.Array) -> pa.Array:
        text = _text(codes.fill_null(0).to_numpy(zero_copy_only=False), k)
        return pc.if_else(codes.is_valid(), text, pa.scalar(None, pa.string())) if codes.null_count else text

    return run(code)


def as_text(counts: DataFrame, k: int) -> DataFrame:
    """counts with the k-mer's text in place of its code."""
    return counts.withColumn("kmer", decoded(F.col("kmer"), k))


def as_codes(counts: DataFrame) -> DataFrame:
    """kmer, n with codes, of k-mer texts from outside; both strands of a k-mer are added up."""
    return counts.select(dna.encode(dna.canonical(F.upper("kmer"))).alias("kmer"), "n").where("kmer is not null").groupBy("kmer").agg(F.sum("n").alias("n"))


def postings(reads: DataFrame, k: int, counts: DataFrame | None = None, share: float = 0.9) -> DataFrame:
    """kmer, read_id, spos: the first occurrence of each k-mer in each read; |spos| - 1 is its end, the sign its strand.

    With counts (kmer, n) only those k-mers are indexed that it holds and that are not of low complexity. The join
    deals windows by k-mer, which the grouping by k-mer and read then needs no further shuffle for."""
    w = windows(reads, k)
    if counts is not None:
        w = w.join(counts.where(~low_complexity(F.col("kmer"), k, share)).select("kmer"), "kmer", "left_semi")
    return first_windows(w)


def first_windows(w: DataFrame) -> DataFrame:
    """postings() of windows."""
    # end and strand as one integer, so that the minimum is a hash aggregate without a sort
    first = w.groupBy("kmer", "read_id").agg(F.min(F.col("end") * 2 + (~F.col("forward")).cast("int")).alias("x"))
    end = F.floor(F.col("x") / 2)
    return first.select("kmer", "read_id", F.when(F.col("x") % 2 == 0, end + 1).otherwise(-end - 1).cast("int").alias("spos"))


def document_frequency(reads: DataFrame, k: int, text: bool = False) -> DataFrame:
    """kmer (with text the text in place of its code), n_reads: each read counts once. Rows are counted as in spectrum(), but for reads of several rows and those without an id: a
    bitmap tells which they may be (which way a read goes changes speed only), and their pairs of k-mer and read are dealt one by one."""
    again = reads.groupBy("read_id").count().where("count > 1 or read_id is null").select("read_id")
    n = again.count()
    once = reads.select("read_id", "seq")
    if not n:
        return _added(once, k, 1, True, text).withColumnRenamed("n", "n_reads")
    seen = marks(again, "read_id", n)
    many = among(once, seen).unionByName(once.where("read_id is null"))
    pairs = windows(many, k).select("kmer", "read_id").distinct().groupBy("kmer").agg(F.count("*").alias("n"))
    out = _added(among(once, seen, False), k, 1, True, False).unionByName(pairs).groupBy("kmer").agg(F.sum("n").alias("n_reads"))
    return as_text(out, k) if text else out


def admit(posts: DataFrame, order: Column | str = "read_id", slack: int = 1) -> DataFrame:
    """read_id of the seeds that may run together: the reads whose order (a number from 1 if slack is used) is at most slack times the
    smallest on every k-mer they hold. With slack 1 and orders unique by read, no two share a k-mer.

    A minimum per k-mer (partial before the shuffle, so a hot k-mer is cheap), then one join back on the k-mer."""
    x = posts.select("kmer", "read_id", (F.col(order) if isinstance(order, str) else order).alias("o"))
    low = x.groupBy("kmer").agg(F.min("o").alias("low"))
    over = F.col("o") > (F.col("low") * slack if slack != 1 else F.col("low"))
    return x.join(low, "kmer").groupBy("read_id").agg(F.max(over.cast("int")).alias("over")).where("over = 0").select("read_id")
