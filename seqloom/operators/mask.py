"""Step 1: masking of unknown bases, and the filter on pairs.

A null sequence is rejected like one with too many Ns, an empty one stays empty. Repeated rows go alike; rows with a null pair are one pair.
Empty tables give empty tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fourth N of a chain in which neighbours are at most GAP other characters apart ends the read; beyond KEEP_OVER it is cut there.
CHAIN, GAP, KEEP_OVER = 4, 3, 35
_BASES = np.frombuffer(b"ACGT", np.uint8)


def _cuts(seqs: pa.LargeStringArray) -> tuple[np.ndarray, ...]:
    """Of texts: their bytes, their offsets, the bytes that are an N, the text and the place (in characters) of each, cut_at, and the byte where the text ends then."""
    off = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    flat = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    at = np.flatnonzero((flat | 32) == ord("n"))
    text = np.searchsorted(off, at, "right") - 1
    if len(flat) and flat.max() > 127:  # a character of several bytes is one place
        begun = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        place = begun[at] - begun[off[:-1]][text]
    else:
        place = at - off[:-1][text]
    cut = np.full(len(seqs), -1, np.int64)
    stop = off[1:].copy()
    if len(at) >= CHAIN:
        near = (np.diff(place) <= GAP + 1) & (text[1:] == text[:-1])
        first = np.flatnonzero(near[: len(near) - 2] & near[1 : len(near) - 1] & near[2:])[::-1]  # the first of a text is written last
        cut[text[first]] = place[first + CHAIN - 1]
        stop[text[first]] = at[first + CHAIN - 1]
    return flat, off, at, text, place, cut, stop


def _strings(flat: np.ndarray, off: np.ndarray, stop: np.ndarray, gone: np.ndarray, without: np.ndarray) -> pa.Array:
    """The texts up to stop, null where gone, without some bytes."""
    size = np.where(gone, 0, stop - off[:-1])
    ends = np.concatenate([[0], np.cumsum(size)])
    if ends[-1] != len(flat) or len(without):
        full = size > 0
        edge = np.bincount(off[:-1][full], minlength=len(flat) + 1) - np.bincount((off[:-1] + size)[full], minlength=len(flat) + 1)
        keep = np.cumsum(edge[:-1]) > 0
        keep[without] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[off[:-1]]
        flat = flat[keep]
        ends = np.append(ends, len(flat))
    valid = pa.py_buffer(np.packbits(~gone, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(gone), [valid, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.string())


def _worked(reads: DataFrame, fill: bool) -> DataFrame:
    """reads with cut_at and masked; with fill every N of masked is replaced by a base chosen by read_id and place (and goes if read_id is null). Whole
    batches are worked on as arrays of bytes."""
    reads = reads.drop("cut_at", "masked")
    names = [*reads.columns, "cut_at", "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column("seq").cast(pa.large_string())
            null = seqs.is_null().to_numpy(zero_copy_only=False)
            flat, off, at, text, place, cut, stop = _cuts(seqs)
            without = at[:0]
            if fill:
                flat = flat.copy()
                without = at[b.column("read_id").is_null().to_numpy(zero_copy_only=False)[text]]
                ids = b.column("read_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                # modulo 4 a place times 7 is its negative; a quotient by 13 is cut towards zero
                part = (ids % 4 * 3 + (np.abs(ids) // 13 * np.sign(ids)) % 4) % 4
                flat[at] = _BASES[(part[text] - place) % 4]
            gone = null | (cut >= 0) & (cut <= KEEP_OVER)
            at_ = pa.array(cut, pa.int32(), mask=null)
            yield pa.RecordBatch.from_arrays([*b.columns, at_, _strings(flat, off, stop, gone, without)], names)

    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, T.StructField("cut_at", T.IntegerType()), T.StructField("masked", T.StringType())]))


def cut(reads: DataFrame) -> DataFrame:
    """reads with cut_at (-1: no cut) and masked: the read up to the cut, null if it is rejected."""
    return _worked(reads, False)


def mask(reads: DataFrame) -> DataFrame:
    """reads (read_id, seq) that are not rejected, cut where need be, with every N replaced."""
    return _worked(reads.select("read_id", "seq"), True).where("masked is not null").select("read_id", F.col("masked").alias("seq"))


def mask_pairs(reads: DataFrame) -> DataFrame:
    """Like mask(), of reads with a pair column; a pair stays only if all its mates do. Ids stay as they are, so gaps tell what was dropped."""
    m = _worked(reads.select("read_id", "pair", "seq"), True).select("read_id", "pair", F.col("masked").alias("seq"))
    return m.withColumn("ok", F.min(F.col("seq").isNotNull()).over(W.partitionBy("pair"))).where("ok").select("read_id", "pair", "seq")
