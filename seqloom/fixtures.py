"""Reads derived from the documents table: letters become bases, whole texts are tiled into 75-base reads every 15 bases,
and one more that ends with the text, so that no letter of a text of 75 and more is left out.

One read in four gets one planted substitution and odd reads are reverse-complemented; `clean` is the read without the
planted change. raw_reads has more Ns, no planted change and one strand. A read's id is doc_id * 100,000,000 + place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ, STEP, ID_STEP = 75, 15, 100_000_000
#: The base of each letter from a to z.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
READ_BASES = "ACGTACGTACGTACGTACGTACGTAN"
RAW_BASES = "ACGTACGTACGTACGTACGTNCNTNN"
#: Reads that a task holds at a time.
AT_ONCE = 1 << 14
#: Bytes of an Arrow batch of documents, unless the session sets its own: rows alone bound nothing when texts are long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def _bytes(pairs: dict[str, str]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for x, y in pairs.items():
        out[ord(x)] = ord(y)
    return out


_CHANGE, _TURN = _bytes(dict(zip("ACGTN", "CGTAN"))), _bytes(dict(zip("ACGTN", "TGCAN")))


def _cut(text: str, pos: int, n: int) -> str:
    """substring() of SQL, for places before the text too."""
    start = pos - 1 if pos > 0 else len(text) + pos if pos < 0 else 0
    return text[start : start + n] if n > 0 else ""


def _planted(f: np.ndarray, h: np.ndarray) -> list[pa.Array]:
    """[numbers of the rows, seq, clean] of reads (rows of bytes) and their h; a negative h may leave a read of another length, so these rows come last, one by one."""
    odd = np.flatnonzero(h % 2 * (h > 0))
    seq, clean = f.copy(), f.copy()
    at = np.flatnonzero((h % 4 == 0) & (h >= 0))
    seq[at, h[at] % READ] = _CHANGE[seq[at, h[at] % READ]]
    for x in (seq, clean):
        x[odd] = _TURN[x[odd, ::-1]]
    below = np.flatnonzero((h % 4 == 0) & (h < 0))
    if not len(below):
        return [pa.array(np.arange(len(h))), _texts(seq), _texts(clean)]
    rest = np.setdiff1d(np.arange(len(h)), below)
    changed = []
    for i in below.tolist():
        text, place = f[i].tobytes().decode(), -(-int(h[i]) % READ)
        changed.append(_cut(text, 1, place) + _cut(text, place + 1, 1).translate(str.maketrans("ACGT", "CGTA")) + _cut(text, place + 2, READ))
    order = np.concatenate([rest, below])
    return [pa.array(order), pa.concat_arrays([_texts(seq[rest]), pa.array(changed, pa.string())]), _texts(clean[order])]


def _texts(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * READ
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows)))


def _tiles(spark: SparkSession, sf_dir: str, bases: str, planted: bool, clean: bool = False) -> DataFrame:
    """doc_id, pos, seq and, if asked for, clean: whole documents are cut as bytes, many reads at a time."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < n:  # a small file is one split, and every read comes out of it
        d = d.repartition(n, "doc_id")
    if not spark.sparkContext.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    base = _bytes(dict(zip(LETTERS + LETTERS.upper(), bases * 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Scalar, np.ndarray, np.ndarray]] = []  # a document's id, letters from the first place on, and places

        def made() -> pa.RecordBatch:
            size = np.array([len(x[2]) for x in held])
            first = np.cumsum([0] + [len(x[1]) for x in held])[:-1] - [x[2][0] for x in held]
            pos = np.concatenate([x[2] for x in held])
            f = np.lib.stride_tricks.sliding_window_view(np.concatenate([x[1] for x in held]), READ)[np.repeat(first, size) + pos]
            ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), size)))
            held.clear()
            if planted:
                # without an id a read is neither changed nor turned
                h = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy() * 31 + pos, 2)
                order, *texts = _planted(f, h)
                ids, pos = ids.take(order), pos[order.to_numpy()]
            else:
                texts = [_texts(f)]
            return pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), *texts[: 1 + clean]], ["doc_id", "pos", *(["seq", "clean"][: 1 + clean])])

        waiting = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if not text.is_valid:
                    continue
                tx = base[np.frombuffer(text.as_buffer(), np.uint8)]
                tx = tx[tx > 0]
                if len(tx) < READ:
                    continue
                pos = np.arange(0, len(tx) - READ + 1, STEP)
                if pos[-1] != len(tx) - READ:
                    pos = np.append(pos, len(tx) - READ)
                for k in range(0, len(pos), AT_ONCE):
                    part = pos[k : k + AT_ONCE]
                    held.append((doc, tx[part[0] : part[-1] + READ], part))
                    waiting += len(part)
                    if waiting >= AT_ONCE:
                        yield made()
                        waiting = 0
        if held:
            yield made()

    return d.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pos int, seq string" + ", clean string" * clean)


def reads(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """read_id, doc_id, pos, seq and, unless left out, clean."""
    r = _tiles(spark, sf_dir, READ_BASES, True, clean)
    return r.select((F.col("doc_id") * ID_STEP + F.col("pos")).alias("read_id"), "doc_id", "pos", "seq", *["clean"] * clean)


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, doc_id, pos, seq."""
    return _tiles(spark, sf_dir, RAW_BASES, False).select((F.col("doc_id") * ID_STEP + F.col("pos")).alias("read_id"), "doc_id", "pos", "seq")


def _tiles_sql(name: str, bases: str) -> str:
    return f"""{name}_t AS (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{bases}') AS tx FROM documents),
{name}_w AS (SELECT doc_id, tx, unnest(list_distinct(list_append(range(0, length(tx) - {READ - 1}, {STEP}), length(tx) - {READ}))) AS pos FROM {name}_t WHERE length(tx) >= {READ}),
{name}_f AS (SELECT doc_id * {ID_STEP} + pos AS read_id, doc_id, CAST(pos AS INT) AS pos, substr(tx, CAST(pos + 1 AS INT), {READ}) AS f, doc_id * 31 + pos AS h FROM {name}_w)"""


#: The same two views for DuckDB, as common table expressions.
READS_SQL = f"""{_tiles_sql('r', READ_BASES)},
r_e AS (SELECT read_id, doc_id, pos, h, f, CASE WHEN h % 4 = 0 THEN concat(substr(f, 1, CAST(h % {READ} AS INT)), translate(substr(f, CAST(h % {READ} + 1 AS INT), 1), 'ACGT', 'CGTA'), substr(f, CAST(h % {READ} + 2 AS INT))) ELSE f END AS s FROM r_f),
reads AS (SELECT read_id, doc_id, pos,
  CASE WHEN h % 2 = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS seq,
  CASE WHEN h % 2 = 1 THEN reverse(translate(f, 'ACGT', 'TGCA')) ELSE f END AS clean FROM r_e)"""
RAW_SQL = f"{_tiles_sql('q', RAW_BASES)},\nraw_reads AS (SELECT read_id, doc_id, pos, f AS seq FROM q_f)"
