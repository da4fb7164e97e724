"""A content-addressed store of token-id streams: rolling-hash chunks, unique chunks once, recipes, Merkle manifests.

Layout under one folder (all written by Spark's committed writers, so a lost executor costs a task, not the store):

- packs/: one row per document, ascending by doc_id over the files (pack = number of the range, ascending). A row has
  the recipe (digests, lens: the chunks in order; place: where each chunk's ids lie) and payload, zstd of the ids of those
  chunks that this document is the first to hold. Ids are little-endian unsigned integers of `width` bytes: 2 if the
  vocabulary fits, else 4. place: 0 in this payload; 1 in this payload, and other documents refer to it; 2 earlier under
  the same doc_id; 3 in the payload of the smallest doc_id that holds it.
- manifest/: one row per pack: its documents, ids, and the Merkle root over its documents' recipes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens, words


@dataclass(frozen=True)
class Params:
    """mask_bits: a chunk ends where the high bits of the rolling hash are 0, on average every 2 ** mask_bits ids.
    window: ids under the rolling hash. least, most: bounds of a chunk's length in ids."""

    tokenizer: str
    end_id: int = 2
    mask_bits: int = 8
    window: int = 4
    least: int = 64
    most: int = 1024


DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of the binary Merkle tree; an odd node goes up unchanged. No leaves: the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        pairs = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


class RollingRoot:
    """The Merkle root of leaves added one at a time, in memory of the logarithm of their number. Equal to merkle_root()."""

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, digest(b"\0" + leaf)
        while self.peaks and self.peaks[-1][0] == height:
            node = digest(b"\1" + self.peaks.pop()[1] + node)
            height += 1
        self.peaks.append((height, node))

    def root(self) -> bytes:
        if not self.peaks:
            return digest(b"")
        node = self.peaks[-1][1]
        for _, left in self.peaks[-2::-1]:
            node = digest(b"\1" + left + node)
        return node


def cuts(ids: np.ndarray, off: np.ndarray, p: Params) -> list[np.ndarray]:
    """The chunk ends of each stream. They depend on the ids near them alone, so an edit moves only the chunks around it."""
    table = (words.numbers(21, 1 << 16) >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        value = table[ids & np.uint32(0xFFFF)] ^ (ids >> np.uint32(16))
        h = value.copy()
        for _ in range(p.window - 1):  # a polynomial hash of the last `window` ids, by Horner's rule over shifted views
            h[1:] = value[1:] + np.uint32(0x9E3779B1) * h[:-1]
    hit = np.flatnonzero(h >> np.uint32(32 - p.mask_bits) == 0) + 1
    lo = np.searchsorted(hit, off[:-1] + p.least)
    hi = np.searchsorted(hit, off[1:])
    out = []
    for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), lo.tolist(), hi.tolist()):
        ends, last = [], a
        for c in hit[i:j].tolist():
            while c - last > p.most:
                last += p.most
                ends.append(last)
            if c - last >= p.least:
                ends.append(c)
                last = c
        while b - last > p.most:
            last += p.most
            ends.append(last)
        if b > last:
            ends.append(b)
        out.append(np.array(ends, np.int64))
    return out


ENCODED = "doc_id long, n_tokens long, digests array<binary>, lens array<int>, payload binary"


def _list_of(values: pa.Array, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), values)


def _encode(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(p.tokenizer)
        kind = np.dtype("<u2") if enc.vocabulary <= 1 << 16 else np.dtype("<u4")
        squeeze = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for part in words.slices(whole, "text"):
                ids, off = enc.encode(part.column("text"))
                n = np.diff(off)
                own = off + np.arange(len(off))  # each stream gets its end id
                full = np.full(len(ids) + len(n), p.end_id, np.uint32)
                full[tokens.gather(own[:-1], n)] = ids
                ends = cuts(full, own, p)
                small = full.astype(kind)
                digests, lens, payload = [], [], []
                for a, e in zip(own[:-1].tolist(), ends):
                    last = a
                    for c in e.tolist():
                        digests.append(digest(small[last:c].tobytes()))
                        lens.append(c - last)
                        last = c
                    payload.append(squeeze.compress(small[a:last].tobytes()))
                count = [len(e) for e in ends]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n + 1), _list_of(pa.array(digests, pa.binary()), count), _list_of(pa.array(lens, pa.int32()), count), pa.array(payload, pa.binary())],
                    ["doc_id", "n_tokens", "digests", "lens", "payload"],
                )

    return run


PACKED = "pack int, doc_id long, n_tokens long, start_in_pack long, width int, digests array<binary>, lens array<int>, place array<int>, payload binary, leaf binary"


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range, by doc_id; a document's notes (kind 0) come before it. A note: a shared digest, and whether it is stored here."""
        from pyspark import TaskContext

        pack, start = TaskContext.get().partitionId(), 0
        squeeze, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        now, notes, seen = None, {}, set()
        for batch in batches:
            out = {k: [] for k in ("pack", "doc_id", "n_tokens", "start_in_pack", "width", "digests", "lens", "place", "payload", "leaf")}
            for doc, kind, n, digests, lens, payload, here in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "n_tokens", "digests", "lens", "payload", "here"))):
                if doc != now:
                    now, notes, seen = doc, {}, set()
                if kind == 0:
                    notes = dict(zip(digests, here))
                    continue
                place = []
                for d in digests:
                    place.append(2 if d in seen else 0 if d not in notes else 1 if notes[d] else 3)
                    seen.add(d)
                if any(x > 1 for x in place):
                    data, at, kept = open_.decompress(payload), 0, []
                    for x, size in zip(place, lens):
                        if x < 2:
                            kept.append(data[at : at + size * width])
                        at += size * width
                    payload = squeeze.compress(b"".join(kept))
                leaf = digest(int(doc).to_bytes(8, "little", signed=True) + b"".join(digests))
                for k, v in zip(out, (pack, doc, n, start, width, digests, lens, place, payload, leaf)):
                    out[k].append(v)
                start += n
            yield pa.RecordBatch.from_pydict(out, pa.schema([("pack", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start_in_pack", pa.int64()), ("width", pa.int32()), ("digests", pa.list_(pa.binary())), ("lens", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("payload", pa.binary()), ("leaf", pa.binary())]))

    return run


def write_store(docs: DataFrame, path: str, p: Params, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the store under path.

    Rows with a null id are left out: a store addresses documents by id. Repeated ids are all written, one after the
    other. An empty text is one chunk that holds the end id. No rows: a store without packs. Extra columns are ignored.
    The texts are encoded once (one map pass, written out); only digests are grouped to find each chunk's first holder;
    then one range shuffle of compressed payloads brings documents into order, notes on shared chunks coming along by union.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    encoded_path = common.write(base.mapInArrow(_encode(p), ENCODED), "encoded")
    encoded = spark.read.parquet(encoded_path)
    entries = encoded.select("doc_id", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = entries.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top")).where("owner != top").select(F.col("digest").alias("key"), "owner")
    notes = entries.join(shared, entries.digest == F.col("key")).select("doc_id", "digest", (F.col("doc_id") == F.col("owner")).alias("here")).distinct()
    notes = notes.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "here")).alias("x"))
    notes = notes.selectExpr("doc_id", "0 as kind", "cast(null as long) as n_tokens", "x.digest as digests", "cast(null as array<int>) as lens", "cast(null as binary) as payload", "x.here as here")
    rows = encoded.selectExpr("doc_id", "1 as kind", "n_tokens", "digests", "lens", "payload", "cast(null as array<boolean>) as here")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = notes.union(rows).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "kind", "payload")
    width = 2 if tokens.encoder(p.tokenizer).vocabulary <= 1 << 16 else 4
    dealt.mapInArrow(_pack(width), PACKED).write.parquet(f"{path}/packs")
    common.drop(spark, encoded_path)
    packs = spark.read.parquet(f"{path}/packs")
    seen = packs.select("pack", "doc_id", "n_tokens", "start_in_pack", "leaf")
    # leaves, 16 bytes a document, meet by pack and are folded to its root one at a time
    roots = seen.repartition(n, "pack").sortWithinPartitions("pack", "start_in_pack").mapInArrow(_roots, "pack int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary")
    roots.repartition(1).write.parquet(f"{path}/manifest")  # a row for each pack, after the fold


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packs: dict[int, list] = {}
    for batch in batches:
        for pack, doc, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("pack", "doc_id", "n_tokens", "leaf"))):
            x = packs.setdefault(pack, [doc, doc, 0, 0, RollingRoot()])
            x[1] = doc
            x[2] += 1
            x[3] += n
            x[4].add(leaf)
    rows = [(k, *v[:4], v[4].root()) for k, v in packs.items()]
    kinds = [("pack", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])


def _library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, data) of the stored chunks that other documents refer to."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        digests, data = [], []
        for width, ds, lens, place, payload in zip(*(batch.column(c).to_pylist() for c in ("width", "digests", "lens", "place", "payload"))):
            if 1 not in place:
                continue
            raw, at = open_.decompress(payload), 0
            for d, size, x in zip(ds, lens, place):
                if x < 2:
                    if x:
                        digests.append(d)
                        data.append(raw[at : at + size * width])
                    at += size * width
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's ids from its payload, what its doc_id held before, and what was sent from other documents (kind 0)."""
    import zlib

    open_ = zstandard.ZstdDecompressor()
    now, sent = None, {}
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "pack", "start_in_pack", "n_tokens", "ids_crc32", "ids")}
        for doc, kind, pack, start, n, width, digests, lens, place, payload, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "pack", "start_in_pack", "n_tokens", "width", "digests", "lens", "place", "payload", "data"))):
            if doc != now:
                now, sent = doc, {}
            if kind == 0:
                sent.update(zip(digests, data))
                continue
            raw, at, parts = open_.decompress(payload), 0, []
            for d, size, x in zip(digests, lens, place):
                if x < 2:
                    sent[d] = raw[at : at + size * width]
                    at += size * width
                part = sent.get(d)
                if part is None or digest(part) != d:
                    raise ValueError(f"document {doc}: a chunk is missing or differs from its digest")
                parts.append(part)
            ids = np.frombuffer(b"".join(parts), f"<u{width}").astype("<u4").tobytes()
            if len(ids) != 4 * n:
                raise ValueError(f"document {doc}: {len(ids) // 4} ids instead of {n}")
            for k, v in zip(out, (doc, pack, start, n, zlib.crc32(ids), ids)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("pack", pa.int32()), ("start_in_pack", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))


def _digest_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _rebuild(batches):
        yield batch.drop_columns(["ids"])


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).

    The packs' Merkle roots are computed again from the recipes and compared with the manifest first (see verify), every
    chunk is checked against its digest and every document against its length. Chunks held by other documents
    come over a join on the digest (the library side has a digest once; adaptive execution splits a hot one)."""
    verify(spark, path)
    packs = spark.read.parquet(f"{path}/packs")
    manifest = spark.read.parquet(f"{path}/manifest").select("pack", "n_tokens").collect()  # as many rows as packs
    before, total = {}, 0
    for pack, n in sorted(map(tuple, manifest)):
        before[pack] = total
        total += n
    library = packs.where(F.array_contains("place", 1)).select("width", "digests", "lens", "place", "payload").mapInArrow(_library, "digest binary, data binary").withColumnRenamed("digest", "key")
    needs = packs.where(F.array_contains("place", 3)).select("doc_id", F.explode(F.array_distinct(F.expr("transform(filter(arrays_zip(digests, place), x -> x.place = 3), x -> x.digests)"))).alias("digest")).distinct()
    sent = needs.join(library, needs.digest == library.key).groupBy("doc_id").agg(F.collect_list(F.struct("digest", "data")).alias("x"))
    empty = "cast(null as int) as pack, cast(null as long) as start_in_pack, cast(null as long) as n_tokens, cast(null as int) as width"
    sent = sent.selectExpr("doc_id", "0 as kind", *empty.split(", "), "x.digest as digests", "cast(null as array<int>) as lens", "cast(null as array<int>) as place", "cast(null as binary) as payload", "x.data as data")
    rows = packs.selectExpr("doc_id", "1 as kind", "pack", "start_in_pack", "n_tokens", "width", "digests", "lens", "place", "payload", "cast(null as array<binary>) as data")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.union(rows).repartition(n, "doc_id").sortWithinPartitions("doc_id", "kind", "pack", "start_in_pack")
    kinds = "doc_id long, pack int, start_in_pack long, n_tokens long, ids_crc32 long"
    got = dealt.mapInArrow(_rebuild, f"{kinds}, ids binary") if ids else dealt.mapInArrow(_digest_only, kinds)
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("pack")] if before else F.lit(0)
    return got.select("doc_id", (F.col("start_in_pack") + offset).cast("long").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def verify(spark: SparkSession, path: str) -> bytes:
    """Recomputes each pack's Merkle root from its recipes, compares it with the manifest's, and returns the root over packs."""
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = [digest(int(d).to_bytes(8, "little", signed=True) + b"".join(ds)) for d, ds in zip(b.column("doc_id").to_pylist(), b.column("digests").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pack", "doc_id", "n_tokens", "start_in_pack")), pa.array(leaf, pa.binary())], ["pack", "doc_id", "n_tokens", "start_in_pack", "leaf"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = spark.read.parquet(f"{path}/packs").select("pack", "doc_id", "n_tokens", "start_in_pack", "digests").mapInArrow(leaves, "pack int, doc_id long, n_tokens long, start_in_pack long, leaf binary")
    got = again.repartition(n, "pack").sortWithinPartitions("pack", "start_in_pack").mapInArrow(_roots, "pack int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary")
    a = sorted((r["pack"], bytes(r["root"])) for r in got.select("pack", "root").collect())
    b = sorted((r["pack"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").select("pack", "root").collect())
    if a != b:
        raise ValueError("the manifest does not fit the packs")
    return merkle_root([r for _, r in b])
