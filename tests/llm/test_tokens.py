import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import token_store as ts
from seqloom.llm import tokens

from .helpers import AWKWARD, frame, sentence

ODD = ["", None, "  a.. b,, c., d.,!", "Hello<|endoftext|>. X", "it's. don't,, I'LL.", "É. é, naïve.́ x", " a b.,", "İstanbul. İ.", "%%%. a1. 1., ...", "a\x1cb \x85c.", "KK. ſ. ß. ẞ.", "ㅎㅏㄴ 한국어. ","각.", "ﬁne. Ǆ."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e = tokens.Encoder(tokens.public(name))
    r = random.Random(2)
    texts = ODD + [sentence(r, r.randrange(60)) for _ in range(200)] + [t for _, t in AWKWARD]
    for _ in range(2):  # the second time from memory
        ids, off = e.encode(pa.array(texts, pa.string()))
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
        assert e.count(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_keeps_case_until_the_library_folds_it(name):
    """Special tokens match the text as it stands; NFC joins a capital and its mark before Lowercase."""
    e = tokens.Encoder(tokens.public(name))
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>. x<|endoftext|>Y<|STARTOFTEXT|>,", "J\u030c", "T\u0308 W\u030a. Y\u030aX,", "A\u0301 \u0130I. I\u0307", "THE The the THE. The,, U.S. I'LL DON'T.", "Stra\u00dfE. \u212aK. \u03a3\u03a3."]
    for t in texts + [" ".join(texts)]:
        ids, _ = e.encode(pa.array([t]))
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and e.count(pa.array([t])).tolist() == [len(want)]


def test_encoder_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    e = tokens.Encoder(tokens.public("word_bpe_49k.json"))
    r = random.Random(3)
    for i in range(30):
        texts = [" ".join(f"w{r.randrange(60)}x" for _ in range(20)) for _ in range(3)]
        ids, off = e.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in e.tokenizer.encode(t, add_special_tokens=False).ids]


def test_store_round_trip(spark):
    r = random.Random(5)
    long = sentence(r, 3000)
    rows = [(i * 7 - 50, sentence(r, r.randrange(80))) for i in range(60)] + [(1000 + i, long if i % 2 else long + f" tail{i}") for i in range(12)] + AWKWARD + [(77, "same same"), (77, "same same"), (77, long), (None, "no id")]
    p = ts.Params(tokens.public("word_bpe_49k.json"))
    path = ts.common.scratch(spark, "store")
    ts.write_store(frame(spark, rows).repartition(6), path, p)
    got = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32, bytes(x.ids)) for x in ts.read_store(spark, path).collect())
    e = tokens.encoder(p.tokenizer)
    want = {}
    for i, t in rows:
        if i is not None:
            want.setdefault(i, []).append(np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    at = 0
    for start, doc, n, crc, ids in got:
        assert start == at and ids in want[doc] and n == len(ids) // 4 and crc == zlib.crc32(ids)
        at += n
    assert [x[1] for x in got] == sorted(i for i, _ in rows if i is not None)
    packs = spark.read.parquet(f"{path}/packs").collect()
    stored = [d for x in packs for d, place in zip(x.digests, x.place) if place < 2]
    assert len(stored) == len(set(map(bytes, stored))), "a chunk is stored once"
    assert len(stored) < sum(len(x.digests) for x in packs) * 0.5
    assert len(ts.verify(spark, path)) == ts.DIGEST


def test_damage_is_noticed(spark):
    p = ts.Params(tokens.public("word_bpe_49k.json"))
    path = ts.common.scratch(spark, "store")
    ts.write_store(frame(spark, [(1, "a b c"), (2, "d e f")]), path, p)
    bad = spark.read.parquet(f"{path}/packs").withColumn("digests", ts.F.transform("digests", lambda d: ts.F.reverse(ts.F.hex(d)).cast("binary")))
    other = ts.common.scratch(spark, "bad")
    bad.write.parquet(f"{other}/packs")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
    with pytest.raises(Exception, match="manifest"):
        ts.verify(spark, other)
    with pytest.raises(Exception, match="manifest"):
        ts.read_store(spark, other)
    # recipes that fit the manifest, but data that fits no recipe
    swapped = spark.read.parquet(f"{path}/packs").withColumn("payload", ts.F.lit(ts.zstandard.ZstdCompressor().compress(b"\0" * 8)))
    third = ts.common.scratch(spark, "swapped")
    swapped.write.parquet(f"{third}/packs")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{third}/manifest")
    with pytest.raises(Exception, match="chunk"):
        ts.read_store(spark, third).collect()


def test_empty_store(spark):
    p, path = ts.Params(tokens.public("word_bpe_49k.json")), ts.common.scratch(spark, "store")
    ts.write_store(frame(spark, []), path, p)
    assert ts.read_store(spark, path).isEmpty()


def test_chunks_move_little_after_an_edit():
    ids = np.random.default_rng(1).integers(0, 49_000, 20_000).astype(np.uint32)
    p = ts.Params("")
    new = np.concatenate([ids[:9000], np.array([5, 6, 7], np.uint32), ids[9000:]])

    def chunks(x):
        ends = ts.cuts(x, np.array([0, len(x)]), p)[0].tolist()
        assert all(b - a <= p.most for a, b in zip([0, *ends], ends)) and ends[-1] == len(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    a, b = chunks(ids), chunks(new)
    assert len(a - b) <= 3 and len(a) > 20


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_rolling_root_equals_tree(n):
    leaves = [bytes([i]) for i in range(n)]
    t = ts.RollingRoot()
    for x in leaves:
        t.add(x)
    assert t.root() == ts.merkle_root(leaves)


def test_strings_are_hashed_in_pieces(monkeypatch):
    """A hash does not depend on how many bytes are handled at a time; 50 MB in one word take little more room than the text."""
    import tracemalloc

    rows = ["", "a", "é" * 40, "x" * 999, "b", "", "long" * 700]
    monkeypatch.setattr(ts.words, "PIECE", 64)
    monkeypatch.setattr(ts.words, "AT_ONCE", 200)
    whole = []
    for s in rows:
        h, m = 0, (1 << 64) - 1
        for k, c in enumerate(s.encode()):
            h = (h + int(ts.words._BYTE[c]) * pow(ts.words._STEP, k, 1 << 64)) & m
        whole.append(h + len(s.encode()) * 0x632BE59BD9B4E019 & m)
    want = ts.words.mix(np.array(whole, np.uint64))
    assert (ts.words.hash_strings(ts.pa.array(rows)) == want).all()
    monkeypatch.undo()
    assert (ts.words.hash_strings(ts.pa.array(rows)) == want).all()
    big = ts.pa.array(["q" * 50_000_000, "w"])
    tracemalloc.start()
    out = ts.words.hash_strings(big)
    assert tracemalloc.get_traced_memory()[1] < 150_000_000 and out[0] != out[1]
    tracemalloc.stop()
