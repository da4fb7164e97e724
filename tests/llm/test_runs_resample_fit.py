"""Periodic runs, importance resampling and exact-fit packing against brute force."""

import bisect
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import exact_fit, queries, resample, runs, tokens

from .helpers import AWKWARD, frame, sentence


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda x: (x[0], x[2]))


texts = st.lists(st.integers(0, 3), max_size=12).flatmap(lambda a: st.tuples(st.just(a), st.integers(0, 8), st.lists(st.integers(0, 3), max_size=8), st.integers(0, 6))).map(lambda x: x[0] * x[1] + x[2] + x[0][:2] * x[3])


@settings(max_examples=400, deadline=None)
@given(texts)
def test_runs_equal_brute_force(w):
    assert runs.runs_of(np.array(w, np.int64)) == brute_runs(w)
    assert runs.runs_of(np.array(w, np.int64), runs.Params(2, 2)) == brute_runs(w, 2, 2)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_edges_equal_brute_force(w):
    nxt, agree = runs.edges([*w, -1])
    for i in range(len(w)):
        j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
        same = next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j) if j < len(w) else 0
        assert (nxt[i], agree[i]) == (j, same)


class Counted(list):
    """A text that counts how often it is read."""

    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return list.__getitem__(self, i)


def test_edges_read_each_word_a_few_times():
    r, fib, before = random.Random(1), [0, 1], [0]
    while len(fib) < 50_000:
        before, fib = fib, fib + before
    part = [r.randrange(2) for _ in range(500)]
    for w in ([0] * 50_000, [0, 1] * 25_000, part * 100, fib, [r.randrange(50) for _ in range(50_000)], list(range(50_000)), list(range(50_000, 0, -1))):
        Counted.reads = 0
        runs.edges(Counted([*w, -1]))
        assert Counted.reads < 12 * len(w)


def test_compact_arrays_give_the_same(monkeypatch):
    w = np.array(([0, 1, 2] * 5 + [3, 1]) * 9 + [4] * 20, np.int64)
    want = runs.runs_of(w)
    monkeypatch.setattr(runs, "COMPACT", 10)
    assert runs.runs_of(w) == want == brute_runs(w.tolist())


def expected13(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13_query_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, sentence(r, r.randint(0, 120))) for i in range(300)] + [(400 + i, " ".join([sentence(r, r.randint(1, 6))] * r.randint(1, 9)) + " É " + "ha " * r.randint(0, 9)) for i in range(60)]
    docs += [x for x in AWKWARD if x[0] != 9008] + [(9009, "a \x0b b\x85 \x1f" * 7), (None, "x y " * 6), (3, docs[3][1]), (3, docs[3][1])]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected13(i, t)) for i, t in docs)
    assert any(x.n_runs for x in got.collect())


def test_runs_of_no_rows_and_of_a_long_text(spark):
    assert runs.digests(runs.detect(frame(spark, []))).collect() == []
    (row,) = runs.detect(frame(spark, [(1, "word " * 300_000 + "end")])).collect()
    assert row.runs == [(0, 300_000, 1)] and (row.n_words, row.collapsed) == (300_001, "word end")


def expected12(docs, bench, p):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    feats = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, p.longest + 1) for i in range(len(w) - k + 1)]
    hashed = lambda t: [zlib.crc32(f.encode()) % p.buckets for f in feats(t)]
    s, t = [0] * p.buckets, [0] * p.buckets
    for _, x in docs:
        for b in hashed(x):
            s[b] += 1
    for x in bench:
        for b in hashed(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + p.buckets) / ((a + 1) * (sum(t) + p.buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        b = hashed(x)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in b)
        out.append([i, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((x for x in out if x[5] >= p.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for n, x in enumerate(able[: len(able) * p.drawn // p.out_of], 1):
        x[4] = n
    return sorted(repr(tuple(x[:5])) for x in out)


@pytest.mark.parametrize("longest,drawn", [(1, 10), (3, 55), (2, 100)])
def test_resample_equals_brute_force(spark, longest, drawn):
    r = random.Random(longest)
    docs = [(i, sentence(r, r.randint(0, 60))) for i in range(150)] + [(9010, "Ünï A-b_c9 " * 30), (None, "alpha beta " * 20), (7, "alpha " * 40), (7, "alpha " * 40)]
    docs += [x for x in AWKWARD if x[0] not in (9002, 9006)]
    bench = [sentence(r, 50), None, "", "alpha BETA 9"]
    p = resample.Params(buckets=97, longest=longest, drawn=drawn, range_rows=20)
    got = resample.resample(frame(spark, docs), spark.createDataFrame([(t, 1) for t in bench], "text string, doc_id int"), p)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(x)) for x in got.collect()) == expected12(docs, bench, p)


def test_resample_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b " * 20), (2, "c")])
    assert resample.resample(none, some).collect() == []
    p = resample.Params(drawn=100)
    assert sorted(repr(tuple(x)) for x in resample.resample(some, none, p).collect()) == expected12([(1, "a b " * 20), (2, "c")], [], p)


def check_plan(counts, capacity):
    stretches, n = exact_fit.plan(counts, capacity)
    held = {}
    for size, count in counts.items():
        own = [x for x in stretches.tolist() if x[0] == size]
        assert not own or own[0][1] == 0
        for k, (_, first, each, sequence, offset) in enumerate(own):
            for i in range(first, own[k + 1][1] if k + 1 < len(own) else count):
                held.setdefault(sequence + (i - first) // each, []).append((offset + (i - first) % each * size, size))
    assert sorted(held) == list(range(n)) and sum(map(len, held.values())) == sum(counts.values())
    for x in held.values():
        assert [a for a, _ in sorted(x)] == np.cumsum([0, *(s for _, s in sorted(x))])[:-1].tolist() and sum(s for _, s in x) <= capacity
    return n


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=c))))
def test_plan_fills_sequences_without_gaps(x):
    capacity, counts = x
    n = check_plan(counts, capacity)
    total = sum(a * b for a, b in counts.items())
    assert -(-total // capacity) <= n and (n < 2 or (n - 1) * capacity < 2 * total)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 25), max_size=12), st.sets(st.integers(1, 25), max_size=6))
def test_sums_count_pairs_and_triples(have, gone):
    sums = exact_fit.Sums(50)
    for n in have:
        sums.add(n, 3)
    for n in have & gone:
        sums.take(n, 3)
    left = sorted(have - gone)
    for g in range(51):
        assert sums.pairs[g] == sum(a + b == g for i, a in enumerate(left) for b in left[i:])
        assert sums.triples[g] == sum(a + b + c == g for i, a in enumerate(left) for j, b in enumerate(left[i:], i) for c in left[j:])
        for f, k in ((sums.one, 1), (sums.two, 2), (sums.three, 3)):
            assert (f(g, []) is not None) == {1: g in left, 2: bool(sums.pairs[g]), 3: bool(sums.triples[g])}[k]
            assert f(g, []) is None or sum(f(g, [])) == g


def test_exact_complements_are_found():
    # best fit alone needs more: it puts 6 with 4 and is left with threes
    assert check_plan({6: 2, 5: 2, 4: 2, 3: 2, 2: 1}, 10) == 4
    assert check_plan({7: 1, 3: 1, 1: 3}, 10) == 2
    assert check_plan({10: 5, 1: 20}, 10) == 7
    assert check_plan({}, 10) == 0 and check_plan({7: 10**3}, 20) == 500


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else capacity) - n)
    return len(gaps)


def test_op11_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    docs = [(i, sentence(r, r.randint(0, 900))) for i in range(120)] + [(200 + i, "same words here") for i in range(60)] + AWKWARD + [(None, None), (3, "x"), (3, "x")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    enc, want, total = tokens.encoder(tokens.public("word_bpe_49k.json")).tokenizer, [], 0
    for i, t in docs:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = queries.op11_exact_fit_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(map(repr, (tuple(x)[:5] for x in rows))) == sorted(map(repr, want))
    held = {}
    for x in rows:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(np.array_equal([a for a, _ in sorted(h)], np.cumsum([0, *(n for _, n in sorted(h))])[:-1]) and sum(n for _, n in h) <= 2048 for h in held.values())
    assert len(held) <= min(best_fit([x.length for x in rows], 2048), -(-total // 2048) + 1)


def test_fit_segments_keep_ids_and_empty_tables(spark):
    p = exact_fit.Params(tokens.public("word_bpe_49k.json"), capacity=8, segment=3)
    docs = frame(spark, [(i % 7, "a b c") for i in range(50)] + [(100, "a b c d e f g h i")])
    rows = exact_fit.pack(docs, p, ids=True).collect()
    assert len({(x.sequence_id, x.offset) for x in rows}) == len(rows) == 52 and len({x.sequence_id for x in rows}) == 27
    assert all(len(x.ids) == x.length and zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 for x in rows)
    assert exact_fit.pack(frame(spark, []), p).collect() == []
