"""Decontamination, packing, URL filters and top-k search against brute force."""

import itertools
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontam, packing, tokens, topk, url_filter

from .helpers import AWKWARD, WORDS, frame


def shingles(t):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("part", [16_000_000, 300])
def test_containment_equals_brute_force(spark, part):
    """A small part size makes several indexes."""
    r = random.Random(1)
    make = lambda n: [r.choice(WORDS) + str(r.randrange(30)) for _ in range(n)]
    items = [(i, make(r.choice([3, 5, 9, 20, 60, 200]))) for i in range(25)]
    docs = []
    for i in range(120):
        w = make(r.choice([10, 100, 900]))
        for _ in range(r.choice([0, 1, 1, 2])):
            _, q = r.choice(items)
            q = list(q)
            if r.random() < 0.5 and len(q) > 9:
                q[r.randrange(len(q))] = "changed"
            if r.random() < 0.2 and len(q) > 15:  # in two pieces, far apart
                w[0:0], q = q[: len(q) // 2 + 4], q[len(q) // 2 :]
            k = r.randrange(len(w))
            w[k:k] = q
        docs.append((i, " ".join(w)))
    docs += AWKWARD + [(500, " ".join(items[0][1])), (500, " ".join(items[0][1]))]
    bench = [(i, " ".join(q)) for i, q in items] + [(90, None), (91, ""), (None, "a b c d e"), (0, " ".join(items[0][1])), (92, "One TWO three")]
    p = replace(decontam.Params(), part_bytes=part)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.contaminated(frame(spark, docs), b, p)
    want = set()
    for (d, t), (i, q) in itertools.product(docs, bench):
        a, s = shingles(q), shingles(t)
        if i is not None and a and 100 * len(a & s) >= 80 * len(a):
            want.add((d, i, len(a), len(a & s)))
    assert {(x.doc_id, x.item_id, x.n_item_shingles, x.n_shared) for x in got.collect()} == want and len(want) > 20
    kept = decontam.stage(frame(spark, docs), b, p)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(spark, AWKWARD), none).isEmpty()
    assert decontam.stage(frame(spark, AWKWARD), none).count() == len(AWKWARD)
    assert decontam.contaminated(frame(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).isEmpty()


def cheapest(hist, k):
    g = [n for n, _ in hist]
    best = None
    for m in range(1, min(k, len(g)) + 1):
        for c in itertools.combinations(g[:-1], m - 1):
            b = [*c, g[-1]]
            cost = sum(n_ * (next(x for x in b if x >= n) - n) for n, n_ in hist)
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_optimal(seed):
    r = random.Random(seed)
    hist = sorted((n, r.randrange(1, 50)) for n in r.sample(range(1, 200), 9))
    for k in (1, 2, 3, 4, 9, 12):
        b = packing.optimal_bounds(hist, k)
        assert len(b) <= k and b == sorted(set(b)) and b[-1] == hist[-1][0]
        assert sum(c * (next(x for x in b if x >= n) - n) for n, c in hist) == cheapest(hist, k)
    assert packing.optimal_bounds([], 4) == []


def test_packing_rows_batches_and_segments(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["alpha"] * r.choice([1, 2, 3, 8, 40, 300]))) for i in range(300)] + AWKWARD + [(5, "alpha"), (None, "alpha beta"), (None, None)]
    p = packing.Params(tokens.public("word_bpe_49k.json"), buckets=4, budget=500, segment=17)
    got = packing.pack(frame(spark, rows), p).collect()
    enc = tokens.encoder(p.tokenizer).tokenizer
    assert sorted((x.doc_id or -1, x.n_tokens) for x in got) == sorted((i or -1, len(enc.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    hist = {}
    for x in got:
        hist[x.n_tokens] = hist.get(x.n_tokens, 0) + 1
    small = {n: c for n, c in hist.items() if n <= 8192}
    assert sum(small.values()) == len(got) - 1  # one row is longer
    batches = {}
    for x in got:
        assert x.n_tokens <= x.padded_len
        batches.setdefault(x.batch_id, []).append(x)
    for b in batches.values():
        assert len({(x.bucket, x.padded_len) for x in b}) == 1 and sorted(x.slot for x in b) == list(range(len(b)))
        assert len(b) * b[0].padded_len <= p.budget or len(b) == 1
    for bucket in {x.bucket for x in got}:
        sizes = [len(b) for i, b in sorted(batches.items()) if b[0].bucket == bucket]
        assert all(s == max(1, p.budget // next(b[0].padded_len for b in batches.values() if b[0].bucket == bucket)) for s in sizes[:-1])
    assert packing.pack(frame(spark, []), p).isEmpty()


def test_long_texts_are_packed_optimally(spark):
    sizes = [9000] * 3 + [9001, 9005, 9014, 9015, 16_390, 16_401, 20_000, 20_000, 5, 7]
    p = packing.Params(tokens.public("word_bpe_49k.json"), buckets=5)
    got = packing.pack(frame(spark, [(i, "alpha " * n) for i, n in enumerate(sizes)]), p).collect()
    hist = sorted((n + 1, sizes.count(n)) for n in set(sizes))
    assert sorted(x.n_tokens for x in got) == sorted(n + 1 for n in sizes)
    assert sum(x.padded_len - x.n_tokens for x in got) == cheapest(hist, p.buckets)
    assert all(max(x.n_tokens for x in got if x.bucket == y.bucket) == y.padded_len for y in got)


def test_packing_of_hot_and_null_ids(spark):
    """Most rows are one id or none, of one length: each row has a place of its own, and batches are full but for a bucket's last."""
    rows = [(7, "a b c")] * 400 + [(None, "a b c")] * 300 + [(i, "x " * (i % 9)) for i in range(100, 160)]
    p = packing.Params(tokens.public("word_bpe_49k.json"), buckets=3, budget=64, segment=50)
    got = packing.pack(frame(spark, rows).repartition(5), p).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted((i is None, i or 0) for i, _ in rows)
    assert len({(x.batch_id, x.slot) for x in got}) == len(rows)
    by = {}
    for x in got:
        by.setdefault((x.bucket, x.padded_len), {}).setdefault(x.batch_id, []).append(x.slot)
    for (_, bound), batches in by.items():
        each = max(1, p.budget // bound)
        assert [len(batches[b]) for b in sorted(batches)][:-1] == [each] * (len(batches) - 1)
        assert all(sorted(v) == list(range(len(v))) for v in batches.values())


def urls(seed, n=400):
    r = random.Random(seed)
    out = [None, "", "no scheme/x", "http://", "http://org", "https://a.b.org?x", "HTTP://Www.Example.ORG/es/1#y", "x://example.org/en/1", "x://notexample.org/en/1", "a://b.com/fr/://c.org/", "q://com/de/\nz", "t://sub.spam-farm.example.com:80/x", "t://sub.spam-farm.example.com/x"]
    for _ in range(n):
        out.append(f"https://{r.choice(['', 'www.', 'm.'])}{r.choice(['a', 'b', 'c', *url_filter.LISTED_NAMES])}{r.choice(['', 'x'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randrange(30)}")
    return list(enumerate(out))


@pytest.mark.parametrize("bits", [10, 1])
@pytest.mark.parametrize("limit", [1 << 22, 0])
def test_url_verdicts_equal_brute_force(spark, bits, limit):
    """One bit a key makes many false positives and so several levels; with limit 0 the filters stay tables."""
    rows = urls(1)
    listed = url_filter.default_list()
    p = url_filter.Params(bits_per_key=bits, constant_bytes=limit)
    pages = spark.createDataFrame([(i, u, "c") for i, u in rows + rows[:5]], "page_id long, url string, rule string")
    got = url_filter.judge(pages, spark.createDataFrame([(x,) for x in [*listed, None, listed[0]]], "d string"), url_filter.RULES, p=p)
    assert got.columns == ["page_id", "url", "rule", "host", "path", "rule_", "listed", "verdict"]
    for x in got.collect():
        rest = (x.url or "").partition("://")[2] if "://" in (x.url or "") else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in __import__("re").split("[/?#]", rest)[0])
        path = __import__("re").split("[?#]", rest[len(host) :])[0]
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text)) if fits else None
        bad = any(host == d or host.endswith("." + d) for d in listed)
        assert (x.host, x.path, x.rule_, x.listed, x.verdict) == (host, path, rule and rule.text, bad, rule.action if rule else "block" if bad else "allow")
    assert got.count() == len(rows) + 5


def test_cascade_alternates_until_exact(spark):
    u = spark.createDataFrame([(f"k{i}", i % 3 == 0) for i in range(600)], "key string, listed boolean")
    p = url_filter.Params(bits_per_key=2, hashes=2)
    levels = url_filter.cascade(u, p)
    assert len(levels) > 2
    wrong = u.where(url_filter.member(url_filter.F.col("key"), levels, p.hashes) != url_filter.F.col("listed"))
    assert wrong.isEmpty() and url_filter.cascade(u.where("not listed"), p) == []


@pytest.mark.parametrize("room", [16_000_000, 40, 0])
def test_many_unlisted_domains_and_small_segments(spark, room):
    """Level 0 holds 18 keys; later levels have more keys, in many segments. With 40 bytes the first levels are constants and the others tables."""
    listed = url_filter.default_list()
    hosts = listed + [f"h{i}.net" for i in range(6000)]
    p = url_filter.Params(bits_per_key=3, hashes=2, segment_bits=256, constant_bytes=room)
    pages = spark.createDataFrame([(i, f"http://{h}/", "x") for i, h in enumerate(hosts)], "page_id long, url string, __host string")
    got = url_filter.judge(pages, spark.createDataFrame([(x,) for x in listed], "d string"), [], p=p)
    assert got.columns == ["page_id", "url", "__host", "host", "path", "rule", "listed", "verdict"]
    got = got.collect()
    assert len(got) == len(hosts) and {x.host for x in got if x.listed} == set(listed) == {x.host for x in got if x.verdict == "block"}


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "d string")
    assert url_filter.judge(pages, none, url_filter.RULES).isEmpty()
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(one, none, []).collect()[0].verdict == "allow"


def brute_top(rows, k, scale=64):
    import math

    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = {}
    for i, e in v:
        first[i] = min(first.get(i, e), e) if i in first else e
    out = []
    for q in sorted(first):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(first[q], e)), i) for i, e in v if i != q)[:k]
            out += [(q, n + 1, i, min(max(-t, -(1 << 63)), (1 << 63) - 1)) for n, (t, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("seed,shape", [(1, {}), (2, {"block": 4, "shard": 16, "chunk": 2, "sample": 30, "step": 2}), (3, {"sample": 5, "block": 3, "shard": 9})])
def test_top_k_equals_brute_force(spark, seed, shape):
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.2, 0.1, 0.3, r.gauss(0, 0.2)]) for _ in range(8)]) for i in range(130)]
    hot = [0.1] * 8
    rows += [(200 + i, hot) for i in range(60)] + [(900, None), (901, [0.1, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (920, []), (921, [1.0]), (None, hot), (922, [1e30] * 8), (940, [-1e30] * 8), (923, [1e9] * 8), (960, [1e9, -1e9, 0.5, 3.0]), (924, [2.0**31, 0.25])]
    df = spark.createDataFrame([(i, e, "z") for i, e in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = topk.top_k(df, "vec_id % 20 = 0", p=replace(topk.Params(), **shape))
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute_top(rows, 20)


def test_top_k_few_rows_large_values_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    assert topk.top_k(spark.createDataFrame([], kind), "vec_id % 20 = 0").isEmpty()
    rows = [(0, [3e6, -2e6]), (20, [3e6, 2e7]), (5, [-1e7, 1e7])]
    got = topk.top_k(spark.createDataFrame(rows, kind), "vec_id % 20 = 0")
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute_top(rows, 20)
    rows = [(0, [1e9, 0.5]), (20, [1e300, -1e300]), (5, [1e300, 1e300]), (40, [3.0, 2.0]), (6, [1e308, 1e9]), (7, [1e18, 1.0]), (9, [1e18, 1.5]), (8, [-1e308, 5.0])]
    got = topk.top_k(spark.createDataFrame(rows, kind), "vec_id % 20 = 0")
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute_top([(i, [min(max(x, -2.8e306), 2.8e306) for x in e]) for i, e in rows], 20)
    rows = [(0, [0.1, 0.2]), (0, [0.1, 0.2]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, kind), "vec_id % 20 = 0")
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute_top(rows, 20)


def test_top_k_cuts_blocks_where_bounds_are_tight(spark):
    """Two far clusters: a query's blocks of the other cluster, and the shards that hold nothing else, are never scored."""
    r = random.Random(3)
    rows = [(i, [(1.0 if i % 2 else -1.0) + r.gauss(0, 0.02) for _ in range(6)]) for i in range(400)]
    p = replace(topk.Params(), block=8, shard=64)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", p=p)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()) == brute_top(rows, 20)
    import numpy as np

    x = np.floor(64 * np.array([e for _, e in rows]))
    order = np.argsort(x[:, 0], kind="stable")
    blocks = [(np.array([rows[i][0] for i in part], "<i8").tobytes(), x[part].astype("<f8").tobytes(), x[part].min(0).tobytes(), x[part].max(0).tobytes()) for part in np.split(order, 50)]
    shard = topk.Shard(blocks, 6, 20)
    shard.search(np.array([1]), x[1:2], np.array([-np.inf]), 4)
    assert 4 <= shard.scored <= 28


def test_hosts_of_many_labels(spark):
    """Only parent domains that can be listed are looked at: a host of 100,000 labels is as quick as its length."""
    host = "a." * 100_000 + "spam-farm.example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/"), (2, f"http://{'b.' * 100_000}net/"), (3, "http://a..b/"), (4, "http://.b/"), (5, "http://x.a..b/")], "page_id long, url string")
    start = time.time()
    got = {x.page_id: (x.listed, x.verdict, x.host) for x in url_filter.judge(pages, spark.createDataFrame([("spam-farm.example.com",), ("a..b",)], "d string"), url_filter.RULES).collect()}
    assert got[1] == (True, "block", host) and not got[2][0] and [got[i][0] for i in (3, 4, 5)] == [True, False, True] and time.time() - start < 60


def test_many_equal_rows_are_dealt_out(spark):
    """A third of a million rows of one null id and length: no task makes more than a stretch of them out of one row."""
    p = packing.Params(tokens.public("word_bpe_49k.json"), buckets=3, budget=64, stretch=500)
    docs = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).union(spark.createDataFrame([(i, "a b c") for i in range(10)], "doc_id long, text string"))
    got = packing.pack(docs, p)
    assert got.select("batch_id", "slot").distinct().count() == got.count() == 300_010
    spread = [x["count"] for x in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(spread) > 1 and max(spread) < 0.6 * 300_010
