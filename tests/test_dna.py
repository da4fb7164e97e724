"""Scalar rules on small cases and random strings."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import kmers, mask
from seqloom.sources import files


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@given(st.text("ACGT", max_size=40))
def test_reverse_complement_is_its_own_inverse(s):
    assert rc(rc(s)) == s and min(s, rc(s)) == min(rc(s), rc(rc(s)))


def cut_by_steps(s, gap=3, limit=4, keep=35):
    """The state machine that the pattern stands for."""
    chain, last = 0, None
    for i, c in enumerate(s):
        if c in "Nn":
            chain = chain + 1 if last is not None and i - last - 1 <= gap else 1
            last = i
            if chain == limit:
                return s[:i] if i > keep else None
    return s


def test_n_cut_equals_state_machine(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ACGTNNn") for _ in range(r.randint(0, 60)))) for i in range(3000)]
    rows += [(9000, "A" * 32 + "NNNN"), (9001, "A" * 33 + "NNNN"), (9002, "NAAANAAANAAAN"), (9003, "NAAAANAAAANAAAAN"), (9004, "nnn")]
    got = {x.read_id: x.masked for x in mask.cut(spark.createDataFrame(rows, "read_id long, seq string")).collect()}
    assert got == {i: cut_by_steps(s) for i, s in rows}


def test_masked_reads_have_no_n_and_repeat(spark):
    rows = [(i, "ACNGTnA" * 3) for i in range(50)]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    a, b = (sorted(map(tuple, mask.mask(df.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    for (_, s), (_, m) in zip(rows, a):
        assert len(s) == len(m) and "N" not in m.upper() and all(x in "Nn" or x == y for x, y in zip(s, m))


def test_low_complexity_edges(spark):
    df = spark.createDataFrame([("A" * 7 + "C" * 3,), ("A" * 8 + "C" * 2,), ("T" * 8 + "CG",), ("ACGTN",)], "seq string")
    assert [r[0] for r in df.select(dna.discard_read(F.col("seq"))).collect()] == [False, True, True, True]
    k = spark.createDataFrame([("A" * 15 + "CG",), ("A" * 16 + "C",)], "seq string")
    assert [r[0] for r in k.select(dna.low_complexity(F.col("seq"), 0.9)).collect()] == [False, True]


def test_encode_decode(spark):
    rows = [("ACGT",), ("TTTT",), ("aCgT",), ("ACNT",), ("AAAA",)]
    got = spark.createDataFrame(rows, "k string").select(dna.encode(F.col("k")), dna.decode(dna.encode(F.col("k")), 4)).collect()
    assert [tuple(r) for r in got] == [(27, "ACGT"), (255, "TTTT"), (27, "ACGT"), (None, None), (0, "AAAA")]


def test_log_sum_exp(spark):
    low = float("-inf")
    rows = [(-1.0, -2.0), (low, -3.0), (-3.0, low), (low, low), (-800.0, -800.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(dna.log_sum_exp(F.col("a"), F.col("b"))).collect()]
    assert got[1:4] == [-3.0, -3.0, low]
    assert got[0] == pytest.approx(math.log(math.exp(-1) + math.exp(-2))) and got[4] == pytest.approx(-800 + math.log(2))


def test_column_profile_ties_and_values(spark):
    rows = [(1, 1, 0, 0), (0, 0, 0, 0), (4, 0, 0, 0), (3, 1, 0, 0), (0, 2, 2, 0)]
    made = dna.column_profile(*(F.col(c) for c in "acgt"))
    got = spark.createDataFrame(rows, "a int, c int, g int, t int").select(made["letter"].alias("l"), made["entropy"].alias("h")).collect()
    assert [r.l for r in got] == ["A", "A", "A", "A", "C"]
    for row, r in zip(rows, got):
        p = [(x + 0.01) / (sum(row) + 0.04) for x in row]
        assert r.h == pytest.approx(-sum(x * math.log(x) for x in p))


def test_windows_and_postings_against_python(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ACGTN" if i % 9 == 0 else "ACGT") for _ in range(r.randint(0, 30)))) for i in range(60)] + [(99, "ACGT" * 5)]
    df = spark.createDataFrame(rows, "read_id long, seq string")
    k = 4
    want, first = [], {}
    for i, s in rows:
        for e in range(k - 1, len(s)):
            km = s[e - k + 1 : e + 1]
            if "N" not in km:
                c = min(km, rc(km))
                want.append((i, e, c, km <= rc(km)))
                first.setdefault((c, i), e + 1 if km <= rc(km) else -e - 1)
    assert sorted(map(tuple, kmers.as_text(kmers.windows(df, k), k).select("read_id", "end", "kmer", "forward").collect())) == sorted(want)
    assert {(x.kmer, x.read_id): x.spos for x in kmers.as_text(kmers.postings(df, k), k).collect()} == first


@pytest.mark.parametrize("k", [1, 17, 30, 31])
def test_windows_of_long_sequences_and_odd_rows(spark, k):
    """Chunks of 31 bases overlap so that no window is lost; null and short sequences, other letters and repeated rows."""
    r = random.Random(k)
    rows = [(i, "".join(r.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, k - 1, k, 31, 32, 62, 63, 200))] + [(50, None), (51, "ACGTacgtRYK" * 9), (52, "A" * 40), (52, "A" * 40), (53, "ACG" * 15 + "N" + "TTG" * 15)]
    want = []
    for i, s in rows:
        for e in range(k - 1, len(s or "")):
            km = s[e - k + 1 : e + 1]
            if set(km) <= set("ACGT"):
                want.append((i, e, min(km, rc(km)), km <= rc(km)))
    df = spark.createDataFrame([(*x, "x") for x in rows], "read_id long, seq string, kmer string")
    assert sorted(map(tuple, kmers.as_text(kmers.windows(df, k), k).select("read_id", "end", "kmer", "forward").collect())) == sorted(want)
    assert kmers.windows(df.where("false"), k).isEmpty()


def test_low_complexity_by_bits(spark):
    texts = ["A" * 15 + "CG", "A" * 16 + "C", "T" * 16 + "C", "T" * 15 + "GC", "ACGTACGTACGTACGTA"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(dna.low_complexity(F.col("t"), 0.9).alias("a"), kmers.low_complexity(dna.encode(F.col("t")), 17, 0.9).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got] == [False, True, True, False, False]
    back = kmers.as_codes(spark.createDataFrame([("ACGTACGTACGTACGTA", 3), ("TACGTACGTACGTACGT", 4), ("AXG", 9)], "kmer string, n long"))
    assert [(x.kmer, x.n) for x in kmers.as_text(back, 17).collect()] == [("ACGTACGTACGTACGTA", 7)]


def test_admitted_seeds_share_no_kmer(spark):
    r = random.Random(5)
    base = "".join(r.choice("ACGT") for _ in range(300))
    rows = [(i, base[p : p + 40]) for i, p in enumerate(r.randint(0, 260) for _ in range(80))]
    posts = kmers.postings(spark.createDataFrame(rows, "read_id long, seq string"), 17)
    seeds = {x.read_id for x in kmers.admit(posts).collect()}
    owners = {}
    for x in posts.collect():
        owners.setdefault(x.kmer, set()).add(x.read_id)
    assert seeds and all(len(s & seeds) <= 1 for s in owners.values())
    assert all((i in seeds) == all(i == min(s) for s in owners.values() if i in s) for i, _ in rows)


def test_pattern_is_plain():
    assert re.compile(dna.N_CHAIN)


@pytest.mark.parametrize("k", [1, 3, 16, 17, 31])
def test_codes_of_arrays_are_the_windows(spark, k):
    """Also of a slice, with other letters, null and short texts; and the spectrum counts repeated rows each."""
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTACGTACGTNac") for _ in range(rng.randrange(120))) for _ in range(60)] + ["", "A" * 40, "ACGT\nACGT" * 5, None]
    df = spark.createDataFrame(list(enumerate(texts + texts[:9])), "read_id long, seq string")
    rows = df.select("read_id", kmers._plain(F.col("seq")).alias("seq")).orderBy("read_id").toArrow().to_batches()
    got = []
    for b in rows:
        n, end, kmer, forward = kmers.codes(b.column("seq")[1:], k)
        got += zip(b.column("read_id")[1:].take(pa.array(n)).to_pylist(), end.tolist(), kmer.tolist(), forward.tolist())
    want = kmers.windows(df.where("read_id > 0"), k).select("read_id", "end", "kmer", "forward")
    assert sorted(got) == sorted(map(tuple, want.collect()))
    counts = kmers.windows(df, k).groupBy("kmer").count()
    assert sorted(map(tuple, kmers.spectrum(df, k).collect())) == sorted(map(tuple, counts.collect()))
    text = kmers.as_text(counts.select("kmer"), k).select("kmer", dna.encode(F.col("kmer")).alias("code"))
    assert {(t, sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(t)))) for t, _ in text.collect()} == set(map(tuple, text.collect()))


def test_masks_equal_a_read_by_read_rule(spark):
    """Lower case, several bytes a character, empty, null and rejected reads in one batch, negative and null ids; only batches of bytes go through Python."""
    r = random.Random(4)
    rows = [(i - 40 if i % 9 else None, i // 3, None if i % 17 == 0 else "".join(r.choice(letters) for _ in range(r.choice([0, 1, 4, 36, 37, 40, 75])))) for i in range(400) for letters in (["ACGTNACGTACGTACGTACG", "nNé", "AcgTÀ日n"][i % 3],)]

    def rule(rid, seq, fill):
        if seq is None:
            return None, None
        n = [i for i, c in enumerate(seq) if c in "nN"]
        cut = next((n[j + 3] for j in range(len(n) - 3) if all(n[k + 1] - n[k] <= 4 for k in range(j, j + 3))), -1)
        if 0 <= cut <= 35:
            return cut, None
        kept = seq[:cut] if cut > 0 else seq
        if not fill:
            return cut, kept
        base = lambda i: "" if rid is None else "ACGT"[(rid * 31 + i * 7 + int(rid / 13)) % 4]
        return cut, "".join(base(i) if c in "nN" else c for i, c in enumerate(kept))

    df = spark.createDataFrame(rows, "read_id long, pair long, seq string").coalesce(1)
    out = mask.cut(df)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(((x.read_id, x.seq, x.cut_at, x.masked) for x in out.collect()), key=key) == sorted(((i, s, *rule(i, s, False)) for i, _, s in rows), key=key)
    done = [(i, p, rule(i, s, True)[1]) for i, p, s in rows]
    assert sorted(map(tuple, mask.mask(df).collect()), key=key) == sorted(((i, s) for i, _, s in done if s is not None), key=key)
    bad = {p for _, p, s in done if s is None}
    assert sorted(map(tuple, mask.mask_pairs(df).collect()), key=key) == sorted((x for x in done if x[1] not in bad), key=key) and bad


def test_encoded_equals_encode(spark, tmp_path):
    """Numbers from whole batches of texts, of any case and length; the count file is read as lines, without a parser and a number for each k-mer."""
    r = random.Random(8)
    rows = [(None,), ("",), ("ACGN",), ("acgT",), ("é",), ("A" * 31,), ("T" * 31,), ("A" * 40,)] + [("".join(r.choice("ACGT") for _ in range(r.randint(1, 31))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "kmer string").coalesce(1).select("kmer", kmers.encoded(F.col("kmer")).alias("code"))
    want = {s: int(s.upper().translate(str.maketrans("ACGT", "0123")), 4) if s and len(s) < 32 and set(s.upper()) <= set("ACGT") else None for (s,) in rows}
    assert dict(map(tuple, df.collect())) == want
    (tmp_path / "c").write_text("ACGT 3\nacgt 4 x\nANC 5\n\nCC\nGG y\n AC 2\nTT  6\n")
    got = files.read_kmer_counts(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect()), key=str) == [("ACGT", 3), ("CC", None), ("GG", None), ("TT", None), ("acgt", 4)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "conv(" not in plan


def test_spectrum_adds_up_over_tasks_and_batches(spark):
    """A k-mer that many tasks hold, whose rows fall into several batches of the task that adds them up; what is shuffled is shares, not k-mers."""
    r = random.Random(2)
    seqs = ["".join(r.choice("ACGT") for _ in range(40)) for _ in range(60)] * 2 + ["ACGTTTACGA" * 3, None, "", "ACN"]
    want = {}
    for s in seqs:
        for i in range(len(s or "") - 8):
            if "N" not in s[i : i + 9]:
                w = min(s[i : i + 9], rc(s[i : i + 9]))
                want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(8)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for size in ("3", "10000"):
            spark.conf.set(key, size)
            for least in (1, 2):
                out = kmers.as_text(kmers.spectrum(df, 9, least), 9)
                assert sorted(map(tuple, out.collect())) == sorted((w, n) for w, n in want.items() if n >= least)
    finally:
        spark.conf.set(key, old)
    plan = kmers.spectrum(df, 9)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "hashpartitioning(share" in plan and "hashpartitioning(kmer" not in plan
    assert kmers.spectrum(df.where("false"), 9).isEmpty()


def test_document_frequency_deals_shares_and_keeps_reads_of_several_rows_whole(spark):
    """A read of several rows counts once for a k-mer wherever its rows lie, and so do all rows without an id; where ids are unique nothing is dealt by k-mer and read."""
    r = random.Random(6)
    base = "".join(r.choice("ACGT") for _ in range(200))
    rows = [(i if i % 7 else None, base[p : p + 30]) for i, p in enumerate(r.randint(0, 170) for _ in range(90))] + [(3, base[:60]), (3, base[20:80]), (4, "ACN"), (4, None), (500, "ACG" * 12)]
    want = {}
    for i, s in rows:
        for e in range(len(s or "") - 8):
            if "N" not in s[e : e + 9]:
                want.setdefault(min(s[e : e + 9], rc(s[e : e + 9])), set()).add(i)
    df = spark.createDataFrame(rows, "read_id long, seq string").repartition(6)
    assert {x.kmer: x.n_reads for x in kmers.as_text(kmers.document_frequency(df, 9), 9).collect()} == {w: len(i) for w, i in want.items()}
    once = spark.createDataFrame(list(enumerate(s for _, s in rows)), "read_id long, seq string").repartition(6)
    out = kmers.document_frequency(once, 9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(share" in plan and "hashpartitioning(kmer" not in plan and "HashAggregate" not in plan
    assert dict(map(tuple, out.collect())) == dict(map(tuple, kmers.windows(once, 9).select("kmer", "read_id").distinct().groupBy("kmer").count().collect()))
    assert kmers.document_frequency(df.where("false"), 9).isEmpty()


@pytest.mark.parametrize("k", [1, 4, 17, 31])
def test_decoded_equals_decode(spark, k):
    """Texts from whole batches of numbers, null too; the spectrum's texts are no longer an expression that grows with k."""
    r = random.Random(k)
    df = spark.createDataFrame([(None,), (0,), ((1 << 2 * k) - 1,)] + [(r.getrandbits(2 * k),) for _ in range(300)], "kmer long").coalesce(1)
    got = df.select("kmer", dna.decode(F.col("kmer"), k).alias("a"), kmers.decoded(F.col("kmer"), k).alias("b")).collect()
    assert len(got) == 303 and all(x.a == x.b and (x.kmer is None or len(x.b) == k) for x in got)
    assert "ArrowEvalPython" in kmers.as_text(df, k)._jdf.queryExecution().executedPlan().toString()


def test_shares_of_kmers_travel_as_gaps():
    """Less than three bytes for a k-mer and its count, where they took twelve."""
    rng = np.random.default_rng(3)
    for k in (1, 2, 9, 17, 31):
        x = np.unique(rng.integers(0, 1 << 2 * k, 20_000))
        m = kmers._mixed(x, 2 * k)
        assert m.min() >= 0 and m.max() < 1 << 2 * k and len(np.unique(m)) == len(x) and (kmers._mixed(m, 2 * k, True) == x).all()
    x = np.sort(kmers._mixed(np.unique(rng.integers(0, 1 << 34, 3_000_000)), 34))
    n = np.where(rng.random(len(x)) < 0.01, rng.integers(1, 100_000, len(x)), rng.integers(1, 16, len(x)))
    n[rng.integers(0, len(x), 50)] = 16
    low = 34 - kmers.SHARE
    rows = list(kmers._shares(x, n, low))
    got = [kmers._of_shares(b, low) for b in rows]
    assert len(rows) > 1 and (np.concatenate([g[2] for g in got]) == x).all() and (np.concatenate([g[3] for g in got]) == n).all()
    share = np.concatenate([g[0] for g in got])
    assert len(np.unique(share)) == len(share) and all((g[2] >> low == np.repeat(g[0], np.diff(g[1]))).all() for g in got)
    assert sum(sum(b.nbytes for b in g.columns[1:]) for g in rows) < 3 * len(x)
    part = rows[1].slice(5, 7)  # a batch that begins within another's buffers
    assert (kmers._of_shares(part, low)[2] == got[1][2][got[1][1][5] : got[1][1][12]]).all() and (kmers._of_shares(part, low)[3] == got[1][3][got[1][1][5] : got[1][1][12]]).all()
    for bits, top in ((34, 1 << 20), (62, 1 << 20), (62, 2)):
        km, c = rng.integers(0, 1 << bits, 4000) >> bits - 9, rng.integers(1, top, 4000)
        want = dict.fromkeys(km.tolist(), 0)
        for i, j in zip(km.tolist(), c.tolist()):
            want[i] += j
        assert dict(zip(*(y.tolist() for y in kmers._summed(km, c, bits)))) == want
    assert len(kmers._packed(np.zeros(50, np.int64), np.array([0]))[0]) == 50
    many = np.array([0, 127, 128, 1 << 34, (1 << 62) + 5])
    assert (kmers._unpacked(kmers._packed(many, np.array([0, 2]))[0]) == many).all()


def test_pairs_are_sorted_in_one_word_or_two():
    rng = np.random.default_rng(4)
    for k in (3, 17, 31):
        kmer, number = rng.integers(0, 1 << 2 * k, 5000) // 3 * 3, rng.integers(0, 700, 5000)
        order = np.lexsort((number, kmer))
        a, b = kmers._sorted_pairs(kmer.copy(), number, k, 700)
        assert (a == kmer[order]).all() and (b == number[order]).all()


def test_tiles_are_the_rule_read_by_read(spark, tmp_path):
    """Documents with odd ids and texts, and one of many reads, against the rule written out; whole documents are cut as bytes, without an expression for each read."""
    from seqloom import fixtures as fx

    r = random.Random(9)
    rows = [(i, None if i == 8 else "".join(r.choice("abcdefghijklmnopqrstuvwxyzABXYZ  .é日\n") for _ in range(r.choice([0, 74, 90, 100, 140, 700])))) for i in [*range(-9, 20), None, 10**10]] + [(5, "Quilt zebra " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turn = str.maketrans("ACGT", "TGCA")
    want, raw = [], []
    for i, text in rows:
        letters = "".join(c for c in (text or "") if c.isascii() and c.isalpha()).lower()
        places = list(range(0, len(letters) - 74, 15)) if len(letters) >= 75 else []
        if places and places[-1] != len(letters) - 75:
            places.append(len(letters) - 75)
        for p in places:
            rid = None if i is None else i * fx.ID_STEP + p
            raw.append((rid, i, p, letters[p : p + 75].translate(str.maketrans(fx.LETTERS, fx.RAW_BASES))))
            f = s = letters[p : p + 75].translate(str.maketrans(fx.LETTERS, fx.READ_BASES))
            h = None if i is None else i * 31 + p
            if h is not None and h % 4 == 0 and h >= 0:
                s = f[: h % 75] + f[h % 75].translate(str.maketrans("ACGT", "CGTA")) + f[h % 75 + 1 :]
            if h is not None and h > 0 and h % 2:
                f, s = f.translate(turn)[::-1], s.translate(turn)[::-1]
            want.append((rid, i, p, s if h is None or h >= 0 or h % 4 else None, f))
    key = lambda x: tuple((y is not None, y) for y in x)
    out = fx.reads(spark, str(tmp_path))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = [(*x[:3], None if x.doc_id is not None and x.doc_id * 31 + x.pos < 0 and (x.doc_id * 31 + x.pos) % 4 == 0 else x.seq, x.clean) for x in out.collect()]  # those follow substring() of places before the text
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 20_000
    assert sorted(map(tuple, fx.raw_reads(spark, str(tmp_path)).collect()), key=key) == sorted(raw, key=key)
    assert fx.reads(spark, str(tmp_path), clean=False).columns == ["read_id", "doc_id", "pos", "seq"]


def test_marks_are_put_together_by_tasks_side_by_side(spark, monkeypatch):
    """All keys are in the bitmap, from several lots and segments; what the driver goes through is written before."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(kmers, "SEGMENT", 10)
    plans = []
    rows = DataFrame.toLocalIterator
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda self, *a: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or (x for x in self.collect()) if rows else None)
    keys = spark.range(0, 30_000, 3, 5)
    log, bits = kmers.marks(keys, "id", 10_000).value
    assert kmers.met((log, bits), np.arange(0, 30_000, 3)).all() and kmers.met((log, bits), np.arange(1, 30_000, 3)).mean() < 0.1
    assert plans and "MapInArrow" not in plans[0]
