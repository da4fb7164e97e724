"""Relational steps on hand-made cases, the files, and the rounds on planted errors."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import claims, gather, mask, pileup
from seqloom.params import Params
from seqloom.plans.correct import Correction
from seqloom.sources import fastx, files, sinks


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def planted(seed, n=60, size=400, read=60, errors=0.25):
    r = random.Random(seed)
    genome = "".join(r.choice("ACGT") for _ in range(size))
    rows, clean = [], {}
    for i in range(n):
        p = r.randrange(size - read)
        s = genome[p : p + read]
        t = list(s)
        if r.random() < errors:
            k = r.randrange(15, read - 15)
            t[k] = r.choice([b for b in "ACGT" if b != t[k]])
        t = "".join(t)
        turn = r.random() < 0.5
        rows.append((i, rc(t) if turn else t))
        clean[i] = rc(s) if turn else s
    return rows, clean


def test_rounds_remove_planted_errors_and_do_not_depend_on_partitions(spark):
    rows, clean = planted(11)
    out = []
    for n in (1, 7):
        c = Correction(spark.createDataFrame(rows, "read_id long, seq string").repartition(n), Params()).run(max_rounds=3)
        out.append(sorted(map(tuple, c.status().collect())))
    assert out[0] == out[1] and len(out[0]) == len(rows)
    before = sum(s != clean[i] for i, s in rows)
    after = sum(s != clean[i] for i, _, s in out[0])
    made = sum(s != clean[i] and dict(rows)[i] == clean[i] for i, _, s in out[0])
    assert after < before / 2 and made <= 1
    assert {s for _, s, _ in out[0]} <= {"", "Corrected", "Assigned"}


def test_error_free_reads_never_change(spark):
    rows, _ = planted(12, n=40, errors=0)
    c = Correction(spark.createDataFrame(rows, "read_id long, seq string")).run(max_rounds=2)
    assert sorted((r.read_id, r.seq) for r in c.status().collect()) == rows
    assert c.corrections().isEmpty() and c.contigs().count() > 0


def test_correct_reads_goes_on_until_nothing_is_left(spark, tmp_path):
    from seqloom import fixtures, queries

    r = random.Random(15)
    rows = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxy") for _ in range(360))) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    c = Correction(fixtures.reads(spark, str(tmp_path)), queries.P).run(max_rounds=1)
    one = rows_of(c.status())
    full = rows_of(c.run().status())
    assert c.rounds > 1 and c.frontier.isEmpty() and c.clusters.isEmpty() and c.admitted().isEmpty() and full != one
    assert rows_of(queries.correct_reads(spark, str(tmp_path))) == full
    tried = {x.read_id for x in c.tried.collect()}
    taken = {x.read_id for x in c.claims.collect()} | {x.read_id for x in c.failures.where("n >= 3").collect()}
    assert {x.read_id for x in c.posts.select("read_id").distinct().collect()} <= tried | taken
    s = c.summary().first()
    assert s.accepted == c.claims.count() and s.corrected == sum(x[1] == "Corrected" for x in full) and s.collided == c.attempts.where("not won").count()
    assert c.contigs().agg({"n_reads": "sum"}).first()[0] <= c.attempts.count()


def test_replayed_corrections_give_the_corrected_reads(spark):
    """The file of places, applied to the reads as sequenced, gives what was claimed (substitutions; bases are on the cluster's strand)."""
    rows, _ = planted(17, n=50)
    c = Correction(spark.createDataFrame(rows, "read_id long, seq string")).run()
    turned = {x.read_id: x.rc for x in c.claims.collect()}
    seqs, gaps = dict(rows), set()
    for x in c.corrections().collect():
        if x.kind != "M":
            gaps.add(x.read_id)
            continue
        a, b = x.bases if not turned[x.read_id] else (rc(x.bases[0]), rc(x.bases[1]))
        s = seqs[x.read_id]
        assert dict(rows)[x.read_id][x.pos] == a
        seqs[x.read_id] = s[: x.pos] + b + s[x.pos + 1 :]
    assert all(x.corrected == seqs[x.read_id] for x in c.claims.collect() if x.read_id not in gaps)


def test_steps_of_a_run_are_deleted(spark):
    import os

    rows, _ = planted(18, n=20)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    c = Correction(spark.createDataFrame(rows, "read_id long, seq string"))
    c.run()
    left = set(os.listdir(folder)) - before
    assert c.rounds >= 1 and len(left) <= len(c._paths) + 2  # the state, the reads and the index


def test_stop_file_and_empty_input(spark):
    rows, _ = planted(13, n=10)
    df = spark.createDataFrame(rows, "read_id long, seq string")
    assert Correction(df, stop=lambda: True).run().rounds == 0
    assert Correction(df.where("false")).run().status().isEmpty()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ACG"), (4, "N" * 40), (5, "A" * 60)], "read_id long, seq string")
    c = Correction(odd).run()
    assert sorted((x.read_id, x.status, x.seq) for x in c.status().collect()) == [(1, "", None), (2, "", ""), (3, "", "ACG"), (4, "", "N" * 40), (5, "", "A" * 60)]


def test_first_claim_and_saturation(spark):
    tries = spark.createDataFrame([(1, 5, "AA"), (1, 3, "AC"), (1, 9, "AC"), (2, 9, "GG")], "read_id long, cluster_id long, corrected string")
    got = {(r.read_id, r.cluster_id): (r.won, r.matched) for r in claims.first_claim(tries).collect()}
    assert got == {(1, 3): (True, True), (1, 5): (False, False), (1, 9): (False, True), (2, 9): (True, True)}
    f = spark.createDataFrame([(1,)] * 5 + [(2,)], "read_id long")
    assert sorted(map(tuple, claims.saturate(f).collect())) == [(1, 3), (2, 1)]


def test_usable_reads(spark):
    h = spark.createDataFrame([(1, r) for r in range(6)], "cluster_id long, read_id long")
    c = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "read_id long, cluster_id long")
    f = spark.createDataFrame([(3, 3), (4, 3), (5, 2)], "read_id long, n int")
    ids = lambda d: sorted(r.read_id for r in d.collect())
    assert ids(gather.usable(h, c, f)) == [0, 2, 4, 5]
    assert ids(gather.usable(h, c, f, strict=True)) == [0, 2, 5]
    assert ids(gather.usable(h, c, f, reuse=False)) == [0, 4, 5]


def test_extension_stops_at_gap_and_entropy(spark):
    p = spark.createDataFrame([(1, i, 0.1) for i in (-3, -1, 0, 1, 3)] + [(2, 0, 0.6), (2, 1, 0.61), (2, 2, 0.1), (2, -1, 0.7)], "cluster_id long, pos int, entropy double")
    from pyspark.sql import functions as F

    run = lambda right: sorted((r.cluster_id, r.pos) for r in gather.core_prefix(p, 0.6, F.lit(0), right).collect())
    assert run(True) == [(1, 0), (1, 1), (2, 0)] and run(False) == [(1, -1)]


def test_pileup_subtract_recounts(spark):
    placed = spark.createDataFrame([(1, 1, 0, "ACG"), (1, 2, 1, "CGT"), (1, 3, 5, "T")], "cluster_id long, read_id long, loc int, oseq string")
    all_ = pileup.counts(pileup.bases(placed))
    got = pileup.subtract(all_, pileup.counts(pileup.bases(placed.where("read_id != 1"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pileup.counts(pileup.bases(placed.where("read_id = 1"))).collect()))


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_fastq_and_fasta_records_over_splits(spark, tmp_path, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        (tmp_path / "a.fq").write_text("".join(f"@r{i} x\n{'ACGT' * (i % 5 + 1)}\n+\n@@@@\n" for i in range(50)))
        got = fastx.read_fastx(spark, str(tmp_path / "a.fq")).orderBy("record").collect()
        assert [(r.record, r.name, r.seq) for r in got] == [(i, f"r{i} x", "ACGT" * (i % 5 + 1)) for i in range(50)]
        (tmp_path / "a.fa").write_text("".join(f">r{i}\r\nACG\r\n" for i in range(30)))
        (tmp_path / "b.fa").write_text("".join(f">s{i}\nTTT\n" for i in range(30)))
        pairs = fastx.read_store(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fa")).orderBy("read_id").collect()
        assert [(r.read_id, r.mate, r.name) for r in pairs] == [(2 * i + m, m, f"{'rs'[m]}{i}") for i in range(30) for m in (0, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_restore_and_files_round_trip(spark, tmp_path):
    originals = spark.createDataFrame([(0, "a", "ACGN"), (1, "b", "NNNN"), (2, "c", "AAAA")], "read_id long, name string, seq string")
    masked = spark.createDataFrame([(0, "ACGT"), (2, "AAAA")], "read_id long, seq string")
    status = spark.createDataFrame([(0, "Corrected", "ACGG"), (2, "", "AAAA")], "read_id long, status string, seq string")
    sinks.write_corrected(status, str(tmp_path / "c.fa"))
    back = files.read_corrected(spark, str(tmp_path / "c.fa"))
    assert sorted(map(tuple, back.collect())) == [(0, "Corrected", "ACGG"), (2, "", "AAAA")]
    sinks.write_masked(masked, str(tmp_path / "m.fa"))
    assert sorted(map(tuple, files.read_masked(spark, str(tmp_path / "m.fa")).collect())) == [(0, "ACGT"), (2, "AAAA")]
    sinks.write_restored(claims.restore(originals, masked, back), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == ">a Corrected\nACGG\n>b\nNNNN\n>c \nAAAA\n"


def test_pairs_fall_together(spark):
    rows = [(0, 0, "ACGT"), (1, 0, "NNNNACGT"), (2, 1, "ACGT"), (3, 1, "ACNT")]
    got = mask.mask_pairs(spark.createDataFrame(rows, "read_id long, pair long, seq string")).collect()
    assert sorted(r.read_id for r in got) == [2, 3]


def test_parameters_are_checked():
    for bad in ({"k": 32}, {"k": 0}, {"failure_limit": 256}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_places_and_hits_give_the_same_first_hit(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    h = spark.createDataFrame([(r.randrange(3), r.randrange(4), r.randrange(50), r.randrange(-9, 9), r.random() < 0.5) for _ in range(200)], "cluster_id long, read_id long, k_end int, loc int, rc boolean")
    places = h.groupBy("cluster_id", "read_id", "loc", "rc").agg(F.min("k_end").alias("k_end"), F.count("*").alias("n"))
    assert sorted(map(tuple, gather.first_places(places).collect())) == sorted(map(tuple, gather.first_hits(h).collect()))


def test_thinned_clusters_begin_at_their_largest_start(spark):
    kept = spark.createDataFrame([(1, 10, 0), (1, 11, 7), (1, 12, -3), (2, 20, 9), (3, 30, 5)], "cluster_id long, read_id long, loc int")
    gone = spark.createDataFrame([(1, 13), (1, 14), (3, 31), (4, 40)], "cluster_id long, read_id long")
    live = spark.createDataFrame([(1, 0, 0, ""), (2, 0, 0, ""), (3, -5, 40, "A" * 45), (4, 0, 0, "")], "cluster_id long, core_lo int, core_hi int, core string")
    assert sorted(map(tuple, gather.anchors(kept, gone).collect())) == [(1, 7), (3, 5)]
    assert sorted(map(tuple, gather.anchored(live, kept, gone).drop("core").collect())) == [(1, 7, 7), (2, 0, 0), (3, -5, 40), (4, 0, 0)]
    assert sorted(map(tuple, gather.moved(kept, gather.anchors(kept, gone), "loc").collect())) == [(1, 10, -7), (1, 11, 0), (1, 12, -10), (2, 20, 9), (3, 30, 0)]
    none = kept.where("false")
    assert sorted(map(tuple, gather.anchored(live, none, gone).collect())) == sorted(map(tuple, live.collect())) and gather.anchors(none, gone).isEmpty()


def test_cores_grow_on_both_sides_and_only_their_ends_are_probed(spark):
    from seqloom.plans.correct import probes_of

    live = spark.createDataFrame([(1, 0, 30, "C" * 30), (2, 4, 4, ""), (3, 0, 5, "GGGGG")], "cluster_id long, core_lo int, core_hi int, core string")
    new = spark.createDataFrame([(1, -1, "A"), (1, -2, "T"), (1, 30, "G"), (2, 3, "A"), (2, 4, "C"), (2, 5, "G")], "cluster_id long, pos int, letter string")
    grown = gather.spliced(live, new)
    assert sorted(map(tuple, grown.collect())) == [(1, -2, 31, "TA" + "C" * 30 + "G", 0, 30), (2, 3, 6, "ACG", 4, 4), (3, 0, 5, "GGGGG", 0, 5)]
    got = sorted((x.cluster_id, x.at, x.core) for x in probes_of(grown, 4).collect())
    assert got == [(1, -2, "TACCC"), (1, 27, "CCCG"), (3, 0, "GGGGG")]  # the ends of the last one meet
    assert sorted((x.cluster_id, x.at, x.core) for x in probes_of(grown, 3).collect()) == [(1, -2, "TACC"), (1, 28, "CCG"), (2, 3, "ACG")]


def test_extension_of_both_sides_at_once(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    rows = [(c, i, r.choice([0.1, 0.1, 0.1, 0.7]), a, a + n) for c in range(30) for a, n in [(r.randrange(-3, 3), r.randrange(4))] for i in range(-9, 12) if r.random() < 0.95]
    p = spark.createDataFrame(rows, "cluster_id long, pos int, entropy double, core_lo int, core_hi int")
    want = gather.core_prefix(p, 0.6, F.col("core_hi"), True).unionByName(gather.core_prefix(p, 0.6, F.col("core_lo"), False))
    assert sorted(map(tuple, gather.extension(p, 0.6).collect())) == sorted(map(tuple, want.collect()))


def test_positions_of_all_kinds(spark):
    edits = "read_id long, rc boolean, edits array<struct<pos:int,kind:string,bases:string>>"
    c = spark.createDataFrame([(1, False, [(3, "M", "AC"), (5, "D", "G")]), (2, True, [(0, "I", "T")]), (3, False, []), (4, False, None), (9, True, [(1, "M", "AC")])], edits)
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGT"), (3, "A"), (4, "A")], "read_id long, seq string")
    assert sorted(map(tuple, claims.positions(c, reads).collect())) == [(1, 3, "M", "AC"), (1, 5, "D", "G"), (2, 3, "I", "T")]


def test_odd_rows_of_relational_steps(spark):
    from pyspark.sql import functions as F

    from seqloom.operators import ungapped

    kind = "cluster_id long, read_id long, loc int, oseq string"
    placed = spark.createDataFrame([(1, 1, 0, "AC"), (1, 1, 0, "AC"), (1, 2, 0, None), (1, 3, None, "AC"), (1, 4, 5, ""), (None, 5, 0, "A"), (1, 6, 1, "N")], kind)
    b = pileup.bases(placed)
    assert sorted(map(tuple, pileup.counts(b.where("cluster_id = 1")).collect())) == [(1, 0, 2, 0, 0, 0), (1, 1, 0, 2, 0, 0)]
    none = placed.where("false")
    assert pileup.counts(pileup.bases(none)).isEmpty() and pileup.spans(pileup.counts(b)).count() == 2
    prof = pileup.profile(pileup.counts(b))
    cmp = ungapped.compared(b, prof)
    assert {x.cluster_id for x in cmp.collect()} == {1} and ungapped.attempts(cmp.where("false")).isEmpty()
    assert ungapped.positions(cmp, spark.createDataFrame([], "read_id long, cluster_id long, won boolean"), placed.withColumn("rc", F.lit(False))).isEmpty()
    tries = spark.createDataFrame([(1, 2, "A"), (1, 2, "A"), (1, 3, None), (None, 1, "A"), (2, None, "A")], "read_id long, cluster_id long, corrected string")
    assert sorted(map(tuple, claims.first_claim(tries).collect())) == [(1, 2, True, True), (1, 2, True, True), (1, 3, False, False)]
    assert claims.first_claim(tries.where("false")).isEmpty()
    assert sorted(map(tuple, claims.saturate(spark.createDataFrame([(None,), (1,)], "read_id long")).collect())) == [(1, 1)]
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "NNNNN"), (4, "ACN"), (4, "ACN")], "read_id long, seq string")
    assert sorted((x.read_id, len(x.seq)) for x in mask.mask(rows).collect()) == [(2, 0), (4, 3), (4, 3)]


def test_store_of_folders_is_numbered_over_their_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}", "ACGT" * (i % 3)) for i in range(40)], "n long, name string, seq string").repartition(5)
    paths = []
    for k, where in enumerate(("n < 25", "n >= 25")):
        sinks.write_fastq(rows.where(where), str(tmp_path / f"{k}.fq"), "n")
        paths.append(str(tmp_path / f"{k}.fq"))
    got = fastx.read_store(spark, ",".join(paths)).orderBy("read_id").collect()
    assert [(x.read_id, x.name, x.seq) for x in got] == [(i, f"r{i}", "ACGT" * (i % 3)) for i in range(40)]
    both = fastx.read_store(spark, ",".join(paths), ",".join(paths)).orderBy("read_id").collect()
    assert [(x.read_id, x.mate, x.name) for x in both] == [(2 * i + m, m, f"r{i}") for i in range(40) for m in (0, 1)]


def test_usable_reads_are_not_written_first(spark):
    """A filter on reads meets them behind the explode that makes them, and nothing goes to the shared folder."""
    from seqloom import queries

    f = queries.Flow(spark, "/root/testdata/sf0.001")
    plan = f.usable._jdf.queryExecution().optimizedPlan().toString()
    assert not f.made and plan.count("Generate") == 2


def test_seeds_and_hits_without_the_index(spark, monkeypatch):
    """The same as over the whole index, also where reads repeat and where most bits of the maps are set; the index is not written."""
    from seqloom import queries
    from seqloom.operators import kmers

    f = queries.Flow(spark, "/root/testdata/sf0.001")
    some = f.lazy.where("doc_id < 40").select("read_id", "seq")
    other = some.select((F.col("read_id") + 15).alias("read_id"), "seq").limit(50)  # ids that come again with other bases
    f.lazy = sinks.materialize(some.unionByName(other).repartition(5), "again")
    monkeypatch.setattr(kmers, "MOST", 12)
    monkeypatch.setattr(kmers, "SEGMENT", 9)
    posts = kmers.postings(f.usable, queries.K, f.counts(), queries.P.kmer_low_complexity)
    seeds = kmers.admit(posts)
    assert sorted(f.seeds().collect()) == sorted(seeds.collect()) != []
    cores = seeds.join(f.usable, "read_id").select(F.col("read_id").alias("cluster_id"), F.col("seq").alias("core"))
    whole = gather.overhang(gather.hits(cores, posts, f.usable, queries.K), F.lit(0))
    assert sorted(f.hits().collect()) == sorted(whole.collect())
    assert not {"postings", "reads"} & set(f.made)


def test_records_are_put_together_where_their_lines_lie(spark, tmp_path):
    """Only records that a split's edge cuts are shuffled: of one split, none. Cut ones come out whole."""
    lines = [x for i in range(3000) for x in (f">r{i}", "ACGT" * (i % 9))] + [">last"]
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    want = sorted((i, f"r{i}", "ACGT" * (i % 9)) for i in range(3000)) + [(3000, "last", "")]
    assert fastx.in_pieces(fastx.told_lines(spark, str(tmp_path / "a.fa")), False).count() == 1
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted(map(tuple, fastx.read_fastx(spark, str(tmp_path / "a.fa")).select("record", "name", "seq").collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hits_and_gathered_reads_take_one_pass_over_all_reads(spark, tmp_path):
    """Hits and the reads turned to the cores' strands are joined from what is near the seeds; the same as over all reads."""
    from seqloom import queries
    from seqloom.operators import gather, kmers

    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxy") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(i, texts[i % 30] if i % 4 else texts[i % 30][20:] + " zz " + texts[(i + 1) % 30]) for i in range(90)] + [(5, texts[7]), (None, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    f = queries.Flow(spark, str(tmp_path))
    hits = f.hits()
    assert "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()
    near, all_reads = f.near(), f.usable.where("read_id is not null")
    posts = kmers.postings(f.usable, queries.K, f.counts(), queries.P.kmer_low_complexity)
    cores = all_reads.join(f.seeds(), "read_id").selectExpr("read_id as cluster_id", "seq as core")
    whole = gather.overhang(gather.hits(cores, posts.where("read_id is not null"), all_reads, queries.K), F.lit(0))
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, whole.collect())) and not hits.isEmpty()
    assert "MapInArrow" not in gather.oriented(f.first_hits(), near)._jdf.queryExecution().optimizedPlan().toString()
    want = gather.oriented(gather.first_hits(whole), all_reads)
    assert sorted(map(tuple, f.oriented().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
