import random
from dataclasses import replace

import pytest

from seqloom.llm import near_dup
from seqloom.llm.components import connected_components

from .helpers import AWKWARD, WORDS, frame


def shingles(t):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


def corpus(seed, n=60):
    r = random.Random(seed)
    rows = []
    for g in range(n // 6):
        base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.choice([3, 40, 120]))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = "new" + str(r.randrange(999))
            rows.append((len(rows) * 3 + 7, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [400, 3])
def test_equals_brute_force(spark, block):
    """With tiny blocks every group is verified block against block."""
    rows = corpus(4) + AWKWARD
    p = replace(near_dup.Params(), block=block, broadcast_ids=400 if block > 9 else 0)
    got = near_dup.near_duplicates(frame(spark, rows).repartition(5), p=p)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_group_of_near_copies(spark):
    """Copies of one text with one or two words changed: links pass through the matrix product, and some copies link with none."""
    r = random.Random(6)
    base = [f"w{r.randrange(10_000)}" for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(90)] = f"n{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(frame(spark, rows, False), p=replace(near_dup.Params(), block=64))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_thousands_of_near_copies_do_not_meet_pairwise(spark):
    """Copies of one text, each with a word of its own changed, and a few further off: what travels grows with the group, not with its square."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        w = list(base)
        for _ in range(1 if i % 300 else 4):  # ten are too far from the usual copy
            w[r.randrange(120)] = f"n{i}x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    p = replace(near_dup.Params(), block=100)
    made = {}
    stars, cells = near_dup.confirm_stars, near_dup.cells_of

    def keep(name, f):
        def call(*args):
            if name == "stars":
                made["stars"] = args[0].count()
            out = f(*args)
            if name == "cells":
                made["cells"] = out.count()
            return out

        return call

    near_dup.confirm_stars, near_dup.cells_of = keep("stars", stars), keep("cells", cells)
    try:
        got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(frame(spark, rows, False), p=p).collect()}
    finally:
        near_dup.confirm_stars, near_dup.cells_of = stars, cells
    assert made["stars"] < 40 * len(rows)  # at most 36 + 9 pivots each; blocks of all pairs would be 3000 * 30 cells
    assert made["cells"] <= 8 * len(rows)
    usual = [i for i in range(3000) if i % 300]
    sets = {i: shingles(t) for i, t in rows}
    assert all(len(sets[usual[0]] & sets[i]) * 100 >= 60 * len(sets[usual[0]] | sets[i]) for i in usual[:50])
    # against brute force over a sample of queries: every link found by hand joins two ids of one class
    for i in r.sample(range(3000), 30):
        for j in range(3000):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert got[i] == got[j]


def test_hot_id_repeats(spark):
    rows = [(5, "a b c d e f g h")] * 200 + [(6, "a b c d e f g h"), (7, "a b c d e f g h i j k l m n o p"), (8, "a b c d e f g h i j k l m n o q")]
    got = near_dup.near_duplicates(frame(spark, rows), p=replace(near_dup.Params(), threshold=60, bands=84, rows=3))
    want = {}
    for i, t in rows:
        want[i] = shingles(t)
    assert sorted((x.doc_id, x.component_id) for x in got.collect()) == [(5, 5), (6, 5), (7, 7), (8, 7)]


def test_empty_null_ids_and_repeated_rows(spark):
    assert near_dup.near_duplicates(frame(spark, [])).isEmpty()
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows)).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]
    kept = near_dup.keep_one(frame(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, 1), (False, 1)] and kept.count() == 3
    assert kept.columns == frame(spark, rows).columns


def test_pipeline_stage_links_from_80_per_cent(spark):
    """Texts of 20 shingles, each with a copy of more words at its end: 20 of 20 + more shingles are shared."""
    import corpus_pipeline

    rows, want = [], []
    for g, more in enumerate([1, 3, 4, 5, 5, 5, 6, 7]):
        base = [f"w{g}x{i}" for i in range(24)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base + [f"end{g}x{i}" for i in range(more)]))]
        want += [10 * g] if 100 * 20 >= 80 * (20 + more) else [10 * g, 10 * g + 1]
    rows += [(1000 + i, t) for i, t in corpus(8)]
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:  # smallest ids move along links until none does
        new = {a: min(root[b] for b in sets if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])) for a in sets}
        if new == root:
            break
        root = new
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    assert got == sorted(i for i in root if root[i] == i) and [i for i in got if i < 1000] == want


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(None, 3), (4, None), (9, 9)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, root(n)) for n in parent)
