"""The four steps from files to files."""

import random

from seqloom import cli

from .test_engine import planted, rc


def read(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_files_to_files_and_resume(spark, tmp_path, capsys):
    rows, clean = planted(21, n=48)
    r = random.Random(1)
    names = [f"run.{i} length={len(s)}" for i, s in rows]
    body = [(n, s) for n, (_, s) in zip(names, rows)]
    body[7] = (names[7], "NNNN" + body[7][1][4:])
    for mate, f in ((0, "a.fq"), (1, "b.fq")):
        (tmp_path / f).write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in body[mate::2]))
    out = tmp_path / "w"
    args = ["-t", str(out), "--max-rounds", "2", str(tmp_path / "a.fq"), str(tmp_path / "b.fq")]
    (tmp_path / "ids").write_text("0\n7\n 12 \n\n12\n9999\n")
    cli.main([*args, "--contigFn", str(tmp_path / "contigs"), "--corPosFn", str(tmp_path / "pos"), "--stats_suffix", "x", "--dbReads", str(tmp_path / "ids")], spark)
    told = capsys.readouterr()
    accepted, corrected = map(int, told.out.split())
    assert f"Accepted: {accepted} Corrected: {corrected}\nCollidedReads: " in told.err and "Substitutions: " in told.err
    lines = read(out / "restored.fa").splitlines()
    order = [n for pair in zip(names[0::2], names[1::2]) for n in pair]
    heads = lines[0::2]
    assert [h[1:].rsplit(" ", 1)[0] if not h.endswith("=60") else h[1:] for h in heads] == order
    seqs = dict(zip(order, lines[1::2]))
    # the pair of the rejected read comes back as it was, without a status
    for i in (6, 7):
        assert seqs[names[i]] == body[i][1] and f">{names[i]}" in heads
    fixed = sum(seqs[n] == clean[i] != s for n, (i, s) in zip(names, rows))
    wrong = sum(s != clean[i] for i, s in rows)
    assert fixed >= wrong / 2
    # replaying the correction places turns the masked reads into the corrected ones
    text = read(out / "masked.fa").splitlines()
    masked = {int(h[1:]): s for h, s in zip(text[0::2], text[1::2])}
    text = read(out / "corrected.fa").splitlines()
    done = {int(h[1:].split("<")[0]): (h.partition("<")[2], s) for h, s in zip(text[0::2], text[1::2])}
    assert (accepted, corrected) == (sum(x[0] != "" for x in done.values()), sum(x[0] == "Corrected" for x in done.values()))
    chosen = read(out / "reads_of_interest.fa").splitlines()[0::2]
    assert [int(h[1:].split("<")[0]) for h in chosen] == [i for i in (0, 7, 12) if i in done]
    edits = {}
    for line in read(tmp_path / "pos").splitlines():
        rid, pos, kind, bases = line.split("\t")
        edits.setdefault(int(rid), []).append((int(pos), kind, bases))
    for rid, (status, s) in done.items():
        if all(k == "M" for _, k, _ in edits.get(rid, [])):
            t = list(masked[rid])
            for pos, _, bases in edits.get(rid, []):
                t[pos] = bases[1] if t[pos] == bases[0] else rc(bases[1])
            assert "".join(t) == s and (status == "Corrected") == (s != masked[rid])
    contig = read(tmp_path / "contigs").splitlines()[0].split("\t")
    assert int(contig[0]) == len(contig[1]) > 17 and (len(contig) - 3) % 5 == 0
    assert len(read(out / "nretrievals_x").splitlines()) == len(masked)
    (tmp_path / "old").mkdir()
    (out / "restored.fa").rename(tmp_path / "old" / "restored.fa")
    cli.main(["-s", "4", *args], spark)
    assert read(out / "restored.fa") == read(tmp_path / "old" / "restored.fa")
    # the corrected reads under another name
    cli.main(["-s", "4", "-o", str(out / "corrected.fa"), *_without_restored(args, out)], spark)
    assert read(out / "restored.fa") == read(tmp_path / "old" / "restored.fa")


def _without_restored(args, out):
    import shutil

    shutil.rmtree(out / "restored.fa")
    return args
