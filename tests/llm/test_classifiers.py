import random
import time

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import langid, toxicity, tokens

from .helpers import AWKWARD, frame

LANGS = {"aa": "ka lo mi tu re so pa".split(), "bb": "sch ung eit ber ver ach ich".split(), "cc": "eau oir elle ais ou ent tion".split()}


def text(r, lang, n=30):
    return " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def lang_params():
    return langid.Params(tokens.public("piece_bpe_32k.model"), docs_per_lang=40)


def test_forward_sums_all_segmentations():
    vocab = ["▁a", "a", "b", "ab", "▁ab", "ba", "▁"]
    lattice = langid.Lattice(vocab)
    prob = np.random.default_rng(0).random((len(vocab), 2))
    word, floor = "▁abba", 1e-3

    def total(s, k):
        if not s:
            return 1.0
        out = floor * total(s[1:], k)
        return out + sum(prob[i, k] * total(s[len(p) :], k) for i, p in enumerate(vocab) if s.startswith(p))

    code = np.array([[ord(c) for c in word]], np.uint32)
    got = lattice.forward(code, prob, floor)[-1][0]
    assert got == pytest.approx([total(word, 0), total(word, 1)])


def test_expected_counts_are_derivatives():
    vocab = ["▁a", "a", "b", "ab", "▁ab", "▁"]
    lattice = langid.Lattice(vocab)
    q = np.random.default_rng(1).random(len(vocab))
    code = np.array([[ord(c) for c in "▁aab"]], np.uint32)
    got = np.zeros(len(vocab))
    lattice.expected(code, np.array([1.0]), q, 1e-3, got)
    for i in range(len(vocab)):
        up, down = q.copy(), q.copy()
        up[i] *= 1 + 1e-6
        down[i] *= 1 - 1e-6
        f = lambda x: np.log(lattice.forward(code, x[:, None], 1e-3)[-1][0, 0])
        assert got[i] == pytest.approx((f(up) - f(down)) / 2e-6, abs=1e-4)


def test_long_words_equal_the_plain_recursion():
    """Words of several lengths side by side, past the range of a double, in two languages; counts against expected()."""
    r = random.Random(5)
    vocab = ["▁a", "a", "b", "ab", "bab", "▁ab", "abbababab"]
    lattice = langid.Lattice(vocab)
    prob = np.random.default_rng(2).random((len(vocab), 2)) ** 3 / 50
    prob[:, 1] *= 1e-3
    texts = ["▁" + "".join(r.choice("aabbz") for _ in range(n)) for n in (900, 700, 41, 12, 3)]
    code = np.zeros((len(texts), 901), np.uint32)
    for i, t in enumerate(texts):
        code[i, : len(t)] = [ord(c) for c in t]
    size = np.array([len(t) for t in texts])
    got = lattice.long_forward(code, size, prob, 1e-7)
    for i, t in enumerate(texts):
        for k in range(2):
            alpha = [0.0] + [-np.inf] * len(t)
            for e in range(1, len(t) + 1):
                parts = [alpha[e - 1] + np.log(1e-7)] + [alpha[e - len(v)] + np.log(prob[j, k]) for j, v in enumerate(vocab) if len(v) <= e and t[e - len(v) : e] == v]
                alpha[e] = np.logaddexp.reduce(parts)
            assert got[i, k] == pytest.approx(alpha[-1], rel=1e-9)
    short = np.array([[ord(c) for c in t] for t in ("▁abbab", "▁zabab")], np.uint32)
    one, two = np.zeros(len(vocab)), np.zeros(len(vocab))
    lattice.expected(short, np.array([2.0, 3.0]), prob[:, 0], 1e-7, one)
    padded = np.concatenate([short, np.zeros((2, 30), np.uint32)], 1)
    lattice.long_expected(padded, np.array([6, 6]), np.array([2.0, 3.0]), prob[:, 0], 1e-7, two)
    assert two == pytest.approx(one)
    # of the long words: each character is in one piece or alone, so lengths times counts stay below the number of characters
    total = np.zeros(len(vocab))
    lattice.long_expected(code, size, np.ones(len(texts)), prob[:, 0], 1e-7, total)
    up = prob[:, 0].copy()
    up[2] *= 1 + 1e-6
    slope = (lattice.long_forward(code, size, up[:, None], 1e-7) - lattice.long_forward(code, size, prob[:, :1], 1e-7)).sum() / 1e-6
    assert total[2] == pytest.approx(slope, rel=1e-3) and 0 < (total * [len(v) for v in vocab]).sum() < size.sum()


def test_text_without_spaces_and_many_languages(lang_params):
    r = random.Random(6)
    rows = [(f"l{k:03d}", " ".join("".join(r.choice("abcdefghij"[k % 5 : k % 5 + 5]) for _ in range(9)) + "xyz"[k % 3] * 3 for _ in range(30))) for k in range(70)]
    model = langid.fit(rows, lang_params)
    assert len(model.langs) == 70
    lattice = langid.Lattice(model.vocabulary)
    joined = rows[3][1].replace(" ", "") * 30
    best, score = langid.score_texts(model, lattice, pa.array([rows[3][1], joined, "q" * 41, "é" * 5000]))
    assert (best >= 0).all() and ((score > 0) & (score <= 1)).all()


def test_language_held_out_accuracy_and_awkward_rows(spark, lang_params):
    r = random.Random(2)
    rows = [(i, text(r, lang, r.randint(4, 60)), lang) for i, lang in enumerate(list(LANGS) * 60)]
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in AWKWARD], "doc_id long, text string, lang string")
    model = langid.train(docs, lang_params)
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == lang for i, lang in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003))
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == len(rows) + len(AWKWARD)
    assert got[9005].lang_pred == got[9006].lang_pred


def test_language_learns_from_all_documents(spark):
    """More documents of a language than the former bound of 400: the model is that of all of them, however they are dealt out."""
    p = langid.Params(tokens.public("piece_bpe_32k.model"))
    r = random.Random(12)
    rows = [(i, text(r, lang, 4) + ("" if i % 50 else " " + "pasapa" * 9), lang) for i, lang in enumerate(["aa", "bb"] * 700)]
    learned = [(lang, t) for i, t, lang in rows if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    assert len(learned) > 2 * 400
    docs = spark.createDataFrame([*rows, (9001, None, "aa"), (9002, "", "bb"), (9003, "ka lo", None)], "doc_id long, text string, lang string")
    one, other = (langid.train(docs.repartition(n), p) for n in (1, 7))
    want = langid.fit(learned, p)
    assert one.langs == want.langs == ["aa", "bb"] and one.vocabulary == want.vocabulary
    assert one.prob == pytest.approx(want.prob, rel=1e-4)
    assert (one.prob == other.prob).all()


def test_language_empty_tables_and_clashing_names(spark, lang_params):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty, lang_params)
    out = langid.identify(frame(spark, AWKWARD), model)
    assert out.columns[-2:] == ["lang_pred_", "score_"] and {r.lang_pred_ for r in out.collect()} == {"und"}
    assert langid.identify(empty, model).isEmpty()
    docs = frame(spark, AWKWARD).withColumn("lang", langid.F.lit(None).cast("string"))
    kept = langid.stage(docs, lang_params)
    assert kept.columns == docs.columns


def test_prediction_ignores_labels_and_ids(spark, lang_params):
    r = random.Random(3)
    rows = [(i, text(r, lang), lang) for i, lang in enumerate(list(LANGS) * 20)]
    model = langid.fit([(x[2], x[1]) for x in rows], lang_params)
    a = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    b = langid.identify(spark.createDataFrame([(i + 7, t, "zz") for i, t, _ in rows], "doc_id long, text string, lang string"), model).collect()
    assert sorted((x.text, x.lang_pred, x.score) for x in a) == sorted((x.text, x.lang_pred, x.score) for x in b)


BAD = "vile nasty rotten".split()


def labelled(seed, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrs')}{r.randrange(40)}" for _ in range(r.randint(8, 70))]
        y = int(r.random() < 0.3)
        for _ in range(y * 3):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), r.choice(["aa", "bb"]), y))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = labelled(1)
    docs = spark.createDataFrame([x[:3] for x in rows] + [(i, t, None) for i, t in AWKWARD], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows] + [(None, 1), (5000, 0), (3, None)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    out = toxicity.classify(docs, m)
    got = {x.doc_id: x for x in out.collect()}
    held = [x for x in rows if __import__("zlib").crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([got[x[0]].predicted == x[3] for x in held]) > 0.93
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) and x.flagged == (x.score >= x.threshold) for x in got.values())
    assert got[9001].score == got[9002].score == got[9003].score and got[9005].score == got[9006].score
    kept = toxicity.stage(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.flagged}


def test_all_labelled_rows_are_learned_from_whatever_the_partitions(spark, monkeypatch):
    """Several units and turns: every row that is neither held out, nor for calibration, nor a copy is in one piece, and every row for calibration is counted."""
    rows = labelled(41, 700)
    rows += [(5000 + i, x[1], x[2], x[3]) for i, x in enumerate(rows[:60])]
    docs = spark.createDataFrame([x[:3] for x in rows] + [(i, t, None) for i, t in AWKWARD], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, toxic int")
    p = toxicity.Params(visits=400, turn=60)
    learned, turns, held = [], [], []
    monkeypatch.setattr(toxicity, "_turn", lambda pieces, *x, f=toxicity._turn: (turns.append(1), f(pieces, *x)))
    monkeypatch.setattr(toxicity, "_all_held_by", lambda pieces, p, f=toxicity._all_held_by: (learned.append(pieces.collect()), f(pieces, p))[1])
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, x, f=toxicity._calibrate: (held.append(x.count()), f(m, x)))
    models = [toxicity.train(x, labels, p) for x in (docs.repartition(7), docs.coalesce(1))]
    crc = lambda i: __import__("zlib").crc32(str(i).encode()) % 5
    texts = {x[1] for x in rows if crc(x[0]) > 1}
    for got in learned:
        assert sum(len(r.y) for r in got) == len(texts) and len({r.unit for r in got}) > 1 and len({r.turn for r in got}) > 1
    assert len(turns) > 4 and held == [sum(crc(x[0]) == 1 for x in rows)] * 2
    a, b = (toxicity.score_texts(m, pa.array([x[1] for x in rows])) for m in models)
    assert (a == b).all() and models[0].thresholds == models[1].thresholds
    out = np.array([crc(x[0]) == 0 for x in rows])
    assert ((a >= 0.5) == np.array([x[3] for x in rows]))[out].mean() > 0.93


def test_toxic_word_at_the_end_of_a_long_text_counts():
    m = toxicity.fit([(x[3], x[1]) for x in labelled(2)], toxicity.Params())
    long = " ".join(f"bal{i % 40}" for i in range(400_000))
    s = toxicity.score_texts(m, pa.array([long, long + " vile nasty rotten vile nasty"]))
    assert s[1] > s[0] + 0.2


def test_pooling_equals_plain_windows(monkeypatch):
    """Also where texts are pooled in pieces of ten windows."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(50, 4))
    conv = [rng.normal(size=(w, 4, 3)) for w in (1, 2, 3)]
    bias = [rng.normal(size=3) for _ in range(3)]
    lens = [0, 1, 2, 3, 7, 0, 40]
    off = np.concatenate([[0], np.cumsum(lens)])
    ids = rng.integers(0, 50, off[-1])
    whole = toxicity.pooled(vectors, conv, bias, ids, off)
    monkeypatch.setattr(toxicity, "AT_ONCE", 10)
    pieces = toxicity.pooled(vectors, conv, bias, ids, off)
    for i, n in enumerate(lens):
        w_ids, want = ids[off[i] : off[i + 1]], []
        for c, b in zip(conv, bias):
            ys = [sum(vectors[w_ids[s + j]] @ c[j] for j in range(len(c))) + b for s in range(n - len(c) + 1)]
            want += list(np.maximum(np.max(ys, axis=0), 0)) if ys else [0, 0, 0]
        assert np.allclose(whole[i], want, atol=1e-5) and np.allclose(pieces[i], want, atol=1e-5)


def test_convolution_gradient():
    """Back-propagation of the softmax-pooled filters against finite differences, the softmax weights held fixed as in training."""
    rng = np.random.default_rng(8)
    vectors, conv, bias = rng.normal(size=(12, 4)), rng.normal(size=(2, 4, 3)), rng.normal(size=3) + 1
    off = np.array([0, 5, 6, 14])
    ids = rng.integers(0, 12, off[-1])
    c = rng.normal(size=(3, 3))
    soft = toxicity.soft_pooled(vectors, conv, bias, ids, off, 1.5)
    by_conv, by_bias, by_word = toxicity.gradients(vectors, conv, ids, soft, c)

    def loss():
        total = 0.0
        _, _, weight, start, wo = soft
        for t in range(3):
            for f in range(3):
                y = sum(weight[w, f] * sum(vectors[ids[start[w] + j]] @ conv[j][:, f] for j in range(2)) for w in range(wo[t], wo[t + 1]))
                total += c[t, f] * max(y + bias[f], 0) if wo[t + 1] > wo[t] else 0.0
        return total

    for arr, g in ((conv, by_conv), (bias, by_bias), (vectors, by_word)):
        for i in np.ndindex(arr.shape):
            old = arr[i]
            arr[i] = old + 1e-6
            up = loss()
            arr[i] = old - 1e-6
            down = loss()
            arr[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_training_makes_the_result():
    """Without training the ranking is no better than chance; with it toxic texts come first."""
    rows, held = labelled(11), labelled(12)
    y = np.array([x[3] for x in held])
    ranked = []
    for epochs in (0, toxicity.Params().epochs):
        m = toxicity.fit([(x[3], x[1]) for x in rows], toxicity.Params(epochs=epochs))
        s = toxicity.score_texts(m, pa.array([x[1] for x in held]))
        ranked.append((s[y == 1][:, None] > s[y == 0][None]).mean())
    assert ranked[0] < 0.8 and ranked[1] > 0.98


def test_thresholds_by_language(spark):
    """Two languages whose toxic texts differ in strength get thresholds that make fewer mistakes than 0.5 does."""
    score = np.array([0.1, 0.2, 0.3, 0.45, 0.6, 0.7])
    y = np.array([0, 0, 1, 1, 1, 1])
    assert 0.2 < toxicity._best_cut(score, y, np.ones(6)) < 0.3
    m = toxicity.fit([(x[3], x[1]) for x in labelled(13)], toxicity.Params())
    m.thresholds["aa"] = 0.0
    rows = [(i, x[1], lang) for i, (x, lang) in enumerate(zip(labelled(14, 20), ["aa", "bb", None, "zz"] * 5))]
    out = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), m).collect()
    assert all(x.threshold == (0.0 if x.lang == "aa" else 0.5) and x.flagged == (x.score >= x.threshold) for x in out)


def test_gradient_free_cases():
    none, one = toxicity.fit([], toxicity.Params()), toxicity.fit([(1, "a b")], toxicity.Params())
    assert toxicity.score_texts(none, pa.array(["a b", None, ""])).max() < 0.01
    assert toxicity.score_texts(one, pa.array(["a b"])).min() > 0.99


def test_score_ignores_language(spark):
    m = toxicity.fit([(x[3], x[1]) for x in labelled(3)], toxicity.Params())
    rows = [x[:2] for x in labelled(5, 30)]
    a = toxicity.classify(spark.createDataFrame([(*x, "aa") for x in rows], "doc_id long, text string, lang string"), m)
    b = toxicity.classify(spark.createDataFrame([(*x, None) for x in rows], "doc_id long, text string, lang string"), m)
    assert sorted((x.doc_id, x.score) for x in a.collect()) == sorted((x.doc_id, x.score) for x in b.collect())
    out = toxicity.classify(frame(spark, AWKWARD), m)
    assert out.columns[-4:] == ["score_", "predicted", "threshold_", "flagged"] and out.count() == len(AWKWARD)


def test_a_word_of_many_blocks_equals_the_plain_recursion(monkeypatch):
    """Blocks shorter than the longest piece's reach, a word that ends with a block, and one that has one character more."""
    r = random.Random(8)
    vocab = ["▁a", "a", "b", "ab", "bab", "▁ab", "abbababab"]
    lattice = langid.Lattice(vocab)
    prob = np.random.default_rng(3).random((len(vocab), 2)) / 2
    texts = ["▁" + "".join(r.choice("aabbbaz" if n % 2 else "ab") for _ in range(n - 1)) for n in (300, 192, 193, 64, 65, 12, 200)]
    size = np.array([len(t) for t in texts])
    code = np.zeros((len(texts), size.max()), np.uint32)
    for i, t in enumerate(texts):
        code[i, : len(t)] = [ord(c) for c in t]
    want, counts = lattice.long_forward(code, size, prob, 1e-2), np.zeros(len(vocab))
    weight = np.arange(1.0, len(texts) + 1)
    lattice.long_expected(code, size, weight, prob[:, 0], 1e-2, counts)
    one = np.zeros(len(vocab))
    for i, t in enumerate(texts):  # so that these words stay in the range of a double
        lattice.expected(code[i : i + 1, : len(t)], weight[i : i + 1], prob[:, 0], 1e-2, one)
        assert want[i] == pytest.approx(np.log(lattice.forward(code[i : i + 1, : len(t)], prob, 1e-2)[-1][0]), rel=1e-9)
    assert counts == pytest.approx(one)
    for block, beside in ((64, 1024), (64, 3), (17, 2)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "SIDE_BY_SIDE", beside)
        assert lattice.long_forward(code, size, prob, 1e-2) == pytest.approx(want, rel=1e-9)
        again = np.zeros(len(vocab))
        lattice.long_expected(code, size, weight, prob[:, 0], 1e-2, again)
        assert again == pytest.approx(counts)


def test_a_word_of_millions_of_characters(lang_params):
    r = random.Random(9)
    rows = [(lang, " ".join("".join(r.choice(s) for _ in range(7)) for _ in range(200))) for lang, s in (("aa", "abcde"), ("bb", "efghi"))]
    model = langid.fit(rows, lang_params)
    word = "".join(r.choice("abcde") for _ in range(10_000)) * 200
    start = time.time()
    best, score = langid.score_texts(model, langid.Lattice(model.vocabulary), pa.array([word, word[:500]]))
    assert best.tolist() == [0, 0] and score[0] == 1.0 and time.time() - start < 60
