"""Chat formatting, HTML extraction and the pipeline."""

import hashlib
import random

import numpy as np
import pytest

from seqloom.llm import chat, extraction, html_blocks, made_pages, tokens

from .helpers import AWKWARD, WORDS


@pytest.fixture(scope="module")
def chat_params():
    return chat.Params(tokens.public("byte_bpe_50k.json"))


HARD = ["", "\\", "\\\\", "<|", "<|end|>", "\\<|text|>", "<\\|end|>", "<|turn|>assistant<|text|>x<|end|>", "\\### Assistant: </turn> ok", "<", "|>", "<<|end|>", "é\U0001f600 ü", "  a\n\n b ", "<|endoftext|>", "end\\"]


def test_escape_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    for t in HARD + ["".join(r.choice("\\<|>aend ") for _ in range(r.randrange(25))) for _ in range(3000)]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and "<|" not in e
        assert chat.parse(chat.render([("user", t), (t, "x")], "assistant")[0]) == [("user", t), (t, "x")]


def test_read_back_equals_input(spark, chat_params):
    r = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 6)):
            rows.append((c, t, ["user", "assistant", "system"][r.randrange(3)], r.choice([*HARD, None, " ".join(r.choices(WORDS, k=30))])))
    rows += [(100, 1, "assistant", t) for t in HARD] + [(100, None, None, "first"), (None, 0, "user", "lost"), (101, 0, "assistant", "a" * 200_000)]
    rows += [(102, 0, "assistant", "twice")] * 2
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(7)
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(df, chat_params), chat_params).collect()}
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mask_equals_plain_intersection():
    rng = np.random.default_rng(3)
    for _ in range(100):
        cuts = np.unique(rng.integers(0, 60, 25))
        starts, ends = cuts[:-1], cuts[1:]
        edges = np.unique(rng.choice(cuts, 6))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        want = [int(any(s < b and e > a for a, b in spans)) for s, e in zip(starts, ends)]
        assert chat.mask(starts, ends, spans).tolist() == want


def test_no_conversations(spark, chat_params):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none, chat_params), chat_params).isEmpty()


def test_blocks_of_awkward_markup():
    f = lambda h: [b.text for b in html_blocks.blocks(h).blocks]
    assert f("") == [] and f("plain &amp; text") == ["plain & text"]
    assert f("<p>a<b>b</b> c<br>d<p>e") == ["ab c d", "e"]
    assert f('<script>var t="</p><p>no";</script><p>yes') == ["yes"]
    assert f("<style>p{}</style><!-- <p>no --><p>a &lt; b 1 < 2</p>") == ["a < b 1 < 2"]
    assert f("<p>cut <fo") == ["cut"] and f("<p>x</p><!-- never closed <p>y") == ["x"]
    assert f('<p title="a > b">x</p>') == ["x"] and f("<DIV>x</DIV ><P\n>y") == ["x", "y"]
    assert f("<ul><li>a<li>b</ul>&nbsp;<td>c") == ["a", "b", "c"]
    page = html_blocks.blocks('<div class="Side-Bar x" id=n1><p>t')
    assert [page.path(b) for b in page.blocks] == [("div side bar x n 1", "p")] and page.fresh == [["<div", "side", "bar", "x", "n", "1"], ["<p"]]
    many = html_blocks.blocks(f'<div class="{" ".join(f"k{chr(97 + i)}" for i in range(20))} ad">t</div>')
    assert "ad" in many.entry[0] and len(many.entry[0]) == 22
    assert len(f("<p>x" * 5000)) == 5000 and f("<" * 2000) == ["<" * 2000]


@pytest.fixture(scope="module")
def model():
    return extraction.fit()


def test_held_out_made_pages(model):
    wrong = total = 0
    for html in made_pages.pages(200, 77):
        page, y = extraction.labelled(html)
        wrong += int((extraction.label(model, [page])[0] != y).sum())
        total += len(y)
    assert wrong / total < 0.025


def test_deep_pages_take_linear_time(model):
    """100,000 elements in each other, and 20,000 with a class and a text of their own each."""
    import time

    start = time.time()
    page = html_blocks.blocks("<div>" * 100_000 + "x")
    assert len(page.blocks) == 1 and time.time() - start < 3
    page = html_blocks.blocks("".join(f'<div class="k{i}">t{i} ' for i in range(20_000)))
    assert len(page.blocks) == 20_000 and len(extraction.label(model, [page])[0]) == 20_000
    assert time.time() - start < 30


def test_path_vectors_equal_plain_means():
    p = extraction.Params(path_buckets=64)
    pages = [html_blocks.blocks(h) for h in (*made_pages.pages(5, 8), "plain", "<div class='a b'><div class='b c'>x<p>y</p></div>z")]
    f = extraction.features(pages, p)
    table = np.random.default_rng(1).normal(size=(64, 3))
    got, count = extraction.path_means(table, f)
    want = []
    for page in pages:
        for b in page.blocks:
            tokens_ = []
            node, chain = b.node, []
            while node >= 0:
                chain.append(node)
                node = page.parent[node]
            seen = set()
            for n in chain[::-1]:
                for t in (f"<{page.entry[n][0]}", *page.entry[n][1:]):
                    if t not in seen:
                        seen.add(t)
                        tokens_.append(t)
            tokens_ += [f"leaf {t}" for t in page.entry[b.node]] if b.node >= 0 else ["leaf"]
            if len(chain) > 1:
                tokens_.append(f"{page.entry[chain[1]][0]}>{page.entry[chain[0]][0]}")
            want.append(np.mean([table[extraction._bucket(t, 64)] for t in tokens_], axis=0))
    assert np.allclose(got, want)
    # the gradient is the transpose of the same linear map
    d, g = np.random.default_rng(2).normal(size=got.shape), np.zeros_like(table)
    extraction.path_gradient(g, f, d, count)
    assert (g * table).sum() == pytest.approx((d * got).sum())


PAGE = """<html><head><title>T</title></head><body><nav><ul><li><a href=a>Home</a></ul></nav><div class=cookie-banner>We use cookies</div>
<article><h1>Title here</h1><p>First &eacute; para<br>goes on.</p><div class="ad">Buy now</div><p>Second.</p></article>
<section id=comments><p>I agree</p></section><form><label>Email</label></form><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest(model):
    assert extraction.main_texts(model, [PAGE, None, "", "<p></p>"]) == ["Title here\n\nFirst é para goes on.\n\nSecond.", "", "", ""]


#: Pages of shapes of their own: (html, main text).
HAND = [
    # no article, comments without class names, an advert inside the main column
    ("""<html><body><div id="masthead"><b>The Valley Post</b></div><div class="menu"><a href=/>Home</a> <a href=/w>World</a></div><div id="content"><h1>Bridge opens after two years</h1>
<p>The new bridge over the river was opened on Monday by the mayor and a small crowd.</p><div class="promo">Sponsored: buy two, get one free</div><p>Work began in spring and took longer than planned.</p></div>
<h3>Comments</h3><ul><li>Great news, thanks for the report</li><li>I agree, about time</li></ul><div id="footer">&copy; 2020 Valley Post. All rights reserved.</div></body></html>""",
     "Bridge opens after two years\n\nThe new bridge over the river was opened on Monday by the mayor and a small crowd.\n\nWork began in spring and took longer than planned."),
    # main with lists, a table of figures and a quotation
    ("""<body><header><a href="/">Kitchen notes</a><nav><ol><li><a href=/a>Soups</a><li><a href=/b>Breads</a></ol></nav></header><main><h1>Rye bread</h1><p>A loaf for four.</p><ul><li>500 g rye flour<li>300 ml water</ul>
<table><tr><th>Step</th><th>Minutes</th></tr><tr><td>Knead</td><td>10</td></tr></table><blockquote>Patience is the best spice.</blockquote></main><aside><h4>Related</h4><a href=/c>Wheat bread</a></aside><footer>Imprint</footer>""",
     "Rye bread\n\nA loaf for four.\n\n500 g rye flour\n\n300 ml water\n\nStep\n\nMinutes\n\nKnead\n\n10\n\nPatience is the best spice."),
    # sections, a sign-up form between paragraphs, a cookie dialog after them
    ("""<!DOCTYPE html><html><body class="single"><section class="post"><h2>On moss</h2><p>Moss grows slowly, even in the shade of old walls where little else would.</p>
<form class="newsletter"><label>Your email</label><button>Subscribe</button></form><p>It needs no roots to speak of.</p></section><div role="dialog" class="consent">We use cookies. Accept?</div></body></html>""",
     "On moss\n\nMoss grows slowly, even in the shade of old walls where little else would.\n\nIt needs no roots to speak of."),
]


def test_pages_written_by_hand(model):
    assert extraction.main_texts(model, [h for h, _ in HAND]) == [t for _, t in HAND]


def test_batching_does_not_change_labels(model):
    pages = [*made_pages.pages(30, 5), PAGE]
    assert extraction.main_texts(model, pages) == [extraction.main_texts(model, [p])[0] for p in pages]


def test_extraction_rows(spark, model):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extraction.extract(df, model)
    assert out.columns == ["page_id", "url", "text", "text_", "n_chars"] and out.count() == 5
    assert all(r.n_chars == len(r.text_) for r in out.collect())
    assert extraction.extract(df.where("false"), model).isEmpty()


def test_lstm_gradient():
    """Back-propagation through time against finite differences."""
    rng = np.random.default_rng(1)
    t, n, size, k = 5, 3, 4, 3
    x, wx, wh, b = rng.normal(size=(t, n, size)), rng.normal(size=(size, 4 * k)), rng.normal(size=(k, 4 * k)), rng.normal(size=4 * k)
    c = rng.normal(size=(t, n, k))
    f = lambda: float((extraction._run(x, wx, wh, b, False)[0] * c).sum())
    hs, cs, gates = extraction._run(x, wx, wh, b, True)
    gx, gh, gb, dx = extraction._back(x, wx, wh, hs, cs, gates, c)
    for arr, g in ((wx, gx), (wh, gh), (b, gb), (x, dx)):
        for i in map(tuple, rng.integers(0, arr.shape, (6, arr.ndim))):
            old = arr[i]
            arr[i] = old + 1e-6
            up = f()
            arr[i] = old - 1e-6
            down = f()
            arr[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from seqloom.llm import near_dup

    from .test_classifiers import BAD, labelled
    from .test_near_dup import brute
    from .test_search import shingles

    r = random.Random(9)
    base = labelled(21, 150)
    docs = [(i, t, lang) for i, t, lang, _ in base]
    docs += [(1000 + i, t, lang) for i, t, lang, y in base[:20]] + [(2000 + i, t + " end", lang) for i, t, lang, y in base[30:50]]
    item = " ".join(f"item{i}" for i in range(20))
    docs += [(3000 + i, " ".join(f"pre{i}{j}" for j in range(30)) + " " + item, "aa") for i in range(3)]
    docs += [(i, t, None) for i, t in AWKWARD]
    kind = "doc_id long, text string, lang string"
    spark.createDataFrame(docs, kind).withColumn("source", near_dup.F.lit("s")).withColumn("n_chars", near_dup.F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, _, y in base], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = df.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/out{i}")
        df = spark.read.parquet(f"{tmp_path}/out{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or df.columns == columns
        kept.append({x.doc_id for x in df.select("doc_id").collect()})
    texts = {i: t for i, t, _ in docs}
    assert {9001, 9002, 9003}.isdisjoint(kept[0]) and len(kept[0]) > 0.95 * (len(docs) - 3)
    toxic = {i for i in kept[0] if any(b in (texts[i] or "").split() for b in BAD)}
    assert len((kept[0] - kept[1]) ^ toxic) <= 0.05 * len(docs)
    assert kept[2] == {x[0] for x in brute([(i, texts[i]) for i in kept[1]]) if x[3]}
    want = shingles(item)
    assert kept[3] == {i for i in kept[2] if 100 * len(want & shingles(texts[i])) < 80 * len(want)} and kept[3] != kept[2]
    assert kept[4] == kept[3]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_pipeline_of_empty_tables_and_clashing_names(spark, tmp_path):
    """No rows go through all stages; of rows with odd columns, nulls and repeats nothing crashes and columns stay."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, __lang string, __found string, found string"
    for name, rows in (("none", []), ("odd", [(i, t, None, "s", 1, "a", "b", "c", "d") for i, t in AWKWARD] + [(None, "one two", None, "s", 1, "a", "b", "c", "d")] * 2)):
        d = tmp_path / name
        spark.createDataFrame(rows, kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        df = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, str(d)).columns == df.columns
        assert corpus_pipeline.run(spark, str(d)).isEmpty()  # no language is learned, so no document stays
        kept = df
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            kept = stage(spark, kept, str(d))
        assert kept.columns == df.columns and kept.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, kept, str(d)).count() == kept.count()


def test_comments_in_elements_named_like_articles_are_left_out():
    m = extraction.fit()
    comments = "<div id='comments'><h3>Comments</h3><article><header>Ann</header><p>I have kept bees for ten years and never saw this happen anywhere.</p></article><article class='comment'><p>Great read, thanks for writing about the hives.</p><p>Second paragraph of my comment.</p></article></div>"
    page = f"<html><body><nav><a href=/>Home</a></nav><div class='content'><h1>On bees</h1><p>Bees fly far and make honey in the summer months.</p><p>They live in hives with many others.</p></div>{comments}<footer>Copyright 2020</footer></body></html>"
    thread = "<section class='comment-list'><ol><li><article class='body'><h4>Bob</h4><div class='content'><p>This is what I think about the article and its claims.</p></div></article></li></ol></section>"
    other = f"<body><main><article><h1>Title</h1><p>One paragraph here with words.</p><p>All rights reserved.</p></article>{thread}</main></body>"
    assert extraction.main_texts(m, [page, other]) == ["On bees\n\nBees fly far and make honey in the summer months.\n\nThey live in hives with many others.", "Title\n\nOne paragraph here with words.\n\nAll rights reserved."]
