"""The registered queries over a small folder of tables: contracts, and brute force where there is no SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from seqloom.llm import queries as q
from seqloom.llm import tokens

from .helpers import AWKWARD
from .test_classifiers import LANGS, labelled, text
from .test_documents import PAGE
from .test_near_dup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(4)
    docs = [(i, t, lang, "s", len(t)) for i, t, lang, _ in labelled(31, 120)]
    docs += [(500 + i, text(r, lang), lang, "s", 1) for i, lang in enumerate(list(LANGS) * 25)]
    docs += [(900 + i, docs[i][1], "aa", "s", 1) for i in range(5)] + [(i, t, None, None, None) for i, t in AWKWARD if i != 9008] + [(9009, "1 2 3 ...", "aa", "s", 1)]

    def put(name, rows, kind):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{d}/{name}.parquet")

    put("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [(x[0], 1, x[3]) for x in labelled(31, 120)], "doc_id long, quality int, toxic int")
    put("benchmark", [(1, docs[3][1]), (2, "no such words here at all")], "item_id long, text string")
    put("pages", [(1, "https://m.casino-win.example.com/en/1?x", PAGE), (2, None, None), (3, "http://a.org/x", "<p>")], "page_id long, url string, html string")
    put("conversations", [(1, 1, "assistant", "b <|end|> \\"), (1, 0, "user", None), (2, 0, "assistant", "é"), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    put("embeddings", [(i, [r.gauss(0, 0.2) for _ in range(6)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int")
    return str(d), docs


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, folder, name):
    d, _ = folder
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = q.queries()[name](spark, d)
    want = c.sql(q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [tuple(r[x] for x in cols) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.select(*cols).fetchall())) and rows


def test_op1_lengths(spark, folder):
    d, docs = folder
    enc = tokens.encoder(tokens.public("word_bpe_49k.json")).tokenizer
    got = sorted((x.doc_id, x.n_tokens) for x in q.op1_packing(spark, d).collect())
    assert got == sorted((x[0], len(enc.encode(x[1] or "", add_special_tokens=False).ids) + 1) for x in docs)


@pytest.mark.parametrize("name,mod,rest,columns", [("op2_toxicity", 5, 0, ["doc_id", "held_out", "score", "predicted"]), ("op6_language_id", 4, 2, ["doc_id", "held_out", "lang_pred", "score"])])
def test_classifier_contracts(spark, folder, name, mod, rest, columns):
    d, docs = folder
    got = q.queries()[name](spark, d)
    assert got.columns[:4] == columns
    rows = got.collect()
    assert sorted(x.doc_id for x in rows) == sorted(x[0] for x in docs)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % mod == rest) and 0 <= x.score <= 1 for x in rows)
    if name.startswith("op6"):
        truth = {x[0]: x[2] for x in docs if 500 <= x[0] < 600}
        assert np.mean([x.lang_pred == truth[x.doc_id] for x in rows if x.held_out and x.doc_id in truth]) > 0.9
        assert {x.doc_id for x in rows if x.lang_pred == "und"} >= {9001, 9002, 9003, 9009}
    else:
        assert all(x.predicted == int(x.score >= 0.5) for x in rows)


def test_op3_equals_brute_force(spark, folder):
    d, docs = folder
    assert sorted(map(tuple, q.op3_minhash_near_dedup(spark, d).collect())) == brute([x[:2] for x in docs])


def test_op8_texts(spark, folder):
    got = {x.page_id: x for x in q.op8_html_extraction(spark, folder[0]).collect()}
    assert got[1].text == "Title here\n\nFirst é para goes on.\n\nSecond." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")


def test_op9_digests(spark, folder):
    got = {x.conv_id: x for x in q.op9_chat_formatting(spark, folder[0]).collect()}
    hard = "\\### Assistant: </turn> ok"
    for c, turns in {1: [("user", ""), ("assistant", "b <|end|> \\")], 2: [("assistant", "é"), ("assistant", "")], -7: [("user", hard), ("assistant", hard)]}.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (2, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 3


def test_op10_ids(spark, folder):
    d, docs = folder
    enc, at = tokens.encoder(tokens.public("word_bpe_49k.json")).tokenizer, 0
    got = {x.doc_id: x for x in q.op10_token_store(spark, d).collect()}
    for i, t in sorted(x[:2] for x in docs):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)
