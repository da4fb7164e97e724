"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_store, tokens

    path = common.scratch(spark, "store")
    token_store.write_store(common.table(spark, sf_dir, "documents"), path, token_store.Params(tokens.public("word_bpe_49k.json")))
    return token_store.read_store(spark, path, ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid, tokens

    docs = common.table(spark, sf_dir, "documents")
    p = langid.Params(tokens.public("piece_bpe_32k.model"))
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs, p))
    return out.select("doc_id", (common.crc_mod("doc_id", p.held_mod) == p.held_rest).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, p = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), toxicity.Params()
    out = toxicity.classify(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels"), p))
    return out.select("doc_id", (common.crc_mod("doc_id", p.held_mod) == p.held_rest).alias("held_out"), "score", "predicted", "threshold", "flagged")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing, tokens

    return packing.pack(common.table(spark, sf_dir, "documents"), packing.Params(tokens.public("word_bpe_49k.json")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    listed = spark.createDataFrame([(x,) for x in url_filter.default_list()], "domain string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat, tokens

    p = chat.Params(tokens.public("byte_bpe_50k.json"))
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_conversations(rows, p), p)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(common.table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import extraction

    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages, extraction.fit())


def op11_exact_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_fit, tokens

    return exact_fit.pack(common.table(spark, sf_dir, "documents"), exact_fit.Params(tokens.public("word_bpe_49k.json")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _planted(doc_id: object, n: int):
    """The words of one document in ten repeat from some place on; which, where and how often depends on its number and length."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import runs

    return runs.digests(runs.detect(common.table(spark, sf_dir, "documents"), places=_planted))


_WORDS = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)"""

OP3_SQL = f"""
WITH RECURSIVE {_WORDS},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d WHERE r.c < e.y),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM (SELECT DISTINCT doc_id FROM documents) q LEFT JOIN n USING (doc_id) JOIN m ON m.d = q.doc_id
"""

OP4_SQL = f"""
WITH {_WORDS},
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM bw),
q AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN b USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, CAST(c AS DOUBLE) / n AS containment FROM p JOIN q USING (item_id) WHERE 100 * c >= 80 * n
"""

OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


_RESAMPLED = """
  SELECT {id}list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}"""
# crc32 byte by byte over a table of 256 entries, for each distinct word
OP12_SQL = f"""
WITH tb AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(x AS BIGINT) for x in range(8)]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)),
d AS ({_RESAMPLED.format(id="doc_id, ", table="documents")}),
b AS ({_RESAMPLED.format(id="", table="benchmark")}),
u AS (SELECT DISTINCT unnest(w) AS f FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS g FROM (SELECT f, hex(encode(f)) AS x FROM u), tb),
n AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
e AS (SELECT r, unnest(w) AS f FROM n),
s AS (SELECT g, count(*) AS s FROM e JOIN k USING (f) GROUP BY g),
t AS (SELECT g, count(*) AS t FROM (SELECT unnest(w) AS f FROM b) JOIN k USING (f) GROUP BY g),
v AS (SELECT range AS g, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM range(10000) LEFT JOIN s ON s.g = range LEFT JOIN t ON t.g = range),
m AS (SELECT r, sum(gain) AS m FROM e JOIN k USING (f) JOIN v USING (g) GROUP BY r),
c AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(m, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM n LEFT JOIN m USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM c),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_url_filters": OP7_SQL, "op5_exact_top_k": OP5_SQL, "op12_importance_resampling": OP12_SQL}
