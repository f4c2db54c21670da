"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from broadloom.llm import ann, decontaminate, html_text, lattice_lm, near_dup, packing, prefix_trie, reshard, simplex_clusters, token_file, toxicity, url_filter, warc
from broadloom.llm.common import crc_mod, table
from broadloom.session import new_path
from broadloom.llm.registry import TEXT_QUERIES, text_query  # noqa: F401

#: Folder of the public vocabularies; each executor has it.
TOKENIZERS = os.environ.get("BROADLOOM_TOKENIZERS", "/opt/tokenizers")

#: Fixed by the contract of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@text_query("""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, v)),
m AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""")
def op1_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


@text_query(r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM l)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM l) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
""")
def op3_decontamination(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.mark_contaminated(docs, table(spark, sf, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@text_query()
def op7_near_dup(spark, sf):
    return near_dup.group_near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


#: Fixed by the contract: the score from which a document counts as toxic, and the held-out quarter.
TOXIC_FROM = 0.3


def toxicity_model(spark, docs, sf):
    """The machine, fitted on the labelled rows outside the held-out quarter."""
    return toxicity.fit_toxicity(docs, table(spark, sf, "labels"), crc_mod(F.col("doc_id"), 4) != 2)


@text_query()
def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf), name="score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@text_query()
def op5_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


@text_query()
def op10_html_text(spark, sf):
    return html_text.extract_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))


#: The layout to leave: one of 20 shards for each source, so that a hot source makes a hot shard.
OLD_SHARDS, NEW_SHARDS = 20, 24


@text_query()
def op9_reshard(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    out = reshard.reshard(docs, old, OLD_SHARDS, NEW_SHARDS, new_path(spark, "shards"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.rows.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                           F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@text_query()
def op8_lattice_lm(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return lattice_lm.score_documents(docs, crc_mod(F.col("doc_id"), 10) != 0, f"{TOKENIZERS}/piece_bpe_32k.model", group="lang")


@text_query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
""")
def op2_warc(spark, sf):
    return warc.archive_round_trip(table(spark, sf, "pages").select("page_id", "url", "html"))


@text_query()
def op4_ann(spark, sf):
    index = ann.build_index(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return ann.search(index, F.col("vec_id") % 20 == 0)


def _cluster_sql(dim=64, k=40, rounds=5):
    """Long form: one row per vector and component; each round is two tables."""
    out = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS a FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dim}),
x AS MATERIALIZED (SELECT r, unnest(a) AS y, unnest(range(1, {dim + 1})) AS p FROM v),
s AS (SELECT a, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), a) - 1 AS c FROM v WHERE vec_id IS NOT NULL ORDER BY 2 LIMIT {k}),
c0 AS MATERIALIZED (SELECT c, unnest(a) AS m, unnest(range(1, {dim + 1})) AS p FROM s)"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, d::BIGINT AS d, c FROM (SELECT r, c, sum((y - m) * (y - m)) AS d FROM x JOIN c{i} USING (p) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            out.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, p, coalesce((t - ((t % n) + n) % n) // n, m)::BIGINT AS m FROM c{i} LEFT JOIN
  (SELECT c, p, sum(y)::HUGEINT AS t, count(*)::HUGEINT AS n FROM x JOIN a{i} USING (r) GROUP BY c, p) USING (c, p))""")
    last = rounds
    return f"""WITH {",".join(out)},
h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{last} JOIN v USING (r) JOIN h USING (c)"""


@text_query(_cluster_sql())
def op11_simplex_clusters(spark, sf):
    return simplex_clusters.cluster_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@text_query()
def op12_token_file(spark, sf):
    files = token_file.write_token_files(table(spark, sf, "documents").select("doc_id", "text"), f"{TOKENIZERS}/word_bpe_49k.json")
    return files.read().select("doc_id", "start", "n_tokens", "ids_crc32")


@text_query("""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
                  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(said ORDER BY pos) AS own FROM t GROUP BY c),
h AS (SELECT c, own, (xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda k: ascii(k)::BIGINT),
        lambda a, k: list_reduce(list_transform(range(8), lambda z: z::BIGINT), lambda b, z: xor(b >> 1, (b & 1) * 3988292384::BIGINT), xor(a, k)), 4294967295::BIGINT),
        4294967295::BIGINT) % 9)::BIGINT AS h FROM o),
s AS (SELECT h.c, list_concat(coalesce(b.own[1:h], []), h.own[h + 1:]) AS q FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
m AS (SELECT c, d, q[1:d] AS k, d = len(q) AS ended FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM s)),
n AS (SELECT k, d, min(c) AS c, count(*) AS n, coalesce(strlen(k[d].t), 0) AS b, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended) AS e FROM m GROUP BY k, d),
p AS (SELECT n.*, u.c AS pc FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]),
ch AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS ch FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT p.*, coalesce(ch, 0) AS ch FROM p LEFT JOIN ch USING (k, d)),
up AS (SELECT k[1:a] AS k, a AS d, sum((ch = 0)::INT) AS leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT c::BIGINT AS conv_id, d::BIGINT AS depth, pc::BIGINT AS parent_conv_id, n::BIGINT AS n_convs, ch::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256 FROM f JOIN up USING (k, d)
""")
def op13_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
