"""Queries over the driver's tables and their DuckDB statements; __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, html_text, langid, line_dedup, mixing, packing, simhash, suffix_dedup, token_files


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark, sf_dir):
    d = mixing.plan_copies(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
a AS (SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
 coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
 coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
f AS (SELECT *, (1.5::DOUBLE * all_size - cap_before) * weight >= cap * (all_weight - weight_before) AS is_full FROM a),
u AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS used, sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS used_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE least(cap::DOUBLE, (1.5::DOUBLE * all_size - used) * weight / nullif(all_weight - used_weight, 0)) END AS target FROM u),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
 ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(_docs(spark, sf_dir).select("doc_id", "text"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
 count(*) OVER (PARTITION BY norm) AS group_size,
 doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS kept, sha256(norm) AS text_sha256 FROM d
"""

def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir).select("doc_id", "text"))


def op3_line_dedup(spark, sf_dir):
    d = line_dedup.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op4_simhash(spark, sf_dir):
    return simhash.near_copies(_docs(spark, sf_dir).select("doc_id", "text"))


def op5_token_files(spark, sf_dir):
    return token_files.write_and_read(_docs(spark, sf_dir).select("doc_id", "text"))


def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of equal labels, and the closure of their links.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON u = vec_id
"""


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.drop_repeats(_docs(spark, sf_dir).select("doc_id", "text")).drop("kept")


#: Every string of 50 bytes with the least document that holds it, then the runs that those of others cover.
OP7_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, h FROM b), s AS (SELECT doc_id, i, h[i + 1 : i + 50] AS s FROM w),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s JOIN f USING (s) WHERE first < doc_id),
m AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM m GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM r),
x AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(CASE WHEN lo > since THEN hex(h[since + 1 : lo]) ELSE '' END, '' ORDER BY lo) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(kept, '') || CASE WHEN n > coalesce(last, 0) THEN hex(h[coalesce(last, 0) + 1 : n]) ELSE '' END)) AS kept_sha256 FROM b LEFT JOIN x USING (doc_id)
"""


def op9_language_id(spark, sf_dir):
    return langid.identify(_docs(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op10_html_text(spark, sf_dir):
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_best_fit_packing, op3_line_dedup, op4_simhash, op5_token_files, op6_embedding_dedup, op7_suffix_dedup, op8_exact_dedup, op9_language_id, op10_html_text)}
SQL = {"op1_mix_sources": OP1_SQL, "op3_line_dedup": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL}
