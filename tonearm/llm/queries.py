"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, jaccard, license, mixing, pii, quality, tokens, topk, urls, warc, whitening
from .common import remainder, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (F.coalesce(remainder(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "score", "predicted", "n_passages")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licenses").alias("n_licenses"), families.alias("families"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_token_counts, op3_quality_classifier, op4_benchmark_decontamination, op5_warc, op6_license_scans, op7_pii, op8_url_filters, op9_exact_topk, op10_mixing, op11_centroid_clustering, op12_byte_level_bpe, op13_embedding_whitening)
    return {f.__name__: f for f in own}


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: list_slice(w, i, i + least(len(w), 13) - 1))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM spots) s JOIN windows x ON x.n = s.n AND x.win = s.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
y AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM y"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: (abs(64 * CAST(x AS DOUBLE)) + 1) * (abs(64 * CAST(x AS DOUBLE)) + 1))) * len(embedding) <= 1152921504606846976),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, CASE WHEN len(q.v) = len(c.v) THEN CAST(list_inner_product(q.v, c.v) AS BIGINT) END AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

OP10 = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS r, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least((SELECT arg_min(level, r) FROM l WHERE level <= r) * weight, cap), cap) AS target FROM l),
g AS (SELECT *, target - whole * source_size AS missing FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t)),
z AS (SELECT d.source, d.size, g.missing, count(*) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE d.size > 0 GROUP BY 1, 2, 3),
f AS (SELECT a.source, a.size, (a.missing - coalesce((SELECT sum(b.size * b.n) FROM z b WHERE b.source IS NOT DISTINCT FROM a.source AND b.size > a.size), 0))
    / CAST((SELECT sum(CAST(b.size AS HUGEINT) * b.size * b.n) FROM z b WHERE b.source IS NOT DISTINCT FROM a.source AND b.size <= a.size) AS DOUBLE) AS factor FROM z a),
h AS (SELECT source, arg_max(factor, size) AS factor FROM f WHERE factor * size < 1 GROUP BY 1),
o AS (SELECT d.*, g.source_size, g.target, g.whole, g.missing, d.size * h.factor AS p, (draw + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, CASE WHEN size = 0 OR missing <= 0 THEN NULL WHEN p >= 1 THEN 0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS q FROM o),
x AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY CAST(floor(q / (1 + q) * 281474976710656.0::DOUBLE) AS BIGINT), doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT doc_id, source, size, source_size, target, (whole + CASE WHEN q IS NOT NULL AND (run - missing) * 2 <= size THEN 1 ELSE 0 END) * size AS taken FROM x"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_decontamination": OP4,
        "op5_warc": OP5,
        "op8_url_filters": urls.sql(),
        "op9_exact_topk": OP9,
        "op10_mixing": OP10,
        "op11_centroid_clustering": centroids.sql(),
    }
