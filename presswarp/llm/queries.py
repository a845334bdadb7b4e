"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, fill_in_middle, fingerprints, language, licenses, media, mixing, near_dup, quality, token_files, url_filter, whitening

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = media.media_tiles(media.text_media(_documents(spark, sf_dir)), "image")
    return media.tile_digests(media.stored_tiles(tiles)).withColumnRenamed("dhash", "feature")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(_documents(spark, sf_dir), WORD_VOCABULARY)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.contract_rules(spark))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_report(_documents(spark, sf_dir), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fim_report(_documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_source_mixing, op3_media_columns, op4_license_scan, op5_token_files, op6_url_filter, op7_byte_bpe, op8_minhash_near_dedup, op9_weighted_fingerprints, op10_language_id, op11_fill_in_middle, op12_embedding_whitening, op13_benchmark_decontamination)}

ORACLES = {
    "op2_source_mixing": r"""
        WITH r AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS random
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS most FROM s),
        l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                     / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
                     row_number() OVER o AS place
              FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), source ASC NULLS LAST)),
        t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce((SELECT arg_min(level, place) FROM l WHERE level * weight <= most), 0) * weight) AS target FROM l),
        p AS (SELECT r.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
                     coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY random, doc_id ASC NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
        FROM p""",
    "op6_url_filter": r"""
        WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        p AS (SELECT page_id, row_number() OVER () AS k, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        m AS (SELECT p.*, rule_verdict, rule_host || rule_path AS rule,
                     row_number() OVER (PARTITION BY k ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, rule_verdict = 'allow', rule_host || rule_path) AS place
              FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE place = 1""",
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
                           FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reached),
        m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        n AS (SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
        p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
    "op13_benchmark_decontamination": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        q AS MATERIALIZED (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS m, array_to_string(w[s : s + 9], ' ') AS words
                           FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)),
        m AS (SELECT DISTINCT m FROM q),
        p AS (SELECT k, m, s, array_to_string(w[s : s + m - 1], ' ') AS words FROM (SELECT k, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, m)),
        f AS MATERIALIZED (SELECT DISTINCT k, p.m, s, item FROM p JOIN q ON p.words = q.words AND p.m = q.m),
        h AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT k, unnest(range(s, s + m)) AS place FROM f) GROUP BY k),
        n AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM f) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (k) LEFT JOIN n USING (k)""",
}
