"""Queries of this subpackage, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, collocations, hard_negatives, jaccard, lines, minhash, packing, quality_knn, rules, secret_scan, simhash, toxicity, warc
from chartloom.sources.tables import scratch_path

Plan = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.learn_and_score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "quality", 5, 0, 0.3)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_next(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "toxic", 3, 1, 0.7)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"), ["doc_id"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_read(spark, sf_dir, "pages"), scratch_path(spark, "warc")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Plan] = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_lines": op7_lines,
    "op8_rules": op8_rules,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op7_lines": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        s AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        w AS (
            SELECT doc_id, k, line AS a, lead(line) OVER p AS b, lead(line, 2) OVER p AS c
            FROM s WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
        v AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM w WHERE c IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, k + d AS k FROM v, (VALUES (0), (1), (2)) t(d) WHERE nth > 1),
        marked AS (
            SELECT l.doc_id, l.pos, l.line, gone.k IS NOT NULL AS removed
            FROM l LEFT JOIN s USING (doc_id, pos) LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.k = s.k)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') AS text,
               count(*) AS n_lines, count(*) FILTER (removed) AS n_removed
        FROM marked GROUP BY doc_id""",
    "op8_rules": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        g AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
        r AS (
            SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words
            FROM g, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
        l AS (
            SELECT doc_id, count(*) AS n_full, count(*) - count(DISTINCT line) AS n_dup
            FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        b AS (
            SELECT t.doc_id, x, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
                   coalesce(n_full, 0) AS n_full, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   length(regexp_replace(x, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(x, '[^a-z]', '', 'g')) AS lower,
                   length(regexp_replace(x, '[^!]', '', 'g')) AS marks, length(regexp_replace(x, '[^0-9]', '', 'g')) AS digits
            FROM t LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 4 * n_symbols > n_words OR upper > lower + upper // 2 OR 3 * marks > n_words
                    OR 3 * digits > strlen(x) OR (n_full >= 4 AND 2 * n_dup_lines > n_full)
                    OR strlen(x) > 60 * greatest(n_words, 1)) AS kept
        FROM f""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op11_collocations": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
            FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, ph, count(*) AS a
            FROM (SELECT lang, ws[i : i + k - 1] AS ph
                  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k)))
            GROUP BY lang, ph HAVING count(*) >= 100),
        c AS (SELECT * FROM g WHERE len(ph) > 1),
        inner_ones AS (
            SELECT lang, ph[i : i + m - 1] AS ph, max(a) AS over
            FROM (SELECT *, unnest(range(1, len(ph) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(ph))) AS m FROM c))
            GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.ph, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
            FROM (SELECT *, unnest(range(1, len(ph))) AS k FROM c) c
            JOIN g l ON l.lang = c.lang AND l.ph = c.ph[1 : k] JOIN g r ON r.lang = c.lang AND r.ph = c.ph[k + 1 : len(c.ph)]
            JOIN total ON total.lang = c.lang
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.ph ORDER BY score, k) = 1),
        kept AS (SELECT cuts.*, array_to_string(cuts.ph, ' ') AS phrase FROM cuts LEFT JOIN inner_ones i USING (lang, ph) WHERE over IS NULL OR over < a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
               phrase, a, l, r, n, score::BIGINT AS score
        FROM kept QUALIFY rank <= 2000""",
    "op13_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score
            FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (
            SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
