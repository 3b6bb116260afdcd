"""The queries of the operators, over their whole tables, and the SQL that some are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import (
    byte_pairs, collocations, decontamination, divergence, embedding_links, html_text, language_model, license_scan, quality_classifier, quality_rules, simhash, token_counts, token_files,
)
from lumenlog.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.totals(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_BPE))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_html_extraction, op3_simhash, op4_token_files, op5_license_scan, op6_token_counts,
        op7_quality_classifier, op8_decontamination, op9_byte_bpe, op10_language_model, op11_source_divergence,
        op12_embedding_links, op13_collocations,
    )
}

_SHARES = """
        CASE WHEN n_chars > 0 THEN n_symbols * 1000 // n_chars ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
        CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
        CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END AS upper"""

ORACLES = {
    "op1_quality_rules": rf"""
WITH w AS (
    SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
), g AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest([0, 1, 2]) AS k)
    GROUP BY doc_id
), m AS (
    SELECT w.doc_id, w.lang, w.t, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, length(t) AS n_chars, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
    FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), s AS (
    SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,{_SHARES}
    FROM m
), known AS (
    SELECT lang, min(quality) = 1 AS good, any_value(symbols) AS symbols, any_value(dup_lines) AS dup_lines, any_value(repeats) AS repeats, any_value(upper) AS upper
    FROM s JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
    GROUP BY lang, t
), long AS (UNPIVOT known ON symbols, dup_lines, repeats, upper INTO NAME rule VALUE share), tests AS (
    SELECT lang, rule, cutoff, sum(good::INT)::BIGINT AS n, sum((good AND share > cutoff)::INT)::BIGINT AS k, sum((NOT good AND share > cutoff)::INT)::BIGINT AS caught
    FROM long, (SELECT unnest(range(25, 1000, 25)) AS cutoff) GROUP BY ALL
), held AS (
    SELECT *, CASE WHEN k >= n * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
        lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.005) + (n - j) * ln(0.995)))) END AS p,
        (SELECT count(DISTINCT lang) FROM tests WHERE n > 0) AS strata
    FROM tests WHERE n > 0
), chosen AS (
    SELECT lang, rule, cutoff FROM held WHERE p * strata * 4 <= 0.05 AND caught > k
    QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - k DESC, cutoff DESC) = 1
), wide AS (
    SELECT lang, max(cutoff) FILTER (rule = 'symbols') AS c1, max(cutoff) FILTER (rule = 'dup_lines') AS c2,
        max(cutoff) FILTER (rule = 'repeats') AS c3, max(cutoff) FILTER (rule = 'upper') AS c4
    FROM chosen GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (coalesce(symbols > c1, false) OR coalesce(dup_lines > c2, false) OR coalesce(repeats > c3, false) OR coalesce(upper > c4, false)) AS kept
FROM s LEFT JOIN wide ON s.lang IS NOT DISTINCT FROM wide.lang""",
    "op8_decontamination": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), q AS (
    SELECT DISTINCT item_id, list_slice(ws, i, i + least(10, len(ws)) - 1) AS win
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)
), p AS (
    SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS win
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT len(win) AS n FROM q))
), hits AS (SELECT doc_id, i, n, item_id FROM p JOIN q USING (win)), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_source_divergence": r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents
), c AS (
    SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL
), k AS (SELECT lang, term, sum(c)::HUGEINT AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
full_counts AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0)::HUGEINT AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
priced AS (
    SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER w + count(*) OVER w)::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (total + 1) // (sum(total) OVER w + count(*) OVER w)::HUGEINT AS q
    FROM full_counts WINDOW w AS (PARTITION BY lang, source)
), pairs AS (
    SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND other = y.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM priced WHERE c > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200""",
    "op12_embedding_links": r"""
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS e,
        coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
    FROM embeddings
), links AS (
    SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.id <> b.id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (SELECT id AS a, id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.id
JOIN (SELECT reach.a, min(x.vec_id) AS component_id FROM reach JOIN v x ON x.id = reach.b GROUP BY reach.a) r ON r.a = v.id""",
    "op13_collocations": r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
    FROM documents
), g AS (
    SELECT lang, k, list_slice(ws, i, i + k - 1) AS w, count(*)::HUGEINT AS f
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k) GROUP BY ALL
), c AS (SELECT lang, k, w, f AS a FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, w, a, list_slice(w, 1, i) AS first, list_slice(w, i + 1, k) AS rest, i FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
scored AS (
    SELECT cuts.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
    FROM cuts JOIN g x ON x.lang = cuts.lang AND x.w = cuts.first JOIN g y ON y.lang = cuts.lang AND y.w = cuts.rest
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, i) = 1),
inner_phrases AS (SELECT lang, list_slice(w, i, i + 1) AS w, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.*, array_to_string(s.w, ' ') AS phrase FROM weakest s LEFT JOIN inner_phrases o ON o.lang = s.lang AND o.w = s.w WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang) t USING (lang) QUALIFY rank <= 2000""",
}
