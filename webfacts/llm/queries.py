"""The registered queries of the training-data operators: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webfacts.llm import cotraining, decontamination, line_dedup, mixing, near_vectors, periodic_runs, pieces, pii, quality_rules, simhash, token_counts, url_filter, whitening
from webfacts.plans.scalars import TEXT_SQL
from webfacts.sources.tables import load

#: Pages with one of these whole words in their visible text make the list of op3.
LISTED_WORDS = ("idiot", "scum", "pathetic", "disgusting")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the verdict of the label model for every document."""
    judged = quality_rules.judge_documents(load(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept")


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return pieces.digest_documents(load(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page; the list holds the canonical URLs of pages with unwanted words."""
    pages = load(spark, folder, "pages")
    judged = url_filter.judge_urls(pages, url_filter.listed_by_words(pages, LISTED_WORDS))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted from distinct pre-tokens."""
    return token_counts.count_tokens(load(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(load(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_counts(load(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document by two views that taught each other."""
    return cotraining.classify(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and class of every vector."""
    return near_vectors.near_vectors(load(spark, folder, "embeddings"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return pii.pii_digest(load(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that stay."""
    return line_dedup.line_report(load(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words of every document, and what is left without the repetitions."""
    return periodic_runs.run_report(load(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the leading eight components, each of variance one."""
    return whitening.whitened(load(spark, folder, "embeddings"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items these come from."""
    return decontamination.contamination(load(spark, folder, "documents"), load(spark, folder, "benchmark")).drop("longest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_sentencepiece, op3_url_filter, op4_token_counts, op5_simhash, op6_mixing,
        op7_quality_classifier, op8_near_vectors, op9_pii, op10_line_dedup, op11_periodic_runs, op12_whitening,
        op13_decontamination,
    )
}

#: DuckDB twins. The other operators are compared with brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_url_filter": r"""
        WITH parts AS (
          SELECT page_id, html,
                 lower(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END) AS host,
                 CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
          FROM pages),
        named AS (SELECT *, regexp_replace(host, '^www\.', '') || rtrim(path, '/') AS key FROM parts),
        listed AS (SELECT DISTINCT key FROM named WHERE regexp_matches(VISIBLE_TEXT, '(?i)(^|[^\p{L}\p{N}_])(idiot|scum|pathetic|disgusting)($|[^\p{L}\p{N}_])') AND key <> ''),
        rules(what, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                             ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
          SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(what, length(rhost || rpath)) AS what
          FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT n.page_id, n.host, n.path, f.rule,
               coalesce(f.what, CASE WHEN l.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               f.rule IS NULL AND l.key IS NOT NULL AS listed
        FROM named n LEFT JOIN fits f USING (page_id) LEFT JOIN listed l ON n.key = l.key
    """.replace("VISIBLE_TEXT", TEXT_SQL.format(h="html")),
    "op13_decontamination": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        i AS (
          SELECT item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        s AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
        wins AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM s, unnest(range(1, len(w) - k + 2)) AS t(p)),
        sizes AS (SELECT DISTINCT k FROM wins),
        places AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(p)),
        met AS (SELECT r, p, k, item_id FROM places JOIN wins USING (k, win)),
        hits AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT DISTINCT r, p, k FROM met) m, unnest(range(p, p + k)) AS t(q) GROUP BY r),
        named AS (
          SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT r, item_id FROM met) x GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits h USING (r) LEFT JOIN named m USING (r)
    """,
}
