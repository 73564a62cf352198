"""The queries that apply this subpackage's operators to the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opinara.llm import bpe, chunk_dedup, filteraudit, fingerprint, htmltext, langid, licenses, packing, pii, simhash, toxicity, urlfilter, vectorcodes
from opinara.llm.common import table


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), width=3)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokens=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_dedup": op1_chunk_dedup,
    "op2_fingerprint": op2_fingerprint,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit": op6_best_fit,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_html_text": op13_html_text,
}

#: A round of the codebooks: each part's nearest entry (n), then the entries' new places (c).
_NEAREST = """
        n{i} AS MATERIALIZED (SELECT rid, p.part, min([list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - c.v[j]) ** 2))::BIGINT, entry]) AS best
              FROM p JOIN c{i} c ON p.part = c.part GROUP BY rid, p.part),"""
_MOVED = """
        s{j} AS (SELECT part, entry, place, sum(x)::BIGINT AS total, count(*) AS n
              FROM (SELECT n.part, best[2] AS entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM n{i} n JOIN p ON n.rid = p.rid AND n.part = p.part) GROUP BY ALL),
        m{j} AS (SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS v FROM s{j} GROUP BY ALL),
        c{j} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{j} m ON c.part = m.part AND c.entry = m.entry),"""

ORACLE_SQL: dict[str, str] = {
    "op1_chunk_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
        g AS (SELECT doc_id, sha256(bare) AS text_sha256, count(*) OVER (PARTITION BY bare) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                          list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
                      coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false)] AS fails
              FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        n AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
                   WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        run AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda k: fails[ascii(filter_order[k]) - 64])[1] AS hit FROM n, orders),
        steps AS (SELECT run.*, step, fails[ascii(filter_order[step]) - 64] AS here,
                         len(list_filter(fails, lambda x: x)) AS failed FROM run, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (SELECT part, filter_order, step, sum(CASE WHEN hit IS NULL OR hit > step THEN docs ELSE 0 END) AS kept,
                     sum(CASE WHEN hit = step THEN docs ELSE 0 END) AS removed, sum(CASE WHEN here AND hit < step THEN docs ELSE 0 END) AS redundant,
                     sum(CASE WHEN here AND failed = 1 THEN docs ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
              FROM steps GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley,
               (sum(kept) OVER (PARTITION BY filter_order, step))::BIGINT AS kept_all FROM r""",
    "op12_vector_codes": """
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
                    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS v FROM k, (SELECT unnest(range(8)) AS part)),
        c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= 16),"""
    + "".join(_NEAREST.format(i=i) + _MOVED.format(i=i, j=i + 1) for i in range(6))
    + _NEAREST.format(i=6)
    + """
        r AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
              FROM n6 JOIN k ON n6.rid = k.rid GROUP BY n6.rid, vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               sha256((SELECT string_agg(array_to_string(v, ','), ',' ORDER BY part, entry) FROM c6)) AS codebooks_sha256 FROM r""",
}
