"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import parse_transcripts, transcripts
from .decontaminate import find_leaks
from .fill_middle import fill_in_middle, restored
from .html_extract import extract_main_text
from .line_dedup import dedup_lines
from .minmax import near_duplicates
from .ngram_join import jaccard_components
from .packing import pack
from .quality import judge_quality
from .shared import table, tokenizer_path
from .sharding import assign_shards
from .substring_dedup import dedup_substrings
from .url_filter import judge_urls
from .vector_codes import vector_codes


#: The rules of op3, fixed values.
URL_RULES = {"allow": ["com/", "www.example.com/en/"], "block": ["example.com/en/", "net/es/", "net/fr/"]}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, per_cent=85, lower=True)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_words=5).select("doc_id", "n_removed", "text")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_transcripts(transcripts(table(spark, sf_dir, "conversations")))  # no speaker is given: roles come from the model


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), limit=16 << 20)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=13, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), size=1024)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = (F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, per_cent=80, lower=True)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filters": op3_url_filters,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

_OP8 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, hash(array_to_string(ws[i:i + 12], ' ')) AS h, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM dup
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j GROUP BY words.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

_OP10 = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), nl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN nl ON nl.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id
), m AS (
  SELECT doc_id, lang, source, 'symbols' AS metric, 35 AS spread, n_symbols * 1000 // greatest(n_words, 1) AS x FROM f
  UNION ALL SELECT doc_id, lang, source, 'word_length', 1500, word_chars * 1000 // greatest(n_words, 1) FROM f
  UNION ALL SELECT doc_id, lang, source, 'dup_lines', 170, n_dup_lines * 1000 // greatest(n_lines, 1) FROM f
), b AS (
  SELECT *, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS bucket FROM m
), s AS (SELECT lang, source, metric, spread, bucket, CAST(count(*) AS HUGEINT) AS n FROM b GROUP BY ALL
), l AS (SELECT lang, metric, bucket, CAST(sum(n) AS HUGEINT) AS n FROM s GROUP BY ALL
), t AS (SELECT lang, metric, CAST(sum(n) AS HUGEINT) AS total FROM l GROUP BY ALL
), g AS (SELECT DISTINCT lang, source, metric, spread FROM s
), weighted AS (
  SELECT 'own' AS kind, lang, source, metric, spread, bucket, n FROM s
  UNION ALL SELECT 'merged', s.lang, source, s.metric, spread, bucket, n * total FROM s JOIN t ON t.lang IS NOT DISTINCT FROM s.lang AND t.metric = s.metric
  UNION ALL SELECT 'merged', g.lang, source, g.metric, spread, bucket, 100 * n FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.metric = g.metric
), c AS (SELECT kind, lang, source, metric, spread, bucket, CAST(sum(n) AS HUGEINT) AS n FROM weighted GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY kind, lang, source, metric) AS total, sum(n) OVER (PARTITION BY kind, lang, source, metric ORDER BY bucket) AS upto FROM c
), k AS (
  SELECT kind, lang, source, metric, spread, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3 FROM u GROUP BY ALL
), h AS (SELECT lang, source, metric, max(q3 + 3 * greatest(q3 - q1, spread)) AS threshold FROM k GROUP BY ALL
), q AS (
  SELECT b.doc_id, b.x, h.threshold FROM b JOIN h ON h.lang IS NOT DISTINCT FROM b.lang AND h.source IS NOT DISTINCT FROM b.source AND h.metric = b.metric
), within AS (SELECT doc_id, bool_and(x <= threshold) AS ok FROM q GROUP BY doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ok AS kept
FROM f JOIN within ON within.doc_id = f.doc_id
"""

_OP3 = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best ON best.page_id = u.page_id
"""

_OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

_OP12 = (
    r"""
WITH v AS (
  SELECT vec_id, label, len(embedding) // 16 AS w, unnest(range(len(embedding))) AS j, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM unnest(embedding) t(c) WHERE c IS NULL OR NOT isfinite(c))
), x AS MATERIALIZED (SELECT vec_id, label, j // w AS part, list(x ORDER BY j) AS x FROM v GROUP BY ALL
), b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM x WHERE vec_id IN (SELECT DISTINCT vec_id FROM x ORDER BY vec_id LIMIT 64)
)"""
    + "".join(
        rf""", n{r} AS MATERIALIZED (
  SELECT vec_id, part, min(list_sum(list_transform(list_zip(x.x, b{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM x JOIN b{r} USING (part) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(list(y ORDER BY j), any_value(old)) AS x FROM (
    SELECT b{r}.part, b{r}.e, any_value(b{r}.x) AS old, j, floor(sum(c)::HUGEINT / count(c))::BIGINT AS y
    FROM b{r} LEFT JOIN (SELECT part, m % 64 AS e, unnest(range(len(x))) AS j, unnest(x) AS c FROM n{r} JOIN x USING (vec_id, part)) USING (part, e) GROUP BY b{r}.part, b{r}.e, j
  ) GROUP BY part, e
)"""
        for r in range(2)
    )
    + r""", n2 AS (
  SELECT vec_id, label, part, min(list_sum(list_transform(list_zip(x.x, b2.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM x JOIN b2 USING (part) GROUP BY ALL
), c AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(m % 64 AS BIGINT))), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM n2 GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM c
"""
)

_OP13 = f"SELECT *, doc_id = component_id AS kept FROM ({_OP1.replace('85 *', '80 *')})"

ORACLE_SQL = {"op3_url_filters": _OP3, "op10_quality_rules": _OP10, "op1_ngram_jaccard_join": _OP1, "op8_substring_dedup": _OP8, "op11_fill_in_middle": _OP11, "op12_vector_codes": _OP12, "op13_minhash_near_dedup": _OP13}
