"""Queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from indexloom.llm import chunk_bpe, collocations, decontam, filter_audit, html_main, jaccard_join, knn_quality, license_scan, pii, plane_files, ppm_lang, quality_rules, textops, url_filter


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_docs(spark, sf_dir))


def op2_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = textops.shared_dir(spark, "plane-files")
    plane_files.write_ids(_docs(spark, sf_dir), folder)
    return plane_files.read_digests(spark, folder)


def op3_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_ppm_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_lang.identify(_docs(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_docs(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_docs(spark, sf_dir))


def op8_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_digests(_docs(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(_docs(spark, sf_dir)).drop("finds")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_plane_files, op3_suffix_decontam, op4_knn_quality, op5_ppm_lang, op6_jaccard_join, op7_quality_rules, op8_html_main, op9_chunk_bpe, op10_license_scan, op11_url_filter, op12_filter_audit, op13_collocations)}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS w FROM benchmark),
item_places AS (SELECT iid, item_id, p AS q, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
doc_windows AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT d.rid, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM item_windows) l WHERE len(d.w) >= l.n)),
hits AS (SELECT x.rid, x.p, x.n, i.item_id FROM doc_windows x JOIN item_windows i ON i.n = x.n AND i.k = x.k),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
placed AS (SELECT x.rid, x.p, i.q, i.n, i.iid, i.item_id FROM doc_windows x JOIN item_places i ON i.n = x.n AND i.k = x.k),
runs AS (SELECT rid, iid, coalesce(CAST(item_id AS VARCHAR), '') AS item, min(q) - 1 AS item_start, min(p) - 1 AS doc_start, max(q) - min(q) + max(n) AS n_words FROM (SELECT *, q - row_number() OVER (PARTITION BY rid, iid, p - q ORDER BY q) AS g FROM placed) GROUP BY rid, iid, item_id, p - q, g),
reaching AS (SELECT DISTINCT rid, iid, item, item_start, doc_start, n_words FROM (SELECT *, max(doc_start + n_words) OVER (PARTITION BY rid, iid ORDER BY doc_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid, iid, doc_start ORDER BY n_words DESC, item_start) = 1)) WHERE before IS NULL OR doc_start + n_words > before),
longest AS (SELECT rid, max(n_words) AS longest_match, string_agg(item || ':' || item_start || ':' || doc_start || ':' || n_words, ',' ORDER BY doc_start, item, item_start, n_words) AS matches FROM (SELECT DISTINCT rid, item, item_start, doc_start, n_words FROM reaching) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(g.longest_match, 0) AS longest_match, coalesce(g.matches, '') AS matches
FROM d LEFT JOIN covered c ON c.rid = d.rid LEFT JOIN found f ON f.rid = d.rid LEFT JOIN longest g ON g.rid = d.rid"""

_OP6 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END)) AS s FROM d),
sh AS (SELECT rid, len(s) AS n, unnest(s) AS k FROM sets),
links AS (SELECT a.rid AS a, b.rid AS b FROM sh a JOIN sh b ON a.k = b.k AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reach AS (SELECT rid, rid AS other FROM sets UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other),
named AS (SELECT r.rid, min(o.doc_id) AS class_id, count(*) AS class_size FROM reach r JOIN sets o ON o.rid = r.other GROUP BY r.rid),
degree AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT s.doc_id, n.class_id, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY array_to_string(s.s, '|')) END AS rep_id, coalesce(g.n, 0) AS n_links, n.class_size
FROM sets s JOIN named n ON n.rid = s.rid LEFT JOIN degree g ON g.rid = s.rid"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

_OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
failed AS (SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 2 * length(d.t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN d.doc_id > l.first THEN 'E' ELSE '' END) AS f
    FROM d JOIN least l ON l.t = d.t LEFT JOIN marks m ON m.doc_id = d.doc_id),
steps AS (SELECT o AS filter_order, CAST(s AS INTEGER) AS step, substring(o, s, 1) AS letter, left(o, s - 1) AS earlier FROM (VALUES {_ORDERS}) v(o) CROSS JOIN range(1, 6) r(s)),
placed AS (SELECT failed.*, steps.*, contains(f, letter) AS fails, length(translate(f, earlier, '')) < length(f) AS gone FROM failed CROSS JOIN steps)
SELECT part, filter_order, step, count(*) FILTER (WHERE NOT fails AND NOT gone) AS kept, count(*) FILTER (WHERE fails AND NOT gone) AS removed, count(*) FILTER (WHERE fails AND gone) AS redundant, count(*) FILTER (WHERE f = letter) AS unique_fails,
    count(*) FILTER (WHERE fails AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE fails AND NOT gone AND toxic) AS toxic_lost, CAST(sum(count(*) FILTER (WHERE fails AND NOT gone)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM placed GROUP BY part, filter_order, step, letter"""

_OP13 = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, g, k, count(*) AS n FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM p CROSS JOIN range(1, 4) r(k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, n AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT c.*, cut, x.n AS l, y.n AS r, CAST((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 50 * b.a AND contains(' ' || c.g || ' ', ' ' || b.g || ' ')))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, t.n, score FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Decontamination, the similarity join the filters' audit and collocations by plain joins; the rest is beyond SQL and tested against brute force."""
    return {"op3_suffix_decontam": _OP3, "op6_jaccard_join": _OP6, "op12_filter_audit": _OP12, "op13_collocations": _OP13}
