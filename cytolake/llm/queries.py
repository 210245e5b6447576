"""Queries of the corpus operators, by name: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, language, mixing, ngram_quality, packing, quality_rules, secrets, simhash, token_counts, topk, toxicity, treaps, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_simhash": op3_simhash,
    "op4_mix_sources": op4_mix_sources,
    "op5_top_k": op5_top_k,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_toxicity": op7_toxicity,
    "op8_pack": op8_pack,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_language_id": op11_language_id,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_divergence": op13_source_divergence,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": f"""WITH rows AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')) AS key FROM documents),
 level0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM rows GROUP BY source),
 level1 AS (SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS l, CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS wl FROM level0
  WINDOW b AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 level2 AS (SELECT *, 4 * source_size * wl > l * w AS free FROM level1),
 plan AS (SELECT source, source_size, CASE WHEN free THEN CAST(w AS DOUBLE) * (SELECT CAST(arg_max(l, wl) AS DOUBLE) / CAST(2 * max(wl) AS DOUBLE) FROM level2 WHERE free) ELSE CAST(2 * source_size AS DOUBLE) END AS target FROM level2),
 cut AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest FROM plan)
 SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
 FROM rows r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source""",
    "op5_top_k": """WITH num AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM num q JOIN num c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "op9_warc": """WITH raw AS (SELECT page_id, coalesce(html, '') AS t FROM pages), digest AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM raw),
 lead AS (SELECT *, count(*) OVER p AS n, max(page_id) OVER p AS first FROM digest WINDOW p AS (PARTITION BY payload_digest, payload_bytes))
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM lead""",
    "op12_lexical_search": rf"""WITH words AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
 size AS (SELECT r, count(*)::BIGINT AS n FROM words GROUP BY r), whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM size),
 held AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY r, term),
 weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, whole GROUP BY term),
 asked AS (SELECT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
 part AS (SELECT item, item_id, r, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // l))) AS s FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN size USING (r), whole),
 score AS (SELECT item, item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part GROUP BY item, item_id, r, doc_id HAVING sum(s) > 0)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 20""",
    "op13_source_divergence": rf"""WITH rows AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
 words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
 kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 own AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
 size AS (SELECT lang, source, coalesce(sum(n), 0) AS n, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN own USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang) GROUP BY ALL),
 share AS (SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (s.n + s.v) AS p FROM size s JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
 whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM own GROUP BY lang, term),
 summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM size a JOIN size b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM share JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 200""",
}
