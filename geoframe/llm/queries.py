"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.llm import alignment, ann, exact_dedup, lexical, license_scan, lm_scoring, mixing, odd_sketch, packing, pii, quality, simhash, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.text_scores(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.document_licenses(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the mix takes of them, range-sorted by their first training position."""
    mixed = mixing.curriculum(_table(spark, sf_dir, "documents")).select("doc_id", "__mix.*")
    first = F.round(F.get("visits", F.lit(0))["position"], 6)
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(_table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, source_size * 2 AS most FROM sources),
levelled AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
            - CAST(coalesce(sum(most) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
         sum(w) OVER (ORDER BY most / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM weighed),
stopped AS (
  SELECT *, min(CASE WHEN most * ws <= rest * w THEN 1 ELSE 0 END)
            OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stops
  FROM levelled),
free AS (SELECT rest, ws FROM stopped WHERE stops = 0 ORDER BY most / w, rk LIMIT 1),
targets AS (
  SELECT source, source_size, rk, CASE WHEN stops = 1 THEN CAST(most AS DOUBLE) ELSE (SELECT rest FROM free) * w / (SELECT ws FROM free) END AS target
  FROM stopped),
joined AS (
  SELECT p.doc_id, p.size, p.start, t.source_size, t.target, t.rk
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
visited AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS w0,
            greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS w1,
            start / target AS done
  FROM joined)
SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken,
  CASE WHEN w0 = 0 THEN NULL
       WHEN rk % 3 = 1 THEN round(CASE WHEN done < 1.0 THEN 2.0 * done / (1.0 + sqrt(1.0)) ELSE 1.0 END, 6)
       WHEN rk % 3 = 0 THEN round(CASE WHEN done < 0.625 THEN 0.0 + 2.0 * done / (1.5 + sqrt(greatest(2.25 - 2.0 * done, 0.0)))
                                       WHEN done < 1.0 THEN 0.5 + 2.0 * (done - 0.625) / (1.0 + sqrt(greatest(1.0 - 2.0 * (done - 0.625), 0.0))) ELSE 1.0 END, 6)
       ELSE round(CASE WHEN done < 0.375 THEN 0.0 + 2.0 * done / (0.5 + sqrt(greatest(0.25 + 2.0 * done, 0.0)))
                       WHEN done < 1.0 THEN 0.5 + 2.0 * (done - 0.375) / (1.0 + sqrt(greatest(1.0 + 2.0 * (done - 0.375), 0.0))) ELSE 1.0 END, 6)
  END AS first_position
FROM visited
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, corpus GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP13_SQL = r"""
WITH RECURSIVE
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_context_tree_scores, op2_license_scan, op3_quality_classifier, op4_mixing_curriculum, op5_suffix_dedup, op6_nearest_neighbours,
        op7_simhash_near_dedup, op8_exact_dedup, op9_personal_data, op10_packing, op11_lexical_search, op12_token_alignment, op13_minhash_near_dedup,
    )
}
SQL: dict[str, str] = {"op4_mixing_curriculum": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op11_lexical_search": OP11_SQL, "op13_minhash_near_dedup": OP13_SQL}
