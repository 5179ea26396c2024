"""Named queries of the document operators and, where it can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    decontaminate,
    fill_middle,
    line_dedup,
    near_dedup,
    nearest,
    packing,
    pii,
    repeats,
    runs,
    secret_scan,
    spotsigs,
    token_counts,
    toxicity,
)
from tallyhouse.llm.texts import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pack(table(spark, sf_dir, "documents")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).drop("kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.repeating(table(spark, sf_dir, "documents"))))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_packing, op2_near_dedup, op3_repeats, op4_decontamination, op5_token_counts, op6_personal_data, op7_fingerprints,
    op8_secrets, op9_line_dedup, op10_toxicity, op11_nearest, op12_runs, op13_fill_middle)}
ORACLE_SQL: dict[str, str] = {
    "op3_repeats": """
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT k, b, substr(h, 2000 * b + 1, 2400) AS s
  FROM (SELECT k, h, unnest(range(0, length(h) // 2000 + 1)) AS b FROM doc)),
string AS (SELECT k, 1000 * b + q AS p, substr(s, 2 * q + 1, 400) AS s
  FROM (SELECT k, b, s, unnest(range(0, least(1000, greatest(length(s) // 2 - 199, 0)))) AS q FROM block)),
often AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY s) AS n FROM string) WHERE n > 1),
run AS (SELECT k, p, sum(jump) OVER (PARTITION BY k ORDER BY p) AS r FROM (
  SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= 200 THEN 0 ELSE 1 END AS jump FROM often)),
span AS (SELECT k, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY k, r),
gap AS (SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS b, b - a AS gone, 1 AS spans FROM span
  UNION ALL SELECT k, max(b), NULL, 0, 0 FROM span GROUP BY k),
kept AS (SELECT k, sum(gone) AS n_removed, sum(spans) AS n_spans, string_agg(
  substr(h, 2 * gap.a + 1, 2 * (coalesce(gap.b, length(h) // 2) - gap.a)), '' ORDER BY gap.a, gap.b NULLS LAST) AS left_over
  FROM gap JOIN doc USING (k) GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM doc LEFT JOIN kept USING (k)
""",
    "op4_decontamination": r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_at AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
  FROM item WHERE len(w) > 0),
phrase AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM item_at),
doc_at AS (
  SELECT k, s.size, w, unnest(range(1, (len(w) - s.size + 2)::BIGINT)) AS i
  FROM doc, (SELECT DISTINCT size FROM phrase) AS s WHERE len(w) >= s.size),
found AS (
  SELECT d.k, d.i, p.size, p.item_id
  FROM (SELECT k, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM doc_at) AS d
  JOIN phrase AS p USING (size, phrase)),
word_hit AS (SELECT k, count(*) AS n_hit FROM (
  SELECT DISTINCT k, unnest(range(i, i + size)) AS place FROM found) GROUP BY k),
names AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM found) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word_hit USING (k) LEFT JOIN names USING (k)
""",
    "op13_fill_middle": """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
  ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM doc),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
    WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars, sha256(CASE form
    WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END)
    AS output_sha256, sha256(t) AS restored_sha256
FROM part
""",
}
