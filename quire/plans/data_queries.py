"""Queries of the data operators of the core: references that fail, and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.packed import unpack_values
from quire.operators.references import broken_reference_counts, broken_references
from quire.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_records", "page_records", "chunk_records", "table_records", "image_records")
    return broken_references({n: table(spark, sf_dir, n) for n in names})


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_reference_counts(p1_found(spark, sf_dir))


def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "text_rows").select(F.lit("text_row").alias("record_kind"), F.col("row_key").alias("record_id"), F.col("keywords").alias("packed"))
    refs = table(spark, sf_dir, "asset_refs").select(F.lit("asset_ref").alias("record_kind"), F.col("asset_id").alias("record_id"), F.col("keywords").alias("packed"))
    return rows.unionByName(refs)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_values(packed_records(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p6_found": p6_found}

_P1 = """
WITH status AS MATERIALIZED (
  {status}
), refs AS MATERIALIZED (
  SELECT DISTINCT 'page_ids' AS ref_field, 'doc_records' AS st, 'page_records' AS tt, doc_id AS source_id, unnest(page_ids) AS target_id FROM doc_records
  UNION SELECT DISTINCT 'chunk_ids', 'page_records', 'chunk_records', page_id, unnest(chunk_ids) FROM page_records
  UNION SELECT DISTINCT 'table_ids_on_page', 'chunk_records', 'table_records', chunk_id, unnest(table_ids_on_page) FROM chunk_records
  UNION SELECT DISTINCT 'image_ids_on_page', 'chunk_records', 'image_records', chunk_id, unnest(image_ids_on_page) FROM chunk_records
), judged AS (
  SELECT r.ref_field, r.source_id, r.target_id,
    CASE WHEN t.id IS NULL THEN 'missing' WHEN t.ended THEN 'deleted' WHEN t.valid_from > s.valid_from THEN 'late' END AS reason,
    strftime(s.valid_from, '%Y-%m') AS period
  FROM refs r JOIN status s ON s.tbl = r.st AND s.id = r.source_id
  LEFT JOIN status t ON t.tbl = r.tt AND t.id = r.target_id
  WHERE r.target_id IS NOT NULL AND r.target_id <> ''
)
""".format(
    status=" UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {k} AS id, min(loaded_at) AS valid_from, "
        + ("false" if t == "doc_records" else "arg_max(coalesce(is_deleted, false), loaded_at)")
        + f" AS ended FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}"
        for t, k in (("doc_records", "doc_id"), ("page_records", "page_id"), ("chunk_records", "chunk_id"), ("table_records", "table_id"), ("image_records", "image_id"))
    )
)

ORACLES = {
    "p1_found": _P1 + "SELECT ref_field, source_id, target_id, reason, period FROM judged WHERE reason IS NOT NULL",
    "p1_counts": _P1 + "SELECT ref_field, period, reason, count(*) AS n_refs, count(DISTINCT source_id) AS n_sources FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
