"""Queries of the operators on text for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.leak import leaked_items, paraphrased_items
from quire.llm.lookalike import consistent_forms, lookalike_pairs
from quire.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from quire.llm.residue import classified_templates, residue_records, skeletons
from quire.llm.scanned import page_noise, repaired_texts
from quire.llm.shared import shared_pairs, shared_share
from quire.llm.tokenize import decode_ids, encode_texts
from quire.tables import table


def _records(spark: SparkSession, sf_dir: str, text: str, *sources: tuple[str, str, str, str]) -> DataFrame:
    """``(record_kind, record_id, <text>)`` of the given (kind, table, key, column)."""
    parts = [table(spark, sf_dir, t).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), F.col(column).alias(text)) for kind, t, key, column in sources]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def _chunks_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "text", ("chunk", "chunk_records", "chunk_id", "chunk_text_clean"), ("table", "table_records", "table_id", "table_markdown"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "text_rows").select(F.lit("text_row").alias("record_kind"), F.col("row_key").alias("record_id"), F.col("file_name").alias("title"), F.col("text_content").alias("text"))
    chunks = table(spark, sf_dir, "chunk_records").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("doc_title").alias("title"), F.col("chunk_text_clean").alias("text"))
    return rows.unionByName(chunks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise(_scanned(spark, sf_dir))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as continuous paragraphs."""
    return repaired_texts(_scanned(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(_chunks_and_tables(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record that has a near duplicate, with its numbers of copies and links."""
    return near_duplicate_groups(_chunks_and_tables(spark, sf_dir))


def _pages_and_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "text", ("page", "page_records", "page_id", "page_summary"), ("chunk", "chunk_records", "chunk_id", "chunk_text_clean"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_records(_pages_and_chunks(spark, sf_dir))


def p4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates judged as residue, with the skeletons they merge and the records they fill."""
    records = _pages_and_chunks(spark, sf_dir).where(F.col("record_id").isNotNull() & F.col("text").isNotNull()).distinct()
    found = classified_templates(skeletons(records))
    return found.groupBy("template", "verdict").agg(F.count("*").alias("n_skeletons"), F.max("n_records").alias("n_records"), F.min("skeleton").alias("example")).drop("template")


def _titles_and_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "stored", ("table", "table_records", "table_id", "table_title"), ("text_row", "text_rows", "row_key", "text_content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_titles_and_rows(spark, sf_dir))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return consistent_forms(_titles_and_rows(spark, sf_dir).distinct()).select("record_kind", "record_id", F.col("form").alias("text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document how many ids it has, and whether decoding them gives the text back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was"))
    ids = encode_texts(table(spark, sf_dir, "documents"))
    back = decode_ids(ids).select("doc_id", F.xxhash64("text").alias("now"))
    counts = ids.select("doc_id", F.size("ids").alias("n_ids"))
    return documents.join(back, "doc_id").join(counts, "doc_id").select("doc_id", "n_ids", (F.col("was") == F.col("now")).alias("restored"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluation items leaked, and into how many documents."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that tell an evaluation item's passage in other words, with its answer."""
    return paraphrased_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document how much of it stands in others too."""
    return shared_share(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_text": p2_text, "p3_found": p3_found, "p3_groups": p3_groups, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_found": p8_found, "p8_items": p8_items, "p8_paraphrases": p8_paraphrases, "p9_found": p9_found, "p9_coverage": p9_coverage, "p4_found": p4_found, "p4_templates": p4_templates, "p5_found": p5_found, "p5_forms": p5_forms}

ORACLES: dict[str, str] = {}
