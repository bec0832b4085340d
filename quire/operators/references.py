"""References to records that do not exist: missing, deleted or late targets of id arrays.

References and targets are brought to one row per key, hash-partitioned and sorted on the key, and merged in one
linear pass over both streams (a sort-merge join); a target's validity interval decides the reason. A key that a
third of the references name only splits the reference side of the join (adaptive skew handling), because the target
side has one row per key.

Defined results
* null arrays, null elements and empty strings are no references; repeated elements count once;
* a record with several rows counts once: its period and its lateness come from its earliest ``loaded_at``, its
  deletion from the row with the latest ``loaded_at`` (null ``is_deleted`` means not deleted; a null ``loaded_at`` is
  older than any other; at equal times a deletion wins);
* a null id in the target table is no target; a reference whose source id is null is kept out, as it has no key;
* where the earliest ``loaded_at`` of either side is null, the reference is not late; a source without any
  ``loaded_at`` has a null period;
* empty tables give no references, or only ``missing`` ones where the target table is empty;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReferenceField:
    """An array column of ids and the table it names."""

    name: str
    source: str
    source_key: str
    target: str
    target_key: str


#: The id arrays of the document store.
STORE_FIELDS = (
    ReferenceField("page_ids", "doc_records", "doc_id", "page_records", "page_id"),
    ReferenceField("chunk_ids", "page_records", "page_id", "chunk_records", "chunk_id"),
    ReferenceField("table_ids_on_page", "chunk_records", "chunk_id", "table_records", "table_id"),
    ReferenceField("image_ids_on_page", "chunk_records", "chunk_id", "image_records", "image_id"),
)


def validity(df: DataFrame, key: str) -> DataFrame:
    """One row per id: ``id``, the start of its validity, and whether its last row ended it."""
    deleted = F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in df.columns else F.lit(False)
    last = F.struct(F.col("loaded_at").isNotNull(), F.col("loaded_at"), deleted.alias("deleted"))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.min("loaded_at").alias("valid_from"), F.max(last)["deleted"].alias("ended"))
    )


def references(df: DataFrame, fields: list[ReferenceField]) -> DataFrame:
    """Distinct ``(ref_field, source_id, target_id)`` of one source table's arrays."""
    key = fields[0].source_key
    arrays = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("source_id"),
        F.explode(F.array(*(F.struct(F.lit(f.name).alias("ref_field"), F.col(f.name).alias("ids")) for f in fields))).alias("a"),
    )
    return (
        arrays.select("source_id", "a.ref_field", F.explode(F.array_distinct("a.ids")).alias("target_id"))
        .where(F.col("target_id").isNotNull() & (F.col("target_id") != ""))
        .distinct()
    )


def broken_references(tables: dict[str, DataFrame], fields: tuple[ReferenceField, ...] = STORE_FIELDS) -> DataFrame:
    """``(ref_field, source_id, target_id, reason, period)``, one row per reference that fails."""
    keys = {f.source: f.source_key for f in fields} | {f.target: f.target_key for f in fields}
    valid = {name: validity(tables[name], key) for name, key in keys.items()}
    checked = []
    for source in dict.fromkeys(f.source for f in fields):
        own = [f for f in fields if f.source == source]
        since = valid[source].select(F.col("id").alias("source_id"), F.col("valid_from").alias("source_from"))
        refs = references(tables[source], own).join(since.hint("merge"), "source_id")
        targets = reduce(
            DataFrame.unionByName,
            (valid[f.target].select(F.lit(f.name).alias("ref_field"), F.col("id").alias("target_id"), F.col("valid_from").alias("target_from"), "ended") for f in own),
        )
        checked.append(refs.join(targets.hint("merge"), ["target_id", "ref_field"], "left"))
    reason = (
        F.when(F.col("ended").isNull(), "missing")
        .when(F.col("ended"), "deleted")
        .when(F.col("target_from") > F.col("source_from"), "late")
    )
    return (
        reduce(DataFrame.unionByName, checked)
        .select("ref_field", "source_id", "target_id", reason.alias("reason"), F.date_format("source_from", "yyyy-MM").alias("period"))
        .where(F.col("reason").isNotNull())
    )


def broken_reference_counts(broken: DataFrame) -> DataFrame:
    """References that fail per field, period and reason."""
    return broken.groupBy("ref_field", "period", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("source_id").alias("n_sources"))
