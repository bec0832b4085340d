"""Visually identical text stored with different characters: one consistent form per text, and the records it joins.

DuckDB runs inside Arrow partitions. Its embedded SQL removes invisible characters, maps compatibility forms (full and
half width, ligatures, Roman numerals, radicals, kinds of spaces and hyphens) and look-alike letters with ``translate``
and ``regexp_replace``, and composes with ``nfc_normalize``. Spark then groups records by a 128-bit key of the form.
Only pairs of different stored strings of one form are expanded, so a form that a third of all rows share in one
spelling costs nothing.

Defined results
* null, empty and blank texts, and texts of invisible characters only, take no part in pairs; the form of a null text
  is null;
* letter case, accents, punctuation, paragraph breaks and the number of spaces stay: they are visible;
* ``\\r\\n`` and ``\\r`` count as ``\\n``; superscripts, fractions and circled numbers stay as they are;
* identical stored strings are no pair; repeated rows of one id count once; an id is never paired with itself;
* texts of any length are mapped whole; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that look like the Latin letter beside them (Cyrillic, then Greek, then Armenian, then phonetic).
LOOKALIKES = {
    "АВЕКМНОРСТХЅІЈУаеорсухіѕјһԁԛԝ": "ABEKMHOPCTXSIJYaeopcyxisjhdqw",
    "ӀӏҮ": "IlY",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϹϺ": "ABEZHIKMNOPTYXovCM",
    "ՕօսոՏհ": "OounSh",
    "ɡϲϳ": "gcj",
}
#: Characters that leave no mark.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
#: Kinds of compatibility forms that a reader sees as the plain character.
KINDS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}


@cache
def compatibility_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters with one-character and with longer plain forms, by the rule of their decomposition's kind."""
    single, longer = {"‐": "-", "‑": "-", "µ": "μ"}, {}
    for code in range(0x80, 0x1F000):
        ch = chr(code)
        if unicodedata.decomposition(ch).partition(" ")[0] in KINDS:
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1:
                single[ch] = plain
            elif not plain.startswith(" ") and plain != ch:
                longer[ch] = plain
    for odd, plain in LOOKALIKES.items():
        single |= dict(zip(odd, plain, strict=True))
    return single, longer


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def form_sql(column: str) -> str:
    """The SQL expression of the consistent form of ``column``."""
    single, longer = compatibility_forms()
    common = {c: p for c, p in single.items() if "＀" <= c <= "￯" or p == " " or p == "-" or c in "".join(LOOKALIKES)}
    rare = {c: p for c, p in single.items() if c not in common}
    expr = f"regexp_replace({column}, {_literal('[' + INVISIBLE + ']')}, '', 'g')"
    expr = f"regexp_replace({expr}, '\\r\\n?', chr(10), 'g')"
    spread = expr
    for ch, plain in longer.items():
        spread = f"replace({spread}, {_literal(ch)}, {_literal(plain)})"
    spread = f"translate({spread}, {_literal(''.join(rare))}, {_literal(''.join(rare.values()))})"
    odd = "[" + re.escape("".join([*rare, *longer])).replace("\\ ", " ") + "]"
    expr = f"CASE WHEN regexp_matches({column}, {_literal(odd)}) THEN {spread} ELSE {expr} END"
    return f"nfc_normalize(translate({expr}, {_literal(''.join(common))}, {_literal(''.join(common.values()))}))"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.filterwarnings("ignore", message="Arrow output")
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    sql = f"SELECT record_kind, record_id, stored, CAST({form_sql('stored')} AS VARCHAR) AS form FROM part"
    out = pa.schema([("record_kind", pa.string()), ("record_id", pa.string()), ("stored", pa.string()), ("form", pa.string())])
    for batch in batches:
        con.register("part", pa.Table.from_batches([batch]))
        result = con.execute(sql).to_arrow_table().cast(out)
        con.unregister("part")
        yield from result.to_batches()


def consistent_forms(records: DataFrame) -> DataFrame:
    """``(record_kind, record_id, stored, form)`` of ``records (record_kind, record_id, stored)``."""
    return records.select("record_kind", "record_id", "stored").mapInArrow(_forms, "record_kind string, record_id string, stored string, form string")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """``(record_kind, id_a, id_b)``: records whose texts look the same and are stored differently."""
    stored = records.where(F.col("record_id").isNotNull() & (F.trim("stored") != "")).select("record_kind", "record_id", "stored")
    members = (
        consistent_forms(stored)
        .where(F.regexp_replace("form", r"\s+", "") != "")
        .select(
            "record_kind",
            "record_id",
            F.struct(F.xxhash64("form").alias("a"), F.xxhash64(F.lit(1), "form", F.length("form")).alias("b")).alias("form"),
            F.struct(F.xxhash64("stored").alias("a"), F.xxhash64(F.lit(1), "stored", F.length("stored")).alias("b")).alias("spelling"),
        )
        .distinct()
    )
    spellings = members.select("record_kind", "form", "spelling").distinct()
    several = spellings.groupBy("record_kind", "form").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = spellings.join(several, ["record_kind", "form"], "left_semi")
    left = kept.select("record_kind", "form", F.col("spelling").alias("spelling_a"))
    right = kept.select("record_kind", "form", F.col("spelling").alias("spelling_b"))
    both = left.join(right, ["record_kind", "form"]).where(F.col("spelling_a") < F.col("spelling_b")).drop("form")
    a = members.select("record_kind", F.col("spelling").alias("spelling_a"), F.col("record_id").alias("a"))
    b = members.select("record_kind", F.col("spelling").alias("spelling_b"), F.col("record_id").alias("b"))
    return (
        both.join(a, ["record_kind", "spelling_a"])
        .join(b, ["record_kind", "spelling_b"])
        .where(F.col("a") != F.col("b"))
        .select("record_kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        .distinct()
    )
