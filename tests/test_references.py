from datetime import datetime as D

from quire.operators.references import STORE_FIELDS, ReferenceField, broken_reference_counts, broken_references

PAGE = "page_id string, chunk_ids array<string>, is_deleted boolean, loaded_at timestamp_ntz, reason string"
CHUNK = "chunk_id string, is_deleted boolean, loaded_at timestamp_ntz, period string"
FIELD = (ReferenceField("chunk_ids", "pages", "page_id", "chunks", "chunk_id"),)


def run(spark, pages, chunks):
    t = {"pages": spark.createDataFrame(pages, PAGE), "chunks": spark.createDataFrame(chunks, CHUNK)}
    return broken_references(t, FIELD)


def test_reasons_ties_and_repeats(spark):
    pages = [
        ("p1", ["a", "a", "", None, "gone", "late", "back", "no"], None, D(2025, 3, 1), "x"),
        ("p1", ["a"], None, D(2025, 4, 1), "x"),
        ("p2", None, None, D(2025, 3, 1), "x"),
        ("p3", [], None, None, "x"),
        ("p4", ["late"], None, None, "x"),
        (None, ["no"], None, D(2025, 3, 1), "x"),
    ]
    chunks = [
        ("a", None, D(2025, 1, 1), "x"),
        ("gone", False, D(2025, 1, 1), "x"),
        ("gone", True, D(2025, 2, 1), "x"),
        ("back", True, D(2025, 1, 1), "x"),
        ("back", False, D(2025, 2, 1), "x"),
        ("late", None, D(2025, 3, 2), "x"),
        ("late", None, D(2025, 3, 2), "x"),
        (None, None, D(2025, 3, 2), "x"),
    ]
    got = {tuple(r) for r in run(spark, pages, chunks).collect()}
    assert got == {
        ("chunk_ids", "p1", "gone", "deleted", "2025-03"),
        ("chunk_ids", "p1", "late", "late", "2025-03"),
        ("chunk_ids", "p1", "no", "missing", "2025-03"),
    }
    counts = {tuple(r) for r in broken_reference_counts(run(spark, pages, chunks)).collect()}
    assert ("chunk_ids", "2025-03", "late", 1, 1) in counts and len(counts) == 3


def test_hot_target_and_empty_tables(spark):
    pages = [(f"p{i}", ["hot"], None, D(2025, 1, 1), "x") for i in range(3000)]
    assert run(spark, pages, []).where("reason = 'missing'").count() == 3000
    assert run(spark, [], []).count() == 0
    assert len(STORE_FIELDS) == 4
