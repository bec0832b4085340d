import json

import pytest

import __spark_entry__ as entry
from quire.operators import assemble, search
from quire.streaming import runlog
from tests.compare import compare

SF = "/root/testdata/sf0.001"
CHECKED = sorted(n for n in entry.oracle_sql() if n in entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    got, want = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert got == want


def test_other_core_queries_run(spark):
    for name in ("norm_text_search", "bm25_doc_folded", "p6_found"):
        assert entry.queries()[name](spark, SF).count() > 0
    assert entry.entry(spark).count() > 0


def test_sparse_tokens(spark):
    from pyspark.sql import functions as F

    from quire.functions import text as T

    rows = [("Ａbc-1 x 中 中文 中文字 é",), ("",), (None,), ("一二三四",)]
    df = spark.createDataFrame(rows, "text string")
    got = [r[0] for r in df.select(T.sparse_tokens(F.col("text"))).collect()]
    assert got == [["abc-1", "x", "中", "中文", "中文", "中文字", "中文", "文字", "中文字"], [], [], ["一二三四", "一二", "二三", "三四", "一二三", "二三四"]]
    ready = search.prepared(df.selectExpr("'doc' AS level", "text AS id", "text"))
    assert [r.dl for r in ready.select("dl").collect()] == [len(g) for g in got]
    assert search.token_rows(ready).count() == sum(map(len, got))


def test_low_confidence_and_rerank(spark):
    b = spark.createDataFrame([(1, f"p{i}", "d", 1.0 - i / 10) for i in range(8)] + [(2, "q", "d", 0.5)], "query_id long, page_id string, doc_id string, bundle double")
    r = spark.createDataFrame([(1, "p7", 0.9), (1, "p0", 0.2), (2, "q", 0.119)], "query_id long, page_id string, rerank double")
    assert [x.page_id for x in search.ranked_pages(b, 3, r).orderBy("rank").collect()] == ["p7", "p0", "p1"]
    assert search.ranked_pages(b, 3).where("query_id = 2").count() == 1


def test_minmax_ties_and_redaction(spark):
    s = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0), (2, 5, 1.0), (2, 6, 3.0)], "query_id long, id long, score double")
    assert {(r.query_id, r.id, r.s) for r in search.minmax(s, ["query_id"], "s").collect()} == {(1, 5, 1.0), (1, 6, 1.0), (2, 5, 0.0), (2, 6, 1.0)}
    df = spark.createDataFrame([("好。\n见《A》第2页\n\nopen /media/x.png\nopen a.pdf",), ("plain",), (None,)], "t string")
    got = [r[0] for r in df.select(assemble.redacted(df.t, (("《[^》]+》", "that"),), (r"/media/", r"\.pdf"), "(cut)")).collect()]
    assert got == ["好。\n见that第2页\n\n(cut)\n(cut)", "plain", None]


def test_log_stream_appends_each_event_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionAll(events.limit(50)).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = runlog.log_stream(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "cp"), str(tmp_path / "out"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    counts = runlog.windowed_counts(spark, str(tmp_path / "in"), events.schema)
    q = counts.writeStream.format("memory").queryName("minutes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM minutes").first()[0] > 0


def test_merged_pieces_and_coverage(spark):
    rows = [(1, 0, "Hel"), (1, 1, "Hello"), (1, 2, " w"), (2, 0, "a")]
    got = {r.run_id: r.text for r in runlog.merged_pieces(spark.createDataFrame(rows, "run_id long, seq long, piece string")).collect()}
    assert got == {1: "Hello w", 2: "a"}
    found = spark.createDataFrame([(1, "gross margin rose")], "query_id long, context string")
    wanted = spark.createDataFrame([(1, ["margin", "loss"]), (2, ["x"]), (3, [])], "query_id long, keywords array<string>")
    assert {r.query_id: r.coverage for r in assemble.keyword_coverage(found, wanted).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert json.loads("{}") == {}
