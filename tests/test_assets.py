from pyspark.sql import functions as F

from quire.operators import assemble, assets, corpus, search
from quire.streaming import runlog


def test_stages_follow_what_stands_in_place(spark):
    rows = [("a", False, True, False, False, "pending"), ("b", False, False, True, False, "pending"), ("c", False, False, False, True, "staged"), ("d", True, True, False, True, "pending"), ("e", False, True, False, True, "pending"), ("f", False, False, False, False, "staged")]
    plan = spark.createDataFrame(rows, "asset_id string, same_place boolean, has_source boolean, has_temp boolean, has_target boolean, stage string")
    assert {r.asset_id: r.stage for r in assets.rename_stages(plan).collect()} == {"a": "pending", "b": "staged", "c": "finalized", "d": "finalized", "e": "pending", "f": "staged"}


def test_plan_counts_and_markdown(spark):
    plan = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("s", 3, None), ("t", 4, "z")], "scope string, value_id int, target_id string")
    was = spark.createDataFrame([(1, "x"), (2, "q"), (3, "r")], "value_id int, was string")
    assert {r.scope: (r.n, r.n_same, r.n_changed, r.n_deleted) for r in assets.plan_counts(plan, was).collect()} == {"s": (3, 1, 1, 1), "t": (1, 0, 1, 0)}
    cells = spark.createDataFrame([([["a", "b"], ["1"], ["x|y", "2\n3"]],), ([],)], "c array<array<string>>")
    assert [r[0] for r in cells.select(assets.markdown_table(F.col("c"))).collect()] == ["| a | b |\n| --- | --- |\n| 1 |  |\n| x y | 2 3 |", ""]


def test_media_budget_prefers_what_is_new(spark):
    hits = [(1, 1, "c1", "image", f"i{k}", 5.0 - k, k) for k in range(5)] + [(1, 2, "c2", "image", f"i{k}", 9.0, k) for k in range(4)] + [(1, 3, "c3", "image", "z", 1.0, 0), (1, 3, "c3", "table", "t", 1.0, 0)]
    got = assets.media_within_budget(spark.createDataFrame(hits, "query_id long, rank int, chunk_id string, asset_type string, asset_id string, score double, idx int")).orderBy("place").collect()
    assert [r.asset_id for r in got] == ["i0", "i1", "i2", "i3", "i0", "i1", "t"]


def test_admission_equals_a_queue(spark):
    times = [0, 1, 2, 3, 40, 41, 70, 200, 201, 202, 203, 204]
    done: list[int] = []
    for t in times:
        done.append(max([t] + ([done[-3] + 60] if len(done) >= 3 else [])))
    rows = spark.createDataFrame([("k", i, t * 1_000_000) for i, t in enumerate(times)], "kind string, request_id int, t long")
    got = {r.request_id: r.admitted // 1_000_000 for r in assets.admission_times(rows, 3).collect()}
    assert [got[i] for i in range(len(times))] == done


def test_rate_over_buckets(spark):
    import datetime as d

    start = d.datetime(2025, 1, 1)
    times = [0, 30, 59, 60, 61, 90, 119, 121, 181, 500]
    rows = spark.createDataFrame([(i, "k", start + d.timedelta(seconds=t)) for i, t in enumerate(times)], "event_id int, event_type string, ts timestamp")
    got = {r.event_id: r.in_window for r in runlog.admission_rate(rows).collect()}
    assert got == {i: sum(t - 60 <= u <= t for u in times) for i, t in enumerate(times)}


def test_answer_texts_and_case_marks(spark):
    answers = ['{"output": {"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}}', '{"output": {"choices": [{"delta": {"content": "c"}}]}}', '{"output": {"choices": []}}', "{", None, '{"output": {"choices": [{"message": null}]}}']
    df = spark.createDataFrame([(a,) for a in answers], "r string")
    assert [r[0] for r in df.select(assemble.response_text(F.col("r"))).collect()] == ["ab", "c", "", "", "", ""]
    found = spark.createDataFrame([(1, "margin up", 2, ["table"]), (2, "margin", 0, None)], "query_id long, context string, n_references int, modalities array<string>")
    cases = spark.createDataFrame([(1, ["margin"], 1, ["table"]), (2, ["margin"], 1, []), (3, [], 0, [])], "query_id long, keywords array<string>, least_references int, wanted array<string>")
    assert {r.query_id: (r.coverage, r.passed) for r in assemble.case_marks(found, cases).collect()} == {1: (1.0, True), 2: (1.0, False), 3: (1.0, True)}


def test_groups_by_part_of_name_and_empty_parents(spark):
    groups = spark.createDataFrame([("g1", "d", "pdf", "annualreport2023"), ("g2", "d", "pdf", "qa"), ("g3", "e", "pdf", "zz")], "group_id string, dir_key string, kind string, name string")
    wanted = spark.createDataFrame([("a", "x", "docx", "report"), ("b", "x", "docx", "theqamanual"), ("c", "x", "docx", "none"), ("d", "x", "docx", "")], "asset_id string, dir_key string, kind string, name string")
    got = {r.asset_id: (r.group_id, r.matched_by) for r in corpus.matched_groups(wanted, groups).collect()}
    assert got == {"a": ("g1", "part of name"), "b": ("g2", "part of name"), "c": ("x/docx/none", "own"), "d": ("x/docx/", "own")}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 4.0]), (3, None)], "child int, embedding array<double>")
    parents = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "parent string, child int")
    assert {r.parent: r.embedding for r in corpus.mean_of_means(vectors, parents, 2).collect()} == {"p": [1.0, 2.0], "q": [0.0, 0.0]}


def test_an_index_is_written_once_and_again_for_new_files(spark, tmp_path):
    texts = spark.createDataFrame([("doc", 1, "pump valve pump"), ("doc", 2, "valve"), ("doc", 3, None), ("doc", 4, "")], "level string, id long, text string")
    texts.write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    asked = spark.createDataFrame([(7, "pump valve"), (8, "nothing")], "query_id long, query string")
    first = search.index(read(), "test", [str(tmp_path / "t")])
    assert first.stats.first().n == 4 and {(r.query_id, r.id) for r in search.bm25(asked, first).collect()} == {(7, 1), (7, 2)}
    assert search.index(read(), "test", [str(tmp_path / "t")]).postings.inputFiles() == first.postings.inputFiles()
    texts.limit(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert search.index(read(), "test", [str(tmp_path / "t")]).stats.first().n == 5
    held = search.holding(spark.createDataFrame([(7, "valve pump"), (9, "alve"), (10, "mp valve pu"), (11, "none of it")], "query_id long, query string"), first, read().where("id < 3"))
    assert sorted(tuple(r) for r in held.collect()) == [(7, 1), (9, 1), (9, 2), (10, 1)]
