"""Assets and sheets: canonical names, alignment of sheet values, page context, budgets of media, completion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Media that go into one answer, and how far a rerank score may lie below the best one.
IMAGES, TABLES, PER_CHUNK = 6, 3, {"image": 3, "table": 2}
LEAST_RERANK, GAP, KEPT = -2.0, 3.5, 10
#: Marks of a medium for a token in its name, for its page, and for its place.
TOKEN_MARK, PAGE_MARK, PAGE_STEP, PLACE_MARK, PLACE_STEP = 8.0, 20.0, 4.0, 5.0, 0.1


def canonical_names(assets: DataFrame) -> DataFrame:
    """``(asset_id, target)``: numbered names per document and kind; numbers are as wide as the largest, two digits at least."""
    per = Window.partitionBy("doc_id", "asset_type")
    n = F.row_number().over(per.orderBy("source_row_index", "asset_id"))
    width = F.greatest(F.lit(2), F.length(F.count("*").over(per).cast("string")))
    named = assets.withColumn("n", n.cast("string")).withColumn("width", width)
    number = F.lpad("n", F.col("width"), F.lit("0"))
    return named.select("asset_id", F.when(F.col("asset_type") == "image", F.concat(F.lit("fig"), number, F.lit(".png"))).otherwise(F.concat(F.lit("table"), number, F.lit(".md"))).alias("target"))


def aligned(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``(value_id, target_id, matched_by)``: the target of each sheet value, by path, by label, or by its numbers if they are alone.

    ``values (value_id, scope, path)``, ``targets (target_id, scope, path)``. What matches nothing is to be deleted.
    """
    known = targets.withColumn("label", T.label(F.col("path"))).withColumn("numbers", F.array_join(T.numbers_of(F.col("path")).cast("array<string>"), ","))
    own = values.withColumn("label", T.label(F.col("path"))).withColumn("numbers", F.array_join(T.numbers_of(F.col("path")).cast("array<string>"), ","))

    def only(key: str) -> DataFrame:
        return known.where(F.col(key) != "").groupBy("scope", key).agg(F.min("target_id").alias(f"t_{key}"), F.countDistinct("target_id").alias("n")).where("n = 1").drop("n")

    joined = own.join(only("path"), ["scope", "path"], "left").join(only("label"), ["scope", "label"], "left").join(only("numbers"), ["scope", "numbers"], "left")
    by = F.when(F.col("t_path").isNotNull(), "path").when(F.col("t_label").isNotNull(), "label").when(F.col("t_numbers").isNotNull(), "numbers").otherwise("delete_missing")
    return joined.select("value_id", F.coalesce("t_path", "t_label", "t_numbers").alias("target_id"), by.alias("matched_by"))


def page_context(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """``(asset_id, context)``: the last text row of the asset's page, else nothing."""
    last = rows.groupBy("file_name", "page").agg(F.max_by("text", F.struct("row_index", "row_key")).alias("context"))
    return assets.join(last, ["file_name", "page"], "left").select("asset_id", F.coalesce("context", F.lit("")).alias("context"))


def rerank_kept(ranked: DataFrame) -> DataFrame:
    """Results within the gap of the best score and above the least; the best alone if none is; ten at most."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    marked = ranked.withColumn("best", best).withColumn("order", order)
    return marked.where(((F.col("score") >= LEAST_RERANK) & (F.col("score") >= F.col("best") - GAP) | (F.col("order") == 1)) & (F.col("order") <= KEPT)).select("query_id", "id", "score", F.col("order").alias("rank"))


def question_tokens(query: Column) -> Column:
    """The distinct tokens of a question in their order, two characters or more."""
    return F.array_distinct(F.filter(T.sparse_tokens(query, False), lambda t: F.length(t) >= 2))


def media_score(path: Column, place: Column, page: Column, tokens: Column) -> Column:
    """How well a medium fits: question tokens in its name, nearness of the page its name tells, and its place in the list, from 0."""
    name = F.lower(T.base_name(path))
    hits = F.size(F.filter(tokens, lambda t: F.contains(name, t)))
    near = F.greatest(F.lit(0.0), PAGE_MARK - PAGE_STEP * F.abs(page - T.path_page_hint(path)))
    return F.round(TOKEN_MARK * hits + F.coalesce(near, F.lit(0.0)) + F.greatest(F.lit(0.0), PLACE_MARK - PLACE_STEP * place), 6)


def media_within_budget(hits: DataFrame) -> DataFrame:
    """``(query_id, asset_type, asset_id, place)``: media picked along a question's ranked chunks.

    A pick depends on those before it: media not yet picked come first, then the better score, then the earlier place; a
    chunk gives ``PER_CHUNK`` media at most, a question ``IMAGES`` and ``TABLES``. The fold runs per question over its few
    ranked chunks. ``hits (query_id, rank, chunk_id, asset_type, asset_id, score, idx)``.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], set()
        left = {"image": IMAGES, "table": TABLES}
        for (_, _), chunk in part.sort_values(["rank", "chunk_id"]).groupby(["rank", "chunk_id"], sort=False):
            for kind in left:
                own = chunk[chunk["asset_type"] == kind]
                options = sorted(zip(own["asset_id"], own["score"], own["idx"]), key=lambda x: (x[0] in seen, -x[1], x[2], x[0]))
                for asset, _, _ in options[: min(left[kind], PER_CHUNK[kind])]:
                    left[kind] -= 1
                    seen.add(asset)
                    out.append((part["query_id"].iloc[0], kind, asset, len(out) + 1))
        return pd.DataFrame(out, columns=["query_id", "asset_type", "asset_id", "place"])

    return hits.groupBy("query_id").applyInPandas(fold, "query_id long, asset_type string, asset_id string, place int")


def completion(rows: DataFrame, key: str, done: Column) -> DataFrame:
    """``(key, n, n_done, status)`` of units whose rows are done, partly done or not begun."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(done).alias("n_done"))
    return counts.withColumn("status", F.when(F.col("n") == F.col("n_done"), "completed").when(F.col("n_done") == 0, "pending").otherwise("processing"))


def table_cells(markdown: Column) -> Column:
    """A Markdown table as text, ``R1: C1=… | C2=…`` a line per row; rules between head and body are left out."""
    lines = F.filter(F.split(T.unix_lines(markdown), "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:\-]+$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    row = lambda cs, i: F.concat(F.lit("R"), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(cs, lambda c, j: F.concat(F.lit("C"), (j + 1).cast("string"), F.lit("="), c)), " | "))
    return F.array_join(F.transform(cells, row), "\n")


def suggestions(answer: Column, most: int = 3) -> Column:
    """The first lines of an answer that are long enough, without numbering."""
    lines = F.transform(F.split(T.unix_lines(answer), "\n"), lambda x: T.strip(F.regexp_replace(x, r"^\s*(?:\d+[.、)]|[-*•])\s*", "")))
    return F.array_join(F.slice(F.filter(lines, lambda x: F.length(x) > 4), 1, most), "\n")


def hashed_embeddings(texts: DataFrame, width: int = 64) -> DataFrame:
    """``(id, embedding)``: a stand-in for an outside model, each token's hash giving a place and a sign; length 1."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        for batch in batches:
            out = np.zeros((len(batch), width), np.float32)
            for k, tokens in enumerate(batch["tokens"]):
                for t in tokens:
                    h = xxhash.xxh64_intdigest(t)
                    out[k, h % width] += 1 if h >> 63 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"id": batch["id"], "embedding": list(out / np.where(norm == 0, 1, norm))})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", T.sparse_tokens(F.col("text")).alias("tokens")).mapInPandas(embed, f"id {kind}, embedding array<float>")


def frequent_keywords(texts: DataFrame, most: int = 6) -> DataFrame:
    """``(id, keywords)``: the words that mark a text off from the others, by tf · idf."""
    words = texts.select("id", F.explode(F.filter(T.latin_tokens(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.length(w) >= 4)).alias("word"))
    tf = words.groupBy("id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    scored = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), 6))  # one row on the right
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "word"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= most)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), "、").alias("keywords"))


def rename_stages(plan: DataFrame) -> DataFrame:
    """``(asset_id, stage)``: how far each move of a plan has come, from what stands in its places.

    A file goes from its source to a name of its own and from there to its target, so that moves that swap names never
    meet. ``plan (asset_id, same_place, has_source, has_temp, has_target, stage)``; what the places don't tell stays as it was.
    """
    done = F.col("has_target") & ~F.col("has_temp") & (F.col("same_place") | ~F.col("has_source"))
    return plan.select("asset_id", F.when(done, "finalized").when(F.col("has_temp"), "staged").when(F.col("has_source"), "pending").otherwise(F.col("stage")).alias("stage"))


def plan_counts(aligned: DataFrame, before: DataFrame) -> DataFrame:
    """``(scope, n, n_same, n_changed, n_deleted)``: what a plan of ``(scope, value_id, target_id)`` changes against ``before (value_id, was)``."""
    joined = aligned.join(before, "value_id", "left")
    same = F.col("target_id").isNotNull() & F.col("target_id").eqNullSafe(F.col("was"))
    return joined.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.count_if(F.col("target_id").isNotNull() & ~same).alias("n_changed"), F.count_if(F.col("target_id").isNull()).alias("n_deleted"))


def step_json(*columns: str) -> Column:
    """A step as JSON with the keys that have a value."""
    return F.to_json(F.struct(*columns))


def markdown_table(cells: Column) -> Column:
    """Rows of cells as a Markdown table; the first is its head, short rows are filled up."""
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(F.regexp_replace(F.try_element_at(r, i), r"\s*\n\s*|\|", " "), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    rest = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(1))), row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(row(F.element_at(cells, 1)), rule), rest), "\n")).otherwise("")


def table_file(title: Column, source: Column, table: Column) -> Column:
    """The text of a table's Markdown file: where it is from, then the table."""
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n- source: "), F.coalesce(source, F.lit("")), F.lit("\n\n"), T.trimmed_lines(table), F.lit("\n"))


def admission_times(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """``(request_id, admitted)``: when a limiter of ``limit`` requests in any ``seconds`` lets each request through, in microseconds.

    The k-th request waits for the one ``limit`` before it to be ``seconds`` old; within the requests of one remainder by
    ``limit`` that is a running maximum. ``requests (kind, request_id, t)`` with ``t`` in microseconds; each kind has its own limiter.
    """
    order = F.row_number().over(Window.partitionBy("kind").orderBy("t", "request_id")) - 1
    lane = requests.withColumn("k", order).withColumn("lane", F.col("k") % limit).withColumn("turn", F.floor(F.col("k") / limit))
    span = seconds * 1_000_000
    reach = F.max(F.col("t") - F.col("turn") * span).over(Window.partitionBy("kind", "lane").orderBy("turn"))
    return lane.select("request_id", (reach + F.col("turn") * span).alias("admitted"))
