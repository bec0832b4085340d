"""The corpus: current records, document groups and ids, records of pages and chunks, relations, incremental merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def current(df: DataFrame, key: str) -> DataFrame:
    """The row of each id with the latest ``loaded_at``, without ids whose last row deletes them."""
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), "loaded_at").alias("r")).select("r.*")
    return last.where(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in df.columns else last


def path_stem(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]*$", "")


def document_groups(rows: DataFrame) -> DataFrame:
    """Rows of the text sheet by document: directory, kind and name, with counts and page range."""
    keyed = rows.select(T.directory_key(F.col("directory")).alias("dir_key"), T.file_kind(F.col("file_type")).alias("kind"), T.name_token(path_stem(F.col("file_name"))).alias("name"), T.first_int(F.col("page_no")).alias("page"), "row_index")
    return keyed.groupBy("dir_key", "kind", "name").agg(F.count("*").alias("n_rows"), F.max("page").alias("last_page"), F.countDistinct("page").alias("n_pages"), F.min("row_index").alias("first_row"))


def document_ids(rows: DataFrame) -> DataFrame:
    """Ids from names; where several documents share one, all but the first carry a hash of their place."""
    place = ["workbook", "directory", "file_type", "title"]
    docs = rows.select(F.col("workbook"), F.col("directory"), T.file_kind(F.col("file_type")).alias("file_type"), path_stem(F.col("file_name")).alias("title")).distinct()
    base = docs.withColumn("base", T.slug(F.col("title")))
    rank = F.row_number().over(Window.partitionBy("base").orderBy(*place))
    tail = F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in place))), 1, 8)
    return base.withColumn("rank", rank).select(*place, F.when(F.col("rank") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", tail)).alias("doc_id"))


def asset_uids(assets: DataFrame) -> DataFrame:
    """Ids of assets within a document; the second and later of one name are numbered, images before tables."""
    base = assets.distinct().withColumn("doc_id", F.regexp_extract("asset_id", r"^(.*?):(?:image|table):", 1)).withColumn("base", F.concat_ws(":", "doc_id", "asset_type", T.slug(T.stem(F.col("rel_path")))))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("asset_type", "source_row_index", "asset_id"))
    return base.withColumn("n", n).select("asset_id", F.when(F.col("n") > 1, F.concat_ws(":", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("uid"))


def document_signatures(rows: DataFrame) -> DataFrame:
    """A digest of each document's rows with their places; it changes when any row does.

    Rows are digested alone and their digests summed, so that a document of any size combines before it is shuffled.
    """
    digest = F.sha2(F.concat_ws("\x01", F.coalesce(F.col("row_index").cast("string"), F.lit("")), *(F.coalesce(F.col(c), F.lit("")) for c in ("row_key", "text_id", "keywords", "text_content"))), 256)
    keyed = rows.select(T.directory_key(F.col("directory")).alias("dir_key"), "file_name", digest.alias("digest"))
    part = lambda at: F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return keyed.groupBy("dir_key", "file_name").agg(F.concat_ws("-", part(1), part(16), F.count("*").cast("string")).alias("signature"), F.count("*").alias("n_rows"))


def document_key(text_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text_id, r"(?s)^(.*)#[^#]*$", 1), F.lit("")), text_id)


def chunk_ordinals(rows: DataFrame) -> DataFrame:
    """Chunk ids by the order of rows in a page; rows without text or page give none."""
    keyed = rows.select("row_key", document_key(F.col("text_id")).alias("doc_key"), T.first_int(F.col("page_no")).alias("page"), "row_index", T.paragraph_text(F.col("text_content")).alias("text")).where("text <> '' AND page > 0")
    n = F.row_number().over(Window.partitionBy("doc_key", "page").orderBy("row_index", "row_key"))
    return keyed.withColumn("n", n).select("row_key", F.format_string("%s:text:p%d:c%d", "doc_key", "page", "n").alias("chunk_id"), F.format_string("%s:page:%d", "doc_key", "page").alias("page_id"), F.length("text").alias("n_chars"))


def page_table(chunks: DataFrame) -> DataFrame:
    """Pages of each document from 1 to its last one, with the sorted ids of their chunks."""
    last = chunks.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    pages = last.where("last > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page_no"))
    ids = chunks.groupBy("doc_id", "page_no").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("chunk_ids"), F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))), 1, 10), "、").alias("page_keywords"))
    return pages.join(ids, ["doc_id", "page_no"], "left").select(F.format_string("%s:page:%d", "doc_id", "page_no").alias("page_id"), "doc_id", "page_no", F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"), F.coalesce("page_keywords", F.lit("")).alias("page_keywords"))


def relations(chunks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Edges from chunks to the assets of their page; edges to assets that are not there fall away."""
    edge = lambda c, kind: chunks.select("chunk_id", "page_id", F.explode(F.array_distinct(c)).alias("asset_id"), F.lit(kind).alias("asset_type"))
    edges = edge("table_ids_on_page", "table").unionByName(edge("image_ids_on_page", "image")).where("asset_id <> ''")
    known = tables.select(F.col("table_id").alias("asset_id"), F.lit("table").alias("asset_type")).unionByName(images.select(F.col("image_id").alias("asset_id"), F.lit("image").alias("asset_type")))
    return edges.join(known, ["asset_id", "asset_type"], "left_semi").select("chunk_id", "asset_id", "asset_type", "page_id", F.lit(0.55).alias("relation_score"), F.lit("same_page").alias("relation_reason"))


def upsert(existing: DataFrame, fresh: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key is not replaced, and the fresh ones."""
    return existing.join(replaced.select(key).distinct(), key, "left_anti").unionByName(fresh)


def changes(before: DataFrame, after: DataFrame, key: str, signature: str) -> DataFrame:
    """``(key, change)``: added, changed, unchanged or stale between two states."""
    a, b = before.select(key, F.col(signature).alias("_was")), after.select(key, F.col(signature).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "stale").when(F.col("_was") == F.col("_is"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def contained_names(names: DataFrame, groups: DataFrame) -> DataFrame:
    """``(name, group_id)``: the only group whose name holds the name, or is held by it.

    The shorter of two such names begins with three characters, or all it has, that the longer one holds somewhere, so
    names meet by those.
    """
    head = lambda c: F.substring(c, 1, 3)
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: c.substr(i, k)))))
    a = names.where("name <> ''").select(F.col("name").alias("a")).distinct()
    b = groups.select("group_id", F.col("name").alias("b"))
    parts = lambda df, c: df.select("*", F.explode(grams(F.col(c))).alias("gram"))
    inside = parts(b.where("b <> ''"), "b").join(a.withColumn("gram", head("a")), "gram").where(F.contains("b", "a"))
    around = parts(a, "a").join(b.where("b <> ''").withColumn("gram", head("b")), "gram").where(F.contains("a", "b"))
    nameless = a.crossJoin(F.broadcast(b.where("b = ''")))  # a name without characters stands in every one; such groups are one a directory and kind
    hits = reduce(DataFrame.unionByName, (x.select("a", "group_id") for x in (inside, around, nameless))).distinct()
    return hits.groupBy(F.col("a").alias("name")).agg(F.min("group_id").alias("group_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def matched_groups(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """The text group of each asset row: the same place, else the only group of its name, of its kind in the directory, of its
    kind, or with its name as a part, else its own.

    ``assets (asset_id, dir_key, kind, name)``, ``groups (group_id, dir_key, kind, name)``.
    """
    def only(*keys: str) -> DataFrame:
        return groups.groupBy(*keys).agg(F.min("group_id").alias("_".join(["g", *keys])), F.count("*").alias("n")).where("n = 1").drop("n")

    exact = groups.select("dir_key", "kind", "name", F.col("group_id").alias("g_exact"))
    part = contained_names(assets, groups).withColumnRenamed("group_id", "g_part")
    joined = assets.join(exact, ["dir_key", "kind", "name"], "left").join(only("name"), "name", "left").join(only("dir_key", "kind"), ["dir_key", "kind"], "left").join(only("kind"), "kind", "left").join(part, "name", "left")
    levels = {"g_exact": "exact", "g_name": "name", "g_dir_key_kind": "directory", "g_kind": "kind", "g_part": "part of name"}
    own = F.concat_ws("/", "dir_key", "kind", "name")
    by = F.coalesce(*(F.when(F.col(c).isNotNull(), name) for c, name in levels.items()), F.lit("own"))
    return joined.select("asset_id", F.coalesce(*levels, own).alias("group_id"), by.alias("matched_by"))


def related_assets(chunks: DataFrame, assets: DataFrame, least: float = 0.18) -> DataFrame:
    """The asset of each kind on a chunk's page that fits it best by keywords and words of the text."""
    marks = F.filter(F.col("asset_keywords"), lambda k: F.col("text").contains(k))
    title_hit = F.when((F.col("title") != "") & F.col("text").contains(F.col("title")), 1).otherwise(0)
    score = 0.7 * T.overlap(F.col("keywords"), F.col("asset_keywords")) + 0.3 * F.least((F.size(marks) + title_hit) / 3.0, F.lit(1.0))
    per = Window.partitionBy("chunk_id", "asset_type")
    joined = chunks.join(assets, "page_id").withColumn("score", F.round(score, 6)).withColumn("n", F.count("*").over(per))
    floored = joined.withColumn("score", F.when(F.col("n") == 1, F.greatest("score", F.lit(least))).otherwise(F.col("score"))).where(F.col("score") >= least)
    best = F.row_number().over(per.orderBy(F.desc("score"), "asset_id"))
    return floored.withColumn("rank", best).where("rank = 1").select("chunk_id", "asset_type", "asset_id", "score")


def mean_vectors(vectors: DataFrame, parent: str) -> DataFrame:
    """The mean vector of each parent, a row per dimension."""
    return vectors.select(parent, F.posexplode("embedding").alias("dim", "x")).groupBy(parent, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def mean_of_means(vectors: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """``(parent, embedding)``: the mean of each parent's child means, unweighted; a parent without vectors gets zeros.

    ``vectors (child, embedding)``, ``parents (parent, child)``. A child's own mean comes first, then that of its siblings.
    """
    flat = vectors.where("embedding IS NOT NULL").select("child", F.posexplode("embedding").alias("dim", "x"))
    child = flat.groupBy("child", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parents.distinct().join(child, "child").groupBy("parent", "dim").agg(F.avg("m").alias("m"))
    arrays = mean.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: F.round(x["m"], 6)).alias("embedding"))  # width entries a parent
    zeros = F.array_repeat(F.lit(0.0), width)
    return parents.select("parent").distinct().join(arrays, "parent", "left").select("parent", F.coalesce("embedding", zeros).alias("embedding"))


def sheet_order(rows: DataFrame) -> DataFrame:
    """``(row_key, place)``: the place of each row in its directory's sheet.

    Rows are numbered within their file only; a file begins after those of the files before it, which are counted.
    """
    keyed = rows.select("row_key", "directory", "file_name", T.first_int(F.col("page_no")).alias("page"), "text_id")
    files = keyed.groupBy("directory", "file_name").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("directory").orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select(F.col("directory").alias("d"), F.col("file_name").alias("f"), F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("directory", "file_name").orderBy("page", "text_id", "row_key"))
    numbered = keyed.withColumn("own", own)
    return numbered.join(offsets, F.col("directory").eqNullSafe(F.col("d")) & F.col("file_name").eqNullSafe(F.col("f"))).select("row_key", (F.col("offset") + F.col("own")).cast("bigint").alias("place"))
