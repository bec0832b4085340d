"""Queries of assets and sheets, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import assets, corpus, search
from quire.plans import reference_queries as R
from quire.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_DOC = "regexp_extract(asset_id, '^(.*?):(?:image|table):', 1)"


def _asset_rows(spark, sf_dir):
    refs = table(spark, sf_dir, "asset_refs").where("asset_id IS NOT NULL")
    first = refs.groupBy("asset_id").agg(F.min("asset_type").alias("asset_type"), F.min("source_row_index").alias("source_row_index"), F.min("rel_path").alias("path"), F.min("page_no").alias("page"))
    return first.withColumn("doc_id", F.regexp_extract("asset_id", r"^(.*?):(?:image|table):", 1))


_ASSETS = f"a AS (SELECT asset_id, min(asset_type) AS asset_type, min(source_row_index) AS source_row_index, min(rel_path) AS path, min(page_no) AS page, {_DOC} AS doc_id FROM asset_refs WHERE asset_id IS NOT NULL GROUP BY asset_id)"


@register("rename_plan", f"""WITH {_ASSETS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, asset_type ORDER BY source_row_index NULLS FIRST, asset_id) AS n, CAST(greatest(2, length(CAST(count(*) OVER (PARTITION BY doc_id, asset_type) AS VARCHAR))) AS INTEGER) AS w FROM a)
SELECT asset_id, CASE WHEN asset_type = 'image' THEN 'fig' || lpad(CAST(n AS VARCHAR), w, '0') || '.png' ELSE 'table' || lpad(CAST(n AS VARCHAR), w, '0') || '.md' END AS target FROM n""")
def rename_plan(spark, sf_dir):
    return assets.canonical_names(_asset_rows(spark, sf_dir))


_LABEL = R.ORACLES["canonical_label"].split("asset_id, ", 1)[1].rsplit(" AS out", 1)[0].replace("rel_path", "path")
_NUMBERS = R.ORACLES["numeric_signature"].split("asset_id, ", 1)[1].rsplit(" AS out", 1)[0].replace("rel_path", "path")


@register("sheet_alignment", f"""WITH {_ASSETS}, v AS (SELECT asset_id AS value_id, doc_id AS scope, path, {_LABEL} AS label, {_NUMBERS} AS numbers FROM a WHERE asset_type = 'image'),
t AS (SELECT DISTINCT image_id AS target_id, doc_id AS scope, image_path AS path FROM image_records WHERE image_id IS NOT NULL), k AS (SELECT *, {_LABEL} AS label, {_NUMBERS} AS numbers FROM t),
bp AS (SELECT scope, path, min(target_id) AS g FROM k WHERE path <> '' GROUP BY 1, 2 HAVING count(DISTINCT target_id) = 1), bl AS (SELECT scope, label, min(target_id) AS g FROM k WHERE label <> '' GROUP BY 1, 2 HAVING count(DISTINCT target_id) = 1), bn AS (SELECT scope, numbers, min(target_id) AS g FROM k WHERE numbers <> '' GROUP BY 1, 2 HAVING count(DISTINCT target_id) = 1)
SELECT value_id, coalesce(bp.g, bl.g, bn.g) AS target_id, CASE WHEN bp.g IS NOT NULL THEN 'path' WHEN bl.g IS NOT NULL THEN 'label' WHEN bn.g IS NOT NULL THEN 'numbers' ELSE 'delete_missing' END AS matched_by
FROM v LEFT JOIN bp ON bp.scope = v.scope AND bp.path = v.path LEFT JOIN bl ON bl.scope = v.scope AND bl.label = v.label LEFT JOIN bn ON bn.scope = v.scope AND bn.numbers = v.numbers""")
def sheet_alignment(spark, sf_dir):
    values = _asset_rows(spark, sf_dir).where("asset_type = 'image'").select(F.col("asset_id").alias("value_id"), F.col("doc_id").alias("scope"), "path")
    targets = table(spark, sf_dir, "image_records").where("image_id IS NOT NULL").select(F.col("image_id").alias("target_id"), F.col("doc_id").alias("scope"), F.col("image_path").alias("path")).distinct()
    return assets.aligned(values, targets)


@register("page_context", f"""WITH {_ASSETS}, r AS (SELECT regexp_replace(coalesce(file_name, ''), '\\.[^.]*$', '') AS doc_id, {R._PAGE_NO} AS page, arg_max(coalesce(text_content, ''), (row_index, row_key)) AS context FROM text_rows GROUP BY 1, 2)
SELECT asset_id, coalesce(context, '') AS context FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.page = a.page""")
def page_context(spark, sf_dir):
    rows = table(spark, sf_dir, "text_rows").select(corpus.path_stem(F.col("file_name")).alias("file_name"), T.first_int(F.col("page_no")).alias("page"), "row_index", "row_key", F.coalesce("text_content", F.lit("")).alias("text"))
    return assets.page_context(_asset_rows(spark, sf_dir).withColumnRenamed("doc_id", "file_name"), rows)


@register("rerank_gap", f"WITH {R._bm25_sql(R._DOC_TEXTS)}, m AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS best, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sparse) SELECT query_id, id, score, rank FROM m WHERE (score >= -2.0 AND score >= best - 3.5 OR rank = 1) AND rank <= 10")
def rerank_gap(spark, sf_dir):
    return assets.rerank_kept(search.bm25(R._questions(spark, sf_dir), R._corpus_index(spark, sf_dir), fold=False))


def _media(spark, sf_dir):
    """Media of the best chunks of each question's results, with their scores."""
    ranked, scores, s = R._retrieval(spark, sf_dir).results()
    asked = R._questions(spark, sf_dir).select("query_id", assets.question_tokens(F.col("query")).alias("tokens"))
    chunks = search.best_chunks(ranked, scores, s["chunk"]).drop("page_id").join(s["chunk"].select("chunk_id", "page_id", "page_no", F.posexplode("image_paths").alias("idx", "path")), "chunk_id")
    of = chunks.where("path <> ''").join(ranked.select("query_id", "page_id", "rank"), ["query_id", "page_id"]).join(F.broadcast(asked), "query_id")
    return of.select("query_id", "rank", "chunk_id", "idx", "path", assets.media_score(F.col("path"), F.col("idx"), F.col("page_no"), F.col("tokens")).alias("score"))


_BASE = "regexp_extract(replace(path, chr(92), '/'), '([^/]*)$', 1)"
_HINT = f"try_cast(coalesce(nullif(regexp_extract({_BASE}, '(?i)_p(\\d+)_', 1), ''), nullif(regexp_extract({_BASE}, '(?i)(?:slide|page|页|p)(\\d+)', 1), ''), nullif(regexp_extract({_BASE}, '_(\\d{{1,4}})[.]', 1), '')) AS INTEGER)"


@register("media_ranking", f"""WITH {R._assets_sql(R._SCORES)}, tk AS (SELECT item_id AS query_id, list_distinct(list_filter({R._tokens('query')}, lambda t: length(t) >= 2)) AS tokens FROM eval_items),
md AS (SELECT ch.query_id, r.rank AS place, ch.chunk_id, page_no, CAST(unnest(range(0, len(image_paths))) AS INTEGER) AS idx, unnest(image_paths) AS path FROM ch JOIN chunks USING (chunk_id) JOIN ranked r ON r.query_id = ch.query_id AND r.page_id = ch.page_id),
sc AS (SELECT query_id, chunk_id, idx, path, round(8.0::DOUBLE * len(list_filter(tokens, lambda t: contains(lower({_BASE}), t))) + coalesce(greatest(0.0::DOUBLE, 20.0::DOUBLE - 4.0::DOUBLE * abs(page_no - {_HINT})), 0.0::DOUBLE) + greatest(0.0::DOUBLE, 5.0::DOUBLE - 0.1::DOUBLE * idx), 6) AS score FROM md JOIN tk USING (query_id) WHERE path <> '')
SELECT query_id, chunk_id, path, score, CAST(row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, idx) AS INTEGER) AS rank FROM sc QUALIFY rank <= 3""")
def media_ranking(spark, sf_dir):
    """The three media of each result's chunk that fit the question best."""
    return search.top(_media(spark, sf_dir), ["query_id", "chunk_id"], 3, tie="idx").select("query_id", "chunk_id", "path", "score", "rank")


@register("media_budget")
def media_budget(spark, sf_dir):
    """Media along the ranked chunks of each question."""
    return assets.media_within_budget(_media(spark, sf_dir).withColumn("asset_type", F.lit("image")).withColumnRenamed("path", "asset_id"))


@register("keyword_completion", "SELECT file_name, count(*) AS n, count_if(coalesce(keywords, '') <> '') AS n_done, CASE WHEN count(*) = count_if(coalesce(keywords, '') <> '') THEN 'completed' WHEN count_if(coalesce(keywords, '') <> '') = 0 THEN 'pending' ELSE 'processing' END AS status FROM text_rows GROUP BY 1")
def keyword_completion(spark, sf_dir):
    return assets.completion(table(spark, sf_dir, "text_rows"), "file_name", F.coalesce("keywords", F.lit("")) != "")


@register("table_cells", f"""WITH t AS (SELECT DISTINCT table_id, list_filter(string_split({R.lines('table_markdown')}, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(x, '^[\\s|:\\-]+$')) AS l FROM table_records)
SELECT table_id, array_to_string(list_transform(l, lambda x, i: 'R' || i || ': ' || array_to_string(list_transform(string_split(regexp_replace(trim(x), '^\\||\\|$', '', 'g'), '|'), lambda c, j: 'C' || j || '=' || trim(c)), ' | ')), chr(10)) AS cells FROM t""")
def table_cells(spark, sf_dir):
    return table(spark, sf_dir, "table_records").select("table_id", assets.table_cells(F.col("table_markdown")).alias("cells")).distinct()


_NUMBERING = r"regexp_replace(x, '^\s*(?:\d+[.、)]|[-*•])\s*', '')"


@register("suggestions_clean", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({R.lines('text')}, chr(10)), lambda x: {R.strip(_NUMBERING)}), lambda x: length(x) > 4)[1:3], chr(10)) AS suggestions FROM documents")
def suggestions_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", assets.suggestions(F.col("text")).alias("suggestions"))


@register("kb_active", "WITH p AS (SELECT doc_id, count(DISTINCT page_id) AS n FROM page_records GROUP BY 1), c AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM chunk_records GROUP BY 1), d AS (SELECT DISTINCT doc_id, category FROM doc_records WHERE category IS NOT NULL) SELECT category, count(DISTINCT doc_id) AS n_docs, coalesce(sum(p.n), 0)::BIGINT AS n_pages, coalesce(sum(c.n), 0)::BIGINT AS n_chunks, coalesce(sum(p.n), 0) > 0 AND coalesce(sum(c.n), 0) > 0 AS active FROM d LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY 1")
def kb_active(spark, sf_dir):
    """Knowledge bases with their parts; one is active if none of its parts is empty."""
    docs = table(spark, sf_dir, "doc_records").where("category IS NOT NULL").select("doc_id", "category").distinct()
    count = lambda name, key, out: table(spark, sf_dir, name).groupBy("doc_id").agg(F.countDistinct(key).alias(out))
    joined = docs.join(count("page_records", "page_id", "p"), "doc_id", "left").join(count("chunk_records", "chunk_id", "c"), "doc_id", "left")
    sums = joined.groupBy("category").agg(F.countDistinct("doc_id").alias("n_docs"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pages"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"))
    return sums.withColumn("active", (F.col("n_pages") > 0) & (F.col("n_chunks") > 0))


@register("text_order", f"SELECT row_key, row_number() OVER (PARTITION BY directory ORDER BY file_name NULLS FIRST, {R._PAGE_NO}, text_id NULLS FIRST, row_key) AS place FROM text_rows")
def text_order(spark, sf_dir):
    """The place of each row in its directory's sheet."""
    return corpus.sheet_order(table(spark, sf_dir, "text_rows"))


@register("alias_expand", f"SELECT item_id AS query_id, {R._ASKED} AS query FROM eval_items")
def alias_expand(spark, sf_dir):
    """Questions with other names of what they ask for, as retrieval takes them."""
    return R._asked(spark, sf_dir)


@register("keywords_tfidf", f"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN}', 1), lambda x: length(x) >= 4)) AS word FROM documents), tf AS (SELECT id, word, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT id, word, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS score FROM tf JOIN df USING (word)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS r FROM s QUALIFY r <= 6) SELECT id, string_agg(word, '、' ORDER BY r) AS keywords FROM r GROUP BY 1""")
def keywords_tfidf(spark, sf_dir):
    return assets.frequent_keywords(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@register("embed_texts")
def embed_texts(spark, sf_dir):
    """Vectors of all documents by the built-in stand-in for an outside model."""
    return assets.hashed_embeddings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@register("keyword_overlap", f"SELECT chunk_id, round({R._OV.format(a='c.keywords', b='p.page_keywords')}, 6)::DOUBLE AS overlap FROM (SELECT DISTINCT chunk_id, page_id, keywords FROM chunk_records) c JOIN (SELECT DISTINCT page_id, page_keywords FROM page_records) p USING (page_id)")
def keyword_overlap(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunk_records").select("chunk_id", "page_id", "keywords").distinct()
    pages = table(spark, sf_dir, "page_records").select("page_id", "page_keywords").distinct()
    return chunks.join(pages, "page_id").select("chunk_id", F.round(T.overlap(F.col("keywords"), F.col("page_keywords")), 6).alias("overlap"))


@register("run_totals", f"SELECT workbook, count(*) AS n_rows, count(DISTINCT file_name) AS n_files, count(DISTINCT {R._PAGE_NO}) AS n_pages, coalesce(sum(length(text_content)), 0)::BIGINT AS n_chars FROM text_rows GROUP BY 1")
def run_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "text_rows")
    return rows.groupBy("workbook").agg(F.count("*").alias("n_rows"), F.countDistinct("file_name").alias("n_files"), F.countDistinct(T.first_int(F.col("page_no"))).alias("n_pages"), F.coalesce(F.sum(F.length("text_content")), F.lit(0)).alias("n_chars"))


@register("question_tokens", f"WITH t AS (SELECT item_id AS query_id, list_filter({R._tokens('query')}, lambda t: length(t) >= 2) AS l FROM eval_items) SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tokens FROM t")
def question_tokens(spark, sf_dir):
    return R._questions(spark, sf_dir).select("query_id", F.array_join(assets.question_tokens(F.col("query")), "|").alias("tokens"))


_PLAN = f"""{_ASSETS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, asset_type ORDER BY source_row_index NULLS FIRST, asset_id) AS k, CAST(greatest(2, length(CAST(count(*) OVER (PARTITION BY doc_id, asset_type) AS VARCHAR))) AS INTEGER) AS w FROM a),
pl AS (SELECT asset_id, doc_id, regexp_extract(path, '([^/]*)$', 1) AS was, CASE WHEN asset_type = 'image' THEN 'fig' || lpad(CAST(k AS VARCHAR), w, '0') || '.png' ELSE 'table' || lpad(CAST(k AS VARCHAR), w, '0') || '.md' END AS target FROM n)"""


def _plan(spark, sf_dir):
    rows = _asset_rows(spark, sf_dir)
    return rows.join(assets.canonical_names(rows), "asset_id").select("asset_id", "doc_id", T.base_name(F.col("path")).alias("was"), "target")


@register("rename_stages", f"WITH {_PLAN}, h AS (SELECT DISTINCT image_id AS asset_id FROM image_records UNION SELECT DISTINCT table_id FROM table_records) SELECT asset_id, CASE WHEN h.asset_id IS NOT NULL AND was = target THEN 'finalized' WHEN was <> target THEN 'pending' ELSE 'pending' END AS stage FROM pl LEFT JOIN h USING (asset_id)")
def rename_stages(spark, sf_dir):
    """How far the moves to canonical names have come, where the store's own records are the files that stand in their places."""
    kept = table(spark, sf_dir, "image_records").select(F.col("image_id").alias("asset_id")).unionByName(table(spark, sf_dir, "table_records").select(F.col("table_id").alias("asset_id"))).distinct().withColumn("kept", F.lit(True))
    plan = _plan(spark, sf_dir).join(kept, "asset_id", "left")
    same = F.col("was") == F.col("target")
    places = plan.select("asset_id", same.alias("same_place"), F.lit(True).alias("has_source"), F.lit(False).alias("has_temp"), (same & F.coalesce("kept", F.lit(False))).alias("has_target"), F.lit("pending").alias("stage"))
    return assets.rename_stages(places)


@register("plan_counts", f"WITH {_PLAN} SELECT doc_id AS scope, count(*) AS n, count_if(was = target) AS n_same, count_if(was <> target) AS n_changed, 0::BIGINT AS n_deleted FROM pl GROUP BY 1")
def plan_counts(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return assets.plan_counts(plan.select(F.col("doc_id").alias("scope"), F.col("asset_id").alias("value_id"), F.col("target").alias("target_id")), plan.select(F.col("asset_id").alias("value_id"), "was"))


@register("process_order", f"WITH g AS (SELECT DISTINCT {R._DIR} AS dir_key, {R._FILE_KIND} AS kind, {R._NAME} AS name FROM text_rows) SELECT dir_key, kind, name FROM g ORDER BY dir_key, kind, name LIMIT 25")
def process_order(spark, sf_dir):
    """The documents that a run of 25 takes first."""
    return corpus.document_groups(table(spark, sf_dir, "text_rows")).select("dir_key", "kind", "name").orderBy("dir_key", "kind", "name").limit(25)


@register("suffix_of_kind", f"SELECT DISTINCT row_key, CASE WHEN contains({R._KIND}, 'pptx') THEN '.pptx' WHEN contains({R._KIND}, 'ppt') THEN '.ppt' WHEN contains({R._KIND}, 'docx') THEN '.docx' WHEN contains({R._KIND}, 'doc') OR contains({R._KIND}, 'word') THEN '.doc' WHEN contains({R._KIND}, 'pdf') THEN '.pdf' ELSE '' END AS out FROM text_rows")
def suffix_of_kind(spark, sf_dir):
    return table(spark, sf_dir, "text_rows").select("row_key", T.suffix_of_kind(F.col("file_type")).alias("out")).distinct()


@register("empty_kbs", "SELECT DISTINCT category FROM documents WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM doc_records JOIN page_records USING (doc_id) JOIN chunk_records USING (doc_id) WHERE category IS NOT NULL)")
def empty_kbs(spark, sf_dir):
    """Categories of the corpus that have no active knowledge base."""
    labels = table(spark, sf_dir, "documents").where("category IS NOT NULL").select("category").distinct()
    return labels.join(kb_active(spark, sf_dir).where("active").select("category"), "category", "left_anti")


@register("admission_times", "WITH k AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events), l AS (SELECT *, k % 5 AS lane, k // 5 AS turn FROM k) SELECT event_id AS request_id, max(t - turn * 60000000) OVER (PARTITION BY event_type, lane ORDER BY turn) + turn * 60000000 AS admitted FROM l")
def admission_times(spark, sf_dir):
    """When a limiter of five requests a minute lets each event of a kind through."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return assets.admission_times(events, 5)


@register("table_files", f"WITH t AS (SELECT DISTINCT table_id, table_title, asset_path, table_markdown FROM table_records) SELECT table_id, '# ' || coalesce(table_title, '') || chr(10) || chr(10) || '- source: ' || coalesce(asset_path, '') || chr(10) || chr(10) || {R.strip(f"regexp_replace({R.lines('table_markdown')}, '[{R.WS.replace(chr(92) + 'n', '')}]+(\\n|$)', '\\1', 'g')")} || chr(10) AS text FROM t")
def table_files(spark, sf_dir):
    """The Markdown file of every table."""
    rows = table(spark, sf_dir, "table_records").select("table_id", "table_title", "asset_path", "table_markdown").distinct()
    return rows.select("table_id", assets.table_file(F.col("table_title"), F.col("asset_path"), F.col("table_markdown")).alias("text"))


@register("step_json", "SELECT event_id, to_json(x) AS step FROM (SELECT event_id, {'run_id': user_id, 'phase': event_type} AS x FROM events)")
def step_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("phase")).select("event_id", assets.step_json("run_id", "phase").alias("step"))


@register("mean_pool_doc", "WITH c AS (SELECT vec_id % 50 AS child, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS x FROM embeddings), m AS (SELECT child, dim, avg(CAST(x AS DOUBLE)) AS m FROM c GROUP BY 1, 2), p AS (SELECT child % 7 AS parent, dim, round(avg(m), 6) AS m FROM m GROUP BY 1, 2) SELECT parent, dim, m FROM p")
def mean_pool_doc(spark, sf_dir):
    """The mean of the means of each parent's children, a row per dimension; vectors are grouped by their number."""
    v = table(spark, sf_dir, "embeddings")
    children = v.select((F.col("vec_id") % 50).alias("child"), "embedding")
    pooled = corpus.mean_of_means(children, children.select((F.col("child") % 7).alias("parent"), "child"), 64)
    return pooled.select("parent", F.posexplode("embedding").alias("dim", "m"))
