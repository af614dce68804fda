"""Queries over the test tables for every operator of the engine, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rank, text
from ..operators import search
from ..schema import backfill
from ..session import read
from ..sources.folder import LOCK_FILES

QUERY, WORDS = "what is the one that was here and there?", ["and", "here", "one", "that", "the", "there", "was", "what"]
TARGET, K = 7, 10
CODE = "/watched/code"


def prose(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    docs = read(spark, d, "documents").withColumn("vec_id", F.col("doc_id") % n)
    path = F.concat(F.lit("/watched/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md"))
    return docs.join(vectors, "vec_id").select(path.alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("file").alias("chunk_kind"), F.col("text").alias("content"), F.lit("").alias("name"), F.lit(False).alias("truncated"), F.col("n_chars").alias("mtime"), "embedding", F.lit(0).alias("chunk_ord"))


def code(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit(CODE + "/"), "label", F.lit("/"), "vec_id", F.lit(".rs"))
    name = F.concat(F.lit("fn_"), "vec_id")
    return read(spark, d, "embeddings").select(path.alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("function").alias("chunk_kind"), F.concat(F.lit("fn "), name, F.lit("() { the one }")).alias("content"), name.alias("name"), F.lit(False).alias("truncated"), F.col("vec_id").alias("mtime"), "embedding", F.lit(0).alias("chunk_ord"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return prose(spark, d).unionByName(code(spark, d))


def chat(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.concat(F.lit("/watched/chat/"), "conv_id", F.lit(".txt")).alias("path"), (F.col("turn") + 1).cast("int").alias("start_line"), F.col("text").alias("content"), F.lit(0).alias("chunk_ord"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.concat(F.lit("/watched/u/"), "user_id", F.lit(".txt")).alias("path"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("mtime"), "event_id", F.col("event_type").alias("op"))


def vector_of(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").filter(F.col("vec_id") == TARGET).select("embedding").first()[0]


def _hits(df: DataFrame) -> DataFrame:
    return df.select("path", "start_line", F.round("score", 6).alias("score"))


def _hybrid(folder=None, exclude=None, weights=rank.RankingWeights(), as_question=None):
    return lambda s, d: _hits(search.hybrid_search(chunks(s, d), QUERY, vector_of(s, d), K, folder, exclude, weights, as_question))


FLAT = rank.RankingWeights(0.5, 0.0, 0.9)
PROSE_1 = "/watched/src1"


def _similar(folder=None, code_only=False, path=f"{CODE}/%s/{TARGET}.rs"):
    def run(s, d):
        label = read(s, d, "embeddings").filter(F.col("vec_id") == TARGET).select("label").first()[0]
        return search.find_similar(chunks(s, d), path % label, 1, K, folder, code_only)

    return run


def _exact(s, d):
    hits = search.hybrid_search(chunks(s, d), QUERY, vector_of(s, d), search.POOL, as_question=True)
    return search.exact_then_hybrid(search.find_by_name(chunks(s, d), f"fn_{TARGET}"), hits, K).select("path", "start_line", "exact_match", F.round("score", 6).alias("score"))


def _batch(s, d):
    first = read(s, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").alias("query_id"), "vector")
    return search.batch_top_k(chunks(s, d), first, K).withColumn("score", F.round("score", 6))


def _citations(s, d):
    hits = search.hybrid_search(chunks(s, d), QUERY, vector_of(s, d), search.POOL, as_question=True)
    return _hits(search.citable(hits))


def _sentences(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(text.sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))


def _line_of(s, d):
    docs = read(s, d, "documents").withColumn("s", text.sentences(F.coalesce("text", F.lit(""))))
    return docs.withColumn("snippet", F.coalesce(F.try_element_at("s", F.lit(-1)), F.lit("-"))).select("doc_id", text.line_of(F.coalesce("text", F.lit("")), F.col("snippet")).cast("long").alias("line"))


def _json(s, d):
    hits = search.hybrid_search(chunks(s, d), QUERY, vector_of(s, d), K, as_question=True)
    made = hits.select("path", F.to_json(F.struct("path", "start_line", "end_line", "chunk_kind", F.lit(False).alias("possibly_stale"))).alias("j"))
    return made.select("path", F.get_json_object("j", "$.start_line").cast("int").alias("start_line"), F.get_json_object("j", "$.chunk_kind").alias("chunk_kind"), F.get_json_object("j", "$.possibly_stale").alias("possibly_stale"))


def _stale(s, d):
    disk = events(s, d).groupBy(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("u")).agg(F.max("mtime").alias("disk_mtime"))
    listing = disk.select(F.concat(F.lit("/watched/chat/"), "u", F.lit(".txt")).alias("path"), "disk_mtime")
    hits = chat(s, d).select("path", "start_line", (F.lit(1704067200) + F.col("start_line") * 86400 * 3).cast("long").alias("mtime"))
    return search.possibly_stale(hits, listing).select("path", "start_line", "possibly_stale")


def _upsert(s, d):
    old = chat(s, d)
    docs = read(s, d, "documents")
    new = docs.filter("doc_id IS NOT NULL").select(F.concat(F.lit("/watched/chat/"), "doc_id", F.lit(".txt")).alias("path"), F.lit(1).alias("start_line"), F.coalesce("text", F.lit("")).alias("content"), F.lit(0).alias("chunk_ord"))
    out = search.upsert(old, new, new.select("path"))
    return out.select("path", "start_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _backfill(s, d):
    out = backfill(code(s, d).drop("name", "truncated", "mtime", "chunk_ord"))
    return out.select("path", "name", "truncated", "mtime", "chunk_ord", "model", F.size("embedding").alias("dim"))


def _diff(s, d):
    every = events(s, d).select("path", "mtime").distinct()
    state = every.groupBy("path").agg(F.max("mtime").alias("mtime"))
    return search.changed(every, state)


def _paths(s, d):
    u = F.coalesce("url", F.lit(""))
    return read(s, d, "pages").select("page_id", text.base_name(u).alias("base"), text.dir_name(u).alias("dir"), text.extension(u).alias("ext"), text.is_prose_file(u).alias("prose"))


QUERIES = {
    "hybrid_search_question": _hybrid(), "hybrid_search_folder": _hybrid(PROSE_1), "hybrid_search_exclude": _hybrid(None, PROSE_1), "hybrid_search_both_filters": _hybrid(CODE, CODE + "/1"), "hybrid_custom_weights": _hybrid(weights=FLAT, as_question=False),
    "batch_topk_per_query": _batch,
    "content_overlap": lambda s, d: read(s, d, "documents").select("doc_id", F.round(rank.overlap(QUERY, F.coalesce("text", F.lit(""))), 6).alias("overlap")),
    "query_terms": lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(text.query_terms(F.coalesce("text", F.lit(""))), ",").alias("terms")),
    "find_by_name": lambda s, d: search.find_by_name(chunks(s, d), f"fn_{TARGET}").select("path", "start_line", "score", "name"),
    "exact_then_hybrid": _exact,
    "find_similar": lambda s, d: _hits(_similar()(s, d)), "find_similar_folder": lambda s, d: _hits(_similar(PROSE_1)(s, d)),
    "doc_drift_hits": lambda s, d: _hits(_similar(code_only=True)(s, d)), "doc_drift_flag": lambda s, d: search.drift_flag(_similar(code_only=True)(s, d), 0.35), "doc_drift_empty": lambda s, d: search.drift_flag(_similar(PROSE_1, True)(s, d), 0.35),
    "is_question_flags": lambda s, d: read(s, d, "conversations").select("conv_id", "turn", text.is_question(F.col("text")).alias("question")),
    "identifier_flags": lambda s, d: read(s, d, "part").select("p_partkey", text.looks_like_identifier(F.col("p_name")).alias("whole"), text.looks_like_identifier(F.element_at(F.split("p_name", " "), 1)).alias("first_word")),
    "sentences": _sentences, "line_of_snippet": _line_of, "citations_code_and_prose": _citations,
    "truncate_content": lambda s, d: read(s, d, "documents").select("doc_id", F.md5(text.truncate_content(F.coalesce("text", F.lit("")), 1500).cast("binary")).alias("md5")),
    "context_blocks": lambda s, d: chunks(s, d).select("path", F.md5(text.context_block(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_kind"), F.lit(0.5), F.coalesce("content", F.lit(""))).cast("binary")).alias("md5")),
    "result_json": _json,
    "line_range_preview": lambda s, d: read(s, d, "documents").select("doc_id", text.line_range(F.coalesce("text", F.lit("")), F.lit(2), F.lit(3)).alias("lines")),
    "possibly_stale": _stale, "upsert_replace": _upsert,
    "purge_folder": lambda s, d: search.purge(chunks(s, d), PROSE_1).select("path", "start_line"),
    "schema_backfill": _backfill,
    "latest_event_per_path": lambda s, d: search.latest_events(events(s, d)), "incremental_diff": _diff,
    "prose_filter": lambda s, d: chunks(s, d).filter(text.is_prose_file(F.col("path"))).groupBy("chunk_kind").agg(F.count(F.lit(1)).alias("n")),
    "path_parts": _paths,
    "row_count": lambda s, d: chunks(s, d).agg(F.count(F.lit(1)).alias("n")),
    "progress_sums": lambda s, d: chunks(s, d).groupBy(F.regexp_extract("path", r"\A/watched/([^/]*)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("truncated").cast("long")).alias("cut"), F.countDistinct("chunk_kind").alias("kinds")),
    "lockfile_filter": lambda s, d: read(s, d, "pages").select("page_id", text.file_name(F.coalesce("url", F.lit(""))).isin(LOCK_FILES).alias("skipped")),
    "subsequence_match": lambda s, d: read(s, d, "part").select("p_partkey", F.lower("p_name").rlike("(?s)a.*e.*l.*t").alias("fits")),
}

_BASE = f"""WITH nv AS (SELECT count(*) AS n FROM embeddings),
prose AS (SELECT '/watched/' || source || '/' || lang || '/' || doc_id || '.md' AS path, 1 AS start_line, 'file' AS chunk_kind, text AS content, '' AS name, n_chars AS mtime, e.embedding::DOUBLE[] AS v
  FROM documents d JOIN embeddings e ON d.doc_id % (SELECT n FROM nv) = e.vec_id),
code AS (SELECT '{CODE}/' || label || '/' || vec_id || '.rs' AS path, 1 AS start_line, 'function' AS chunk_kind, 'fn fn_' || vec_id || '() {{ the one }}' AS content, 'fn_' || vec_id AS name, vec_id AS mtime, embedding::DOUBLE[] AS v FROM embeddings),
chunks AS (SELECT * FROM prose UNION ALL SELECT * FROM code),
q AS (SELECT embedding::DOUBLE[] AS v, '{CODE}/' || label || '/' || vec_id || '.rs' AS path FROM embeddings WHERE vec_id = {TARGET}),
s AS (SELECT c.*, greatest(list_dot_product(c.v, q.v), 0) AS sem, c.path = q.path AS own,
  len(list_intersect({WORDS}, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'))) / {len(WORDS)} AS cont FROM chunks c, q)
"""


def _hybrid_sql(where: str = "true", score: str = "0.85 * sem + 0.15 * cont", k: int = K) -> str:
    return f"{_BASE} SELECT path, start_line, round(score, 6) AS score FROM (SELECT *, {score} AS score FROM s WHERE {where} ORDER BY score DESC, path LIMIT {k})"


def _in(folder: str) -> str:
    return f"starts_with(path, '{folder}/')"


_EVENTS = "WITH e AS (SELECT '/watched/u/' || user_id || '.txt' AS path, floor(epoch(ts))::BIGINT AS mtime, event_id, event_type AS op, user_id FROM events) "
_SENT = r"""WITH l AS (SELECT doc_id, i, unnest(x) AS line, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, 0 AS i, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
p AS (SELECT doc_id, k, unnest(y) AS s, generate_subscripts(y, 1) AS j FROM (SELECT doc_id, k, string_split(regexp_replace(line, '([.!?])( |\z)', '\1' || chr(1), 'g'), chr(1)) AS y FROM l)),
t AS (SELECT doc_id, k, j, regexp_replace(s, '^\s+|\s+$', '', 'g') AS sentence FROM p),
f AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INT AS i, sentence FROM t WHERE strlen(sentence) > 3 AND NOT starts_with(sentence, '#'))
"""
_Q = "regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')"

SQL = {
    "hybrid_search_question": _hybrid_sql(), "hybrid_search_folder": _hybrid_sql(_in(PROSE_1)), "hybrid_search_exclude": _hybrid_sql("NOT " + _in(PROSE_1)), "hybrid_search_both_filters": _hybrid_sql(f"{_in(CODE)} AND NOT {_in(CODE + '/1')}"), "hybrid_custom_weights": _hybrid_sql(score="0.5 * sem + 0.9 * cont"),
    "batch_topk_per_query": _BASE + f", a AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS w FROM embeddings GROUP BY label), b AS (SELECT query_id, path, start_line, greatest(list_dot_product(v, w), 0) AS score FROM chunks, a), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INT AS rank FROM b) SELECT query_id, rank, path, start_line, round(score, 6) AS score FROM r WHERE rank <= {K}",
    "content_overlap": f"SELECT doc_id, round(len(list_intersect({WORDS}, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'))) / {len(WORDS)}, 6) AS overlap FROM documents",
    "query_terms": "SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 3))), ','), '') AS terms FROM benchmark",
    "find_by_name": _BASE + f" SELECT path, start_line, 1.0::DOUBLE AS score, name FROM chunks WHERE name = 'fn_{TARGET}'",
    "exact_then_hybrid": _BASE + f", h AS (SELECT path, start_line, 0.85 * sem + 0.15 * cont AS score FROM s ORDER BY score DESC, path LIMIT 50), e AS (SELECT path, start_line, 1.0::DOUBLE AS score FROM chunks WHERE name = 'fn_{TARGET}'), u AS (SELECT *, true AS exact_match FROM e UNION ALL SELECT *, false FROM h ANTI JOIN e USING (path, start_line)) SELECT path, start_line, exact_match, round(score, 6) AS score FROM u ORDER BY exact_match DESC, score DESC, path LIMIT {K}",
    "find_similar": _hybrid_sql("NOT own", "sem"), "find_similar_folder": _hybrid_sql(f"NOT own AND {_in(PROSE_1)}", "sem"), "doc_drift_hits": _hybrid_sql("NOT own AND chunk_kind <> 'file'", "sem"),
    "doc_drift_flag": _BASE + " SELECT coalesce(max(sem) < 0.35, true) AS likely_stale FROM s WHERE NOT own AND chunk_kind <> 'file'",
    "doc_drift_empty": _BASE + f" SELECT coalesce(max(sem) < 0.35, true) AS likely_stale FROM s WHERE NOT own AND chunk_kind <> 'file' AND {_in(PROSE_1)}",
    "is_question_flags": f"SELECT conv_id, turn, coalesce({_Q} <> '' AND (ends_with({_Q}, '?') OR regexp_matches({_Q}, '^({'|'.join(text.QUESTION_STARTERS)})( |\\z)')), false) AS question FROM conversations",
    "identifier_flags": "SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS whole, regexp_full_match(split_part(p_name, ' ', 1), '[A-Za-z_][A-Za-z0-9_]*') AS first_word FROM part",
    "sentences": _SENT + "SELECT doc_id, i, sentence FROM f",
    "line_of_snippet": _SENT + ", z AS (SELECT doc_id, arg_max(sentence, i) AS s FROM f GROUP BY doc_id), d AS (SELECT d.doc_id, coalesce(text, '') AS t, coalesce(z.s, '-') AS s FROM documents d LEFT JOIN z USING (doc_id)), w AS (SELECT doc_id, t, strpos(t, s) AS pos FROM d) SELECT doc_id, CASE WHEN pos > 0 THEN 1 + length(substr(t, 1, pos - 1)) - length(replace(substr(t, 1, pos - 1), chr(10), '')) ELSE 1 END AS line FROM w",
    "citations_code_and_prose": _BASE + ", h AS (SELECT path, start_line, 0.85 * sem + 0.15 * cont AS score FROM s ORDER BY score DESC, path LIMIT 50), f AS (SELECT * FROM h ORDER BY score DESC, path LIMIT 3) SELECT path, start_line, round(score, 6) AS score FROM f WHERE score >= 0.3 * (SELECT max(score) FROM f)",
    "truncate_content": "SELECT doc_id, md5(CASE WHEN length(t) > 1500 THEN left(t, 1500) || chr(10) || '… [truncated, ' || (length(t) - 1500) || ' more chars — read the file directly for the rest]' ELSE t END) AS md5 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "context_blocks": _BASE + " SELECT path, md5(path || ':1-1 (' || chunk_kind || ', score 0.50)' || chr(10) || coalesce(content, '')) AS md5 FROM chunks",
    "result_json": f"{_BASE} SELECT path, start_line, chunk_kind, 'false' AS possibly_stale FROM s ORDER BY 0.85 * sem + 0.15 * cont DESC, path LIMIT {K}",
    "line_range_preview": r"SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(coalesce(text, ''), '\n\z', ''), chr(10)), 2, 3), chr(10)) AS lines FROM documents",
    "possibly_stale": _EVENTS + ", m AS (SELECT user_id, max(mtime) AS disk FROM e GROUP BY user_id) SELECT '/watched/chat/' || conv_id || '.txt' AS path, (turn + 1)::INT AS start_line, coalesce(disk > 1704067200 + (turn + 1) * 86400 * 3, false) AS possibly_stale FROM conversations c LEFT JOIN m ON c.conv_id = m.user_id",
    "upsert_replace": "SELECT '/watched/chat/' || doc_id || '.txt' AS path, 1 AS start_line, md5(coalesce(text, '')) AS content_md5 FROM documents UNION ALL SELECT '/watched/chat/' || conv_id || '.txt', (turn + 1)::INT, md5(text) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)",
    "purge_folder": f"{_BASE} SELECT path, start_line FROM chunks WHERE NOT {_in(PROSE_1)}",
    "schema_backfill": f"SELECT '{CODE}/' || label || '/' || vec_id || '.rs' AS path, '' AS name, false AS truncated, 0::BIGINT AS mtime, 0 AS chunk_ord, '' AS model, len(embedding)::INT AS dim FROM embeddings",
    "latest_event_per_path": _EVENTS + "SELECT path, mtime, event_id, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, event_id DESC) AS r FROM e) WHERE r = 1",
    "incremental_diff": _EVENTS + "SELECT DISTINCT path, mtime FROM e ANTI JOIN (SELECT path, max(mtime) AS mtime FROM e GROUP BY path) m USING (path, mtime)",
    "prose_filter": _BASE + " SELECT chunk_kind, count(*) AS n FROM chunks WHERE regexp_matches(lower(path), '\\.(md|txt|rst|org|adoc)$') GROUP BY chunk_kind",
    "path_parts": r"WITH u AS (SELECT page_id, coalesce(url, '') AS u, regexp_replace(coalesce(url, ''), '/\z', '') AS p FROM pages), f AS (SELECT *, regexp_extract(u, '[^/]*\z') AS file FROM u), x AS (SELECT *, regexp_extract(file, '^.+\.([^.]*)\z', 1) AS ext FROM f) SELECT page_id, regexp_extract(p, '[^/]*\z') AS base, regexp_replace(p, '/?[^/]*\z', '') AS dir, ext, lower(ext) IN ('md', 'txt', 'rst', 'org', 'adoc') AS prose FROM x",
    "row_count": _BASE + " SELECT count(*) AS n FROM chunks",
    "progress_sums": _BASE + " SELECT split_part(path, '/', 3) AS folder, count(*) AS total, 0::BIGINT AS cut, count(DISTINCT chunk_kind) AS kinds FROM chunks GROUP BY 1",
    "lockfile_filter": f"SELECT page_id, regexp_extract(coalesce(url, ''), '[^/]*$') IN ({', '.join(repr(x) for x in LOCK_FILES)}) AS skipped FROM pages",
    "subsequence_match": "SELECT p_partkey, regexp_matches(lower(p_name), 'a.*e.*l.*t', 's') AS fits FROM part",
}
