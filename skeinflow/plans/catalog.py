"""Queries over the reference's operators on whole tables, with the SQL that checks them where SQL can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.engine import CANDIDATES, Engine
from skeinflow.functions import embedding
from skeinflow.functions import text as T
from skeinflow.functions.session import table
from skeinflow.operators import budget as B
from skeinflow.operators import chunking, formatting, graphs, ranking, service, similarity, store, symbols, usage
from skeinflow.streaming import live

FLAGSHIP = "select_context"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The request of the selection queries.
QUERY = "How does the syntax tree serialize a symbol table in parserCache"
BUDGET, DIM = 8_000, 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    """Times as microseconds, -1 for none, which compare alike everywhere."""
    return df.withColumns({c: F.coalesce(F.unix_micros(c), F.lit(-1)) for c in columns})


def _query_vector(chunks: DataFrame) -> list[float]:
    """The vector that the selection queries look for: that of the first usable chunk by id."""
    usable = similarity.usable(chunks, DIM).filter(F.exists("embedding", lambda x: x != 0))
    return list(usable.select("id", "embedding").orderBy("id").limit(1).first().embedding)


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine(table(spark, d, "chunks"), table(spark, d, "import_edges"))


# ---- SQL fragments, written independently of the Spark expressions

_DISTINCT = "c AS (SELECT id, any_value(source_id) source_id, any_value(file_path) file_path, any_value(content) AS content, any_value(start_line) start_line, any_value(end_line) end_line, any_value(tokens) tokens, any_value(embedding)::DOUBLE[] AS e FROM chunks GROUP BY id)"
_FOUND = f"""{_DISTINCT}, q AS (SELECT e AS v FROM c WHERE len(e) = 64 AND list_sum(list_transform(e, lambda x: x * x)) > 0 ORDER BY id LIMIT 1),
s AS (SELECT id, CASE WHEN list_sum(list_transform(e, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity(e, v) END AS similarity FROM c, q WHERE len(e) = 64),
k AS (SELECT id, similarity FROM s ORDER BY similarity DESC, id LIMIT 50)"""


def _sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_signals(path: str = "c.file_path", content: str = "c.content") -> dict[str, str]:
    words, wanted = T.keywords(QUERY), T.names(QUERY)
    has = " + ".join(f"CASE WHEN contains(lower({path}), {_sql_quote(w)}) THEN 1.0 ELSE 0.0 END" for w in words)
    count = [f"len(regexp_extract_all({content}, {_sql_quote('(?i)' + chr(92) + 'b' + w + chr(92) + 'b')}))" for w in words]
    met = "(" + " + ".join(f"CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END" for c in count) + ")"
    often = "(" + " + ".join(f"least({c}, 5) / 5.0" for c in count) + ")"
    rules = [r"function\s+(\w+)", r"const\s+(\w+)\s*=", r"class\s+(\w+)", r"export\s+(?:async\s+)?function\s+(\w+)", r"export\s+const\s+(\w+)", r"(\w+)\s*[:=]\s*(?:async\s+)?\("]
    declared = "list_transform(" + " || ".join(f"regexp_extract_all({content}, {_sql_quote('(?i)' + r)}, 1)" for r in rules) + ", lambda x: lower(x))"
    each = " + ".join(f"CASE WHEN list_contains({declared}, {_sql_quote(w)}) THEN 1.0 WHEN len(list_filter({declared}, lambda x: contains(x, {_sql_quote(w)}) OR contains({_sql_quote(w)}, x))) > 0 THEN 0.5 ELSE 0.0 END" for w in wanted)
    p = f"lower({path})"
    return {
        "path_match": f"({has}) / {len(words)}.0",
        "content_match": f"({met} / {len(words)}.0 * 0.7 + CASE WHEN {met} > 0 THEN {often} / {met} ELSE 0.0 END * 0.3)",
        "symbol_match": f"least(({each}) / {len(wanted)}.0, 1.0)",
        "kind": f"(CASE WHEN contains({p}, '.test.') OR contains({p}, '.spec.') OR contains({p}, '__tests__') THEN 0.3 WHEN contains({p}, 'config') OR contains({p}, 'setup') OR {p} LIKE '%.json' THEN 0.4 WHEN {p} LIKE '%.d.ts' THEN 0.5 WHEN {p} LIKE '%/index.ts' OR {p} LIKE '%/index.js' THEN 0.6 ELSE 1.0 END)",
    }


_S = _sql_signals()
_RANKED = f"""{_FOUND},
b AS (SELECT c.id, c.source_id, c.file_path, c.content, c.start_line, c.end_line, CASE WHEN c.tokens >= 1 THEN c.tokens ELSE ceil(length(c.content) / 4.0) END::BIGINT AS tokens, k.similarity, {_S['path_match']} AS path_match, {_S['content_match']} AS content_match, {_S['symbol_match']} AS symbol_match, {_S['kind']} AS kind FROM c JOIN k USING (id)),
g AS (SELECT *, 0.45 * similarity + 0.15 * path_match + 0.15 * content_match + 0.15 * symbol_match + 0.05 * kind AS base FROM b),
t AS (SELECT * FROM g ORDER BY base DESC, similarity DESC, id LIMIT 20),
f AS (SELECT source_id, file_path, max(base) AS score FROM t GROUP BY ALL),
i AS (SELECT e.source_id, e.dst AS file_path, greatest(max(least(f.score, 1.0)), 0.0) AS boost FROM import_edges e JOIN f ON f.source_id = e.source_id AND f.file_path = e.src GROUP BY ALL),
r AS (SELECT g.*, coalesce(i.boost, 0.0) AS boost, g.base + 0.05 * coalesce(i.boost, 0.0) AS score FROM g LEFT JOIN i USING (source_id, file_path))"""
_ORDERED = f"{_RANKED}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, base DESC, similarity DESC, id) AS n FROM r)"


# ---- scans and statistics


@query("SELECT (SELECT count(*) FROM sources) AS sources, (SELECT coalesce(epoch_us(max(indexed_at)), -1) FROM sources) AS last_indexed, (SELECT count(DISTINCT id) FROM files) AS files, count(*) AS chunks, count(*) FILTER (WHERE e) AS embedded, coalesce(epoch_us(max(t)), -1) AS last_chunk, round(100.0 * count(*) FILTER (WHERE e) / count(*), 4) AS coverage FROM (SELECT id, bool_or(embedding IS NOT NULL) AS e, max(created_at) AS t FROM chunks GROUP BY id)")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return _micros(store.index_stats(table(spark, d, "sources"), table(spark, d, "files"), table(spark, d, "chunks")), "last_indexed", "last_chunk")


@query("SELECT source_id, count(DISTINCT id) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT id) FILTER (WHERE embedding IS NOT NULL) AS embedded FROM chunks GROUP BY source_id")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", "source_id", "file_path", F.col("embedding").isNotNull().alias("e"))
    return rows.groupBy("source_id").agg(F.count_distinct("id").alias("chunks"), F.count_distinct("file_path").alias("files"), F.count_distinct(F.when(F.col("e"), F.col("id"))).alias("embedded"))


@query("SELECT source_id, file_path, count(DISTINCT id) AS chunks FROM chunks GROUP BY ALL")
def file_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("source_id", "file_path").agg(F.count_distinct("id").alias("chunks"))


@query("SELECT DISTINCT source_id, file_path, md5(content) AS digest FROM chunks")
def distinct_contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("source_id", "file_path", F.md5("content").alias("digest")).distinct()


@query("SELECT DISTINCT 'chunk_' || substr(sha256(concat_ws(':', source_id, file_path, start_line, end_line)), 1, 16) AS derived_id, id FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(T.chunk_id(F.col("source_id"), F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("derived_id"), "id").distinct()


@query("SELECT DISTINCT id, substr(sha256(source_id || ':' || file_path), 1, 16) AS derived_id FROM files")
def file_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.file_id(F.col("source_id"), F.col("file_path")).alias("derived_id")).distinct()


@query("WITH e AS (SELECT source_id, nullif(lower(regexp_extract(file_path, '\\.([^./]+)$', 1)), '') AS x, count(DISTINCT file_path) AS n FROM files GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, x) AS k FROM e WHERE x IS NOT NULL) SELECT source_id, string_agg(x, ',' ORDER BY k) || CASE WHEN count(*) > 5 THEN ',...' ELSE '' END AS extensions FROM (SELECT *, max(k) OVER (PARTITION BY source_id) AS m FROM r) WHERE k <= 5 AND m <= 5 GROUP BY source_id UNION ALL SELECT source_id, string_agg(x, ',' ORDER BY k) || ',...' FROM (SELECT *, max(k) OVER (PARTITION BY source_id) AS m FROM r) WHERE k <= 5 AND m > 5 GROUP BY source_id")
def extension_summary(spark: SparkSession, d: str) -> DataFrame:
    ending = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).alias("x")
    counts = table(spark, d, "files").select("source_id", "file_path", ending).filter("x <> ''").groupBy("source_id", "x").agg(F.count_distinct("file_path").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "x")))
    by = ranked.groupBy("source_id").agg(F.max("k").alias("m"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "x")))).alias("top"))
    return by.select("source_id", F.concat(F.array_join(F.transform("top", lambda t: t["x"]), ","), F.when(F.col("m") > 5, ",...").otherwise("")).alias("extensions"))


@query("SELECT substr(sha256(concat_ws(':', count(*), count(DISTINCT source_id), coalesce(strftime(max(created_at), '%Y-%m-%d %H:%M:%S'), ''))), 1, 16) AS version FROM chunks")
def index_version(spark: SparkSession, d: str) -> DataFrame:
    return store.index_version(table(spark, d, "chunks"))


# ---- store: changes, upserts, snapshots

_SNAPSHOTS = "l AS (SELECT source_id, file_path, arg_max(content_hash, struct_pack(a := coalesce(indexed_at, TIMESTAMPTZ '1900-01-01'), b := content_hash)) AS now FROM files GROUP BY ALL), o AS (SELECT source_id, file_path, arg_min(content_hash, struct_pack(a := coalesce(indexed_at, TIMESTAMPTZ '1900-01-01'), b := content_hash)) AS then_ FROM files WHERE substr(id, 1, 1) <> 'a' GROUP BY ALL), x AS (SELECT source_id, file_path, now FROM l WHERE substr(sha256(file_path), 1, 1) <> 'b')"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(discovered, stored) made of the table's versions: the latest ones but some files, and the earliest ones but others."""
    files = table(spark, d, "files").select("id", "source_id", "file_path", "content_hash", F.coalesce("indexed_at", F.lit("1900-01-01 00:00:00").cast("timestamp")).alias("at"))
    key, order = ["source_id", "file_path"], F.struct("at", "content_hash")
    now = files.filter(F.substring(F.sha2("file_path", 256), 1, 1) != "b").groupBy(*key).agg(F.max_by("content_hash", order).alias("content_hash"))
    then = files.filter(F.substring("id", 1, 1) != "a").groupBy(*key).agg(F.min_by("content_hash", order).alias("content_hash"))
    return now, then


_STATUS = "CASE WHEN then_ IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN now = then_ THEN 'unchanged' ELSE 'changed' END"


@query(f"WITH {_SNAPSHOTS} SELECT source_id, file_path, {_STATUS} AS status FROM x FULL OUTER JOIN o USING (source_id, file_path)")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return store.categorize(*_snapshots(spark, d))


@query(f"WITH {_SNAPSHOTS}, s AS (SELECT source_id, file_path, {_STATUS} AS status FROM x FULL OUTER JOIN o USING (source_id, file_path)), n AS (SELECT source_id, file_path, count(DISTINCT id) AS n FROM chunks GROUP BY ALL) SELECT source_id, file_path, status, coalesce(CASE status WHEN 'changed' THEN n WHEN 'removed' THEN coalesce(n, 0) END, -1) AS chunk_count FROM s LEFT JOIN n USING (source_id, file_path)")
def diff_with_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.diff(*_snapshots(spark, d), table(spark, d, "chunks")).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(-1)))


@query(f"WITH {_SNAPSHOTS}, s AS (SELECT source_id, {_STATUS} AS status FROM x FULL OUTER JOIN o USING (source_id, file_path)) SELECT source_id, count(*) FILTER (WHERE status = 'new') AS \"new\", count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status <> 'unchanged') > 0 AS needs_reindex FROM s GROUP BY source_id")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return store.diff_summary(store.categorize(*_snapshots(spark, d)))


@query("WITH r AS (SELECT id, source_id, file_path, content_hash, indexed_at, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, source_id DESC, file_path DESC, content_hash DESC) AS n FROM files) SELECT id, source_id, file_path, content_hash, coalesce(epoch_us(indexed_at), -1) AS indexed_at FROM r WHERE n = 1")
def latest_files(spark: SparkSession, d: str) -> DataFrame:
    return _micros(store.latest(table(spark, d, "files"), ["id"], ["indexed_at"]), "indexed_at")


@query(f"WITH {_SNAPSHOTS} SELECT source_id, file_path, coalesce(now, then_) AS content_hash FROM x FULL OUTER JOIN o USING (source_id, file_path)")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    now, then = _snapshots(spark, d)
    return store.upsert(then, now, store.FILE_KEY)


@query(f"WITH {_SNAPSHOTS}, g AS (SELECT source_id, file_path FROM x FULL OUTER JOIN o USING (source_id, file_path) WHERE now IS NULL OR (then_ IS NOT NULL AND now <> then_)) SELECT DISTINCT id, source_id, file_path FROM chunks WHERE (source_id, file_path) NOT IN (SELECT source_id, file_path FROM g)")
def chunks_kept(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "source_id", "file_path").distinct()
    return store.replace_files(chunks, store.categorize(*_snapshots(spark, d)), chunks.limit(0))


@query("SELECT DISTINCT id FROM chunks WHERE source_id IN (SELECT id FROM sources WHERE path NOT LIKE './%')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "sources").filter(~F.col("path").startswith("./"))
    return store.cascade(table(spark, d, "chunks").select("id", "source_id"), left, "source_id", "id").select("id").distinct()


@query("SELECT DISTINCT sha256(content) AS checksum FROM chunks EXCEPT SELECT DISTINCT sha256(content) FROM chunks WHERE created_at < (SELECT min(created_at) + (max(created_at) - min(created_at)) / 2 FROM chunks)")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.sha2("content", 256).alias("checksum"), F.unix_micros("created_at").alias("t"))
    middle = chunks.agg(((F.min("t") + F.max("t")) / 2).alias("m"))
    held = chunks.crossJoin(F.broadcast(middle)).filter(F.col("t") < F.col("m"))  # one row
    return store.missing_chunks(chunks, held)


_VERSIONS = "v AS (SELECT source_id AS project_id, content_hash AS checksum, row_number() OVER (PARTITION BY source_id ORDER BY id, content_hash, indexed_at) AS version FROM (SELECT DISTINCT * FROM files))"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("id", "content_hash", F.col("indexed_at").asc_nulls_last())
    return table(spark, d, "files").distinct().select(F.col("source_id").alias("project_id"), F.col("content_hash").alias("checksum"), F.row_number().over(w).alias("version"))


@query(f"WITH {_VERSIONS} SELECT project_id, max(version) AS version, arg_max(checksum, version) AS checksum FROM v GROUP BY project_id")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_snapshot(_versions(spark, d))


@query(f"WITH {_VERSIONS} SELECT project_id, coalesce(max(version), 0) + 1 AS version FROM v GROUP BY project_id")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return store.next_version(_versions(spark, d))


@query("SELECT 'source' AS kind, count(*) AS documents FROM sources UNION ALL SELECT 'file', count(DISTINCT id) FROM files UNION ALL SELECT 'chunk', count(DISTINCT id) FROM chunks")
def export_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.export_index(table(spark, d, "sources"), table(spark, d, "files"), table(spark, d, "chunks")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT id, any_value(md5(content)) AS digest, coalesce(any_value(len(embedding)), -1) AS size, round(coalesce(any_value(CASE WHEN embedding IS NOT NULL THEN list_sum(embedding::DOUBLE[]) END), 0), 4) AS total FROM chunks GROUP BY id")
def export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    exported = store.export_index(table(spark, d, "sources"), table(spark, d, "files"), chunks)
    schema = ", ".join(f"{c} {'string' if c == 'embedding' else t}" for c, t in chunks.dtypes)
    back = store.import_index(exported, {"chunk": schema})["chunk"]
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("id", F.md5("content").alias("digest"), F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("size"), F.round(F.coalesce(total, F.lit(0.0)), 4).alias("total"))


# ---- history, cache, metering


@query("SELECT id, query, budget, format, epoch_us(created_at) AS created_at FROM (SELECT DISTINCT * FROM query_history) query_history_ ORDER BY query_history_.created_at DESC, id DESC LIMIT 20")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return _micros(store.recent_history(table(spark, d, "query_history")), "created_at").select("id", "query", "budget", "format", "created_at")


@query("SELECT id, query FROM (SELECT DISTINCT id, query FROM query_history) ORDER BY query, id LIMIT 20 OFFSET 40")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return store.page(table(spark, d, "query_history").select("id", "query").distinct(), ["query", "id"], 20, 40)


_KEYS = "h AS (SELECT DISTINCT id, created_at, sha256(concat_ws('|', query, budget::VARCHAR, array_to_string(list_sort(string_split(coalesce(sources, ''), ',')), ','), format, coalesce(mode, 'full'))) AS cache_key FROM query_history)"


@query(f"WITH {_KEYS} SELECT cache_key, count(*) AS requests, count(*) - 1 AS hits, epoch_us(min(created_at)) AS first_at, epoch_us(max(created_at)) AS last_at FROM h GROUP BY cache_key")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return _micros(store.cache_hits(table(spark, d, "query_history")), "first_at", "last_at")


@query(f"WITH {_KEYS}, g AS (SELECT cache_key, count(*) AS n, min(created_at) AS a, max(created_at) AS z FROM h GROUP BY cache_key) SELECT count(*) AS entries, coalesce(sum(n - 1), 0)::BIGINT AS total_hits, epoch_us(min(a)) AS oldest, epoch_us(max(z)) AS newest FROM g")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    keys = store.cache_hits(table(spark, d, "query_history"))
    return keys.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"), F.unix_micros(F.min("first_at")).alias("oldest"), F.unix_micros(F.max("last_at")).alias("newest"))


@query("WITH u AS (SELECT DISTINCT * FROM usage_events) SELECT org_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) FILTER (WHERE lower(event_type) = 'query') AS queries, coalesce(sum(tokens_used), 0)::BIGINT AS tokens, count(*) AS events FROM u GROUP BY ALL")
def monthly_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.monthly(table(spark, d, "usage_events"))


def _sql_limit(seconds: int, limit: int) -> str:
    return f"WITH u AS (SELECT DISTINCT id, org_id, epoch_ms(created_at) AS ms FROM usage_events), c AS (SELECT id, org_id, count(*) OVER (PARTITION BY org_id ORDER BY ms RANGE BETWEEN {seconds * 1000 - 1} PRECEDING AND CURRENT ROW) AS requests FROM u) SELECT id, org_id, requests, requests <= {limit} AS allowed FROM c"


@query(_sql_limit(60, 1))
def sliding_limit_minute(spark: SparkSession, d: str) -> DataFrame:
    return usage.sliding_limit(table(spark, d, "usage_events"), 1)


@query(_sql_limit(10_800, 3))
def sliding_limit_hours(spark: SparkSession, d: str) -> DataFrame:
    return usage.sliding_limit(table(spark, d, "usage_events"), 3, seconds=10_800)


@query(_sql_limit(86_400, 10))
def sliding_limit_day(spark: SparkSession, d: str) -> DataFrame:
    return usage.sliding_limit(table(spark, d, "usage_events"), 10, seconds=86_400)


@query(_sql_limit(3_600, 3))
def sliding_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return usage.sliding_limit(table(spark, d, "usage_events"), 3, seconds=3_600)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "usage_events").schema).parquet(f"{d}/usage_event[s].parquet")  # as a pattern it may be a file or a folder


@query("WITH u AS (SELECT DISTINCT * FROM usage_events) SELECT org_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) FILTER (WHERE lower(event_type) = 'query') AS queries, coalesce(sum(tokens_used), 0)::BIGINT AS tokens FROM u GROUP BY ALL")
def streamed_monthly_usage(spark: SparkSession, d: str) -> DataFrame:
    """The counters as a stream gives them, the last of each."""
    given = live.drained(live.monthly_counters(_stream(spark, d)))
    return given.groupBy("org_id", "month").agg(F.max_by(F.struct("queries", "tokens"), "batch").alias("r")).select("org_id", "month", "r.queries", "r.tokens")


@query(_sql_limit(3_600, 3))
def streamed_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return live.drained(live.rate_limited(_stream(spark, d), 3, 3_600)).select("id", "org_id", "requests", "allowed")


@query("WITH u AS (SELECT DISTINCT * FROM usage_events), g AS (SELECT project_id, sum(tokens_used)::BIGINT AS used FROM u WHERE project_id IS NOT NULL GROUP BY 1), l AS (SELECT project_id, CASE WHEN substr(project_id, 1, 1) = 'a' THEN NULL ELSE 20000 END AS most FROM g WHERE substr(project_id, 1, 1) <> 'b') SELECT g.project_id, used, coalesce(most, -1)::BIGINT AS most, (most IS NULL OR used < most) AS within, CASE WHEN most IS NULL THEN -1 ELSE greatest(most - used, 0) END::BIGINT AS left_over FROM g LEFT JOIN l USING (project_id) WHERE used IS NOT NULL")
def limit_check(spark: SparkSession, d: str) -> DataFrame:
    used = usage.distinct_events(table(spark, d, "usage_events")).filter("project_id is not null").groupBy("project_id").agg(F.sum("tokens_used").alias("used")).filter("used is not null")
    first = F.substring("project_id", 1, 1)
    limits = used.filter(first != "b").select("project_id", F.when(first != "a", F.lit(20_000)).cast("long").alias("most"))
    left = usage.against_limits(used, limits, "project_id")
    return left.withColumns({"left_over": F.when(F.col("most").isNull(), -1).otherwise(F.col("left_over")), "most": F.coalesce("most", F.lit(-1))})


@query("SELECT DISTINCT source_id, substr(regexp_replace(regexp_replace(lower(file_path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 50) AS slug FROM files")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("source_id", T.slug(F.col("file_path")).alias("slug")).distinct()


# ---- search, ranking, budget


@query(f"WITH {_FOUND} SELECT id, round(similarity, 6) AS similarity FROM k")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return similarity.search(chunks, _query_vector(chunks), CANDIDATES).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_DISTINCT}, v AS (SELECT id, e FROM c WHERE len(e) = 64), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, id, CASE WHEN list_sum(list_transform(e, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity(e, w) END AS similarity FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10")
def batch_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.search_many(table(spark, d, "chunks"), queries, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_DISTINCT} SELECT id, round({_S['path_match']}, 6) AS path_match, round({_S['content_match']}, 6) AS content_match, {_S['kind']}::DOUBLE AS kind FROM c")
def text_signals(spark: SparkSession, d: str) -> DataFrame:
    words = T.keywords(QUERY)
    rows = table(spark, d, "chunks").select("id", "file_path", "content")
    out = rows.select("id", F.round(T.path_match(F.col("file_path"), words), 6).alias("path_match"), F.round(T.content_match(F.col("content"), words), 6).alias("content_match"), T.file_kind(F.col("file_path")).alias("kind"))
    return out.distinct()


@query(f"WITH {_DISTINCT} SELECT id, round({_S['symbol_match']}, 6) AS symbol_match FROM c")
def symbol_signal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.round(T.symbol_match(F.col("content"), T.names(QUERY)), 6).alias("symbol_match")).distinct()


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    found = _engine(spark, d).candidates(_query_vector(chunks))
    counted = found.withColumn("tokens", F.when(F.col("tokens") >= 1, F.col("tokens")).otherwise(T.token_count(F.col("content"))).cast("long"))
    return ranking.rank(counted, QUERY, table(spark, d, "import_edges"))


@query(f"WITH {_RANKED} SELECT id, round(base, 6) AS base, round(boost, 6) AS boost, round(score, 6) AS score FROM r")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("id", *(F.round(c, 6).alias(c) for c in ("base", "boost", "score")))


@query(f"WITH {_RANKED} SELECT id, round(score * (1 - least((row_number() OVER (PARTITION BY source_id, file_path ORDER BY score DESC, base DESC, id) - 1) * 0.1, 0.3)), 6) AS score FROM r")
def diversity_penalty(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversify(_ranked(spark, d)).select("id", F.round("score", 6).alias("score"))


def _order() -> list:
    return [F.desc("score"), F.desc("base"), F.desc("similarity"), F.col("id")]


@query(f"WITH RECURSIVE {_ORDERED}, w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS total, '' AS id, false AS kept UNION ALL SELECT o.n, CASE WHEN w.total + o.tokens <= {BUDGET} THEN w.total + o.tokens ELSE w.total END, o.id, w.total + o.tokens <= {BUDGET} FROM w JOIN o ON o.n = w.n + 1) SELECT w.id, o.tokens FROM w JOIN o ON o.id = w.id WHERE w.kept")
def greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    return B.greedy(_ranked(spark, d), BUDGET, [], _order()).select("id", "tokens")


@query(f"WITH {_ORDERED}, p AS (SELECT id, tokens, sum(tokens) OVER (ORDER BY n) AS running FROM o) SELECT id, tokens, running::BIGINT AS running FROM p WHERE running <= {BUDGET}")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    return B.prefix(_ranked(spark, d), BUDGET, [], _order()).select("id", "tokens", "running")


_MERGE = """m0 AS (SELECT *, lag(end_line) OVER f AS before FROM lined WINDOW f AS (PARTITION BY source_id, file_path ORDER BY start_line, end_line, id)),
m1 AS (SELECT *, CASE WHEN before IS NULL OR before + 1 < start_line THEN 1 ELSE 0 END AS opens, row_number() OVER f AS nth FROM m0 WINDOW f AS (PARTITION BY source_id, file_path ORDER BY start_line, end_line, id)),
m2 AS (SELECT *, sum(opens) OVER (PARTITION BY source_id, file_path ORDER BY nth) AS island, CASE WHEN opens = 1 THEN 0 ELSE greatest(0, before - start_line + 1) END AS over FROM m1),
m3 AS (SELECT *, tokens - CASE WHEN over > 0 THEN floor(tokens * (over::DOUBLE / (end_line - start_line + 1)))::BIGINT ELSE 0 END AS own_tokens, CASE WHEN over > 0 THEN array_to_string(list_slice(string_split(content, chr(10)), (over + 1)::BIGINT, NULL), chr(10)) ELSE content END AS own FROM m2)"""


@query(f"WITH {_DISTINCT}, lined AS (SELECT id, source_id, file_path, content, start_line, end_line, coalesce(tokens, 0)::BIGINT AS tokens FROM c WHERE start_line IS NOT NULL AND end_line IS NOT NULL), {_MERGE} SELECT source_id, file_path, arg_min(id, nth) AS id, arg_min(start_line, nth) AS start_line, arg_max(end_line, nth) AS end_line, sum(own_tokens)::BIGINT AS tokens, count(*) AS chunks, md5(string_agg(own, chr(10) ORDER BY nth) FILTER (WHERE opens = 1 OR own <> '')) AS digest FROM m3 GROUP BY source_id, file_path, island")
def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", "source_id", "file_path", "content", "start_line", "end_line", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(0.0).alias("score"))
    lined = rows.filter("start_line is not null and end_line is not null").dropDuplicates(["id"])
    return B.merge_adjacent(lined).select("source_id", "file_path", "id", "start_line", "end_line", "tokens", "chunks", F.md5("content").alias("digest"))


_KEPT = f"""{_ORDERED}, w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS total, '' AS id, false AS kept UNION ALL SELECT o.n, CASE WHEN w.total + o.tokens <= {BUDGET} THEN w.total + o.tokens ELSE w.total END, o.id, w.total + o.tokens <= {BUDGET} FROM w JOIN o ON o.n = w.n + 1),
lined AS (SELECT o.id, source_id, file_path, content, coalesce(start_line, 1) AS start_line, coalesce(end_line, start_line, 1) AS end_line, tokens, score FROM w JOIN o ON o.id = w.id WHERE w.kept), {_MERGE},
joined AS (SELECT source_id, file_path, arg_min(id, nth) AS id, arg_min(start_line, nth) AS start_line, arg_max(end_line, nth) AS end_line, sum(own_tokens)::BIGINT AS tokens, max(score) AS score, string_agg(own, chr(10) ORDER BY nth) FILTER (WHERE opens = 1 OR own <> '') AS content FROM m3 GROUP BY source_id, file_path, island)"""


@query(f"WITH RECURSIVE {_KEPT} SELECT source_id, file_path, id, start_line, end_line, tokens, round(score, 6) AS score, content FROM joined")
def select_context(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return _engine(spark, d).selected(QUERY, _query_vector(chunks), BUDGET).select("source_id", "file_path", "id", "start_line", "end_line", "tokens", F.round("score", 6).alias("score"), "content")


@query(f"WITH {_FOUND}, t AS (SELECT k.id, similarity, ceil(length(content) / 4.0)::BIGINT AS tokens FROM k JOIN c USING (id)), p AS (SELECT *, sum(tokens) OVER (ORDER BY similarity DESC, id) AS running FROM t) SELECT id, tokens, round(similarity, 6) AS similarity FROM p WHERE running <= {BUDGET}")
def select_prefix(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return _engine(spark, d).selected(QUERY, _query_vector(chunks), BUDGET, policy="prefix").select("id", "tokens", F.round("similarity", 6).alias("similarity"))


@query(f"WITH RECURSIVE {_KEPT}, p AS (SELECT file_path, '=== ' || file_path || ' ===' || chr(10) || string_agg(content, chr(10) || chr(10) ORDER BY start_line) AS part FROM joined GROUP BY file_path) SELECT 1::BIGINT AS query_id, string_agg(part, chr(10) || chr(10) ORDER BY file_path) AS text FROM p")
def select_plain(spark: SparkSession, d: str) -> DataFrame:
    picked = _engine(spark, d).selected(QUERY, _query_vector(table(spark, d, "chunks")), BUDGET)
    return formatting.render_all(picked.withColumns({"query_id": F.lit(1).cast("long"), "query": F.lit(QUERY), "considered": F.lit(CANDIDATES)}), "plain")


@query(f"WITH {_DISTINCT} SELECT id, md5('## ' || file_path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```') AS markdown, md5('<file path=\"' || file_path || '\" lines=\"' || start_line || '-' || end_line || '\">' || chr(10) || content || chr(10) || '</file>') AS xml, md5('// ' || file_path || ':' || start_line || '-' || end_line || chr(10) || content) AS plain FROM c WHERE start_line IS NOT NULL AND end_line IS NOT NULL")
def hosted_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").filter("start_line is not null and end_line is not null")
    return rows.select("id", *(F.md5(formatting.render_plainly(f)).alias(f) for f in ("markdown", "xml", "plain"))).distinct()


@query()
def select_rendered(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    picked = formatting.as_map(_engine(spark, d).selected(QUERY, _query_vector(chunks), BUDGET))
    return formatting.render_all(picked.withColumns({"query_id": F.lit(1).cast("long"), "query": F.lit(QUERY), "considered": F.lit(CANDIDATES)}), mode="map")


# ---- graphs


@query("SELECT source_id, dst AS file_path, count(DISTINCT src) AS importers, string_agg(DISTINCT src, ',' ORDER BY src) AS imported_by FROM import_edges GROUP BY source_id, dst")
def importers(spark: SparkSession, d: str) -> DataFrame:
    return graphs.importers(table(spark, d, "import_edges")).withColumn("imported_by", F.array_join("imported_by", ","))


@query("WITH e AS (SELECT DISTINCT source_id, src, dst FROM import_edges), f AS (SELECT DISTINCT source_id, src FROM e WHERE source_id || src IN (SELECT source_id || min(src) FROM e GROUP BY source_id)) SELECT DISTINCT e.source_id, e.dst AS file_path FROM e SEMI JOIN f ON e.source_id = f.source_id AND e.src = f.src ANTI JOIN f g ON e.source_id = g.source_id AND e.dst = g.src")
def related_left(spark: SparkSession, d: str) -> DataFrame:
    """Files that the included ones import and that aren't included themselves."""
    edges = table(spark, d, "import_edges")
    included = edges.groupBy("source_id").agg(F.min("src").alias("src"))
    hit = edges.join(included, ["source_id", "src"], "left_semi").select("source_id", F.col("dst").alias("file_path")).distinct()
    return hit.join(included.withColumnRenamed("src", "file_path"), ["source_id", "file_path"], "left_anti")


_SEEDS = "z AS (SELECT source_id, min(src) AS file_path FROM import_edges GROUP BY source_id)"


@query(f"WITH RECURSIVE {_SEEDS}, w AS (SELECT source_id, file_path, 0 AS depth FROM z UNION SELECT w.source_id, e.dst, w.depth + 1 FROM w JOIN import_edges e ON e.source_id = w.source_id AND e.src = w.file_path WHERE w.depth < 3), m AS (SELECT source_id, file_path, min(depth) AS depth FROM w GROUP BY ALL) SELECT source_id, file_path, depth FROM m WHERE depth > 0")
def related_files(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "import_edges")
    return graphs.related(edges, edges.groupBy("source_id").agg(F.min("src").alias("file_path")), 3)


_IMPORTS = f"""{_DISTINCT}, f AS (SELECT source_id, file_path, string_agg(content || CASE WHEN content = '' OR ends_with(content, chr(10)) THEN '' ELSE chr(10) END, '' ORDER BY coalesce(start_line, 1), id) AS content FROM c GROUP BY ALL),
l AS (SELECT source_id, file_path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM f WHERE regexp_matches(lower(file_path), '\\.(ts|tsx|js|jsx|mjs|cjs)$')),
n AS (SELECT *, regexp_extract(text, '^import \\{{([^}}]+)\\}} from \\x27([^\\x27]+)\\x27', ['names', 'specifier']) AS m, regexp_extract(text, 'require\\([\"\\x27]([^\"\\x27]+)[\"\\x27]\\)', 1) AS q FROM l WHERE NOT regexp_matches(ltrim(text), '^(//|[*])')),
i AS (SELECT source_id, file_path, line, CASE WHEN m.specifier <> '' THEN m.specifier ELSE q END AS specifier, CASE WHEN m.specifier <> '' THEN 'named' ELSE 'require' END AS form, CASE WHEN m.specifier <> '' THEN array_to_string(list_transform(string_split(m.names, ','), lambda x: trim(x)), ',') ELSE '' END AS names FROM n WHERE m.specifier <> '' OR q <> '')"""


@query(f"WITH {_IMPORTS} SELECT source_id, file_path, line, specifier, form, names, CASE WHEN starts_with(specifier, '.') THEN 'relative' WHEN starts_with(specifier, '/') THEN 'absolute' ELSE 'package' END AS kind FROM i")
def import_statements(spark: SparkSession, d: str) -> DataFrame:
    found = graphs.parse_imports(chunking.files_of(table(spark, d, "chunks")))
    return found.select("source_id", "file_path", "line", "specifier", "form", F.array_join("names", ",").alias("names"), "kind")


@query(f"""WITH {_IMPORTS}, a AS (SELECT DISTINCT source_id, file_path AS src, list_filter(string_split(regexp_replace(file_path, '[^/]*$', ''), '/'), lambda x: x <> '') AS dir, len(regexp_extract_all(specifier, '\\.\\./')) AS ups, regexp_replace(specifier, '^(\\.{{1,2}}/)+', '') AS tail FROM i WHERE starts_with(specifier, '.')),
b AS (SELECT source_id, src, array_to_string(list_slice(dir, 1, greatest(len(dir) - ups, 0)) || [tail], '/') AS base FROM a),
e AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS ending, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 1) AS rank),
h AS (SELECT b.source_id, src, base, f.file_path AS dst, row_number() OVER (PARTITION BY b.source_id, src, base ORDER BY rank) AS k FROM b, e JOIN f ON f.source_id = b.source_id AND f.file_path = base || ending)
SELECT DISTINCT source_id, src, dst FROM h WHERE k = 1""")
def import_graph(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).imports()


@query()
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).symbols("symbolTable")


@query()
def symbol_definitions(spark: SparkSession, d: str) -> DataFrame:
    return symbols.definitions(table(spark, d, "chunks"))


@query()
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return symbols.call_edges(table(spark, d, "chunks"))


# ---- chunking


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select(F.coalesce("source", F.lit("none")).alias("source_id"), F.coalesce("file_path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.col("text").alias("content"))


_LINES = """f AS (SELECT row_number() OVER () AS k, coalesce(source, 'none') AS source_id, coalesce(file_path, 'doc-' || doc_id || '.txt') AS file_path, text AS content FROM documents WHERE text IS NOT NULL),
l AS (SELECT k, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f),
c AS (SELECT k, n, text, ceil((length(text) + 1) / 4.0)::BIGINT AS cost, sum(ceil((length(text) + 1) / 4.0)::BIGINT) OVER (PARTITION BY k ORDER BY n) AS upto, count(*) OVER (PARTITION BY k) AS lines FROM l),
b AS (SELECT c.k, c.n, c.cost, c.upto, c.lines, max(p.n) AS back FROM c LEFT JOIN c p ON p.k = c.k AND p.n < c.n AND p.n > c.n - 60 AND (c.upto - c.cost) - (p.upto - p.cost) >= 50 GROUP BY ALL),
w AS (SELECT k, 0::BIGINT AS n, 1::BIGINT AS start, NULL::BIGINT AS a, NULL::BIGINT AS z FROM f UNION ALL
      SELECT w.k, b.n, CASE WHEN full_ THEN greatest(coalesce(b.back, w.start), w.start) ELSE w.start END, CASE WHEN full_ THEN w.start END, CASE WHEN full_ THEN b.n - 1 END
      FROM (SELECT w.*, b.n > w.start AND b.upto - s.upto + s.cost > 500 AS full_ FROM w JOIN b ON b.k = w.k AND b.n = w.n + 1 JOIN b s ON s.k = w.k AND s.n = w.start) w JOIN b ON b.k = w.k AND b.n = w.n + 1),
r AS (SELECT k, a, z, false AS last FROM w WHERE a IS NOT NULL UNION ALL SELECT w.k, w.start, w.n, true FROM w JOIN (SELECT k, max(n) AS n FROM w GROUP BY k) m USING (k, n)),
t AS (SELECT r.k, a, z, last, string_agg(text, chr(10) ORDER BY n) AS content, sum(cost) AS cost FROM r JOIN c ON c.k = r.k AND c.n BETWEEN a AND z GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_LINES} SELECT source_id, file_path, a::INT AS start_line, z::INT AS end_line, md5(t.content) AS digest, (CASE WHEN last THEN ceil(length(t.content) / 4.0) ELSE cost END)::INT AS tokens FROM t JOIN f USING (k)")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk_files(_files(spark, d), structure=False)
    return made.select("source_id", "file_path", "start_line", "end_line", F.md5("content").alias("digest"), "tokens")


@query()
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    options = table(spark, d, "chunk_options").drop("max_unit_tokens")
    return chunking.chunk_files(_files(spark, d).join(F.broadcast(options), "source_id", "left"))  # a row per source at most


@query()
def file_signatures(spark: SparkSession, d: str) -> DataFrame:
    files = chunking.files_of(table(spark, d, "chunks"))
    return files.select("source_id", "file_path", formatting.signatures("content", "file_path").alias("signatures"), formatting.repo_map("content", "file_path").alias("map"))


# ---- hosted index: scopes, lookups, uploads, copies, stored symbols


@query("SELECT DISTINCT id, org_id, event_type FROM usage_events WHERE org_id = (SELECT min(org_id) FROM usage_events) AND event_type = 'query'")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "usage_events")
    org = events.agg(F.min("org_id")).first()[0]
    return service.in_scope(events, org_id=org, event_type="query").select("id", "org_id", "event_type").distinct()


_PROJECTS = "p AS (SELECT DISTINCT org_id, project_id AS id, 'p-' || substr(project_id, 1, 8) AS slug FROM usage_events WHERE project_id IS NOT NULL), a AS (SELECT DISTINCT org_id, CASE WHEN substr(id, 1, 1) < '8' THEN id ELSE slug END AS ref FROM p)"


@query(f"WITH {_PROJECTS} SELECT a.org_id, a.ref, p.id, p.slug FROM a JOIN p ON p.org_id = a.org_id AND (p.id = a.ref OR (p.slug = a.ref AND NOT EXISTS (SELECT 1 FROM p q WHERE q.org_id = a.org_id AND q.id = a.ref))) QUALIFY row_number() OVER (PARTITION BY a.org_id, a.ref ORDER BY p.id) = 1")
def project_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "usage_events").filter("project_id is not null").select("org_id", F.col("project_id").alias("id"), F.concat(F.lit("p-"), F.substring("project_id", 1, 8)).alias("slug")).distinct()
    asked = p.select("org_id", F.when(F.substring("id", 1, 1) < "8", F.col("id")).otherwise(F.col("slug")).alias("ref"))
    return service.by_id_or_slug(asked, p)


@query("WITH m AS (SELECT api_key_id AS user_id, arg_min(org_id, struct_pack(t := created_at, o := org_id)) AS org_id FROM usage_events WHERE api_key_id IS NOT NULL GROUP BY 1), o AS (SELECT org_id, count(DISTINCT id) AS events FROM usage_events GROUP BY 1) SELECT user_id, org_id, events FROM m JOIN o USING (org_id)")
def member_organisation(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "usage_events")
    members = events.filter("api_key_id is not null").select(F.col("api_key_id").alias("user_id"), "org_id", "created_at")
    return service.organisation_of(members, events.groupBy(F.col("org_id").alias("id")).agg(F.count_distinct("id").alias("events"))).select("user_id", "org_id", "events")


@query("SELECT id, path, (SELECT count(*) FROM sources) AS total FROM sources ORDER BY id LIMIT 20 OFFSET 10")
def page_total(spark: SparkSession, d: str) -> DataFrame:
    return service.page_with_total(table(spark, d, "sources").select("id", "path"), ["id"], 20, 10)


@query(f"WITH {_VERSIONS} SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY version DESC) <= 20")
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    return service.newest_versions(_versions(spark, d))


@query("SELECT source_id AS project_id, count(*) AS files, coalesce(sum(length(content)), 0)::BIGINT AS characters, count(*) <= 10000 AND coalesce(sum(length(content)), 0) <= 104857600 AND count(*) FILTER (WHERE file_path IS NULL OR file_path = '' OR content IS NULL) = 0 AS accepted FROM chunks GROUP BY 1")
def upload_check(spark: SparkSession, d: str) -> DataFrame:
    return service.check_uploads(table(spark, d, "chunks").select(F.col("source_id").alias("project_id"), F.col("file_path").alias("path"), "content"))


_DIGESTS = "h AS (SELECT DISTINCT source_id, id, ('0x' || substr(md5(id || ':' || content), 1, 12))::BIGINT AS h, start_line FROM chunks), a AS (SELECT source_id, sum(h) AS digest FROM h WHERE substr(source_id, 1, 1) <> 'b' GROUP BY 1), b AS (SELECT source_id, sum(h) AS digest FROM h WHERE substr(source_id, 1, 1) <> 'c' AND NOT (substr(source_id, 1, 1) < 'h' AND start_line > 40) GROUP BY 1)"


@query(f"WITH {_DIGESTS} SELECT source_id, CASE WHEN b.digest IS NULL THEN 'upload' WHEN a.digest IS NULL THEN 'download' WHEN a.digest = b.digest THEN 'skip' ELSE 'upload' END AS action FROM a FULL JOIN b USING (source_id)")
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    """The whole-index sync of two states of the index: one lacks some sources, the other others and the later lines of some."""
    chunks, first = table(spark, d, "chunks"), F.substring("source_id", 1, 1)
    there = chunks.filter((first != "c") & ~((first < "h") & (F.coalesce("start_line", F.lit(0)) > 40)))
    return service.to_sync(service.index_digest(chunks.filter(first != "b")), service.index_digest(there))


@query("WITH c AS (SELECT DISTINCT id, source_id AS project_id, sha256(content) AS checksum, strlen(content) AS bytes FROM chunks) SELECT project_id, checksum, max(bytes)::BIGINT AS bytes, count(*) AS uses FROM c GROUP BY ALL")
def project_manifest(spark: SparkSession, d: str) -> DataFrame:
    return service.manifest(table(spark, d, "chunks")).withColumn("bytes", F.col("bytes").cast("long"))


@query("WITH c AS (SELECT DISTINCT source_id AS project_id, sha256(content) AS checksum, md5(content) AS digest FROM chunks) SELECT project_id, 1 AS version, checksum, digest FROM c WHERE substr(project_id, 1, 1) >= 'h' AND substr(checksum, 1, 1) < '8' UNION ALL SELECT project_id, CASE WHEN EXISTS (SELECT 1 FROM c o WHERE o.project_id = c.project_id AND substr(o.checksum, 1, 1) < '8') THEN 2 ELSE 1 END, checksum, digest FROM c WHERE substr(project_id, 1, 1) < 'h'")
def snapshot_download(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each project after some of them were finalized once more."""
    chunks = table(spark, d, "chunks").select(F.col("source_id").alias("project_id"), F.sha2("content", 256).alias("checksum"), "content")
    old = chunks.filter(F.substring("checksum", 1, 1) < "8").select("project_id", F.lit(1).alias("version"), "checksum").distinct()
    snapshots = service.finalize(old, chunks.filter(F.substring("project_id", 1, 1) < "h"))
    return service.download(snapshots, chunks).select("project_id", "version", "checksum", F.md5("content").alias("digest"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with what a hosted index stores of them: the unit's name as symbol, and the words before brackets as calls."""
    rows = table(spark, d, "chunks").dropDuplicates(["id"])
    names = F.when(F.col("unit_name").isNotNull(), F.array("unit_name")).otherwise(F.array().cast("array<string>"))
    return rows.select("id", "file_path", "start_line", "content", F.lit(None).cast("string").alias("kind"), names.alias("symbols"), F.array_distinct(F.regexp_extract_all("content", F.lit(r"([a-z][A-Za-z0-9]+)\("), F.lit(1))).alias("calls"))


_STORED = "s AS (SELECT id, any_value(file_path) AS file_path, any_value(start_line) AS start_line, any_value(content) AS content, any_value(unit_name) AS name FROM chunks GROUP BY id)"


@query(f"WITH {_STORED} SELECT name, 'function' AS kind, file_path, start_line FROM s WHERE contains(lower(name), 'cache') ORDER BY name, file_path, start_line, id LIMIT 50")
def stored_symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return service.stored_symbols(_stored(spark, d), "Cache", limit=500).select("name", "kind", "file_path", "start_line")


@query(f"WITH {_STORED}, t AS (SELECT *, list_distinct(regexp_extract_all(content, '([a-z][A-Za-z0-9]+)\\(', 1)) AS calls FROM s), a AS (SELECT * FROM t WHERE list_contains(calls, 'split') ORDER BY file_path, start_line NULLS FIRST, id LIMIT 50), b AS (SELECT * FROM t WHERE name = 'split' ORDER BY file_path, start_line NULLS FIRST, id LIMIT 10) SELECT DISTINCT 'caller' AS side, coalesce(name, 'anonymous') AS name, file_path, coalesce(start_line, 0) AS line FROM a UNION SELECT DISTINCT 'callee', unnest(calls), file_path, 0 FROM b")
def stored_call_graph(spark: SparkSession, d: str) -> DataFrame:
    return service.stored_calls(_stored(spark, d), "split")


@query("WITH e AS (SELECT org_id, epoch_us(date_trunc('hour', created_at)) AS hour_at, count(DISTINCT id) AS n FROM usage_events GROUP BY ALL), m AS (SELECT max(epoch_us(created_at)) AS now_at FROM usage_events) SELECT org_id, hour_at, n FROM e, m WHERE now_at - hour_at < 3024000 * 1000000::BIGINT")
def counters_alive(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "usage_events")
    hours = events.groupBy("org_id", F.date_trunc("hour", "created_at").alias("hour_at")).agg(F.count_distinct("id").alias("n"))
    now = events.agg(F.max("created_at")).first()[0]
    return service.alive(hours, "hour_at", F.lit(now), service.COUNTER_TTL).withColumn("hour_at", F.unix_micros("hour_at"))


@query("SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 102.4 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 104857.6 + 0.5) / 10) END AS size, format('{:,}', n) AS number FROM (SELECT DISTINCT id, strlen(content) AS n FROM chunks)")
def readable_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", F.octet_length("content").alias("n")).distinct()
    return rows.select("id", T.readable_bytes(F.col("n")).alias("size"), T.readable_number(F.col("n")).alias("number"))


@query("WITH h AS (SELECT DISTINCT * FROM query_history), m AS (SELECT max(id) AS last FROM h), r AS (SELECT query, created_at, row_number() OVER (ORDER BY created_at, query) AS n FROM (SELECT DISTINCT query, max(created_at) OVER (PARTITION BY query) AS created_at FROM h)) SELECT id, query, coalesce(sources, '') AS sources FROM h UNION ALL SELECT last + n, query, 'a,b' FROM r, m")
def history_record(spark: SparkSession, d: str) -> DataFrame:
    """The history after each of its queries was asked once more."""
    history = table(spark, d, "query_history").distinct()
    asked = history.groupBy("query").agg(F.max("created_at").alias("created_at"))
    filled = asked.select("query", F.array(F.lit("a"), F.lit("b")).alias("sources"), "created_at", *(F.lit(None).cast(t).alias(c) for c, t in history.dtypes if c not in ("id", "query", "sources", "created_at")))
    return store.record(history, filled).select("id", "query", F.coalesce("sources", F.lit("")).alias("sources"))


@query("SELECT DISTINCT id FROM query_history WHERE created_at >= (SELECT min(created_at) + (max(created_at) - min(created_at)) / 2 FROM query_history)")
def history_cleared(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "query_history")
    t = history.agg(((F.unix_micros(F.min("created_at")) + F.unix_micros(F.max("created_at"))) / 2).cast("long").alias("t")).first().t
    return store.clear(history, F.timestamp_micros(F.lit(t))).select("id").distinct()


@query("WITH w AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS word FROM (SELECT DISTINCT id, content FROM chunks)), b AS (SELECT id, ('0x' || substr(md5(word), 1, 7))::BIGINT % 384 AS at, sum(CASE WHEN ('0x' || substr(md5(word), 8, 1))::INT < 8 THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM b GROUP BY id) SELECT id, round(max(v / norm), 4) AS most, round(min(v / norm), 4) AS least, count(*) FILTER (WHERE v <> 0) AS filled FROM b JOIN n USING (id) WHERE norm > 0 GROUP BY id")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", "content").distinct().select("id", embedding.embed(F.col("content")).alias("v"))
    filled = rows.withColumn("v", F.filter("v", lambda x: x != 0)).filter(F.size("v") > 0)
    return filled.select("id", F.round(F.array_max("v").cast("double"), 4).alias("most"), F.round(F.array_min("v").cast("double"), 4).alias("least"), F.size("v").cast("long").alias("filled"))


@query("SELECT id, coalesce(len(json_extract(config, '$.include')::JSON[]), -1) AS includes, coalesce(len(json_extract(config, '$.exclude')::JSON[]), -1) AS excludes, config IS NULL AS by_default FROM sources")
def source_configs(spark: SparkSession, d: str) -> DataFrame:
    kind = "include array<string>, exclude array<string>"
    rows = table(spark, d, "sources").select("id", F.col("config").isNull().alias("by_default"), F.from_json("config", kind).alias("c"))
    return rows.select("id", *(F.coalesce(F.size(f"c.{k}"), F.lit(-1)).cast("long").alias(f"{k}s") for k in ("include", "exclude")), "by_default")
