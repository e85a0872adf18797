"""The index as tables: change detection, upserts, snapshots, cache, history and statistics.

Tables are never changed in place: an operator gives the new state, and ``publish`` writes it as a new version and then moves the pointer.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


FILE_KEY = ["source_id", "file_path"]


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The latest row of each key: the greatest of ``by``, nulls least, whole rows breaking ties."""
    others = [c for c in rows.columns if c not in keys and c not in by]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*(F.col(c) for c in [*by, *others]))).alias("r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns))


def categorize(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_id, file_path, status) of each file: new, changed, unchanged or removed, by content hash."""
    d = discovered.select(*FILE_KEY, F.col("content_hash").alias("now"))
    s = stored.select(*FILE_KEY, F.col("content_hash").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return d.join(s, FILE_KEY, "full_outer").select(*FILE_KEY, status.alias("status"))


def diff(discovered: DataFrame, stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """``categorize`` with the chunks that each stored file has (null for a changed file without any, 0 for a removed one)."""
    counts = chunks.groupBy(*FILE_KEY).agg(F.count_distinct("id").alias("n"))
    rows = categorize(discovered, stored).join(counts, FILE_KEY, "left")
    return rows.select(*FILE_KEY, "status", F.when(F.col("status") == "changed", F.col("n")).when(F.col("status") == "removed", F.coalesce("n", F.lit(0))).alias("chunk_count"))


def diff_summary(changes: DataFrame) -> DataFrame:
    """Files by source and status, and whether the source must be indexed again."""
    by = changes.groupBy("source_id").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("new", "changed", "removed", "unchanged")))
    return by.withColumn("needs_reindex", (F.col("new") + F.col("changed") + F.col("removed")) > 0)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """``table`` with ``rows`` put in by key: replacing what is there, or (``update`` false) only where nothing is."""
    fresh = rows if update else rows.join(table.select(*keys), keys, "left_anti")
    kept = table.join(rows.select(*keys), keys, "left_anti") if update else table
    return kept.unionByName(fresh.select(*table.columns))


def replace_files(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after an incremental run: those of changed and removed files go, fresh ones come."""
    gone = changes.filter(F.col("status").isin("changed", "removed")).select(*FILE_KEY)
    return chunks.join(gone, FILE_KEY, "left_anti").unionByName(fresh.select(*chunks.columns))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias("_parent")), F.col(child_key) == F.col("_parent"), "left_semi")


def missing_chunks(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Checksums that a manifest names and the store doesn't hold, each once."""
    return manifest.select("checksum").distinct().join(stored.select("checksum"), "checksum", "left_anti")


def next_version(snapshots: DataFrame) -> DataFrame:
    """(project_id, version) that the next snapshot of each project gets."""
    return snapshots.groupBy("project_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each project."""
    return snapshots.groupBy("project_id").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*")


def index_stats(sources: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: sources, files, chunks, embedded chunks, their percentage, time of the last index."""
    c = chunks.select("id", F.col("embedding").isNotNull().alias("e"), "created_at").groupBy("id").agg(F.max("e").alias("e"), F.max("created_at").alias("created_at"))
    chunk_row = c.agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("e"), 1)).alias("embedded"), F.max("created_at").alias("last_chunk"))
    file_row = files.agg(F.count_distinct("id").alias("files"))
    source_row = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("indexed_at").alias("last_indexed"))
    coverage = F.when(F.col("chunks") > 0, F.round(100 * F.col("embedded") / F.col("chunks"), 4)).otherwise(0.0)
    return source_row.crossJoin(file_row).crossJoin(chunk_row).withColumn("coverage", coverage)  # rows of one


def index_version(chunks: DataFrame) -> DataFrame:
    """A mark that changes with the index: hash of the number of chunks and sources and the last time."""
    row = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("s"), F.coalesce(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("t"))
    return row.select(F.substring(F.sha2(F.concat_ws(":", "n", "s", "t"), 256), 1, 16).alias("version"))


def cache_key(query: str, budget: int, sources: list[str] | None = None, format: str = "markdown", mode: str = "full", imports: bool = True) -> str:
    """The key of a request; the order of its sources doesn't matter."""
    return hashlib.sha256(json.dumps({"query": query, "budget": budget, "sources": sorted(sources or []), "format": format, "mode": mode, "imports": imports}, sort_keys=True).encode()).hexdigest()


def history_keys(history: DataFrame) -> DataFrame:
    """Requests of the history with their key, as columns: repeated rows once."""
    ordered = F.array_join(F.array_sort(F.split(F.coalesce("sources", F.lit("")), ",")), ",")
    key = F.sha2(F.concat_ws("|", "query", F.col("budget").cast("string"), ordered, "format", F.coalesce("mode", F.lit("full"))), 256)
    return history.dropDuplicates(["id"]).select("id", "created_at", key.alias("cache_key"))


def cache_hits(history: DataFrame) -> DataFrame:
    """Of each key: requests, hits (all but the first) and the times of the first and the last."""
    return history_keys(history).groupBy("cache_key").agg(F.count(F.lit(1)).alias("requests"), (F.count(F.lit(1)) - 1).alias("hits"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def lookup(cache: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(the cached row, the cache after the lookup): a hit counts up, a row of another version goes."""
    hit = cache.filter((F.col("cache_key") == key) & (F.col("index_version") == version))
    kept = cache.filter((F.col("cache_key") != key) | (F.col("index_version") == version))
    return hit, kept.withColumn("hit_count", F.col("hit_count") + (F.col("cache_key") == key).cast("int"))


def recent_history(history: DataFrame, limit: int = 20) -> DataFrame:
    """The newest requests, repeated rows once; of equal times the greater id first."""
    return history.dropDuplicates(["id"]).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def record(history: DataFrame, requests: DataFrame) -> DataFrame:
    """``history`` with new requests (sources as an array become one text), whose ids follow the greatest so far in order of their time."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    n = F.row_number().over(Window.orderBy("created_at", "query"))  # the requests since the last record
    fresh = requests.withColumn("sources", F.array_join("sources", ",")).withColumn("n", n).crossJoin(F.broadcast(last)).withColumn("id", (F.col("last") + F.col("n")).cast("long"))
    return history.unionByName(fresh.select(*history.columns))


def clear(history: DataFrame, before: Column | None = None) -> DataFrame:
    """``history`` without the requests before a time, or empty."""
    return history.filter(F.lit(False)) if before is None else history.filter(F.col("created_at") >= before)


def page(rows: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of at most 100 rows."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, 100))


def export_index(sources: DataFrame, files: DataFrame, chunks: DataFrame, embeddings: bool = True) -> DataFrame:
    """(kind, document): the index as JSON documents, one a row, so an export of any size is written by many tasks."""
    vector = F.base64(F.to_binary(F.array_join(F.transform("embedding", lambda x: F.hex(x.cast("string"))), "2C"), F.lit("hex"))) if embeddings else F.lit(None).cast("string")
    rows = [(sources, "source"), (latest(files, ["id"], ["indexed_at"]), "file"), (chunks.dropDuplicates(["id"]).withColumn("embedding", vector), "chunk")]
    out = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("document")) for df, kind in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


def import_index(documents: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of an export; a vector comes back as numbers."""
    out = {}
    for kind, schema in schemas.items():
        df = documents.filter(F.col("kind") == kind).select(F.from_json("document", schema).alias("r")).select("r.*")
        if "embedding" in df.columns:
            df = df.withColumn("embedding", F.transform(F.split(F.unbase64("embedding").cast("string"), ","), lambda x: x.cast("float")))
        out[kind] = df
    return out


def publish(tables: dict[str, DataFrame], root: str, partition: dict[str, list[str]] | None = None) -> int:
    """Write the tables as the next version under ``root`` and move the pointer to it; readers see the old version until then.

    A version is taken by a file that can be made only once, so two writers never share one; one that fails leaves a gap.
    """
    spark = next(iter(tables.values())).sparkSession
    version = _take_version(spark, root, current_version(spark, root) + 1)
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition or {}).get(name, [])).parquet(f"{root}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def _take_version(spark: SparkSession, root: str, version: int) -> int:
    """The first version from ``version`` on that nobody has taken."""
    while True:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/taken/v{version}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            files.create(path, False).close()
            return version
        except Exception:
            if not files.exists(path):
                raise
            version += 1


def current_version(spark: SparkSession, root: str) -> int:
    """The version that readers see; 0 if nothing was published."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return spark.read.schema("version long").parquet(f"{root}/pointer").agg(F.max("version")).first()[0] or 0


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a published version, the current one by default."""
    return spark.read.parquet(f"{root}/v{version or current_version(spark, root)}/{name}")


