"""What a hosted index needs beside the index: scopes, lookups by id or name, pages with totals, uploads, copies of a whole index, manifests, and searches in stored symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most files and characters of an upload.
UPLOAD_FILES, UPLOAD_CHARACTERS = 10_000, 100 * 1024 * 1024
#: Symbols given by default and at most, and stored chunks looked at for callers and callees.
SYMBOLS, MOST_SYMBOLS, CALLERS, CALLEES = 10, 50, 50, 10
#: Seconds that a counter, a cached result and a limiter's window are kept.
COUNTER_TTL, CACHE_TTL, LIMITER_TTL = 3_024_000, 3_600, 120


def in_scope(rows: DataFrame, **values: str) -> DataFrame:
    """The rows that have all of the values; a null value or cell fits nothing."""
    for column, value in values.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def by_id_or_slug(asked: DataFrame, projects: DataFrame) -> DataFrame:
    """(org_id, ref, id, slug): of each asked (org_id, ref) the project of the organisation with that id, or else with that slug (the least id of several)."""
    p = projects.select(F.col("org_id").alias("o"), "id", "slug")
    each = p.select("o", F.col("id").alias("name"), F.lit(0).alias("how"), "id", "slug").unionByName(p.select("o", F.col("slug").alias("name"), F.lit(1).alias("how"), "id", "slug"))
    hit = asked.distinct().join(each, (F.col("org_id") == F.col("o")) & (F.col("ref") == F.col("name")))
    best = hit.groupBy("org_id", "ref").agg(F.min(F.struct("how", "id", "slug")).alias("b"))
    return best.select("org_id", "ref", "b.id", "b.slug")


def organisation_of(members: DataFrame, organisations: DataFrame) -> DataFrame:
    """(user_id, org_id, ..): the organisation of each user's first membership by time, then by id."""
    first = members.groupBy("user_id").agg(F.min_by("org_id", F.struct("created_at", "org_id")).alias("org_id"))
    return first.join(organisations.withColumnRenamed("id", "org_id"), "org_id")


def page_with_total(rows: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of at most 100 rows, each with the number of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, 100)).crossJoin(F.broadcast(total))  # one row


def newest_versions(snapshots: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` versions of each project."""
    w = Window.partitionBy("project_id").orderBy(F.desc("version"))
    return snapshots.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def check_uploads(files: DataFrame) -> DataFrame:
    """(project_id, files, characters, accepted) of each upload (project_id, path, content): 1 to ``UPLOAD_FILES`` files with paths, of ``UPLOAD_CHARACTERS`` characters at most."""
    by = files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"), F.count(F.when(F.col("path").isNull() | (F.col("path") == "") | F.col("content").isNull(), 1)).alias("broken")
    )
    fine = (F.col("files") <= UPLOAD_FILES) & (F.col("characters") <= UPLOAD_CHARACTERS) & (F.col("broken") == 0)
    return by.select("project_id", "files", "characters", fine.alias("accepted"))


def index_digest(chunks: DataFrame, by: str = "source_id") -> DataFrame:
    """(source_id, chunks, digest): a mark of each source's whole index that doesn't depend on the order of rows; sums of hashes add up map-side, so no source is one task.

    Hashes have 48 bits, so the sum of a large source leaves 64 bits; it is a decimal."""
    fine = chunks.select(by, "id", F.conv(F.substring(F.md5(F.concat_ws(":", "id", "content")), 1, 12), 16, 10).cast("long").alias("h")).distinct()
    return fine.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("h").cast("decimal(28,0)")).alias("digest"))


def to_sync(local: DataFrame, remote: DataFrame, by: str = "source_id") -> DataFrame:
    """(source_id, action): upload what is only here or differs, download what is only there, skip what is equal."""
    here, there = local.select(by, F.col("digest").alias("a")), remote.select(by, F.col("digest").alias("b"))
    action = F.when(F.col("b").isNull(), "upload").when(F.col("a").isNull(), "download").when(F.col("a") == F.col("b"), "skip").otherwise("upload")
    return here.join(there, by, "full_outer").select(by, action.alias("action"))


def manifest(chunks: DataFrame) -> DataFrame:
    """(project_id, checksum, bytes, uses): the distinct contents of each project, addressed by their hash."""
    return chunks.select("id", F.col("source_id").alias("project_id"), F.sha2("content", 256).alias("checksum"), F.octet_length("content").alias("bytes")).distinct().groupBy("project_id", "checksum").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("uses"))


def finalize(snapshots: DataFrame, project: DataFrame) -> DataFrame:
    """``snapshots`` (project_id, version, checksum) with the checksums of ``project`` as each project's next version, 1 at first."""
    last = snapshots.groupBy("project_id").agg(F.max("version").alias("v"))
    fresh = project.select("project_id", "checksum").distinct().join(last, "project_id", "left")
    return snapshots.unionByName(fresh.select("project_id", (F.coalesce("v", F.lit(0)) + 1).alias("version"), "checksum"))


def download(snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """(project_id, version, checksum, content) of each project's latest version; a checksum that isn't stored has no content."""
    last = snapshots.groupBy("project_id").agg(F.max("version").alias("version"))
    return snapshots.join(last, ["project_id", "version"], "left_semi").join(stored.select("checksum", "content").dropDuplicates(["checksum"]), "checksum", "left")


def has_symbol(symbols: Column, query: str, exact: bool = False) -> Column:
    """Whether one of a chunk's stored names is the query, letter by letter, or holds it in any case."""
    return F.array_contains(symbols, query) if exact else F.exists(symbols, lambda s: F.contains(F.lower(s), F.lit(query.lower())))


def stored_symbols(chunks: DataFrame, query: str, exact: bool = False, kind: str | None = None, limit: int = SYMBOLS) -> DataFrame:
    """(name, kind, file_path, start_line, signature) of stored symbols (array column ``symbols``; ``kind`` null counts as function) that fit the query; at most ``MOST_SYMBOLS``.

    A signature is the line that first names the symbol, and where brackets stay open in it up to four more; without such a line the name.
    """
    kinds = F.coalesce("kind", F.lit("function"))
    rows = chunks.filter(has_symbol(F.col("symbols"), query, exact))
    if kind:
        rows = rows.filter(kinds == kind)
    each = rows.select("id", "file_path", "start_line", "content", kinds.alias("kind"), F.explode("symbols").alias("name"))
    each = each.filter(F.col("name") == query if exact else F.contains(F.lower("name"), F.lit(query.lower())))
    lines = F.split("content", "\n", -1)
    has = lambda x, what: F.contains(x, F.lit(what) if isinstance(what, str) else what)
    at = F.array_position(F.transform(lines, lambda x: has(x, F.col("name"))), F.lit(True)).cast("int")
    head, rest = F.try_element_at(lines, at), F.slice(lines, at + 1, F.lit(4))
    close = F.array_position(F.transform(rest, lambda x: has(x, ")")), F.lit(True)).cast("int")
    more = F.slice(rest, F.lit(1), F.when(close > 0, close).otherwise(F.lit(4)))
    said = F.when(at == 0, F.col("name")).when(has(head, "(") & ~has(head, ")"), F.trim(F.array_join(F.concat(F.array(head), more), "\n"))).otherwise(F.trim(head))
    return each.select("name", "kind", "file_path", "start_line", said.alias("signature"), "id").orderBy("name", "file_path", "start_line", "id").limit(min(limit, MOST_SYMBOLS)).drop("id")


def stored_calls(chunks: DataFrame, target: str) -> DataFrame:
    """(side, name, file_path, line) around a name, from the stored arrays ``symbols`` and ``calls``.

    A caller is a chunk's first symbol, or "anonymous", of the first ``CALLERS`` chunks that call the target; callees are what the first ``CALLEES`` chunks with the
    target as a symbol call, whose line isn't stored and given as 0.
    """
    order = ["file_path", "start_line", "id"]
    callers = chunks.filter(F.array_contains("calls", target)).orderBy(*order).limit(CALLERS)
    name = F.when(F.size("symbols") > 0, F.element_at("symbols", 1)).otherwise(F.lit("anonymous"))
    above = callers.select(F.lit("caller").alias("side"), name.alias("name"), "file_path", F.coalesce("start_line", F.lit(0)).alias("line"))
    inside = chunks.filter(F.array_contains("symbols", target)).orderBy(*order).limit(CALLEES)
    below = inside.select(F.lit("callee").alias("side"), F.explode("calls").alias("name"), "file_path", F.lit(0).alias("line"))
    return above.unionByName(below).distinct()


def alive(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """The rows whose time ``at`` is less than ``seconds`` before ``now``; older counters, cached results and windows have expired."""
    return rows.filter(F.unix_micros(now) - F.unix_micros(at) < seconds * 1_000_000)
