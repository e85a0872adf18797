"""Queries of the training-data operators over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions.session import table
from skeinflow.llm import bisection, credentials, encoding, mixing, neighbours, packing, provenance, subjects
from skeinflow.operators import similarity

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_lines(table(spark, d, "chunks"))


@query
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact(table(spark, d, "chunks"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "chunks"), least=0.9), 0.9)


@query
def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "chunks"))


@query
def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of a fiftieth of the chunks against all, with the similarity in double precision from the embeddings themselves: what the operator found, to be held against brute force."""
    chunks = table(spark, d, "chunks")
    asked = F.conv(F.substring(F.sha2("chunk_id", 256), 1, 8), 16, 10).cast("long") % 50 == 0
    found = neighbours.nearest(chunks).filter(asked)
    each = chunks.filter("embedding is not null").select("id", "embedding").dropDuplicates(["id"])
    mine = found.join(each.select(F.col("id").alias("chunk_id"), F.col("embedding").alias("x")), "chunk_id").join(each.select(F.col("id").alias("neighbour_id"), F.col("embedding").alias("y")), "neighbour_id")
    exact = mine.select("chunk_id", "neighbour_id", F.round(similarity.cosine(F.col("x"), F.col("y")), 8).alias("similarity"))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("similarity"), "neighbour_id")
    return exact.withColumn("rank", F.row_number().over(order))


ORACLE["p2_search"] = """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 GROUP BY id),
     w AS (SELECT id, e FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
     q AS (SELECT id, e FROM w WHERE ('0x' || substr(sha256(id), 1, 8))::BIGINT % 50 = 0),
     s AS (SELECT q.id AS chunk_id, w.id AS neighbour_id, round(list_cosine_similarity(q.e, w.e), 8) AS similarity FROM q, w WHERE q.id <> w.id),
     r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, neighbour_id) AS rank FROM s)
SELECT chunk_id, neighbour_id, similarity, rank FROM r WHERE rank <= 10"""
ORACLE["p2_found"] = """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 GROUP BY id),
     w AS (SELECT id, e FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
     s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS c FROM w a, w b WHERE a.id <> b.id),
     r AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS n FROM s WHERE c >= 0.9)
SELECT DISTINCT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM r WHERE n <= 10"""


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return bisection.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_options")).select("chunk_id").distinct()


@query
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return bisection.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_options"))


@query
def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized chunk the digest of its pieces joined without the overlaps, and whether they all fit and follow one another."""
    options = table(spark, d, "chunk_options")
    pieces = bisection.split_oversized(table(spark, d, "chunks"), options)
    own = pieces.withColumn("own", F.substring(F.col("content"), F.col("overlap") + 1, F.length("content"))).join(F.broadcast(options.select("source_id", F.col("chunk_size").alias("most"))), "source_id", "left")  # a row a source at most
    by = own.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("piece", "own"))).alias("all"), F.every(F.col("tokens") <= F.coalesce("most", F.lit(500))).alias("fits"), F.max("pieces").alias("n"))  # one chunk's own text
    joined = F.array_join(F.transform("all", lambda x: x["own"]), "")
    return by.select("chunk_id", F.md5(joined).alias("digest"), (F.col("fits") & (F.size("all") == F.col("n"))).alias("fits"))


ORACLE["p3_rejoined"] = """
SELECT c.id AS chunk_id, md5(any_value(c.content)) AS digest, true AS fits FROM chunks c LEFT JOIN chunk_options o ON o.source_id = c.source_id
WHERE ceil(length(c.content) / 4.0) > coalesce(o.max_unit_tokens, 2 * coalesce(o.chunk_size, 500)) GROUP BY c.id"""
ORACLE["p3_found"] = """
SELECT DISTINCT c.id AS chunk_id FROM chunks c LEFT JOIN chunk_options o ON o.source_id = c.source_id
WHERE ceil(length(c.content) / 4.0) > coalesce(o.max_unit_tokens, 2 * coalesce(o.chunk_size, 500))"""


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


@query
def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text after it was encoded and decoded again."""
    ids = encoding.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return encoding.decode_ids(ids).select("doc_id", F.md5("text").alias("digest"))


ORACLE["p6_decoded"] = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).filter(~F.col("reachable")).select("mix_id", "source")


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@query
def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """Of each target whether the selection keeps to it: no document above its repeats, and the tokens nearer to what is wanted (or to all there is) than half the source's longest document."""
    sizes = mixing.sized(table(spark, d, "documents"))
    chosen = mixing.report(sizes, table(spark, d, "mix_targets"))
    longest = sizes.groupBy(F.col("source").alias("of")).agg(F.max("tokens").alias("longest"), F.sum("tokens").alias("all"))
    caps = table(spark, d, "mix_targets").select(F.col("mix_id").alias("m"), F.col("source").alias("s"), "max_repeats")
    rows = chosen.join(longest, F.col("source").eqNullSafe(F.col("of")), "left").join(caps, F.col("mix_id").eqNullSafe(F.col("m")) & F.col("source").eqNullSafe(F.col("s")))
    wanted = F.least("target_tokens", F.coalesce("all", F.lit(0)) * F.col("max_repeats"))
    return rows.select("mix_id", "source", ((F.abs(F.col("selected_tokens") - wanted) <= F.coalesce("longest", F.lit(0)) / 2 + 0.001) & (F.col("most_repeats") <= F.col("max_repeats"))).alias("kept"))


ORACLE["p7_targets"] = "SELECT mix_id, source, true AS kept FROM mix_targets"


@query
def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select_mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")).select("mix_id", "source", "doc_id", "tokens", "repeats")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_labels(spark, d).filter(F.col("label") != "handwritten").select("file_id")


@query
def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.label_files(table(spark, d, "files"), table(spark, d, "chunks"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(p5_packing(spark, d))


@query
def p5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "chunks"), table(spark, d, "pack_jobs"))


@query
def p5_selections(spark: SparkSession, d: str) -> DataFrame:
    return packing.selections(p5_packing(spark, d))


@query
def p5_placed(spark: SparkSession, d: str) -> DataFrame:
    """Of each job and chunk what the selections hold of it, in how many of them, and whether all of these keep to the budget."""
    packed = p5_packing(spark, d)
    total = packing.selections(packed).select("job_id", "selection", (F.col("unused") >= 0).alias("fits"))
    return packed.join(total, ["job_id", "selection"]).groupBy("job_id", "chunk_id").agg(F.sum("tokens").alias("tokens"), F.count_distinct("selection").alias("selections"), F.every("fits").alias("fits"))


ORACLE["p5_placed"] = """
WITH c AS (SELECT id, any_value(source_id) AS source_id, max(CASE WHEN tokens >= 1 THEN tokens ELSE ceil(length(content) / 4.0) END)::BIGINT AS t FROM chunks GROUP BY id)
SELECT j.job_id, c.id AS chunk_id, c.t AS tokens, greatest(ceil(c.t / j.budget), 1)::BIGINT AS selections, true AS fits FROM pack_jobs j JOIN c ON c.source_id = j.source_id"""
ORACLE["p5_found"] = """
WITH c AS (SELECT id, any_value(source_id) AS source_id, max(CASE WHEN tokens >= 1 THEN tokens ELSE ceil(length(content) / 4.0) END) AS t FROM chunks GROUP BY id)
SELECT DISTINCT j.job_id, c.id AS chunk_id FROM pack_jobs j JOIN c ON c.source_id = j.source_id WHERE c.t > j.budget"""


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(p8_subjects(spark, d))


@query
def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.label_documents(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


@query
def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p8_found(spark, d), table(spark, d, "documents"))
