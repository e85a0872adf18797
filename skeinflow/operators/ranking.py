"""Scores of candidate chunks from several signals, the boost of imported files, and the penalty for many chunks of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import text as T
from skeinflow.functions.session import small

#: Candidates that lend their score to what they import.
BOOST_FROM = 20


def base_scores(candidates: DataFrame, query: str) -> DataFrame:
    """``candidates`` (file_path, content, similarity, ..) with the signals and ``base``."""
    words, wanted = T.keywords(query), T.names(query)
    w = T.WEIGHTS
    signals = candidates.withColumns(
        {
            "path_match": T.path_match(F.col("file_path"), words),
            "content_match": T.content_match(F.col("content"), words),
            "symbol_match": T.symbol_match(F.col("content"), wanted),
            "kind": T.file_kind(F.col("file_path")),
        }
    )
    base = w["similarity"] * F.col("similarity") + w["path"] * F.col("path_match") + w["content"] * F.col("content_match") + w["symbol"] * F.col("symbol_match") + w["kind"] * F.col("kind")
    return signals.withColumn("base", base)


def import_boosts(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, file_path, boost) of files imported by those of the ``BOOST_FROM`` best candidates, by their best importer's score."""
    top = scored.orderBy(F.desc("base"), F.desc("similarity"), "id").limit(BOOST_FROM)
    files = top.groupBy("source_id", "file_path").agg(F.max("base").alias("score")).select(F.col("source_id").alias("s"), F.col("file_path").alias("src_file"), "score")
    hit = edges.select("source_id", "src", "dst").join(F.broadcast(files), (F.col("source_id") == F.col("s")) & (F.col("src") == F.col("src_file")))  # at most BOOST_FROM files
    return hit.groupBy("source_id", F.col("dst").alias("file_path")).agg(F.greatest(F.max(F.least("score", F.lit(1.0))), F.lit(0.0)).alias("boost"))


def rank(candidates: DataFrame, query: str, edges: DataFrame | None = None, diversity: bool = False) -> DataFrame:
    """Candidates with ``score``; best first by (score, base, similarity, id) where an order is asked for."""
    scored = base_scores(candidates, query)
    if edges is None:
        ranked = scored.withColumn("boost", F.lit(0.0))
    else:
        boosts = small(import_boosts(scored, edges))
        ranked = scored.join(boosts, ["source_id", "file_path"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    ranked = ranked.withColumn("score", F.col("base") + T.WEIGHTS["imports"] * F.col("boost"))
    return diversify(ranked) if diversity else ranked


def diversify(ranked: DataFrame) -> DataFrame:
    """The score of the n-th chunk of a file (from 0) falls by 10 percent each, 30 at most."""
    nth = F.row_number().over(Window.partitionBy("source_id", "file_path").orderBy(F.desc("score"), F.desc("base"), "id")) - 1
    return ranked.withColumn("score", F.col("score") * (1 - F.least(nth * 0.1, F.lit(0.3))))
