"""Choosing chunks for a token budget, and joining the chunks that touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(ranked: DataFrame, budget: int, keys: list[str], order: list[Column], tokens: str = "tokens") -> DataFrame:
    """The rows of each group that fit when taken in ``order``: one that doesn't fit is skipped and the next is tried.

    The running total depends on what was skipped, so it is a fold over the group's rows, which are the bounded candidates of a query.
    """
    n = F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order))
    rows = ranked.select(*keys, F.struct(n.alias("n"), F.col(tokens).cast("long").alias("t"), F.struct(*(F.col(c) for c in ranked.columns)).alias("r")).alias("x"))
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x"), lambda a, b: a["n"] - b["n"]).alias("all"))
    fold = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("kept")),
        lambda s, x: F.when(s["total"] + x["t"] <= budget, F.struct((s["total"] + x["t"]).alias("total"), F.concat(s["kept"], F.array(x["n"])).alias("kept"))).otherwise(s),
    )
    kept = groups.select("all", fold["kept"].alias("kept")).select(F.explode(F.filter("all", lambda x: F.array_contains("kept", x["n"]))).alias("x"))
    return kept.select("x.r.*")


def prefix(ranked: DataFrame, budget: int, keys: list[str], order: list[Column], tokens: str = "tokens") -> DataFrame:
    """The rows of each group up to the first that doesn't fit."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running", F.sum(tokens).over(w)).filter(F.col("running") <= budget)


def merge_adjacent(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chunks of a file whose lines touch or overlap, joined: (keys.., file_path, id, start_line, end_line, tokens, score, chunks, content).

    An island ends where a chunk starts more than one line below the end of the chunk right before it (not the furthest end so far). Of overlapping lines
    the later chunk's copy is dropped, and its tokens are reduced in that proportion. All of it depends on the row before only.
    """
    by = [*(keys or ["source_id"]), "file_path"]
    order = ["start_line", "end_line", "id"]
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag("end_line").over(w)
    overlap = F.greatest(F.lit(0), F.col("before") - F.col("start_line") + 1)
    lines = F.col("end_line") - F.col("start_line") + 1
    rows = (
        chunks.withColumn("before", before)
        .withColumn("opens", F.when(F.col("before").isNull() | (F.col("before") + 1 < F.col("start_line")), 1).otherwise(0))
        .withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("overlap", F.when(F.col("opens") == 1, 0).otherwise(overlap))
        .withColumn("own_tokens", F.col("tokens") - F.when(F.col("overlap") > 0, F.floor(F.col("tokens") * (F.col("overlap") / lines))).otherwise(F.lit(0)))
        .withColumn("own", F.when(F.col("overlap") > 0, F.array_join(F.slice(F.split("content", "\n", -1), F.col("overlap") + 1, F.greatest(F.size(F.split("content", "\n", -1)), F.lit(1))), "\n")).otherwise(F.col("content")))
        .withColumn("nth", F.row_number().over(w))
    )
    parts = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("nth", "opens", "own"))), lambda x: (x["opens"] == 1) | (F.length(x["own"]) > 0)), lambda x: x["own"])
    return rows.groupBy(*by, "island").agg(
        F.min_by("id", "nth").alias("id"),
        F.min_by("start_line", "nth").alias("start_line"),
        F.max_by("end_line", "nth").alias("end_line"),
        F.sum("own_tokens").alias("tokens"),
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("chunks"),
        F.array_join(parts, "\n").alias("content"),
    )
