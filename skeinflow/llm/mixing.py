"""Problem 7: select documents with repeat counts so that each source reaches its target share of a wanted total.

Every document gets a hash-random key. Within its source the keys are cut into ranges of about ``range_rows`` rows; sums of the ranges are
added up to offsets, sums within a range are added to those, so a source of any size has exact prefix sums without one task that holds it.
A source's budget is met by whole epochs (each document once) and the prefix of the next epoch that comes closest to what is left.

Cases: null and empty texts have 0 tokens and are never selected, but null-source documents count in the total of all documents; a target
of a source without documents is unreachable; targets of null or negative share, ratio or repeats select nothing; repeated rows are
documents of their own. Output columns are named afresh, so extra columns of the inputs can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.session import cut, small
from skeinflow.llm.encoding import TOKENIZER, TOKENIZERS, count_tokens

RANGE_ROWS = 20_000
SEED = 7


def sized(docs: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every row, written once in the shared folder."""
    return cut(count_tokens(docs.select("doc_id", "source", "text"), folder=folder, name=name).drop("text"))


def prefix_sums(sizes: DataFrame, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """``sizes`` with ``key``, ``upto`` (tokens of the source up to and with this document, by key) and ``whole`` (of the source)."""
    keyed = sizes.select("doc_id", "source", "tokens", (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(2.0**53)).alias("key"))
    rows = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    ranged = (
        keyed.join(small(rows.select(F.col("source").alias("of"), F.ceil(F.col("rows") / range_rows).alias("ranges"))), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("range", F.floor(F.col("key") * F.col("ranges")))
    )
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    by_source = Window.partitionBy("source")
    offsets = sums.select(
        F.col("source").alias("of"),
        F.col("range").alias("at"),
        F.coalesce(F.sum("in_range").over(by_source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("in_range").over(by_source).alias("whole"),
    )
    within = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranged.withColumn("within", within)
        .join(small(offsets), F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
        .select("doc_id", "source", "tokens", "key", (F.col("within") + F.col("offset")).alias("upto"), "whole")
    )


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, share, cap, target, whole, epochs, rest) of each target; one row per mix and source."""
    of_source = sizes.groupBy("source").agg(F.sum("tokens").alias("whole"))
    total = of_source.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("total"))
    cap = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("long")
    want = F.greatest(F.coalesce(F.col("target_share") * F.col("size_ratio") * F.col("total"), F.lit(0.0)), F.lit(0.0))
    t = (
        targets.select("mix_id", "source", "target_share", "max_repeats", "size_ratio")
        .crossJoin(F.broadcast(total))  # one row
        .join(of_source.select(F.col("source").alias("of"), "whole"), F.col("source").eqNullSafe(F.col("of")), "left")
        .select("mix_id", "source", F.col("target_share").alias("share"), cap.alias("cap"), want.alias("target"), F.coalesce("whole", F.lit(0)).alias("whole"))
    )
    epochs = F.when(F.col("whole") > 0, F.least(F.floor(F.col("target") / F.col("whole")), F.col("cap"))).otherwise(F.lit(0)).cast("long")
    return t.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") >= F.col("cap"), F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("whole")))


def select_mix(sizes: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats, upto, whole, target, share, cap) of the documents selected."""
    prefix = prefix_sums(sizes.filter(F.col("tokens") > 0), range_rows, seed)
    goals = plan(sizes, targets).withColumnsRenamed({"source": "of", "whole": "whole_of"})
    before = F.col("upto") - F.col("tokens")
    # the document across the cut is taken if that comes closer to the budget
    once = (F.col("upto") <= F.col("rest")) | ((before < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - before))
    return (
        prefix.join(small(goals), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("repeats", F.col("epochs") + once.cast("long"))
        .filter(F.col("repeats") > 0)
        .select("mix_id", "source", "doc_id", "tokens", "repeats", "upto", "whole", "target", "share", "cap")
    )


def report(sizes: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """Of each target: tokens wanted and selected, the shares, and whether it can be reached.

    What a source can give is the last of its prefix sums times its cap; without a selected document it comes from the plan.
    """
    chosen = cut(  # a row a target, used twice
        select_mix(sizes, targets, range_rows, seed)
        .groupBy(F.col("mix_id").alias("m"), F.col("source").alias("s"))
        .agg(
            F.sum(F.col("tokens") * F.col("repeats")).alias("got"),
            F.count(F.lit(1)).alias("documents"),
            F.max("repeats").alias("most_repeats"),
            F.max(F.col("whole") * F.col("cap")).alias("can"),
        )
    )
    goals = plan(sizes, targets)
    rows = goals.join(small(chosen), F.col("mix_id").eqNullSafe(F.col("m")) & F.col("source").eqNullSafe(F.col("s")), "left")
    got = F.coalesce("got", F.lit(0))
    can = F.coalesce("can", F.col("whole") * F.col("cap"))
    return rows.select(
        "mix_id",
        "source",
        F.col("share").alias("target_share"),
        F.round("target", 3).alias("target_tokens"),
        got.alias("selected_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(got / F.nullif(F.sum(got).over(Window.partitionBy("mix_id")), F.lit(0)), 9).alias("actual_share"),
        (can >= F.col("target")).alias("reachable"),
    )
