"""Metering: monthly counters, the sliding request limit, and a check against limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once, with its type in lower case."""
    return events.dropDuplicates(["id"]).withColumn("event_type", F.lower("event_type"))


def monthly(events: DataFrame) -> DataFrame:
    """(org_id, month, queries, tokens): counters of each organisation and UTC month; adds up map-side before the shuffle."""
    rows = distinct_events(events)
    return rows.groupBy("org_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.when(F.col("event_type") == "query", 1)).alias("queries"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("events")
    )


def sliding_limit(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Each request with the requests of its organisation in the last ``seconds`` (its own counted, one exactly that old not) and whether it is let through.

    Windows are taken within (org, slice) parts; a slice is as long as the window and also holds the requests of the slice before, so a window reaches over two slices at
    most, whatever its length, and a large organisation is many tasks.
    """
    span = max(1, seconds) * 1000
    ms = F.floor(F.unix_micros("created_at") / 1000)
    rows = distinct_events(events).select("id", "org_id", ms.alias("ms"))
    own = F.floor(F.col("ms") / span)
    spread = rows.withColumn("slice", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("org_id", "slice").orderBy("ms").rangeBetween(-(span - 1), 0)
    counted = spread.withColumn("requests", F.count(F.lit(1)).over(w)).filter(F.col("slice") == own)
    return counted.select("id", "org_id", "requests", (F.col("requests") <= limit).alias("allowed"))


def against_limits(usage: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """``usage`` (.., key, used) against ``limits`` (key, most), which may be any size; a null or missing limit is none."""
    joined = usage.join(limits.select(key, "most"), key, "left")
    return joined.withColumn("within", F.col("most").isNull() | (F.col("used") < F.col("most"))).withColumn("left_over", F.when(F.col("most").isNotNull(), F.greatest(F.col("most") - F.col("used"), F.lit(0))))
