"""Cosine similarity and exact search of the most similar chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.session import kept

#: Queries up to which every task holds them all.
MATRIX_QUERIES = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision: 0 if one has no length, an error if their sizes differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors must have the same length"))).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def usable(chunks: DataFrame, dim: int) -> DataFrame:
    """Distinct chunks with an embedding of ``dim`` numbers; the others can't be compared."""
    return chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim))


def search(chunks: DataFrame, query: list[float], limit: int = 50, sources: list[str] | None = None) -> DataFrame:
    """(id, similarity) of the ``limit`` most similar chunks (0 means 50); ties go to the smaller id.

    Only id and embedding are read: contents of the few found are joined later. The plan ends in a top-k without a sort of all rows.
    """
    rows = chunks.filter(F.col("source_id").isin(sources)) if sources else chunks
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = usable(rows, len(query)).select("id", cosine(F.col("embedding"), vector).alias("similarity"))
    # a chunk delivered twice has the same row: twice the limit holds the limit of distinct ones only if repeats are dropped first
    return scored.groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit or 50)


def search_many(chunks: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, id, similarity, rank) for each row (query_id, vector) of a set of queries.

    Up to ``MATRIX_QUERIES`` queries, which are counted first, are held by every task as a matrix: a batch of chunks is one matrix product and hands on its own best
    of each query. More queries are dealt into batches of about half as many, each a pass over the chunks of its own whose result is kept. A chunk delivered twice counts once.
    """
    rows = chunks.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    asked, key = queries.select("query_id", "vector"), queries.schema["query_id"].dataType.simpleString()
    number = asked.count()
    if number <= MATRIX_QUERIES:
        pairs = _by_matrix(rows, asked.collect(), limit, key)
    else:
        asked = kept(asked)
        batches = -(-2 * number // MATRIX_QUERIES)
        pairs = None
        for b in range(batches):
            batch = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b).collect()  # about half of MATRIX_QUERIES
            found = kept(_by_matrix(rows, batch, limit, key))
            pairs = found if pairs is None else pairs.unionByName(found)
    distinct = pairs.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return distinct.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def _by_matrix(rows: DataFrame, queries: list, limit: int, key: str) -> DataFrame:
    """The best of each query in each batch of chunks: as many distinct ids as asked for, and all that tie with the last."""
    import numpy as np
    import pandas as pd

    sized: dict[int, list] = {}
    for q in queries:
        sized.setdefault(len(q.vector or []), []).append((q.query_id, q.vector))

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def run(parts):
        for p in parts:
            p = p.drop_duplicates("id")
            sizes = p.embedding.map(len)
            for size, asked in sized.items():
                some = p[sizes == size]
                if not size or some.empty:
                    continue
                s = unit(np.vstack(some.embedding.to_numpy()).astype(np.float64)) @ unit(np.array([v for _, v in asked], dtype=np.float64)).T
                k = min(limit, len(some))
                least = np.partition(s, len(some) - k, axis=0)[len(some) - k]
                i, j = np.nonzero(s >= least)
                yield pd.DataFrame({"query_id": [asked[x][0] for x in j], "id": some.id.to_numpy()[i], "similarity": s[i, j]})

    return rows.mapInPandas(run, f"query_id {key}, id string, similarity double")
