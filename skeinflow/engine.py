"""The engine: index, select, symbols, graph, diff over one set of tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.session import cut
from skeinflow.operators import budget as B
from skeinflow.operators import chunking, formatting, graphs, ranking, similarity, store, symbols

#: Candidates that a search hands to the ranking.
CANDIDATES = 50


@dataclass
class Selection:
    chunks: DataFrame
    stats: dict[str, Any]

    def text(self, query: str, format: str = "markdown", explain: bool = False, mode: str = "full") -> str:
        """The selection as text; its rows are bounded by the budget."""
        rows = [r.asDict() for r in self.chunks.orderBy(F.collate(F.col("file_path"), "UNICODE"), "file_path", "start_line").collect()]
        return formatting.render(rows, query, self.stats["chunksConsidered"], format, explain, mode)


class Engine:
    """Operators over chunks and import edges; everything but a selection's text stays a DataFrame."""

    def __init__(self, chunks: DataFrame, edges: DataFrame | None = None):
        self.chunks, self.edges = chunks, edges

    def candidates(self, vector: list[float], limit: int = CANDIDATES, sources: list[str] | None = None) -> DataFrame:
        """The most similar chunks with their contents, which are read for these few only; kept, as the ranking reads them more than once."""
        found = F.broadcast(similarity.search(self.chunks, vector, limit, sources))  # at most ``limit`` rows
        columns = ["id", "source_id", "file_path", "content", "start_line", "end_line", "tokens"]
        return cut(self.chunks.select(*columns).join(found, "id").dropDuplicates(["id"]))

    def selected(self, query: str, vector: list[float], budget: int = 8000, policy: str = "greedy", sources: list[str] | None = None, imports: bool = True, merge: bool = True, diversity: bool = False) -> DataFrame:
        """The chunks for a query within a budget; ``policy`` prefix stops at the first that doesn't fit, without rescoring or joining."""
        return self._chosen(self.candidates(vector, sources=sources), query, budget, policy, imports, merge, diversity)

    def _chosen(self, candidates: DataFrame, query: str, budget: int, policy: str = "greedy", imports: bool = True, merge: bool = True, diversity: bool = False) -> DataFrame:
        order = [F.desc("score"), F.desc("base"), F.desc("similarity"), F.col("id")]
        if policy == "prefix":
            plain = candidates.withColumns({"score": F.col("similarity"), "base": F.col("similarity"), "tokens": F.ceil(F.length("content") / 4)})
            return B.prefix(plain, budget, [], order).drop("running")
        counted = candidates.withColumn("tokens", F.when(F.col("tokens") >= 1, F.col("tokens")).otherwise(F.ceil(F.length("content") / 4)))
        ranked = ranking.rank(counted, query, self.edges if imports else None, diversity)
        kept = B.greedy(ranked, budget, [], order)
        return self._merged(kept) if merge else kept

    @staticmethod
    def _merged(kept: DataFrame) -> DataFrame:
        lined = kept.withColumns({"start_line": F.coalesce("start_line", F.lit(1)), "end_line": F.coalesce("end_line", "start_line", F.lit(1))})
        return B.merge_adjacent(lined)

    def select(self, query: str, vector: list[float], budget: int = 8000, **options: Any) -> Selection:
        """A selection with its figures: tokens before joining, chunks after."""
        merge = options.pop("merge", True) and options.get("policy") != "prefix"
        candidates = self.candidates(vector, sources=options.pop("sources", None))
        kept = cut(self._chosen(candidates, query, budget, merge=False, **options))  # at most as many rows as candidates
        chunks = cut(self._merged(kept)) if merge else kept
        before = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t
        return Selection(chunks, {"totalTokens": before, "chunksIncluded": chunks.count(), "chunksConsidered": candidates.count(), "budget": budget})

    def index(self, discovered: DataFrame, stored: DataFrame, force: bool = False, **options: Any) -> tuple[DataFrame, DataFrame]:
        """(changes, chunks after the run): only new and changed files are cut again; ``force`` cuts all, and removed files go in either case."""
        changes = store.categorize(discovered, stored)
        again = changes if force else changes.filter(F.col("status").isin("new", "changed"))
        work = discovered.join(again.filter("status <> 'removed'").select(*store.FILE_KEY), store.FILE_KEY, "left_semi")
        fresh = chunking.chunk_files(work, **options)
        for c, kind in self.chunks.dtypes:
            if c not in fresh.columns:
                fresh = fresh.withColumn(c, F.current_timestamp() if c == "created_at" else F.lit(None).cast(kind))
        gone = changes.filter("status <> 'unchanged'") if not force else changes
        kept = self.chunks.join(gone.select(*store.FILE_KEY), store.FILE_KEY, "left_anti")
        return changes, kept.unionByName(fresh.select(*self.chunks.columns))

    def symbols(self, query: str, exact: bool = False, limit: int = 20, sources: list[str] | None = None) -> DataFrame:
        rows = self.chunks.filter(F.col("source_id").isin(sources)) if sources else self.chunks
        return symbols.search(symbols.definitions(rows), query, exact, limit)

    def graph(self, target: str, sources: list[str] | None = None) -> DataFrame:
        rows = self.chunks.filter(F.col("source_id").isin(sources)) if sources else self.chunks
        return symbols.call_graph(symbols.call_edges(rows), target)

    def imports(self) -> DataFrame:
        """Edges read from the chunks' own import statements."""
        files = chunking.files_of(self.chunks)
        return graphs.resolve_imports(graphs.parse_imports(files), files)
