"""Names that chunks define and call: symbol search and the call graph, for all names at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import parsers
from skeinflow.functions.session import kept

#: Words before a bracket that are no calls.
NO_CALLS = frozenset({"if", "else", "while", "for", "switch", "catch", "return", "throw", "new", "typeof", "import", "export", "const", "let", "var", "function", "class", "interface", "type", "async", "await", "try", "finally"})
_LANGUAGES = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "cs", "php")
_CALL = re.compile(r"\b(\w+)\s*\(", re.ASCII)
_METHOD = re.compile(r"\s*(?:(?:public|private|protected|static|async)\s+)*(\w+)\s*\([^)]*\)\s*[:{]", re.ASCII)
_PYTHON = re.compile(r"\s*(?:async\s+)?(def|class)\s+(\w+)")
DEFINITIONS = "source_id string, file_path string, chunk_id string, name string, kind string, start_line int, end_line int, signature string"
CALLS = "source_id string, file_path string, chunk_id string, caller string, caller_line int, callee string, line int, context string"


def definitions_in(content: str, path: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, start, end, signature) of what a text defines, by lines; also where it isn't a whole file."""
    ending = path.rsplit(".", 1)[-1].lower() if path else ""
    if ending not in _LANGUAGES:
        return []
    lines = content.split("\n")
    out = []
    if ending == "py":
        for n, line in enumerate(lines):
            if m := _PYTHON.match(line):
                out.append((m.group(2), "class" if m.group(1) == "class" else "function", n + 1, parsers.indent_end(lines, n), line.strip()))
        return out
    for u in parsers.parse(content, path) or []:
        out.append((u.name.split(".")[-1], u.kind, u.start, u.end, lines[u.start - 1].strip()))
    if ending in ("ts", "tsx", "js", "jsx"):
        at = {o[2] for o in out}
        for n, line in enumerate(lines):
            if n + 1 not in at and (m := _METHOD.match(line)) and m.group(1) not in NO_CALLS:
                out.append((m.group(1), "method", n + 1, parsers.block_end(lines, n), line.strip()))
    return sorted(out, key=lambda o: o[2])


def definitions(chunks: DataFrame, narrow: bool = False, within_chunk: bool = False) -> DataFrame:
    """What each distinct chunk defines, with lines of the file (a chunk without a start begins at line 1), or of the chunk itself (``within_chunk``).

    ``narrow`` leaves out the types of Go and the structures and traits of Rust, as the search of the tool server does.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for s, f, i, c, n in zip(p.source_id, p.file_path, p.id, p.content, p.start_line):
                first = 0 if within_chunk else int(n) - 1
                types = narrow and f.lower().endswith((".go", ".rs"))
                rows += [(s, f, i, name, kind, first + a, first + z, said[:200]) for name, kind, a, z, said in definitions_in(c, f) if not (types and kind == "class")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEFINITIONS.split(", ")])

    return _code(chunks).mapInPandas(run, DEFINITIONS).dropDuplicates(["chunk_id", "name", "start_line"])


def _code(chunks: DataFrame) -> DataFrame:
    ending = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    return chunks.filter(ending.isin(*_LANGUAGES) & F.col("content").isNotNull()).select("source_id", "file_path", "id", "content", F.coalesce("start_line", F.lit(1)).alias("start_line"))


def search(defined: DataFrame, query: str, exact: bool = False, limit: int = 20) -> DataFrame:
    """The symbols whose name is the query (``exact``) or holds it and has three characters; equal names first, then shorter ones."""
    name, q = F.lower("name"), query.lower()
    rows = defined.filter(name == q if exact else (name == q) | (F.contains(name, F.lit(q)) & (F.length("name") >= 3)))
    return rows.orderBy((name == q).desc(), F.length("name"), "name", "file_path", "source_id", "start_line", "chunk_id").limit(limit)


def _calls_in(content: str, found: list[tuple[str, str, int, int, str]]) -> list[tuple[str, int, str, int, str]]:
    """(caller, its line, callee, line, text) of the calls within each definition: names that start in lower case, or are defined in the text; the caller itself is left out."""
    lines, out = content.split("\n"), []
    own = [d for d in found if d[1] in ("function", "method", "constant")]
    known = {d[0] for d in own}
    for name, _, a, z, _ in own:
        for k in range(a - 1, min(z, len(lines))):
            line = lines[k].strip()
            if line.startswith(("//", "#", "*")):
                continue
            for m in _CALL.finditer(lines[k]):
                callee = m.group(1)
                if callee not in NO_CALLS and callee != name and (callee in known or not callee[0].isupper()):
                    out.append((name, a, callee, k + 1, line[:80]))
    return out


PARSED = f"call boolean, {CALLS}, kind string"


def _parsed(chunks: DataFrame) -> DataFrame:
    """Definitions (callee null) and calls of each distinct chunk, by one pass over the contents, kept for both uses."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for s, f, i, c, n in zip(p.source_id, p.file_path, p.id, p.content, p.start_line):
                found = definitions_in(c, f)
                rows += [(False, s, f, i, name, int(n) + a - 1, None, int(n) + a - 1, said[:80], kind) for name, kind, a, _, said in found]
                rows += [(True, s, f, i, name, int(n) + a - 1, callee, int(n) + k - 1, said, None) for name, a, callee, k, said in _calls_in(c, found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return kept(_code(chunks).mapInPandas(run, PARSED))


def calls(chunks: DataFrame) -> DataFrame:
    """The calls within each definition of a chunk, each once."""
    return _parsed(chunks).filter("call").drop("call", "kind").dropDuplicates(["chunk_id", "caller", "callee", "line"])


def last_chunks(chunks: DataFrame) -> DataFrame:
    """Of each file the chunk that begins last, the greatest id of several."""
    last = chunks.groupBy("source_id", "file_path").agg(F.max(F.struct(F.coalesce("start_line", F.lit(1)).alias("n"), "id")).alias("x")).select(F.col("x.id").alias("last"))
    return chunks.join(last, F.col("id") == F.col("last"), "left_semi")


def call_edges(chunks: DataFrame, methods: bool = True) -> DataFrame:
    """(source_id, caller_file, caller, callee, first_line, line, context, callee_file): each caller and callee of a file once, with the first line and the last call's line and text.

    The callee's file is the first that defines it, or "(external)". Both sides add up map-side, so a name that is everywhere isn't one task.
    The graph of the tool server comes from ``last_chunks`` and counts no ``methods`` as definitions.
    """
    parsed = _parsed(chunks)
    first = (
        parsed.filter(~F.col("call") & F.col("kind").isin("function", "constant", *(["method"] if methods else [])))
        .groupBy(F.col("source_id").alias("s"), F.col("caller").alias("callee_name"))
        .agg(F.min_by("file_path", F.struct("file_path", "line")).alias("callee_file"))
    )
    made = parsed.filter("call").groupBy("source_id", "file_path", "caller", "callee").agg(F.min("line").alias("first_line"), F.max(F.struct("line", "chunk_id", "context")).alias("last"))
    joined = made.join(first, (F.col("source_id") == F.col("s")) & (F.col("callee") == F.col("callee_name")), "left")
    return joined.select("source_id", F.col("file_path").alias("caller_file"), "caller", "callee", "first_line", F.col("last.line").alias("line"), F.col("last.context").alias("context"), F.coalesce("callee_file", F.lit("(external)")).alias("callee_file"))


def call_graph(edges: DataFrame, target: str) -> DataFrame:
    """(side, file, function, line, context) around one name: its callers and its callees."""
    callers = edges.filter(F.col("callee") == target).select(F.lit("caller").alias("side"), F.col("caller_file").alias("file"), F.col("caller").alias("function"), "line", "context")
    callees = edges.filter(F.col("caller") == target).select(F.lit("callee").alias("side"), F.col("callee_file").alias("file"), F.col("callee").alias("function"), "line", "context")
    return callers.unionByName(callees).distinct()
