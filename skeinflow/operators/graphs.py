"""Import graphs: statements, resolution, reverse edges, and what is reachable."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.session import cut

#: Files that can import, and what a specifier without an ending may stand for, in order.
IMPORTING = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
IMPORTS = "source_id string, file_path string, line int, specifier string, form string, names array<string>, default_name string, type_only boolean"
_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\S")


class Import(NamedTuple):
    line: int
    specifier: str
    form: str
    names: list[str]
    default_name: str | None
    type_only: bool


class _Reader:
    """The words of a script, without comments, read one by one."""

    def __init__(self, text: str):
        found = [m for m in _TOKEN.finditer(text) if not m.group().startswith(("//", "/*"))]
        self.words, self.places, self.at = [m.group() for m in found], [m.start() for m in found], 0

    def peek(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead] if self.at + ahead < len(self.words) else ""

    def take(self) -> str:
        word = self.peek()
        self.at += 1
        return word

    def string(self) -> str | None:
        """The content of the quoted word that comes next, if one does."""
        if self.peek()[:1] in ("'", '"') and len(self.peek()) > 2:
            return self.take()[1:-1]
        return None

    def braces(self) -> list[str]:
        """The names between braces; of ``a as b`` the first."""
        out: list[str] = []
        fresh = True
        while (word := self.take()) not in ("}", ""):
            if word == ",":
                fresh = True
            elif fresh and not (word == "type" and self.peek() not in (",", "}", "as")):
                out.append(word)
                fresh = False
        return out


def read_imports(text: str) -> list[Import]:
    """What a script imports, requires and exports again, in order, over as many lines as a statement takes."""
    if "import" not in text and "require" not in text and "export" not in text:
        return []
    r, out, line, seen = _Reader(text), [], 1, 0
    while r.at < len(r.words):
        begin, before, word = r.at, r.words[r.at - 1] if r.at else "", r.take()
        if word not in ("import", "require", "export") or before == ".":
            continue
        names: list[str] = []
        default, typed, form, said = None, False, "", None
        if word == "export":
            if r.peek() == "type":
                r.take()
            if r.peek() == "*":
                r.take()
            elif r.peek() == "{":
                r.take()
                r.braces()
            else:
                continue
            if r.peek() == "as":
                r.at += 2
            if r.peek() == "from":
                r.take()
                form, said = "export", r.string()
        elif r.peek() == "(":
            r.take()
            form, said = "require" if word == "require" else "dynamic", r.string()
        elif word == "import" and (said := r.string()) is not None:
            form = "effect"
        elif word == "import":
            if r.peek() == "type" and r.peek(1) not in ("from", ","):
                typed = bool(r.take())
            if r.peek() not in ("{", "*") and r.peek().isidentifier():
                default, form = r.take(), "default"
                if r.peek() == ",":
                    r.take()
            if r.peek() == "*" and r.peek(1) == "as":
                r.at += 2
                default, form = r.take(), "namespace"
            elif r.peek() == "{":
                r.take()
                names, form = r.braces(), "mixed" if default else "named"
            if r.peek() == "from":
                r.take()
                said = r.string()
        if said is None:
            r.at = begin + 1  # no statement: read on behind the word
            continue
        line += text.count("\n", seen, r.places[begin])
        seen = r.places[begin]
        out.append(Import(line, said, form, names, default, typed))
    return out


def import_kind(specifier: Column) -> Column:
    return F.when(specifier.startswith("."), "relative").when(specifier.startswith("/") | specifier.rlike("^[A-Za-z]:"), "absolute").otherwise("package")


def parse_imports(files: DataFrame) -> DataFrame:
    """(source_id, file_path, line, specifier, kind, form, names, default_name, type_only) of each import statement of ``files`` (source_id, file_path, content)."""
    ending = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(s, f, *i) for s, f, c in zip(p.source_id, p.file_path, p.content) for i in read_imports(c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMPORTS.split(", ")])

    found = files.filter(ending.isin(*IMPORTING) & F.col("content").isNotNull()).select("source_id", "file_path", "content").mapInPandas(run, IMPORTS)
    return found.select("source_id", "file_path", "line", "specifier", import_kind(F.col("specifier")).alias("kind"), "form", "names", "default_name", "type_only")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` above the root stays out."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, src, dst) of relative imports that name a file: the first of the possible endings that exists."""
    folder = F.regexp_replace("file_path", r"[^/]*$", "")
    base = normal_path(F.concat(folder, F.col("specifier")))
    tries = imports.filter(F.col("kind") == "relative").select("source_id", F.col("file_path").alias("src"), base.alias("base")).distinct()
    tries = tries.select("source_id", "src", "base", F.posexplode(F.array(*(F.lit(e) for e in ENDINGS))).alias("rank", "end"))
    named = tries.select("source_id", "src", "base", "rank", F.concat("base", "end").alias("file_path"))
    hit = named.join(files.select("source_id", "file_path").distinct(), ["source_id", "file_path"])
    return hit.groupBy("source_id", "src", "base").agg(F.min_by("file_path", "rank").alias("dst")).select("source_id", "src", "dst").distinct()


def importers(edges: DataFrame) -> DataFrame:
    """(source_id, file_path, importers, imported_by): reverse edges, each importer once; the list of a file is as long as its importers, at most the files of its source."""
    return edges.select("source_id", "src", "dst").distinct().groupBy("source_id", F.col("dst").alias("file_path")).agg(F.count(F.lit(1)).alias("importers"), F.sort_array(F.collect_list("src")).alias("imported_by"))


def related(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(source_id, file_path, depth) of files that the seeds import, directly or by others, within ``depth`` steps, seeds left out.

    Breadth first: one join a step against the files not yet seen, lineage cut after each, so any depth keeps a small plan.
    """
    steps = edges.select("source_id", F.col("src").alias("file_path"), F.col("dst").alias("to")).distinct()
    seen = cut(seeds.select("source_id", "file_path").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.select("source_id", "file_path").join(steps, ["source_id", "file_path"]).select("source_id", F.col("to").alias("file_path")).distinct()
        frontier = cut(step.join(seen.select("source_id", "file_path"), ["source_id", "file_path"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.filter("depth > 0")
