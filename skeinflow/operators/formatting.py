"""Selected chunks as text: markdown, XML, JSON, plain, an explanation of scores, and a map of signatures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.functions import parsers
from skeinflow.functions.text import token_count

#: The language of a fenced block by the file's ending.
LANGUAGES = {
    "ts": "typescript",
    "tsx": "tsx",
    "js": "javascript",
    "jsx": "jsx",
    "py": "python",
    "rb": "ruby",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "kt": "kotlin",
    "cs": "csharp",
    "cpp": "cpp",
    "c": "c",
    "h": "c",
    "hpp": "cpp",
    "md": "markdown",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "sql": "sql",
    "sh": "bash",
    "bash": "bash",
    "zsh": "bash",
}


@F.pandas_udf(T.StringType())
def signatures(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([parsers.signatures(c or "", p or "") for c, p in zip(content, path)], dtype=object)


@F.pandas_udf(T.StringType())
def repo_map(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([parsers.repo_map(c or "", p or "") for c, p in zip(content, path)], dtype=object)


def as_map(selected: DataFrame) -> DataFrame:
    """The selection with signatures in place of contents, and their tokens."""
    return selected.withColumn("content", signatures("content", "file_path")).withColumn("tokens", token_count(F.col("content")))


def rounded(score: float) -> float:
    """Half up, to three places."""
    return int(score * 1000 + 0.5) / 1000


def render(rows: Iterator[dict], query: str, considered: int, format: str = "markdown", explain: bool = False, mode: str = "full", budget: int | None = None) -> str:
    """The text of one selection, whose rows are bounded by the token budget; ``rows`` in order of path and line."""
    rows = list(rows)
    total = sum(r["tokens"] for r in rows)
    if format == "json":
        data = {
            "query": query,
            "context": "\n\n".join(r["content"] for r in rows),
            "chunks": [{"file": r["file_path"], "lines": [r["start_line"], r["end_line"]], "tokens": r["tokens"], "score": rounded(r["score"])} for r in rows],
            "stats": {"totalTokens": total, "chunksIncluded": len(rows), "chunksConsidered": considered, "budget": budget},
        }
        return json.dumps(data, indent=2, ensure_ascii=False)
    files: dict[str, list[dict]] = {}
    for r in rows:
        files.setdefault(r["file_path"], []).append(r)
    if format == "plain":
        return "\n\n".join(f"=== {f} ===\n" + "\n\n".join(r["content"] for r in rs) for f, rs in files.items())
    if format == "xml":
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
        body = "\n".join(
            f'  <file path="{esc(f)}">\n' + "\n".join(f'    <chunk lines="{r["start_line"]}-{r["end_line"]}" score="{rounded(r["score"])}"><![CDATA[{r["content"].replace("]]>", "]]]]><![CDATA[>")}]]></chunk>' for r in rs) + "\n  </file>" for f, rs in files.items()
        )
        return f'<context query="{esc(query)}" tokens="{total}" chunks="{len(rows)}">\n{body}\n</context>'
    out = [f"# Context for: {query}", ""]
    for f, rs in files.items():
        out.append(f"## {f}")
        for r in rs:
            if mode == "map":
                out += ["", r["content"]]
                continue
            out += ["", f"Lines {r['start_line']}-{r['end_line']}" + (f", score {rounded(r['score'])}" if explain else "")]
            if explain:
                out += [f"- {k}: {rounded(r[k])}" for k in ("similarity", "path_match", "content_match", "symbol_match", "kind", "boost") if r.get(k) is not None]
            fence = "````" if "```" in r["content"] else "```"
            out += [f"{fence}{LANGUAGES.get(f.rsplit('.', 1)[-1].lower(), '')}", r["content"], fence]
        out.append("")
    out.append(f"---\n{total:,} tokens in {len(rows)} of {considered} chunks")
    return "\n".join(out)


def render_plainly(format: str = "markdown") -> Column:
    """A chunk as the hosted selection gives it: a heading and a fenced block, an element with its content as it is, or a line comment above it."""
    lines = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    if format == "markdown":
        return F.concat(F.lit("## "), "file_path", F.lit(" (lines "), lines, F.lit(")\n\n```\n"), "content", F.lit("\n```"))
    if format == "xml":
        return F.concat(F.lit('<file path="'), "file_path", F.lit('" lines="'), lines, F.lit('">\n'), "content", F.lit("\n</file>"))
    return F.concat(F.lit("// "), "file_path", F.lit(":"), lines, F.lit("\n"), "content")


def render_all(selected: DataFrame, format: str = "markdown", mode: str = "full") -> DataFrame:
    """(query_id, text) of many selections at once; one group is one query's bounded selection."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["file_path", "start_line"])
        return pd.DataFrame([(p.query_id.iloc[0], render(p.to_dict("records"), p["query"].iloc[0], int(p.considered.iloc[0]), format, mode=mode))], columns=["query_id", "text"])

    return selected.groupBy("query_id").applyInPandas(one, "query_id long, text string")
