"""Cutting files into chunks by lines or by structure: row-local work of Arrow UDFs, so no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import parsers
from skeinflow.functions.text import chunk_id, token_count

CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
#: A stretch between units is worth a chunk of its own above this many tokens.
GAP_TOKENS = 20
Counter = Callable[[str], int]
SCHEMA = "source_id string, file_path string, start_line int, end_line int, content string, tokens int, chunk_type string, unit_name string, exported boolean"


def quarter(text: str) -> int:
    """Tokens by the rule of four characters each; any other counter may be passed instead."""
    return -(-len(text) // 4)


def by_lines(lines: list[str], size: int, overlap: int, first: int = 1, count: Counter = quarter) -> list[tuple[int, int, str, int]]:
    """(start line, end line, text, tokens) of blocks of whole lines up to ``size`` tokens; a longer line is a block of its own.

    Each next block begins with the last lines of the one before that hold at least ``overlap`` tokens. A closed block has the sum of its lines' tokens, the last one its text's.
    """
    cost = [count(x + "\n") for x in lines]
    out, start, total = [], 0, 0
    for n in range(len(lines)):
        if total + cost[n] > size and n > start:
            out.append((first + start, first + n - 1, "\n".join(lines[start:n]), total))
            back, held = n, 0
            while back > start and held < overlap:
                back -= 1
                held += cost[back]
            start, total = back, held
        total += cost[n]
    text = "\n".join(lines[start:])
    out.append((first + start, first + len(lines) - 1, text, count(text)))
    return out


def by_structure(content: str, path: str, size: int, overlap: int, count: Counter = quarter) -> list[tuple] | None:
    """(start, end, text, tokens, type, name, exported) of the units of a file, oversized ones in parts, and of what lies between; None without units.

    A class that fits in twice the size stands for its methods; a larger one gives way to them.
    """
    units = parsers.parse(content, path)
    if not units:
        return None
    lines, most = content.split("\n"), 2 * size
    text = lambda a, z: "\n".join(lines[a - 1 : z])
    large = {u.name for u in units if u.kind == "class" and count(text(u.start, u.end)) > most}
    keep = [u for u in units if (u.name.split(".")[0] in large if u.kind == "method" and "." in u.name else not (u.kind == "class" and u.name in large and any(m.kind == "method" and m.name.startswith(f"{u.name}.") for m in units)))]
    out, covered = [], 0
    for u in keep:
        if u.start > covered + 1 and count(text(covered + 1, u.start - 1)) > GAP_TOKENS and text(covered + 1, u.start - 1).strip():
            out.append((covered + 1, u.start - 1, text(covered + 1, u.start - 1), count(text(covered + 1, u.start - 1)), "block", "header" if covered == 0 else "between", False))
        body = text(u.start, u.end)
        if count(body) > most:
            out += [(a, z, t, n, u.kind, f"{u.name} (part {k})", u.exported) for k, (a, z, t, n) in enumerate(by_lines(lines[u.start - 1 : u.end], size, overlap, u.start, count), 1)]
        else:
            out.append((u.start, u.end, body, count(body), u.kind, u.name, u.exported))
        covered = max(covered, u.end)
    if text(covered + 1, len(lines)).strip():
        out.append((covered + 1, len(lines), text(covered + 1, len(lines)), count(text(covered + 1, len(lines))), "block", "footer", False))
    return out


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, structure: bool = True, count: Counter = quarter) -> DataFrame:
    """Chunks of ``files`` (source_id, file_path, content), with ids; options may also be columns chunk_size, chunk_overlap and use_ast of a file.

    Null contents have no chunk, an empty one has one; a text that doesn't parse is cut by lines.
    """
    own = {c: c in files.columns for c in ("chunk_size", "chunk_overlap", "use_ast")}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for r in p.itertuples(index=False):
                n = int(r.chunk_size) if own["chunk_size"] and r.chunk_size == r.chunk_size and r.chunk_size else size
                o = int(r.chunk_overlap) if own["chunk_overlap"] and r.chunk_overlap == r.chunk_overlap and r.chunk_overlap is not None else overlap
                s = structure if not own["use_ast"] or r.use_ast is None else bool(r.use_ast)
                made = by_structure(r.content, r.file_path or "", n, o, count) if s else None
                if made is None:
                    made = [(a, z, t, k, "token-block", None, None) for a, z, t, k in by_lines(r.content.split("\n"), n, o, 1, count)]
                rows += [(r.source_id, r.file_path, *m) for m in made]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    columns = ["source_id", "file_path", "content", *(c for c, there in own.items() if there)]
    made = files.filter(F.col("content").isNotNull()).select(*columns).mapInPandas(run, SCHEMA)
    return made.select(chunk_id(F.col("source_id"), F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("id"), "*")


def files_of(chunks: DataFrame) -> DataFrame:
    """(source_id, file_path, content): the text of each file from its distinct chunks, in order of their lines; a chunk that doesn't end a line ends it here.

    A file is one row, as it was before it was cut.
    """
    line = F.when(F.col("content").endswith("\n") | (F.col("content") == ""), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    distinct = chunks.filter("content is not null").select("id", "source_id", "file_path", "start_line", line.alias("content")).dropDuplicates(["id"])
    return distinct.groupBy("source_id", "file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("start_line", F.lit(1)).alias("n"), "id", "content"))), lambda x: x["content"]), "").alias("content"))


__all__ = ["by_lines", "by_structure", "chunk_files", "files_of", "quarter", "token_count"]
