"""Problem 3: cut oversized chunks into overlapping pieces by recursive bisection.

A stretch longer than the limit less the overlap is cut at the strongest boundary near its midpoint, and its halves are cut again. Each piece
after the first then starts with about the overlap of the text before it. Sizes are tokens of ceil(code points / 4).

Boundary strengths, from strong to weak: line before a heading or a definition at the margin, blank line, line end before a less indented
line, line end, sentence end, clause end, white space, and only where a stretch has none of these any place that parts neither CR from LF nor a
mark from its letter.

Cases: null, empty and fitting contents give no piece; null options and sources without options take the defaults; a chunk_size below 1
takes the default, an overlap of half the chunk_size or more is cut to half; repeated rows of an id count once; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.session import small

CHUNK_SIZE, CHUNK_OVERLAP, CHARS = 500, 50, 4
#: Share of a stretch, on either side of its midpoint, where the strongest boundary is taken; where it has none, the nearest further out is.
REACH = 0.25

_DEFINITION = regex.compile(r"\n(?=(?:#{1,6} |(?:export |pub |public |private |static |async |default )*(?:def|class|func|fn|function|interface|impl|struct|enum|module|resource|variable|create table)\b|@\w))", regex.I)
_BLANK = regex.compile(r"\n[ \t]*\r?\n+")
_LINE = regex.compile(r"\n")
_SENTENCE = regex.compile(r"[.!?][\"')\]]*\s+|[。！？]")
_CLAUSE = regex.compile(r"[,;:})\]]\s*|[、，；]")
_SPACE = regex.compile(r"\s+")
PIECE_SCHEMA = "chunk_id string, source_id string, piece int, pieces int, start int, overlap int, tokens int, content string"


def boundaries(text: str, structure: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut before, ascending, and their strengths."""
    best: dict[int, int] = {}
    for strength, rule in ((1, _SPACE), (2, _CLAUSE), (3, _SENTENCE), (4, _LINE), (6, _BLANK), (7, _DEFINITION)):
        if strength == 7 and not structure:
            continue
        for m in rule.finditer(text):
            best[m.end()] = strength
    for m in _LINE.finditer(text):
        if best.get(m.end()) == 4 and text[m.end() : m.end() + 1] not in (" ", "\t", "\n", "\r", ""):
            best[m.end()] = 5
    best.pop(0, None)
    best.pop(len(text), None)
    at = np.array(sorted(best), dtype=np.int64)
    return at, np.array([best[i] for i in at], dtype=np.int64)


def _whole(text: str, i: int) -> bool:
    """Whether a cut before i parts nothing that belongs together."""
    return not (text[i - 1] == "\r" and text[i] == "\n") and not unicodedata.combining(text[i]) and text[i] not in "‍️" and text[i - 1] != "‍"


def _cut(text: str, at: np.ndarray, strength: np.ndarray, a: int, z: int) -> int:
    """Where to cut the stretch a..z."""
    middle, reach = (a + z) // 2, max(1, int((z - a) * REACH))
    lo, hi = np.searchsorted(at, (max(a + 1, middle - reach), min(z - 1, middle + reach) + 1))
    if lo < hi:
        s = strength[lo:hi]
        near = np.flatnonzero(s == s.max()) + lo
        return int(at[near[np.argmin(np.abs(at[near] - middle))]])
    lo, hi = np.searchsorted(at, (a + 1, z))
    if lo < hi:  # the nearest place further out
        return int(at[lo + int(np.argmin(np.abs(at[lo:hi] - middle)))])
    for step in range(reach):
        for i in (middle - step, middle + step):
            if a < i < z and _whole(text, i):
                return i
    return middle


def split(text: str, size: int, overlap: int, structure: bool = True) -> list[tuple[int, int, int]]:
    """(start of the overlap, start, end) of each piece; sizes in tokens."""
    limit = size * CHARS
    back = min(overlap * CHARS, limit // 2)
    at, strength = boundaries(text, structure)
    cuts, stack = [], [(0, len(text))]
    while stack:
        a, z = stack.pop()
        if z - a <= limit - (back if a else 0):
            cuts.append((a, z))
            continue
        m = _cut(text, at, strength, a, z)
        stack += [(m, z), (a, m)]
    out = []
    for a, z in cuts:
        start = max(0, a - back) if a else 0
        if a and back:
            lo, hi = np.searchsorted(at, (start, min(a, start + max(1, back // 3) + 1)))
            if lo < hi:  # begin the overlap at a natural place too, at most a third shorter
                s = strength[lo:hi]
                start = int(at[lo + int(np.argmax(s))])
            else:
                while start < a and start and not _whole(text, start):
                    start += 1
        out.append((start, a, z))
    return out


def oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """Distinct chunks above their source's max_unit_tokens, with the options in force."""
    size = F.when(F.col("chunk_size") >= 1, F.col("chunk_size")).otherwise(F.lit(CHUNK_SIZE))
    opts = options.groupBy(F.col("source_id").alias("of")).agg(*(F.max(c).alias(c) for c in ("chunk_size", "chunk_overlap", "max_unit_tokens", "use_ast")))
    return (
        chunks.select("id", "source_id", "content")
        .join(small(opts), F.col("source_id") == F.col("of"), "left")
        .withColumn("size", size)
        .withColumn("most", F.coalesce(F.col("max_unit_tokens"), 2 * F.col("size")))
        .filter(F.ceil(F.length("content") / CHARS) > F.col("most"))
        .dropDuplicates(["id"])
        .select("id", "source_id", "content", "size", F.greatest(F.coalesce("chunk_overlap", F.lit(CHUNK_OVERLAP)), F.lit(0)).alias("overlap"), F.coalesce("use_ast", F.lit(True)).alias("structure"))
    )


def split_oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """The ordered pieces of every oversized chunk; ``overlap`` counts the leading code points shared with the piece before."""

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                cuts = split(row.content, row.size, row.overlap, row.structure)
                yield pd.DataFrame(
                    [(row.id, row.source_id, i, len(cuts), a, a - o, -(-(z - o) // CHARS), row.content[o:z]) for i, (o, a, z) in enumerate(cuts)],
                    columns=["chunk_id", "source_id", "piece", "pieces", "start", "overlap", "tokens", "content"],
                )

    return oversized(chunks, options).mapInPandas(pieces, PIECE_SCHEMA)
