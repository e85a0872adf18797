"""Problem 4: label files as handwritten, generated, minified, vendored or blob by belief propagation over directory trees.

Each chunk gives counts (lines that are packed, that are literal data, that carry on the numbers of a line of the same shape) and marks found in comments. Marks in the run of comments and
imports a file begins with, however long it is, count in full; those further down weigh little. All are added up by file and, with the path, become a
pattern of marks, which has a first belief in the five labels. Names of libraries are learned from the banners and paths of the whole corpus.

Sum-product belief propagation runs on the tree of each source: files and directories are nodes, and one upward and one downward sweep by depth give exact marginals, so
siblings act on each other through their directory. From the marginals the model is learned by expectation maximisation: how likely each label is with each pattern, and
how often a file of each label stands in a directory of each; then the sweeps run again, ``ROUNDS`` times. A pattern that says little, as that of
a file without content, thereby leaves the word to the neighbours, as far as these are alike in the corpus.

Work per sweep level is one aggregation or join over directories, keyed by source and directory. Messages of files are added up map-side before the
shuffle; on the way back the files of a directory with more than ``HOT_FILES`` are dealt over several keys, as are path words in many paths.

Cases: files without chunks are judged by path and neighbours alone; null or empty contents count nothing; a null path is a file in the root;
repeated rows and older versions of a file are one file; chunks without a row in files give no row; extra columns are ignored.
Directories of any depth count as themselves; each level is one more step up and down.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.session import cut, small

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: log prior of the labels, and log compatibility of equal against unequal labels of a directory and one in it, and (at first) of a directory and its file.
PRIOR = (0.0, -2.2, -2.2, -2.2, -2.2)
SAME, OTHER = math.log(0.52), math.log(0.12)
LIKE, UNLIKE = math.log(0.9), math.log(0.025)
N = len(LABELS)
#: First beliefs are softened by this; they count as so many files of each pattern, and as so many edges.
SOFT, PSEUDO, EDGES = 1.0, 5.0, 20.0
#: Rounds of learning; levels of the tree between cuts of the plan; files of a directory beyond which they are dealt over several keys; keys of a hot name.
ROUNDS, LEVELS, HOT_FILES, SALTS = 2, 4, 1_000_000, 32
#: Patterns up to which they are broadcast (56 bytes each).
PATTERNS = 500_000
#: Files whose banner or container names a library at least this often make it a known library.
LIBRARY_FILES = 2

_COMMENT = regex.compile(r"^\s*(?://+|#+|/\*+!?|\*+|--+|<!--|;+|\"\"\"|''')\s?(.*)$")
#: Words of several languages that say a file is made by a tool, and that it should not be changed by hand.
_MADE = regex.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[- ]?generated\b|\bgenerated (?:by|from|code|file|using|with|on)\b|\bmachine[- ](?:written|generated|made)\b|\bwritten by a (?:tool|machine|program)\b"
    r"|\b(?:produced|emitted|compiled|built|created|output) (?:by|of|from) [\w./-]+\b|\bregenerate (?:with|by|using)\b|\boverwritten (?:at|by|on|in|with)\b|\bchanges (?:will|would) be lost\b"
    r"|\b(?:creado|generado) (?:por|autom)|\b(?:erzeugt|generiert)\b|\b(?:généré|produit|créé) (?:par|automatiquement)|\b(?:gerado|generato|creato) (?:por|da|autom)|сгенерирован|создан автоматически|自動生成|自动生成|自動的に生成",
    regex.I,
)
_KEEP = regex.compile(
    r"\bdo(?:n'?t| not) (?:edit|modify|change|touch)\b|\bno (?:editar|modificar|edit)\b|\bnicht (?:von hand |manuell )?(?:ändern|bearbeiten|editieren)\b|\bne pas (?:modifier|éditer)\b|\bnão editar\b|\bnon modificare\b"
    r"|\boverwritten\b|\bchanges (?:will|would) be lost\b|\bregenerate\b|не редактировать|не изменять|編集しないで|请勿(?:编辑|修改)|\bby hand\b",
    regex.I,
)
_STRONG = regex.compile(r"@generated\b|<auto-?generated|\bcode generated by .+ do not edit|\bAUTO-?GENERATED\b.*(?:do not|don't)|^\s*machine[- ]written\b|\bthis file (?:was|is) (?:automatically |machine[- ])?generated\b", regex.I)
_HAND = regex.compile(r"\bwritten by hand\b|\bhand[- ]?written\b|\bwithout asking\b|\bvon hand geschrieben\b|\bescrito a mano\b|\bécrit à la main\b", regex.I)
_BANNER = (
    regex.compile(r"^\s*(?:/\*!?|//|\*|#|--|;)?\s*!?\s*(?P<lib>[a-z][\w-]*(?:\.js)?)\s+(?:v\d+\.\d+(?:\.\d+)?|\d+\.\d+\.\d+)\b\s*(?:[-|(].*)?(?:\*/)?\s*$", regex.I),
    regex.compile(r"\b(?:copied|copy|taken|imported|forked|vendored) from (?P<lib>[a-z][\w-]*) (?:release|version|v?\d)", regex.I),
    regex.compile(r"\(c\)\s+(?:\d{4}\s+)?(?:the )?(?P<lib>[a-z][\w-]*) (?:authors|contributors|developers)\b", regex.I),
    regex.compile(r"https?://(?P<lib>[a-z][\w-]*)\.[\w.]+/licen[cs]e", regex.I),
    regex.compile(r"\bupstream (?:copy, )?(?:see|at|:)?\s*:?\s*(?P<lib>[a-z][\w-]*)\.", regex.I),
)
_COPY = regex.compile(r"\bupstream\b|\bcopied from\b|\bthird[- ]party\b.*\blicen|\bauthors, released under\b|/licen[cs]e\b", regex.I)
_NUMBERS = regex.compile(r"^[\s\[({]*(?:[-+]?(?:0x[0-9a-f]+|\d[\d_]*(?:\.\d*)?(?:e[-+]?\d+)?)[\s,;|\])}]*){4,}$", regex.I)
_RECORD = regex.compile(r"^\s*[\[({].*[\])}]\s*,?\s*$")
_FIELDS = regex.compile(r"^[^\s;,|\t]{1,24}(?:[;,|\t][^\s;,|\t]{0,24}){3,}$")
_BASE64 = regex.compile(r"^\s*[\"'`]?[A-Za-z0-9+/]{56,}={0,2}[\"'`]?,?\s*\\?$")
_ESCAPED = regex.compile(r"(?:\\x[0-9a-f]{2}){2,}|_0x[0-9a-f]{3,}", regex.I)
_KEYFILE = regex.compile(r"-----BEGIN [A-Z0-9 ]+-----|ssh-(?:rsa|ed25519|dss) AAAA")
_DIGITS, _WORDS = regex.compile(r"-?\d+"), regex.compile(r"[A-Za-z]+")
_LOCKED = regex.compile(r"\"lockfileVersion\"|\"integrity\"\s*:\s*\"sha|^integrity sha|^\[\[package\]\]|\bchecksum = \"", regex.M)

#: Lines that may stand above or among the comments a file begins with: directives, packages and imports.
_PREAMBLE = regex.compile(
    r"^\s*(?:[\"']use \w+[\"'];?\s*$|<\?(?:php|xml)\b|<!DOCTYPE\b|@(?:charset|import|use)\b|(?:package|namespace|module)\s+[\w.:\\\\]+\s*;?\s*$|declare\s*\(|set -\w+"
    r"|(?P<opens>(?:static |global |public )?import\b|from\s+\S+\s+import\b|using\s+[\w.:= ]+;|use\s+[\w:\\\\{]|extern crate\b|require(?:_once|_relative)?\b|export\s+(?:\*|\{[^}]*\})\s+from\b|(?:const|let|var|local)\s+[\w${},:\s]+=\s*require\b|library\())",
    regex.I,
)
#: A one-line assignment at the margin, such as that of a logger, which may stand there too.
_SETUP = regex.compile(r"^(?:export |const |let |var |local |final |static )*[A-Za-z_$][\w.$]*(?:\s*:\s*[\w.\[\], ]+)?\s*:?=\s*(?!.*(?:=>|\bfunction\b|\blambda\b|\{))[^=\s].{0,160}[^(\[,\\]$")

FEATURES = "chars double, packed double, data double, numbered double, lines double, escaped double, locked int, keyed int, keyed_low int, made_low int, hand_low int, copied_low int"
_COUNTS = ("chars", "packed", "data", "numbered", "lines", "escaped")
_FLAGS = ("locked", "keyed", "keyed_low", "made_low", "hand_low", "copied_low")
#: Marks that count in full if the chunk continues the run of comments its file begins with.
_LEADING = ("made", "hand", "copied")

_CODE = r"\.(?:js|jsx|mjs|cjs|ts|tsx|py|go|java|rs|c|h|cc|cpp|hpp|cs|php|rb|swift|kt|scala|css|scss|sql|sh|lua|r|m)$"
_PROSE = r"\.(?:md|rst|txt|adoc|html?)$"
_LOCKFILE = r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|uv\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock|podfile\.lock|mix\.lock|flake\.lock|[\w.-]+\.lock|packages\.lock\.json)$"
_GENERATED_PATH = r"(?:^|/)(?:__generated__|generated|codegen|autogen|gen|gen-src)/|\.generated\.|\.g\.(?:dart|cs)$|\.pb\.\w+$|_pb2(?:_grpc)?\.py$|(?:^|/)autogen\.\w+$|\.designer\.cs$|_generated\.\w+$"
_MINIFIED_PATH = r"[.-]min\.(?:js|css|mjs)$|[.-]bundle\.js$|\.packed\.js$"
_VENDOR_PATH = r"(?:^|/)(?:node_modules|bower_components|vendor|third[_-]?party|3rdparty|deps|pods|external|extern|carthage)/"
_CONTAINER = r"(?:^|/)(?:node_modules|bower_components|vendor|third[_-]?party|3rdparty|deps|Pods|external|extern|Carthage)/(@?[a-z][\w.-]*?)(?:-\d+\.\d+[\w.]*)?/"
_DATA_PATH = r"(?:^|/)(?:data|resources|fixtures|assets)/"
_VERSIONED = r"([a-z][a-z-]*[a-z])-\d+\.\d+\.\d+(?=[./-])"


def _remarks(content: str, head: bool) -> Iterator[tuple[str, str | None, bool]]:
    """(text, what it says, whether only comments and preamble stand above) of each comment line, None for other lines.

    A last item without a text tells whether the whole chunk is such a run. Comments that follow code on a line are read if they are
    of the kind that packers keep; inner lines of a docstring never belong to the run.
    """
    lead, close, quote, nest = True, "", "", 0
    lines = content.split("\n")
    if not head:  # it may begin within a comment
        for line in lines:
            if "/*" in line:
                break
            if line.rstrip().endswith("*/"):
                close = "*/"
                break
    for line in lines:
        if quote:
            yield line, line.strip(), False
            if quote in line:
                quote = ""
            continue
        rest = line
        while True:
            m = _COMMENT.match(rest)
            start = rest.lstrip()
            if not close and start.startswith(("/*", "<!--")):
                close = "*/" if start.startswith("/*") else "-->"
            if not close:
                break
            end = rest.find(close, len(rest) - len(start) + 2 if start.startswith("/*") else 0)
            text = rest if end < 0 else rest[: end + len(close)]
            m = _COMMENT.match(text)
            yield text, m.group(1) if m else text.strip(), lead
            rest = "" if end < 0 else rest[end + len(close) :]
            if end >= 0:
                close = ""
            if not rest.strip():
                rest = ""
                break
        if not rest.strip():
            if not line.strip():
                yield line, None, lead
            continue
        if m:
            yield rest, m.group(1), lead
            if (q := rest.lstrip()[:3]) in ('"""', "'''") and rest.count(q) % 2:
                quote = q
            continue
        if nest > 0 or (lead and (p := _PREAMBLE.match(rest))):
            if nest > 0 or p.group("opens"):
                nest = max(0, nest + sum(rest.count(c) for c in "([{") - sum(rest.count(c) for c in ")]}"))
        elif not _SETUP.match(rest):
            lead = False
        yield rest, None, lead
        at = rest.find("/*")
        while at >= 0 and (end := rest.find("*/", at + 2)) >= 0:
            if rest[at + 2 : at + 3] in ("!", "*"):
                m = _COMMENT.match(text := rest[at : end + 2])
                yield text, m.group(1) if m else text, False
            at = rest.find("/*", end + 2)
    yield "", None, lead


def look(content: str | None, head: bool) -> tuple[list[float], list[int], list[int], list[str | None], bool]:
    """Counts, marks, marks of its leading run, library names in and below it, and whether it is such a run as a whole; ``head``: the chunk may begin its file."""
    if not content:
        return [0.0] * 6, [0] * 6, [0] * 3, [None, None], True
    lines = content.split("\n")
    chars = float(len(content))
    packed = data = numbered = 0.0
    held = 0
    shapes: dict[str, list[int]] = {}
    in_key = False
    for line in lines:
        n = len(line)
        if n < 8:
            continue
        held += 1
        if in_key:
            in_key = "-----END" not in line
            continue
        if "-----BEGIN" in line:
            in_key = "-----END" not in line
            continue
        if n > 180 and line.count(" ") < 0.06 * n:
            if n > 200 and _BASE64.match(line[:400] if n > 400 else line) and n < 20_000:
                data += n
            else:
                packed += n
            continue
        c = line.lstrip()[:1]
        if c.isdigit() or c in "-+[({." or n < 26:
            if _NUMBERS.match(line) or (_FIELDS.match(line) and sum(x.isdigit() for x in line) > 0.15 * n):
                data += n
                continue
            if c in "[({" and _RECORD.match(line) and sum(x.isdigit() for x in line) > 0.2 * n:
                data += n
                continue
        elif _FIELDS.match(line) and sum(x.isdigit() for x in line) > 0.2 * n:
            data += n
            continue
        if n >= 56 and _BASE64.match(line):
            data += n
            continue
        start = line[:48]
        numbers = _DIGITS.findall(start)
        if numbers:
            shape = _WORDS.sub("w", _DIGITS.sub("0", start))[:18]
            now = [int(x[:9]) for x in numbers if x != "-"]
            if any(x == y + 1 for x, y in zip(now, shapes.get(shape, ()))):
                numbered += 1
            shapes[shape] = now
    escaped = float(sum(len(m.group()) for m in _ESCAPED.finditer(content))) if "\\x" in content or "_0x" in content else 0.0
    marks: dict[bool, list[int]] = {True: [0, 0, 0], False: [0, 0, 0]}
    names: dict[bool, list[str]] = {True: [], False: []}
    above, lead = "", True
    for text, said, lead in _remarks(content, head):
        if said is None:
            above = ""
            continue
        of = marks[lead]
        if _HAND.search(said):
            of[1] = 1
        elif _STRONG.search(said):
            of[0] = 2
        elif _MADE.search(said):
            of[0] = max(of[0], 2 if _KEEP.search(above + " " + said) else 1)
        elif of[0] and _KEEP.search(said):
            of[0] = 2
        for rule in _BANNER:
            if b := rule.search(text):
                names[lead].append(b.group("lib").lower())
                of[2] = max(of[2], 1)
        if _COPY.search(said):
            of[2] = 2
        above = said
    key = _KEYFILE.search(content)
    return (
        [chars, packed, data, numbered, float(held), escaped],
        [int(bool(_LOCKED.search(content))), int(bool(key) and key.start() < 200), int(bool(key)), *marks[False]],
        marks[True],
        [n[0] if n and n[0] not in ("version", "release") else None for n in (names[True], names[False])],
        lead,  # of the last item
    )


def chunk_features(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its counts and marks; contents don't leave the scan's tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, s, f, c, start in zip(p.id, p.source_id, p.file_path, p.content, p.start_line):
                at = 1.0 if start is None or not start == start else max(1.0, start)
                counts, flags, leading, names, whole = look(c, at == 1)
                rows.append((i, s, f, *counts, *flags, *leading, *names, at, whole))
            yield pd.DataFrame(rows, columns=["id", "source_id", "file_path", *_COUNTS, *_FLAGS, *_LEADING, "library", "library_low", "at", "whole"])

    schema = f"id string, source_id string, file_path string, {FEATURES}, made int, hand int, copied int, library string, library_low string, at double, whole boolean"
    return chunks.select("id", "source_id", "file_path", "content", F.col("start_line").cast("double").alias("start_line")).mapInPandas(run, schema)


def file_features(chunks: DataFrame) -> DataFrame:
    """The counts and marks of each file that has chunks; a chunk id counts once.

    Marks of a chunk's leading run count in full if all chunks above it are such runs as a whole, else as those further down (``_low``).
    """
    each = chunk_features(chunks).groupBy("source_id", "file_path", "id").agg(*(F.max(c).alias(c) for c in (*_COUNTS, *_FLAGS, *_LEADING, "library", "library_low", "whole")), F.min("at").alias("at"))
    marked = F.when((F.greatest(*_LEADING) > 0) | F.col("library").isNotNull(), F.struct("at", *_LEADING, "library"))
    by = each.groupBy("source_id", "file_path").agg(
        *(F.sum(c).alias(c) for c in _COUNTS),
        *(F.max(c).alias(c) for c in (*_FLAGS, "library_low")),
        F.min("at").alias("first"),
        F.min(F.when(~F.col("whole"), F.col("at"))).alias("last"),
        F.collect_list(marked).alias("marks"),
    )
    last = F.when(F.col("first") > 1, F.lit(0.0)).otherwise(F.coalesce("last", F.lit(float("inf"))))
    by = by.withColumn("in_run", F.filter("marks", lambda x: x["at"] <= last)).withColumn("below", F.filter("marks", lambda x: x["at"] > last))

    def most(of: str, c: str) -> Column:
        return F.array_max(F.transform(of, lambda x: x[c]))

    return by.select(
        "source_id",
        "file_path",
        *_COUNTS,
        "locked",
        "keyed",
        "keyed_low",
        *(F.coalesce(most("in_run", c), F.lit(0)).alias(c) for c in _LEADING),
        *(F.greatest(F.col(f"{c}_low"), F.coalesce(most("below", c), F.lit(0))).alias(f"{c}_low") for c in _LEADING),
        most("in_run", "library").alias("library"),
        F.coalesce(most("below", "library"), F.col("library_low")).alias("library_low"),
    )


#: Columns of evidence: one mark a bit.
class _Marks:
    """Scores of the labels by marks, which are also numbered as the bits of a file's pattern."""

    def __init__(self) -> None:
        self.bits: list[Column] = []

    def score(self, *terms: tuple[Column, float]) -> Column:
        out = F.lit(0.0)
        for when, weight in terms:
            held = F.coalesce(when, F.lit(False))
            self.bits.append(held)
            out = out + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return out

    def pattern(self) -> Column:
        return sum((F.shiftleft(b.cast("long"), i) for i, b in enumerate(self.bits)), F.lit(0).cast("long"))


def _beliefs(known: Column) -> tuple[Column, list[Column]]:
    """(pattern of marks, first beliefs in the labels as logs), from columns of path and features."""
    path = F.lower(F.coalesce("file_path", F.lit("")))
    has = F.coalesce(F.col("chars"), F.lit(0.0)) > 0

    def share(c: str, of: str = "chars") -> Column:
        return F.coalesce(F.col(c) / F.nullif(F.col(of), F.lit(0.0)), F.lit(0.0))

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    marks = _Marks()
    code, prose, lock = path.rlike(_CODE), path.rlike(_PROSE), path.rlike(_LOCKFILE)
    key = (flag("keyed") == 1) & ~code
    banner = F.col("known_banner")
    generated = marks.score(
        (lock, 9.0),
        ((flag("locked") == 1) & path.rlike(r"lock"), 5.0),
        ((flag("made") == 2) & ~prose, 8.0),
        ((flag("made") == 1) & ~prose & (flag("hand") == 0), 2.5),
        ((flag("made") == 0) & (flag("made_low") == 2) & ~prose & (flag("hand_low") == 0), 1.0),
        (flag("hand") == 1, -6.0),
        (path.rlike(_GENERATED_PATH) & ~prose, 7.0),
        ((share("numbered", "lines") > 0.35) & code, 7.0),
        ((share("numbered", "lines") > 0.2) & code, 2.0),
        (prose, -4.0),
    )
    minified = marks.score(
        (path.rlike(_MINIFIED_PATH), 3.0),
        ((share("packed") > 0.6) & code, 7.0),
        ((share("packed") > 0.35) & code, 2.0),
        ((share("escaped") > 0.2) & code, 5.0),
        (has & (share("packed") < 0.2) & (share("escaped") < 0.05), -5.0),
        (~code, -6.0),
    )
    vendored = marks.score(
        (known & path.rlike(_VENDOR_PATH), 4.5),
        (path.rlike(_VENDOR_PATH), 2.5),
        (known & ~path.rlike(_VENDOR_PATH), 3.5),
        ((flag("copied") == 2) & ~prose & banner, 7.0),
        ((flag("copied") == 2) & ~prose & ~banner, 3.0),
        ((flag("copied") == 1) & code & banner, 4.0),
        ((flag("copied") == 0) & (flag("copied_low") > 0) & code & F.col("known_low"), 1.5),
        (prose & ~path.rlike(_VENDOR_PATH), -4.0),
    )
    blob = marks.score(
        ((share("data") > 0.55) & ~prose & ~key, 7.0),
        ((share("data") > 0.4) & ~prose & ~key, 2.0),
        (path.rlike(_DATA_PATH) & code & (share("data") > 0.3), 1.5),
        (has & (share("data") < 0.25), -5.0),
        (key | ~code, -5.0),
    )
    hand = marks.score((prose, 3.0), (key, 6.0), (~key & (flag("keyed_low") == 1) & ~code, 1.5), (has & (share("packed") < 0.05) & (share("data") < 0.05) & (flag("made") == 0) & (flag("copied") == 0) & ~lock, 2.0))
    return marks.pattern(), [c + F.lit(p) for c, p in zip((hand, generated, minified, vendored, blob), PRIOR)]


def evidence(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, source_id, dir, pattern, e0..e4) of each file: the marks it shows, and the first beliefs they give."""
    features = cut(file_features(chunks))
    path = F.coalesce("file_path", F.lit(""))
    base = files.select("id", "source_id", "file_path").filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("source_id").alias("source_id"), F.min("file_path").alias("file_path"))
    # names of libraries: from banners of copies, and of directories right below a container
    from_banner = features.filter(F.col("copied") > 0).select(F.col("library").alias("name"), F.lit(1.0).alias("w"))
    from_below = features.filter((F.col("copied_low") > 0) & F.col("library").isNull()).select(F.col("library_low").alias("name"), F.lit(0.5).alias("w"))
    from_path = base.select(F.lower(F.regexp_extract(path, _CONTAINER, 1)).alias("name"), F.lit(1.0).alias("w"))
    names = from_banner.unionByName(from_below).unionByName(from_path).filter(F.length("name") > 2).groupBy("name").agg(F.sum("w").alias("n")).filter(F.col("n") >= LIBRARY_FILES).select("name")
    names = cut(names)
    lower = F.lower(path)
    parts = F.concat(
        F.slice(F.split(lower, "/"), 1, F.greatest(F.size(F.split(lower, "/")) - 1, F.lit(0))),
        F.array(F.regexp_extract(lower, _VERSIONED, 1), F.regexp_extract(lower, r"(?:^|/)([a-z][a-z-]*[a-z])\.[^/]*$", 1)),
    )
    # directory names like name-1.2.3 count as the name
    parts = F.transform(parts, lambda x: F.regexp_replace(x, r"-\d+\.\d+[\w.]*$", ""))
    words = base.select("id", F.explode(F.array_distinct(parts)).alias("name")).filter(F.length("name") > 2)
    known = _named(words, names).select("id").distinct().withColumn("known", F.lit(True))
    said = features.select("source_id", "file_path", F.coalesce("library", "library_low").alias("name"), F.col("library").isNotNull().alias("banner"))
    banners = said.join(names, "name", "left_semi").select(F.col("source_id").alias("s"), F.col("file_path").alias("p"), "banner")
    joined = (
        base.join(features, ["source_id", "file_path"], "left")
        .join(banners, F.col("source_id").eqNullSafe(F.col("s")) & F.col("file_path").eqNullSafe(F.col("p")), "left")
        .drop("s", "p")
        .join(known, "id", "left")
        .withColumn("known_low", F.col("banner").isNotNull())
        .withColumn("known_banner", F.coalesce("banner", F.lit(False)))
    )
    segments = F.split(path, "/")
    folder = F.array_join(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), "/")
    pattern, scores = _beliefs(F.coalesce("known", F.lit(False)))
    return joined.select("id", F.coalesce("source_id", F.lit("")).alias("source_id"), folder.alias("dir"), pattern.alias("pattern"), *(s.alias(f"e{i}") for i, s in enumerate(scores)))


def _named(words: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``words`` whose name is in ``names``: by broadcast of a few names, else by salted names, as a path word like "src" may be in most rows."""
    if (few := small(names)) is not names:
        return words.join(few, "name", "left_semi")
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return words.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"], "left_semi").drop("salt")


class Model(NamedTuple):
    """What is learned: of each pattern the log probability of the labels; of directories the log share of the labels; the log weight of each pair of labels of a directory and its file, and of two directories."""

    patterns: DataFrame | None
    folders: np.ndarray
    edges: np.ndarray
    tree: np.ndarray


def first_model() -> Model:
    """Beliefs to begin with: a file is mostly like its directory, and no label of a directory is likelier than another."""
    same = np.eye(N, dtype=bool)
    return Model(None, np.zeros(N), np.where(same, LIKE, UNLIKE), np.where(same, SAME, OTHER))


def _with(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with the model's numbers as columns of one broadcast row: as literals they would make every round's code anew."""
    numbers = {
        **{f"r{i}": float(x) for i, x in enumerate(model.folders)},
        **{f"{name}{x}{y}": float(v) for name, edges in (("f", model.edges), ("t", model.tree)) for (x, y), v in np.ndenumerate(np.exp(edges))},
    }
    one = rows.sparkSession.sql(f"SELECT * FROM VALUES ({', '.join(f'{v!r}D' for v in numbers.values())}) AS t({', '.join(numbers)})")  # a local row: no job of its own
    return rows.crossJoin(F.broadcast(one))  # one row


def _send(state: list[Column], edges: str, up: bool = False) -> list[Column]:
    """The message over an edge: of each label of the receiver the log of the sum over the sender's, whose greatest counts as 1; ``edges``: f of a directory and its file, t of two directories."""
    top = F.greatest(*state)
    mass = [F.exp(s - top) for s in state]
    weight = [[F.col(f"{edges}{y}{x}" if up else f"{edges}{x}{y}") for y in range(N)] for x in range(N)]
    return [F.log(sum((m * weight[x][y] for x, m in enumerate(mass[1:], 1)), mass[0] * weight[0][y])) for y in range(N)]


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(N)]


def _named_as(prefix: str, columns: list[Column]) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def _parent(depth: int) -> Column:
    """The directory above one of that depth."""
    return F.when(F.instr("dir", "/") > 0, F.substring_index("dir", "/", depth - 1)).otherwise(F.lit(""))


def _beside(rows: DataFrame, states: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the state of their directory (ps, pd, ..); the files of a hot directory are dealt over several keys."""
    keyed = rows.join(hot.select(F.col("source_id").alias("hs"), F.col("dir").alias("hd"), "salts"), (F.col("source_id") == F.col("hs")) & (F.col("dir") == F.col("hd")), "left")
    keyed = keyed.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int")).drop("hs", "hd", "salts")
    wide = states.join(hot.select(F.col("source_id").alias("hs"), F.col("dir").alias("hd"), "salts"), (F.col("ps") == F.col("hs")) & (F.col("pd") == F.col("hd")), "left")
    wide = wide.withColumn("ns", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("int")))).drop("hs", "hd", "salts")
    return keyed.join(wide, (F.col("source_id") == F.col("ps")) & (F.col("dir") == F.col("pd")) & (F.col("salt") == F.col("ns"))).drop("ps", "pd", "ns", "salt")


def hot_folders(files: DataFrame) -> DataFrame:
    """(source_id, dir, salts) of the directories with more than ``HOT_FILES`` files, of which there are few."""
    by = files.groupBy("source_id", "dir").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_FILES)
    return small(cut(by.select("source_id", "dir", F.ceil(F.col("n") / HOT_FILES).cast("int").alias("salts"))))


def propagate(files: DataFrame, model: Model, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` (id, source_id, dir, pattern, e0..e4) with the number of files of their directory, s0..s4, what it has heard from all others, and b0..b4, the log beliefs of the labels (not yet scaled);
    and of each pair of directories s0..s4 and e0..e4, what the upper one has heard from elsewhere and the lower one from below.

    Levels of the tree are steps of one plan, which is cut every ``LEVELS`` of them.
    """
    n = range(N)
    root = _cols("r")
    told = _with(files, model).select("id", "source_id", "dir", "pattern", *_named_as("m", _send(_cols("e"), "f", up=True)), *_cols("e"))
    # upward: what each directory hears from its files and directories, from the deepest level to the root
    direct = cut(told.groupBy("source_id", "dir").agg(*(F.sum(f"m{i}").alias(f"a{i}") for i in n), F.count(F.lit(1)).alias("files")).withColumn("depth", F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/")))))
    deepest = direct.agg(F.max("depth")).first()[0] or 0
    ups: list[DataFrame] = []
    from_below: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        here = direct.filter(F.col("depth") == depth).select("source_id", "dir", "files", *_cols("a"))
        if from_below is not None:
            here = here.unionByName(from_below).groupBy("source_id", "dir").agg(F.sum("files").alias("files"), *(F.sum(f"a{i}").alias(f"a{i}") for i in n))
        # a = all that came from below; u = the message to the directory above
        here = _with(here, model).select("source_id", "dir", "files", *_cols("a"), *_named_as("u", _send([c + r for c, r in zip(_cols("a"), root)], "t", up=True)))
        if (deepest - depth) % LEVELS == LEVELS - 1:
            here = cut(here)
        ups.append(here)
        from_below = here.select("source_id", _parent(depth).alias("dir"), F.lit(0).cast("long").alias("files"), *_named_as("a", _cols("u")))
    ups.reverse()
    up = ups[0].withColumn("depth", F.lit(0))
    for depth in range(1, deepest + 1):
        up = up.unionByName(ups[depth].withColumn("depth", F.lit(depth)))
    up = cut(up)
    # downward: each directory's full state, from the root
    nothing = [F.lit(None).cast("double")] * N
    state = _with(up.filter("depth = 0"), model).select("source_id", "dir", "files", *_named_as("s", [c + r for c, r in zip(_cols("a"), root)]), *_named_as("c", nothing), *_named_as("w", nothing))
    states = state
    for depth in range(1, deepest + 1):
        here = up.filter(F.col("depth") == depth).withColumn("parent", _parent(depth))
        above = state.select(F.col("source_id").alias("ps"), F.col("dir").alias("pd"), *_cols("s"))
        joined = _with(here.join(above, (F.col("source_id") == F.col("ps")) & (F.col("parent") == F.col("pd"))), model)
        cavity, own = [F.col(f"s{i}") - F.col(f"u{i}") for i in n], [F.col(f"a{i}") + root[i] for i in n]
        down = _send(cavity, "t")
        state = joined.select("source_id", "dir", "files", *_named_as("s", [o + d for o, d in zip(own, down)]), *_named_as("c", cavity), *_named_as("w", own))
        if depth % LEVELS == 0:
            state = cut(state)
        states = states.unionByName(state)
    # to the files: all that their directory heard but their own message
    states = cut(states)
    at = states.select(F.col("source_id").alias("ps"), F.col("dir").alias("pd"), "files", *_cols("s"))
    final = _beside(told, at, hot)
    final = final.select("id", "pattern", "files", *_cols("e"), *_named_as("s", [F.col(f"s{i}") - F.col(f"m{i}") for i in n]))
    links = states.filter("c0 is not null").select(*_named_as("s", _cols("c")), *_named_as("e", _cols("w")))
    final = _with(final, model).select(*final.columns, *_named_as("b", [F.col(f"e{i}") + h for i, h in enumerate(_send(_cols("s"), "f"))]))
    return final, links


def _soft(state: list[Column]) -> list[Column]:
    top = F.greatest(*state)
    mass = [F.exp(s - top) for s in state]
    total = sum(mass[1:], mass[0])
    return [m / total for m in mass]


def learn(files: DataFrame, found: DataFrame, links: DataFrame, model: Model) -> Model:
    """The model that fits what was found: counts of labels by pattern, and of pairs of labels of directories and files and of two directories, all smoothed by the first beliefs.

    A directory of one file tells nothing about how alike its files are, so pairs are counted where there are more.
    """
    p = found.select("id", "pattern", *_named_as("p", _soft(_cols("b"))))
    first = files.select("pattern", *_named_as("q", _soft([c / SOFT for c in _cols("e")])))
    believed = first.groupBy("pattern").agg(*(F.max(f"q{i}").alias(f"q{i}") for i in range(N)))  # alike in all files of a pattern
    counted = p.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(N))).join(believed, "pattern")
    patterns = cut(counted.select("pattern", *_named_as("l", [F.log((F.col(f"p{i}") + PSEUDO * F.col(f"q{i}") + 1e-6) / (F.col("n") + PSEUDO)) for i in range(N)])))
    edges = _joint(found.filter("files > 1"), model, "f", LIKE, UNLIKE)
    tree = _joint(links, model, "t", SAME, OTHER)
    folders = edges.sum(axis=1)
    return Model(patterns, np.log(folders), _ratio(edges), _ratio(tree))


def _ratio(joint: np.ndarray) -> np.ndarray:
    return np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))


def _joint(pairs: DataFrame, model: Model, edges: str, same: float, other: float) -> np.ndarray:
    """The share of each pair of labels over edges between nodes of states s and e, smoothed."""
    rows = _with(pairs.select(*_named_as("s", _soft(_cols("s"))), *_named_as("e", _soft(_cols("e")))), model)
    scaled = rows.select(F.array(*(F.col(f"s{x}") * F.col(f"e{y}") * F.col(f"{edges}{x}{y}") for x in range(N) for y in range(N))).alias("j"))
    scaled = scaled.withColumn("t", F.aggregate("j", F.lit(0.0), lambda a, x: a + x))
    sums = scaled.agg(*(F.sum(F.col("j")[i] / F.col("t")).alias(f"j{i}") for i in range(N * N))).first()
    belief = np.where(np.eye(N, dtype=bool), math.exp(same), math.exp(other)) * np.exp(np.array(PRIOR))[:, None]
    joint = np.array([v or 0.0 for v in sums]).reshape(N, N) + EDGES * belief / belief.sum()
    return joint / joint.sum()


def with_beliefs(files: DataFrame, model: Model) -> DataFrame:
    """``files`` with the log probabilities of their pattern's labels as e0..e4: the first beliefs, softened, before anything is learned."""
    if model.patterns is None:
        return files.withColumns({f"e{i}": F.log(c + 1e-6) for i, c in enumerate(_soft([x / SOFT for x in _cols("e")]))})
    return files.drop(*(f"e{i}" for i in range(N))).join(small(model.patterns, PATTERNS), "pattern").withColumnsRenamed({f"l{i}": f"e{i}" for i in range(N)})


def label_evidence(files: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, alone, p0..p4): the label of each file by its marginals, what its own marks alone would say, and the marginals."""
    model, hot = first_model(), hot_folders(files)
    for _ in range(rounds):
        found, links = propagate(with_beliefs(files, model), model, hot)
        model = learn(files, cut(found), links, model)
    found, _ = propagate(with_beliefs(files, model), model, hot)

    def best(prefix: str) -> Column:
        top = F.greatest(*_cols(prefix))
        label = F.lit(LABELS[-1])
        for i in reversed(range(N - 1)):
            label = F.when(F.col(f"{prefix}{i}") >= top, F.lit(LABELS[i])).otherwise(label)
        return label

    return found.select("id", best("b").alias("label"), best("e").alias("alone"), *_named_as("p", _soft(_cols("b"))))


def label_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, label, handwritten) of each distinct file id; ``handwritten`` is that label's marginal."""
    return label_evidence(cut(evidence(files, chunks))).select(F.col("id").alias("file_id"), "label", F.round("p0", 6).alias("handwritten"))
