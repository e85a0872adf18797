"""Files as a source: glob rules, limits on size and kind, content hashes, and configurations with presets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest file in bytes, and the rules of a source that names none.
MAX_BYTES = 102_400
INCLUDE = ["**/*.ts", "**/*.js", "**/*.tsx", "**/*.jsx", "**/*.md", "**/*.json"]
EXCLUDE = ["**/node_modules/**", "**/dist/**", "**/.git/**"]
PRESETS = {
    "typescript": ["**/*.ts", "**/*.tsx", "**/*.md"],
    "javascript": ["**/*.js", "**/*.jsx", "**/*.md"],
    "python": ["**/*.py", "**/*.md"],
    "go": ["**/*.go", "**/*.md"],
    "rust": ["**/*.rs", "**/*.md"],
}


@dataclass
class Source:
    id: str
    path: str
    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))


@dataclass
class Config:
    sources: list[Source]
    chunk_size: int = 500
    chunk_overlap: int = 50
    version: int = 1


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over relative paths: ``**`` crosses directories, ``*`` and ``?`` don't, ``{a,b}`` is a choice."""
    out, i, choice = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, choice = out + "(?:", choice + 1
        elif c == "}" and choice:
            out, choice = out + ")", choice - 1
        elif c == "," and choice:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a relative path fits one of the rules and none of the exceptions."""
    some = F.lit(False)
    for g in include:
        some = some | path.rlike(glob_pattern(g))
    for g in exclude:
        some = some & ~path.rlike(glob_pattern(g))
    return some


def discover(spark: SparkSession, sources: list[Source], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files: source_id, file_path, content, size, content_hash; skipped: source_id, file_path, reason) of all sources.

    Size and path are tested on the listing, before a file's bytes are read; a file with a NUL character isn't text.
    """
    every: DataFrame | None = None
    for s in sources:
        root = spark._jvm.org.apache.hadoop.fs.Path(s.path)
        full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(s.path)
        plain, clean = re.sub(r"^file:/+", "/", full), F.regexp_replace("path", r"^file:/+", "/")
        relative = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(plain) + 2})") if full.startswith("file:") else F.expr(f"substring(path, {len(full) + 2})")
        rows = listed.filter(clean.isNotNull()).select(F.lit(s.id).alias("source_id"), relative.alias("file_path"), "length", "content")
        rows = rows.filter(matches(F.col("file_path"), s.include, s.exclude))
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        empty = spark.createDataFrame([], "source_id string, file_path string, content string, size long, content_hash string")
        return empty, spark.createDataFrame([], "source_id string, file_path string, reason string")
    text = F.decode("content", "UTF-8")
    sized = every.withColumn("large", F.col("length") > max_bytes)
    read = sized.filter(~F.col("large")).select("source_id", "file_path", text.alias("content"), F.col("length").alias("size"))
    nul = F.contains("content", F.lit("\0"))
    files = read.filter(~nul).withColumn("content_hash", F.sha2("content", 256))
    skipped = sized.filter("large").select("source_id", "file_path", F.lit("size").alias("reason")).unionByName(read.filter(nul).select("source_id", "file_path", F.lit("binary").alias("reason")))
    return files, skipped


def validate(config: Config) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a configuration."""
    errors, warnings, seen = [], [], set()
    if not config.sources:
        warnings.append("no sources")
    for s in config.sources:
        if not re.fullmatch(r"[A-Za-z0-9][\w-]*", s.id or ""):
            errors.append(f"source id {s.id!r} must be letters, digits, dashes and underscores")
        if s.id in seen:
            errors.append(f"source id {s.id!r} is used twice")
        seen.add(s.id)
        if not s.path:
            errors.append(f"source {s.id!r} has no path")
        if not s.include:
            errors.append(f"source {s.id!r} includes nothing")
        for g in [*s.include, *s.exclude]:
            if g.count("{") != g.count("}"):
                errors.append(f"pattern {g!r} has an open brace")
    if config.chunk_size <= 0:
        errors.append("chunk_size must be positive")
    if config.chunk_overlap < 0:
        errors.append("chunk_overlap can't be negative")
    if config.chunk_size > 0 and config.chunk_overlap >= config.chunk_size:
        errors.append("chunk_overlap must be less than chunk_size")
    if 0 < config.chunk_size < 50 or config.chunk_size > 4000:
        warnings.append("chunk_size is unusual")
    return errors, warnings


def load_config(text: str) -> Config:
    """A configuration from YAML or JSON text; a preset's name stands for its rules."""
    import yaml

    raw = yaml.safe_load(text) or {}
    sources = []
    for s in raw.get("sources") or []:
        rules = s.get("patterns") or {}
        include = PRESETS[s["preset"]] if s.get("preset") in PRESETS else rules.get("include") or s.get("include") or list(INCLUDE)
        sources.append(Source(str(s.get("id", "")), str(s.get("path", "")), list(include), list(rules.get("exclude") or s.get("exclude") or EXCLUDE)))
    settings = raw.get("settings") or {}
    return Config(sources, int(settings.get("chunk_size", 500)), int(settings.get("chunk_overlap", 50)), int(raw.get("version", 1)))
