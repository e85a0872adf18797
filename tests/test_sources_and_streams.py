import re

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import store
from skeinflow.sources import discovery as D
from skeinflow.streaming import live


@pytest.mark.parametrize("glob,path,fits", [("**/*.ts", "a.ts", True), ("**/*.ts", "x/y/a.ts", True), ("*.ts", "x/a.ts", False), ("**/dist/**", "a/dist/b.js", True), ("src/*.{js,ts}", "src/a.ts", True), ("src/*.{js,ts}", "src/a.py", False), ("a?.md", "ab.md", True)])
def test_glob(glob, path, fits):
    assert bool(re.match(D.glob_pattern(glob), path)) == fits


def test_discover(spark, tmp_path):
    for name, data in {"a.ts": b"x", "sub/b.md": b"hello", "node_modules/c.ts": b"no", "big.json": b"1" * (D.MAX_BYTES + 1), "edge.json": b"1" * D.MAX_BYTES, "nul.js": b"a\0b", "d.py": b"no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files, skipped = D.discover(spark, [D.Source("s", str(tmp_path))])
    assert {r.file_path for r in files.collect()} == {"a.ts", "sub/b.md", "edge.json"}
    assert {(r.file_path, r.reason) for r in skipped.collect()} == {("big.json", "size"), ("nul.js", "binary")}
    assert files.filter("file_path = 'a.ts'").first().content_hash == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    assert D.discover(spark, [])[0].count() == 0


def test_config():
    c = D.load_config("version: 1\nsources:\n- id: a\n  path: ./a\n  preset: python\n- id: a\n  path: ''\nsettings: {chunk_size: 10, chunk_overlap: 20}\n")
    errors, warnings = D.validate(c)
    assert c.sources[0].include == D.PRESETS["python"] and len(errors) == 3 and len(warnings) == 1
    assert D.validate(D.Config([D.Source("ok", "./x")])) == ([], [])


def _drain(stream, spark, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return spark.table(name).collect()


def test_rate_limit_and_counters(spark, tmp_path):
    rows = [("a", "o", 0), ("b", "o", 1_000), ("c", "o", 59_000), ("d", "o", 61_500), ("e", "p", 0)]
    df = spark.createDataFrame([(i, o, 1_700_000_000_000 + t) for i, o, t in rows], "id string, org_id string, ms long").select("id", "org_id", F.timestamp_millis("ms").alias("created_at"), F.lit("Query").alias("event_type"), F.lit(5).alias("tokens_used"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = _drain(live.rate_limited(stream, 2), spark, "limited", "append")
    assert {r.id: (r.requests, r.allowed) for r in out} == {"a": (1, True), "b": (2, True), "c": (3, False), "d": (2, True), "e": (1, True)}
    out = _drain(live.monthly_counters(stream), spark, "monthly", "append")
    assert {(r.org_id, r.month, r.queries, r.tokens) for r in out} == {("o", "2023-11", 4, 20), ("p", "2023-11", 1, 5)}
    assert live.bursts(stream).isStreaming and live.windowed_usage(stream).isStreaming


def test_follow(spark, tmp_path):
    folder, root = tmp_path / "src", str(tmp_path / "index")
    folder.mkdir()
    (folder / "a.ts").write_text("one")
    (folder / "b.ts").write_text("two")

    def discovered():
        return D.discover(spark, [D.Source("s", str(folder))])[0]

    def apply(changes, now):
        return {"files": now.select("source_id", "file_path", "content_hash"), "changes": changes}

    def run():
        q = live.follow(spark, str(folder), discovered, root, apply, str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
        return store.current_version(spark, root)

    assert run() == 1
    (folder / "a.ts").write_text("three")
    (folder / "b.ts").unlink()
    (folder / "c.ts").write_text("four")
    assert run() == 2
    got = {(r.file_path, r.status) for r in store.read_version(spark, root, "changes").collect()}
    assert got == {("a.ts", "changed"), ("b.ts", "removed"), ("c.ts", "new")}
