from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.functions import embedding, tokens
from skeinflow.functions import text as T
from skeinflow.operators import budget, chunking, graphs, service, similarity, store, symbols, usage

IMPORTS = [
    ("import { a, b as c } from './x';", [(1, "./x", "named", ["a", "b"], None, False)]),
    ("import type { A } from './x'", [(1, "./x", "named", ["A"], None, True)]),
    ("import {\n  a,\n  type B,\n} from \"./x\";\nimport y from 'y'", [(1, "./x", "named", ["a", "B"], None, False), (5, "y", "default", [], "y", False)]),
    ("import d, { e } from 'z'", [(1, "z", "mixed", ["e"], "d", False)]),
    ("import * as ns from 'z'", [(1, "z", "namespace", [], "ns", False)]),
    ("import 'side'", [(1, "side", "effect", [], None, False)]),
    ("export * from './x'; export { q } from './y'; export * as n from './z'", [(1, "./x", "export", [], None, False), (1, "./y", "export", [], None, False), (1, "./z", "export", [], None, False)]),
    ("const a = require('a'), b = await import('b')", [(1, "a", "require", [], None, False), (1, "b", "dynamic", [], None, False)]),
    ("// import 'no'\n/* import 'no' */\nconst s = \"import 'no'\"; x.import('no'); export const y = 1; require(name)", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), IMPORTS)
def test_imports(text, want):
    assert [tuple(i) for i in graphs.read_imports(text)] == want


@pytest.mark.parametrize(("query", "want"), [("where is parserCache used", ["parsercache", "where"]), ("load cache_key of XMLFile", ["cache_key", "xmlfile"]), ("a b", []), ("Symbol table", ["symbol", "table"])])
def test_names(query, want):
    assert T.names(query) == want


@pytest.mark.parametrize(("seconds", "want"), [(60, [1, 1, 1, 1]), (3 * 3600, [1, 2, 3, 4]), (5400, [1, 2, 2, 2]), (86_400, [1, 2, 3, 4])])
def test_limits_of_any_length(spark, seconds, want):
    rows = [(str(i), "o", datetime(2024, 1, 1) + timedelta(minutes=45 * i), "query") for i in range(4)]
    events = spark.createDataFrame([*rows, rows[0]], "id string, org_id string, created_at timestamp, event_type string")
    assert [r.requests for r in usage.sliding_limit(events, 2, seconds).orderBy("id").collect()] == want


def test_lookups(spark):
    projects = spark.createDataFrame([("o", "1", "one"), ("o", "2", "1"), ("o", "3", "two"), ("o", "4", "two"), ("q", "5", "one"), (None, "6", None)], "org_id string, id string, slug string")
    asked = spark.createDataFrame([("o", "1"), ("o", "two"), ("o", "none"), ("q", "one"), (None, "6"), ("o", "1")], "org_id string, ref string")
    assert {(r.org_id, r.ref): r.id for r in service.by_id_or_slug(asked, projects).collect()} == {("o", "1"): "1", ("o", "two"): "3", ("q", "one"): "5"}
    members = spark.createDataFrame([("u", "b", datetime(2024, 1, 2)), ("u", "a", datetime(2024, 1, 3)), ("v", "x", datetime(2024, 1, 1))], "user_id string, org_id string, created_at timestamp")
    orgs = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert [(r.user_id, r.name) for r in service.organisation_of(members, orgs).collect()] == [("u", "B")]
    page = service.page_with_total(projects, ["id"], 2, 1).collect()
    assert [(r.id, r.total) for r in page] == [("2", 6), ("3", 6)]
    assert service.in_scope(projects, org_id="o", slug="two").count() == 2


def test_digest_of_a_large_source(spark):
    """The sum of 48-bit hashes of more than 65,536 chunks doesn't fit 64 bits."""
    chunks = spark.range(80_000).select(F.lit("s").alias("source_id"), F.col("id").cast("string").alias("id"), F.lit("x").alias("content"))
    whole, less = service.index_digest(chunks), service.index_digest(chunks.filter("id <> '7'"))
    row = whole.first()
    assert row.chunks == 80_000 and row.digest > 2**63
    assert [[r.action for r in service.to_sync(whole, other).collect()] for other in (whole, less)] == [["skip"], ["upload"]]


def test_uploads_and_copies(spark):
    files = spark.createDataFrame([("a", "x.py", "1"), ("a", "y.py", ""), ("b", "", "1"), ("c", "x", None)], "project_id string, path string, content string")
    assert {r.project_id: r.accepted for r in service.check_uploads(files).collect()} == {"a": True, "b": False, "c": False}
    assert service.check_uploads(files.limit(0)).collect() == []
    rows = [("s", "1", "x"), ("s", "2", "y"), ("t", "3", "z")]
    chunks = spark.createDataFrame([*rows, rows[0]], "source_id string, id string, content string")
    again = spark.createDataFrame([rows[1], rows[0], ("t", "3", "other"), ("w", "4", "")], "source_id string, id string, content string")
    got = {r.source_id: r.action for r in service.to_sync(service.index_digest(chunks), service.index_digest(again)).collect()}
    assert got == {"s": "skip", "t": "upload", "w": "download"}


def test_snapshots_of_contents(spark):
    chunks = spark.createDataFrame([("1", "p", "x"), ("2", "p", "x"), ("3", "p", "y"), ("4", "q", "x")], "id string, source_id string, content string")
    listed = service.manifest(chunks)
    assert {(r.project_id, r.bytes, r.uses) for r in listed.collect()} == {("p", 1, 2), ("p", 1, 1), ("q", 1, 1)}
    none = spark.createDataFrame([], "project_id string, version int, checksum string")
    first = service.finalize(none, listed)
    second = service.finalize(first, listed.filter("project_id = 'p' and uses = 2"))
    stored = chunks.select(F.sha2("content", 256).alias("checksum"), "content").filter("content = 'x'")
    assert {(r.project_id, r.version, r.content) for r in service.download(second, stored).collect()} == {("p", 2, "x"), ("q", 1, "x")}
    assert {r.version for r in service.newest_versions(second, 1).collect()} == {1, 2}


def test_stored_symbols(spark):
    schema = "id string, file_path string, start_line int, content string, kind string, symbols array<string>, calls array<string>"
    chunks = spark.createDataFrame([("1", "a.ts", 3, "function go(\n  a,\n) {\n run()\n}", None, ["go"], ["run", "load"]), ("2", "b.ts", None, "run()", "class", [], ["run"]), ("3", "c.ts", 9, "x", "class", ["Gopher"], []), ("4", "d", 1, "", None, None, None)], schema)
    assert [(r.name, r.kind, r.signature) for r in service.stored_symbols(chunks, "go").collect()] == [("Gopher", "class", "Gopher"), ("go", "function", "function go(\n  a,\n) {")]
    assert service.stored_symbols(chunks, "Go", exact=True).count() == 0 and service.stored_symbols(chunks, "go", kind="class").count() == 1
    assert {tuple(r) for r in service.stored_calls(chunks, "run").collect()} == {("caller", "go", "a.ts", 3), ("caller", "anonymous", "b.ts", 0)}
    assert {tuple(r) for r in service.stored_calls(chunks, "go").collect()} == {("callee", "run", "a.ts", 0), ("callee", "load", "a.ts", 0)}


def test_history(spark):
    schema = "id long, query string, sources string, created_at timestamp"
    history = spark.createDataFrame([(4, "a", None, datetime(2024, 1, 1))], schema)
    asked = spark.createDataFrame([("c", ["x", "y"], datetime(2024, 1, 3)), ("b", [], datetime(2024, 1, 2))], "query string, sources array<string>, created_at timestamp")
    assert [(r.id, r.query, r.sources) for r in store.record(history, asked).orderBy("id").collect()] == [(4, "a", None), (5, "b", ""), (6, "c", "x,y")]
    assert store.clear(history).count() == 0 and store.clear(history, F.lit(datetime(2023, 1, 1))).count() == 1
    assert store.record(history.limit(0), asked.limit(0)).count() == 0


def test_embedder(spark):
    rows = spark.createDataFrame([("a", "read the Cache"), ("b", "cache THE read"), ("c", None), ("d", "")], "id string, content string")
    got = {r.id: r.v for r in rows.select("id", embedding.embed(F.col("content")).alias("v")).collect()}
    assert got["a"] == got["b"] and len(got["a"]) == 384 and abs(np.linalg.norm(got["a"]) - 1) < 1e-6 and got["c"] is None and not any(got["d"])


def test_many_queries_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "id string, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(25, 8)))], "query_id int, vector array<double>")

    def found():
        return {(r.query_id, r.rank): r.id for r in similarity.search_many(chunks, queries, 5).collect()}

    whole = found()
    monkeypatch.setattr(similarity, "MATRIX_QUERIES", 10)
    assert found() == whole and len(whole) == 125


def test_readable(spark):
    rows = spark.createDataFrame([(512,), (1280,), (5 * 1024**2,), (1024**3,)], "n long").select(T.readable_bytes(F.col("n")).alias("b"), T.readable_number(F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("512 B", "512"), ("1.3 KB", "1,280"), ("5.0 MB", "5,242,880"), ("1.0 GB", "1,073,741,824")]


def test_tokens_of_a_public_tokenizer(spark):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "def area(shape):\n    return shape.width", "naïve 解析器 <|endoftext|>", "x" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = [r.n for r in rows.select("i", tokens.token_length(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [*(len(other.encode_ordinary(t)) for t in texts), None] and tokens.Counter()(texts[1]) == got[1]
    lines = chunking.by_lines(texts[1].split("\n"), 8, 0, count=tokens.Counter())
    assert [x[2] for x in lines] == texts[1].split("\n")


def test_two_writers_take_two_versions(spark, tmp_path):
    root = str(tmp_path)
    assert [store._take_version(spark, root, 1) for _ in range(3)] == [1, 2, 3]
    rows = spark.createDataFrame([(1,)], "x int")
    assert store.publish({"t": rows}, root) == 4 and store.current_version(spark, root) == 4


def test_variants_of_symbols_and_calls(spark):
    go = "type Shape struct {\n}\nfunc Area(s Shape) int {\n  return side(s)\n}\n"
    js = "class Box {\n  open() {\n    return load(1);\n  }\n}\nfunction start() {\n  return open();\n}\n"
    rows = [("1", "s", "a.go", go, 11), ("2", "s", "b.js", js, 1), ("3", "s", "b.js", "function later() {\n  return start();\n}\n", 9), ("3", "s", "b.js", "function later() {\n  return start();\n}\n", 9)]
    chunks = spark.createDataFrame(rows, "id string, source_id string, file_path string, content string, start_line int")
    found = {(r.name, r.start_line) for r in symbols.definitions(chunks.filter("id = '1'")).collect()}
    assert found == {("Shape", 11), ("Area", 13)}
    assert {(r.name, r.start_line) for r in symbols.definitions(chunks.filter("id = '1'"), narrow=True, within_chunk=True).collect()} == {("Area", 3)}
    edges = {(r.caller, r.callee, r.callee_file) for r in symbols.call_edges(chunks).collect()}
    assert {("start", "open", "b.js"), ("later", "start", "b.js"), ("Area", "side", "(external)")} <= edges
    assert ("start", "open", "(external)") in {(r.caller, r.callee, r.callee_file) for r in symbols.call_edges(chunks, methods=False).collect()}
    assert {(r.caller, r.callee, r.callee_file) for r in symbols.call_edges(symbols.last_chunks(chunks)).filter("caller_file = 'b.js'").collect()} == {("later", "start", "(external)")}
    assert symbols.call_edges(chunks.limit(0)).collect() == [] and symbols.definitions(chunks.limit(0)).collect() == []


def test_calls_keep_the_first_line_and_the_last_text(spark):
    text = "function go() {\n  load(1);\n  stop();\n  load(2);\n}\n"
    chunks = spark.createDataFrame([("1", "s", "a.js", text, 5)], "id string, source_id string, file_path string, content string, start_line int")
    (row,) = symbols.call_edges(chunks).filter("callee = 'load'").collect()
    assert (row.first_line, row.line, row.context) == (6, 8, "load(2);")


def test_greedy_keeps_rows_of_any_type(spark):
    rows = spark.createDataFrame([("a", 100, {"x": 1}), ("b", 150, None), ("c", 50, {}), ("d", None, None)], "id string, tokens int, m map<string,int>")
    assert [r.id for r in budget.greedy(rows, 200, [], [F.col("id")]).orderBy("id").collect()] == ["a", "c"]
    assert budget.greedy(rows.limit(0), 200, [], [F.col("id")]).columns == rows.columns
