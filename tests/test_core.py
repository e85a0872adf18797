import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.functions import parsers
from skeinflow.functions import text as T
from skeinflow.operators import budget as B
from skeinflow.operators import chunking, formatting, graphs, ranking, similarity, store, symbols, usage
from pyspark.sql import functions as F


def test_keywords_and_names():
    assert T.keywords("How does the parseFile function work?") == ["parsefile", "work?"]
    assert T.names("call parseFile and user_name with stuff") == ["parsefile", "user_name", "stuff"]
    assert T.keywords("the of is") == []


def test_signals(spark):
    df = spark.createDataFrame([("src/auth/login.ts", "function loginUser() { login(); login(); }"), ("x.test.ts", None)], "p string, c string")
    r = df.select(T.path_match(F.col("p"), ["auth", "zzz"]).alias("p"), T.content_match(F.col("c"), ["login"]).alias("c"), T.symbol_match(F.col("c"), ["loginuser", "login"]).alias("s"), T.file_kind(F.col("p")).alias("k")).collect()
    assert r[0].p == 0.5 and abs(r[0].c - (0.7 + 0.3 * 2 / 5)) < 1e-9 and r[0].s == 0.75 and r[0].k == 1.0 and r[1].k == 0.3
    kinds = {"a/config.ts": 0.4, "a.json": 0.4, "a.d.ts": 0.5, "a/index.ts": 0.6, "index.ts": 1.0, "a/__tests__/b.ts": 0.3}
    got = {r.p: r.k for r in spark.createDataFrame([(k,) for k in kinds], "p string").select("p", T.file_kind(F.col("p")).alias("k")).collect()}
    assert got == kinds


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 0.0], 0), ([1e-10, 0.0], [5.0, 0.0], 1)]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>, w int")
    assert all(abs(r.c - r.w) < 1e-6 for r in df.select("w", similarity.cosine(F.col("a"), F.col("b")).alias("c")).collect())
    with pytest.raises(Exception, match="same length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(similarity.cosine(F.col("a"), F.col("b"))).collect()


def ranked(spark, rows):
    return spark.createDataFrame([(f"c{i}", f, s, e, t, sc, f"text {i}") for i, (f, s, e, t, sc) in enumerate(rows)], "id string, file_path string, start_line int, end_line int, tokens int, score double, content string").withColumn("source_id", F.lit("s"))


@pytest.mark.parametrize("budget,tokens,kept,prefix", [(250, [100, 100, 100], [0, 1], [0, 1]), (200, [100, 150, 50], [0, 2], [0]), (0, [100], [], []), (500, [], [], [])])
def test_budget(spark, budget, tokens, kept, prefix):
    df = ranked(spark, [("a.ts", 1, 2, t, 1.0 - i / 10) for i, t in enumerate(tokens)])
    assert sorted(r.id for r in B.greedy(df, budget, [], [F.desc("score")]).collect()) == [f"c{i}" for i in kept]
    assert sorted(r.id for r in B.prefix(df, budget, [], [F.desc("score")]).collect()) == [f"c{i}" for i in prefix]


def fold(rows):
    """The joining of touching chunks, one after the other."""
    out = []
    for r in rows:
        if out and out[-1]["end"] + 1 >= r["start"]:
            c = out[-1]
            over = max(0, c["end"] - r["start"] + 1)
            text = "\n".join(r["text"].split("\n")[over:]) if over else r["text"]
            c["text"] += "\n" + text if text else ""
            c["tokens"] += r["tokens"] - (int(r["tokens"] * (over / (r["end"] - r["start"] + 1))) if over else 0)
            c["end"], c["score"] = r["end"], max(c["score"], r["score"])
        else:
            out.append(dict(r))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 8), st.integers(0, 50)), min_size=1, max_size=12))
def test_merge_is_the_fold(spark, spans):
    rows = sorted(({"start": s, "end": s + n, "tokens": t, "score": t / 50, "text": "\n".join(f"l{k}" for k in range(s, s + n + 1)), "id": f"c{i:02d}"} for i, (s, n, t) in enumerate(spans)), key=lambda r: (r["start"], r["end"], r["id"]))
    df = spark.createDataFrame([(r["id"], "s", "f", r["text"], r["start"], r["end"], r["tokens"], r["score"]) for r in rows], "id string, source_id string, file_path string, content string, start_line int, end_line int, tokens long, score double")
    got = sorted((r.start_line, r.end_line, r.tokens, r.score, r.content, r.id) for r in B.merge_adjacent(df).collect())
    assert got == sorted((r["start"], r["end"], r["tokens"], r["score"], r["text"], r["id"]) for r in fold(rows))


def test_import_boost_and_diversity(spark):
    rows = [("a", "main.ts", 0.9), ("b", "utils.ts", 0.5), ("c", "other.ts", 0.5)]
    df = spark.createDataFrame([(i, "s", f, "", x, 10) for i, f, x in rows], "id string, source_id string, file_path string, content string, similarity double, tokens int")
    edges = spark.createDataFrame([("s", "main.ts", "utils.ts"), ("s", "main.ts", "main.ts"), ("t", "main.ts", "other.ts")], "source_id string, src string, dst string")
    got = {r.id: r for r in ranking.rank(df, "zzz", edges).collect()}
    assert got["b"].score > got["c"].score and got["c"].boost == 0 and got["a"].boost > 0
    same = spark.createDataFrame([(f"c{i}", "s", "f", 1.0, 1.0) for i in range(6)], "id string, source_id string, file_path string, score double, base double")
    assert sorted(round(r.score, 6) for r in ranking.diversify(same).collect()) == [0.7, 0.7, 0.7, 0.8, 0.9, 1.0]


def test_line_chunks():
    lines = [f"line {i} of the text" for i in range(100)]
    made = chunking.by_lines(lines, 100, 20)
    assert made[0][0] == 1 and made[-1][1] == 100 and len(made) > 1
    assert all(b[0] <= a[1] + 1 and b[0] > a[0] for a, b in zip(made, made[1:]))
    assert chunking.by_lines([""], 100, 10) == [(1, 1, "", 0)]
    assert len(chunking.by_lines(["x" * 500], 100, 10)) == 1


def test_structural_chunks(spark):
    code = "import os\n\n\ndef a():\n    return 1\n\n\nclass B:\n    def m(self):\n        return 2\n"
    rows = [("s", "a.py", code), ("s", "b.json", '{"x": 1}'), ("s", "c.py", "def broken(:\n"), ("s", "d.md", ""), ("s", "e.py", None)]
    got = {}
    for r in chunking.chunk_files(spark.createDataFrame(rows, "source_id string, file_path string, content string")).collect():
        got.setdefault(r.file_path, []).append(r)
        assert r.id.startswith("chunk_") and len(r.id) == 22
    assert {r.unit_name for r in got["a.py"]} == {"a", "B"} and got["b.json"][0].chunk_type == "token-block"
    assert got["c.py"][0].chunk_type == "token-block" and len(got["d.md"]) == 1 and "e.py" not in got
    big = "class Big:\n" + "".join(f"    def m{i}(self):\n        return '{'x' * 200}'\n" for i in range(30))
    names = [m[5] for m in chunking.by_structure(big, "big.py", 100, 10)]
    assert "Big" not in names and "Big.m3" in names


def test_markdown():
    text = "---\ntitle: x\n---\n# One\ntext\n```js\n# not a header\n```\n## Two\nmore\n```\nopen"
    assert [tuple(u) for u in parsers.parse(text, "a.md")] == [("constant", "frontmatter", 1, 3, False), ("class", "One", 4, 8, True), ("function", "codeblock:js", 6, 8, False), ("class", "Two", 9, 12, False), ("function", "codeblock:text", 11, 12, False)]
    assert parsers.markdown("text\n---\nmore") == []
    parsers.register_parser(".zz", lambda c: [parsers.Unit("block", "all", 1, 1, True)])
    assert parsers.parse("x", "f.zz")[0].name == "all" and parsers.parse("x", "f.unknown") is None


def test_scanners():
    ts = "export class A {\n  run() {\n    go();\n  }\n}\nexport async function load(x) {\n  return x;\n}\nconst k = () => {\n  load(1);\n};\n"
    assert [(u.kind, u.name, u.start, u.end) for u in parsers.parse(ts, "a.ts")] == [("class", "A", 1, 5), ("function", "load", 6, 8), ("constant", "k", 9, 11)]
    assert [u.name for u in parsers.parse("type T struct {\n}\nfunc (t *T) Go() {\n}\n", "a.go")] == ["T", "Go"]
    assert "load" in parsers.signatures(ts, "a.ts") and parsers.repo_map(ts, "a.ts").startswith("a.ts")


def test_imports(spark):
    text = "import { a, b as c } from './x'\nimport D, { e } from \"../y\"\nimport * as n from 'pkg'\nimport F from '/abs'\nimport './side'\nexport * from './z'\nconst r = require('q')\nconst d = await import('./dyn')\n// import { no } from './no'\nimport type { T } from './t'\r"
    files = spark.createDataFrame([("s", "src/m/a.ts", text), ("s", "src/m/x.ts", ""), ("s", "src/y/index.ts", ""), ("s", "src/m/z.js", ""), ("s", "b.py", "import os")], "source_id string, file_path string, content string")
    found = graphs.parse_imports(files)
    rows = {r.specifier: r for r in found.collect()}
    assert set(rows) == {"./x", "../y", "pkg", "/abs", "./side", "./z", "q", "./dyn", "./t"}
    assert rows["./x"].names == ["a", "b"] and rows["../y"].default_name == "D" and rows["./t"].type_only and rows["/abs"].kind == "absolute" and rows["pkg"].kind == "package"
    assert {(r.src, r.dst) for r in graphs.resolve_imports(found, files).collect()} == {("src/m/a.ts", "src/m/x.ts"), ("src/m/a.ts", "src/y/index.ts"), ("src/m/a.ts", "src/m/z.js")}


def test_related(spark):
    edges = spark.createDataFrame([("s", *e) for e in [("a", "b"), ("b", "c"), ("c", "d"), ("c", "a"), ("a", "a")]], "source_id string, src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "source_id string, file_path string")
    assert {(r.file_path, r.depth) for r in graphs.related(edges, seeds, 2).collect()} == {("b", 1), ("c", 2)}
    assert {r.file_path for r in graphs.related(edges, seeds, 9).collect()} == {"b", "c", "d"}
    assert graphs.related(edges, seeds.limit(0), 2).collect() == []


def test_calls(spark):
    rows = [("s", "a.ts", "c1", "export function run() {\n  helper(1);\n  Widget(2);\n  outside();\n  if (x) {}\n}\nfunction Widget() {\n}\n", 10), ("s", "b.ts", "c2", "function helper(x) {\n  return run();\n}\n", 1)]
    df = spark.createDataFrame([(*r, "") for r in rows], "source_id string, file_path string, id string, content string, start_line int, unit_name string")
    edges = {(r.caller, r.callee, r.callee_file, r.line) for r in symbols.call_edges(df).collect()}
    assert edges == {("run", "helper", "b.ts", 11), ("run", "Widget", "a.ts", 12), ("run", "outside", "(external)", 13), ("helper", "run", "a.ts", 2)}
    got = {(r.side, r.function) for r in symbols.call_graph(symbols.call_edges(df), "run").collect()}
    assert got == {("caller", "helper"), ("callee", "helper"), ("callee", "Widget"), ("callee", "outside")}
    assert [r.name for r in symbols.search(symbols.definitions(df), "HELPER").collect()] == ["helper"]


def test_changes_and_upsert(spark):
    f = "source_id string, file_path string, content_hash string"
    now = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3")], f)
    then = spark.createDataFrame([("s", "a", "1"), ("s", "b", "9"), ("s", "d", "4")], f)
    changes = store.categorize(now, then)
    assert {(r.file_path, r.status) for r in changes.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "removed")}
    assert store.diff_summary(changes).first().needs_reindex
    assert {(r.file_path, r.content_hash) for r in store.upsert(then, now, ["source_id", "file_path"]).collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")}
    assert {(r.file_path, r.content_hash) for r in store.upsert(then, now, ["source_id", "file_path"], update=False).collect()} == {("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")}


def test_publish(spark, tmp_path):
    root = str(tmp_path / "index")
    df = spark.createDataFrame([("s", 1)], "source_id string, n int")
    assert store.current_version(spark, root) == 0
    assert store.publish({"t": df}, root) == 1 and store.publish({"t": df.union(store.read_version(spark, root, "t"))}, root) == 2
    assert store.read_version(spark, root, "t").count() == 2 and store.read_version(spark, root, "t", 1).count() == 1


def test_cache(spark):
    assert store.cache_key("q", 1, ["b", "a"]) == store.cache_key("q", 1, ["a", "b"]) != store.cache_key("q", 2, ["a", "b"])
    cache = spark.createDataFrame([("k", "r", "v1", 0), ("o", "r", "v0", 3)], "cache_key string, result string, index_version string, hit_count int")
    hit, after = store.lookup(cache, "k", "v1")
    assert hit.count() == 1 and {(r.cache_key, r.hit_count) for r in after.collect()} == {("k", 1), ("o", 3)}
    miss, after = store.lookup(cache, "k", "v2")
    assert miss.count() == 0 and {r.cache_key for r in after.collect()} == {"o"}


def test_sliding_limit(spark):
    base = 1_700_000_000_000
    at = [("a", 0), ("b", 59_999), ("c", 60_000), ("d", 60_000), ("e", 3_599_000), ("f", 3_600_001)]
    df = spark.createDataFrame([(i, "o", base + t) for i, t in at], "id string, org_id string, ms long").select("id", "org_id", F.timestamp_millis("ms").alias("created_at"), F.lit("Query").alias("event_type"))
    got = {r.id: (r.requests, r.allowed) for r in usage.sliding_limit(df.unionByName(df.limit(1)), 2).collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (3, False), "d": (3, False), "e": (1, True), "f": (2, True)}


def test_render():
    rows = [{"file_path": "a.ts", "start_line": 1, "end_line": 2, "content": "x < 1 ]]> y", "tokens": 1200, "score": 0.12345, "similarity": 0.5}]
    md = formatting.render(rows, "q", 50)
    assert "```typescript" in md and "1,200 tokens in 1 of 50 chunks" in md
    assert '"score": 0.123' in formatting.render(rows, "q", 50, "json")
    xml = formatting.render(rows, 'a "q" & <b>', 50, "xml")
    assert "&quot;q&quot; &amp; &lt;b&gt;" in xml
    assert xml and __import__("xml.dom.minidom").dom.minidom.parseString(formatting.render(rows, "q", 50, "xml"))
    assert formatting.render(rows, "q", 1, "plain").startswith("=== a.ts ===") and formatting.render([], "q", 0).endswith("0 tokens in 0 of 0 chunks")
