import pytest

from skeinflow.llm import provenance as P

FILES = "id string, source_id string, file_path string, content_hash string, label string"
CHUNKS = "id string, source_id string, file_path string, content string, start_line int, label int"
CODE = "def area(shape, unit=None):\n    if unit is None:\n        raise ValueError('no unit')\n    return shape.width * shape.height\n" * 6
HEAD = "# Code generated by tablegen. DO NOT EDIT.\n"
COPIED = "/*!\n * tinylib 3.1.4\n * https://tinylib.example/license\n */\n"
CASES = {
    "src/area.py": (CODE, "handwritten"),
    "src/made.py": (HEAD + CODE, "generated"),
    "src/talk.py": ("# Build step written by hand; it runs tablegen and checks what was generated.\n" + CODE, "handwritten"),
    "docs/notes.md": ("# Notes\nThis file was generated by a tool, do not edit.\n" * 5, "handwritten"),
    "web/app.js": ("a=>b.c(d=>d?.e),f.g=function(h){for(var i=0;i<h.length;i++)this.j(h[i])}," * 40, "minified"),
    "src/lib/tinylib/x.js": (COPIED + CODE, "vendored"),
    "utils/y.js": (COPIED + CODE, "vendored"),
    "node_modules/tinylib/z.js": (CODE, "vendored"),
    "src/table.py": ("rows = [\n" + "  1.5, -2.25, 3.75, 4.5, 5.0, -6.125,\n" * 60 + "]\n", "blob"),
    "package-lock.json": ('{"lockfileVersion": 3}', "generated"),
    "ops/server.pem": ("-----BEGIN CERTIFICATE-----\n" + "QUJD" * 16 + "\n-----END CERTIFICATE-----\n", "handwritten"),
    "gen/nothing.py": (None, "generated"),
    "src/fields.js": ("\n".join(f"  static get_field_{i}(o) {{ return o.$f[{i}] | 0; }}" for i in range(40)), "generated"),
}


@pytest.fixture(scope="module")
def labels(spark):
    files = [(f"f{i}", "s", p, "h", "x") for i, p in enumerate(CASES)] * 2 + [("none", None, None, None, None), ("deep", "s", "/".join("abcdefghijklmnop") + "/x.py", "h", "x"), (None, "s", "q", "h", "x")]
    chunks = [(f"c{i}", "s", p, c, 1, 0) for i, (p, (c, _)) in enumerate(CASES.items())] * 2 + [("u", "s", "unknown.py", CODE, 1, 0), ("v", None, None, CODE, None, 0)]
    return {r.file_id: r for r in P.label_files(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)).collect()}


@pytest.mark.parametrize("path", CASES)
def test_label(labels, path):
    assert labels[f"f{list(CASES).index(path)}"].label == CASES[path][1]


def test_each_file_once(labels):
    assert len(labels) == len(CASES) + 2 and labels["none"].label == "handwritten" and labels["deep"].label == "handwritten"


LICENCE = "".join(f"// line {3 * i} of the terms\n" for i in range(40))
IMPORTS = "import {\n" + "".join(f"  part{3 * i},\n" for i in range(40)) + "} from './parts';\n"
BLOCK = "/*\n" + "".join(f"line {3 * i} of the terms\n" for i in range(40)) + "*/\n"
MADE, JS = "// Code generated by tablegen. DO NOT EDIT.\n", "function area(shape, unit) {\n  return shape.width * shape.height;\n}\n" * 12


def test_marks_of_any_depth(spark):
    """Banners after long headers count in full, also in a later chunk; mentions further down don't."""
    cases = {
        "a/licence.js": ([(1, LICENCE + MADE + JS)], "generated"),
        "b/imports.js": ([(1, IMPORTS + MADE + JS)], "generated"),
        "c/block.js": ([(1, BLOCK + MADE + JS)], "generated"),
        "g/logger.py": ([(1, "import logging\n\nlog = logging.getLogger(__name__)\n\n" + HEAD + CODE)], "generated"),
        "d/two.js": ([(1, LICENCE), (41, MADE + JS)], "generated"),
        "e/mention.js": ([(1, JS[: JS.index("}\n") + 2] + "// ids are auto-generated by the database, do not set them by hand\n" + JS)], "handwritten"),
        "f/later.js": ([(1, JS), (37, MADE + JS)], "handwritten"),
    }
    files = [(f"f{i}", f"s{i}", p, "h", "x") for i, p in enumerate(cases)]
    chunks = [(f"c{i}.{at}", f"s{i}", p, c, at, 0) for i, (p, (parts, _)) in enumerate(cases.items()) for at, c in parts]
    got = {r.file_id: r.label for r in P.label_files(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)).collect()}
    assert [got[f"f{i}"] for i in range(len(cases))] == [want for _, want in cases.values()]


def test_library_beyond_300_characters():
    line = "/*! " + "terms of use " * 40 + "copied from tinylib 3.1.4 */!function(){a=1}();"
    _, _, leading, names, _ = P.look(line, True)
    assert leading[2] == 2 and names == ["tinylib", None]
    _, flags, leading, names, _ = P.look("a=1;" * 200 + "/*! tinylib v3.1.4 */b=2;", True)
    assert leading[2] == 0 and flags[-1] == 1 and names == [None, "tinylib"]


def test_lock_and_key_marks_anywhere():
    assert P.look('{"a": 1}\n' * 1000 + '"lockfileVersion": 3', True)[1][0] == 1
    assert P.look("Bag Attributes\n" * 30 + "-----BEGIN CERTIFICATE-----\n", True)[1][1:3] == [0, 1]


def test_deep_directories_are_kept_apart(spark):
    top = "/".join("abcdefghijkl")
    files = spark.createDataFrame([(f"f{d}", "s", f"{top}/{d}/x.py", "h", "x") for d in "pq"], FILES)
    assert {r.id: r.dir for r in P.evidence(files, spark.createDataFrame([], CHUNKS)).collect()} == {f"f{d}": f"{top}/{d}" for d in "pq"}


EVIDENCE = "id string, source_id string, dir string, pattern long, e0 double, e1 double, e2 double, e3 double, e4 double"


def test_marginals_are_exact(spark):
    """Against the sum over all labellings of a small tree, with weights that aren't symmetric."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model = P.Model(None, rng.normal(size=5), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    rows = [("a", "s", "d/e", 1, *[0.3 * i for i in range(5)]), ("b", "s", "d", 2, 1.0, 0.0, -1.0, 2.0, 0.5), ("c", "s", "", 3, 0.0, 3.0, 0.0, 0.0, 0.0)]
    files = spark.createDataFrame(rows, EVIDENCE)
    found, _ = P.propagate(files, model, P.hot_folders(files))
    got = {r.id: [r[f"p{i}"] for i in range(5)] for r in found.select("id", *P._named_as("p", P._soft(P._cols("b")))).collect()}
    folder, file, tree = (np.exp(x) for x in (model.folders, model.edges, model.tree))
    want = {k: [0.0] * 5 for k in "abc"}
    for root, d, e, x, y, z in itertools.product(range(5), repeat=6):
        w = folder[root] * folder[d] * folder[e] * tree[root, d] * tree[d, e] * file[e, x] * file[d, y] * file[root, z]
        w *= np.exp(rows[0][4 + x] + rows[1][4 + y] + rows[2][4 + z])
        want["a"][x] += w
        want["b"][y] += w
        want["c"][z] += w
    for k in "abc":
        assert max(abs(g - w / sum(want[k])) for g, w in zip(got[k], want[k])) < 1e-9


def test_neighbours_decide_where_a_file_says_little(spark):
    """Files without contents in directories of generated files, and alone."""
    line = "  static get_field_{i}(o) {{ return o.$f[{i}] | 0; }}"
    made = "\n".join(line.format(i=i) for i in range(40))
    files, chunks = [], []
    for d in range(6):
        for i in range(8):
            path = f"lib/part{d}/x{i}.js"
            files.append((f"{d}.{i}", "s", path, "h", "x"))
            if i:
                chunks.append((f"c{d}.{i}", "s", path, made if d < 3 else CODE, 1, 0))
    files.append(("alone", "s", "other/x.js", "h", "x"))
    found = {r.id: r for r in P.label_evidence(P.evidence(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS))).collect()}
    assert [found[f"{d}.0"].label for d in range(6)] == ["generated"] * 3 + ["handwritten"] * 3
    assert found["0.0"].alone == "handwritten" and found["alone"].label == "handwritten"


def test_contents_withheld(spark):
    """Of a fifth of the files of sf0.01 the contents are withheld: neighbours find more of the machine-made ones than paths alone, and few others."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    files, chunks = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("files", "chunks"))
    full = P.label_files(files, chunks).filter(F.pmod(F.xxhash64("file_id"), F.lit(5)) == 0).select("file_id", F.col("label").alias("full"))
    hidden = files.join(full, files.id == full.file_id).select("source_id", "file_path").distinct()
    found = P.label_evidence(P.evidence(files, chunks.join(hidden, ["source_id", "file_path"], "left_anti"))).join(full, F.col("id") == F.col("file_id")).collect()
    other = [r for r in found if r.full != "handwritten"]
    alone, model = (sum(r[c] != "handwritten" for r in other) for c in ("alone", "label"))
    wrong = sum(r.full == "handwritten" != r.label for r in found)
    assert model > alone and wrong <= 2


def test_hot_directories_and_names_give_the_same(spark, monkeypatch):
    """A directory dealt over several keys, and names joined by salted keys."""
    rows = [(f"f{i}", "s", "d" if i % 5 else f"d/{i}", i % 3, *[float((i * 7 + j * 3) % 5) for j in range(5)]) for i in range(60)]
    files = spark.createDataFrame(rows, EVIDENCE)

    def marginals():
        return {r.id: r.p0 for r in P.label_evidence(files, rounds=1).select("id", "p0").collect()}

    plain = marginals()
    monkeypatch.setattr(P, "HOT_FILES", 10)
    assert P.hot_folders(files).count() == 1
    assert all(abs(p - plain[k]) < 1e-9 for k, p in marginals().items())
    words = spark.createDataFrame([(f"f{i}", "src" if i % 2 else f"n{i}") for i in range(50)], "id string, name string")
    names = spark.createDataFrame([("src",), ("n4",)], "name string")
    few = sorted(map(tuple, P._named(words, names).select("id", "name").collect()))
    monkeypatch.setattr(P, "small", lambda x: x)
    assert sorted(map(tuple, P._named(words, names).select("id", "name").collect())) == few and len(few) == 26


def test_empty(spark):
    files, chunks = spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS)
    assert P.label_files(files, chunks).collect() == []
