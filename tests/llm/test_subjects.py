import numpy as np
import pytest

from skeinflow.llm import subjects as P

DOCS = "doc_id long, source string, text string, doc_kind string, file_path string, subject string"
SUBJECTS = "subject string, description string"
LABELS = "doc_id long, subject string, annotator string"
LAW = ["The plaintiff asked the tribunal for a verdict.", "Each affidavit names one bailiff.", "The attorney filed a deposition.", "A subpoena reached the notary."]
FARM = ["The tractor stood near the orchard.", "Each beehive feeds on the pasture.", "The plough broke during the harvest.", "Manure is kept by the greenhouse."]
PLAIN = ["See the notes below for details.", "The screenshot is attached.", "Nothing else depends on it.", "Closes item 12."]


def test_words():
    assert P.parts_of("loadCargoHold") == ["load", "cargo", "hold"] and P.parts_of("XMLFile") == ["xml", "file"] and P.parts_of("解析器") == ["解析", "析器"]
    coder = P.Coder()
    assert coder("cargo_hold2 Cargo hold") == [P.code_of("cargo"), P.code_of("hold")]


def test_units():
    found = list(P.units("# Title here\nOne two. Three four!\n```sh\nrun it\n```\n\n- five six", False, str.split))
    assert [(" ".join(w), s, h) for w, s, h in found] == [("Title here", 0, True), ("One two.", 0, False), ("Three four!", 0, False), ("five six", 1, False)]
    assert list(P.units(None, True, str.split)) == []


def test_decide():
    assert P.decide(np.array([[2.0, 0.5], [2.0, 1.9], [0.9, 0.0], [0.0, 3.0]])).tolist() == [0, -1, -1, 1]


def test_latent_model_finds_accurate_functions():
    """Seven functions that vote at random given the truth: the learned rates come near to those they were drawn with, and beat the lexicon alone."""
    rng = np.random.default_rng(1)
    n = 20_000
    y = rng.random(n) < 0.4
    true = [np.stack([np.roll(b[0], 0), b[1]]) for b in P.first_beliefs()]
    true[3] = np.array([[0.98, 0.02], [0.4, 0.6]])
    v = np.stack([np.array([rng.choice(len(r[0]), p=r[int(t)]) for t in y]) for r in true], axis=1)
    subject = rng.integers(0, 2, n)
    patterns, count = np.unique(np.c_[v, subject], axis=0, return_counts=True)
    prior, rates = P.learn_accuracies(patterns[:, :7], patterns[:, 7], count.astype(float), 2)
    assert abs(prior - 0.4).max() < 0.06 and abs(rates[3][:, 1, 1] - 0.6).max() < 0.06 and rates[3][:, 0, 1].max() < 0.06
    right = ((P.posterior(v, subject, prior, rates) >= 0.5) == y).mean()
    alone = ((v[:, 0] >= 6) == y).mean()
    assert right > alone


def test_labels_anchor_the_model():
    """Where the lexicon knows few words, labels teach that a lower share already means the subject."""
    rng = np.random.default_rng(2)
    y = rng.random(8000) < 0.5
    v = np.zeros((8000, 7), dtype=int)
    v[:, 0] = np.where(y, 4, 2)  # 15 to 20 hundredths against 5 to 10
    v[:, 2] = np.where(y, 3, 1)
    v[:800, 6] = np.where(y[:800], 1, 2)
    patterns, count = np.unique(v, axis=0, return_counts=True)
    of = np.zeros(len(patterns), dtype=int)
    fitted = P.learn_accuracies(patterns, of, count.astype(float), 1)
    assert ((P.posterior(v, np.zeros(8000, dtype=int), *fitted) >= 0.5) == y).all()


@pytest.fixture(scope="module")
def rows(spark):
    docs = []
    for i in range(60):
        own = LAW if i % 2 else FARM
        docs.append((i, f"s{i % 3}", " ".join([own[i % 4], own[(i + 1) % 4], PLAIN[i // 2 % 4]]), "guide", None, "x"))
    docs += [(100, "s0", None, "guide", None, "x"), (101, "s0", "", "guide", None, "x"), (102, None, " ".join(PLAIN), "guide", None, "x"), (103, "s0", " ".join([*LAW, *LAW, *LAW, FARM[0]]), "guide", None, "x"), (104, "s0", " ".join([LAW[0], FARM[0]]), "issue", None, "x"), (None, "s0", LAW[0], "guide", None, "x")]
    docs += docs[:2]
    code = "// The plaintiff asked the tribunal for a verdict.\nfunction fileAffidavit(bailiff, notaryRecord) {\n  return subpoena(bailiff);\n}\n"
    docs.append((105, "s1", code * 3, "code", "src/a.js", "x"))
    subjects = spark.createDataFrame([("law", "courts, contracts, statutes and legal practice"), ("agriculture", "farming"), ("law", None)], SUBJECTS)
    labels = spark.createDataFrame([(1, "Law ", "a"), (2, "AGRICULTURE", "b"), (3, "law", "a"), (3, None, "a"), (4, "weather", "c"), (8, "agriculture", "a"), (None, "law", "c")], LABELS)
    found = P.label_documents(spark.createDataFrame(docs, DOCS), subjects, labels)
    return {(r.doc_id, r.subject) for r in P.subject_areas(found).collect()}


def test_areas(rows):
    assert {(1, "law"), (2, "agriculture"), (103, "law"), (104, "law"), (104, "agriculture"), (105, "law")} <= rows
    assert {d for d, _ in rows}.isdisjoint({100, 101, 102, None})
    assert (103, "agriculture") not in rows and (1, "agriculture") not in rows


def lexicon(spark, words):
    return spark.createDataFrame([(P.code_of(w), s, x) for w, s, x in words], "word long, subject int, weight double")


def test_lexicon_keeps_all_pure_words(spark):
    from pyspark.sql import functions as F

    rare = spark.range(20_100).select("id", F.lit(0).alias("subject"), F.lit(5).cast("long").alias("n")).withColumnRenamed("id", "word")
    other = spark.createDataFrame([(-1, -1, 90_000), (-2, 1, 100_000)], "word long, subject int, n long")
    words = {r.word: r.subject for r in P.as_lexicon(P.pure_words(rare.unionByName(other)), {-1: 0, -3: 1}).collect()}
    assert len(words) == 20_102 and words[20_099] == 0 and words[-3] == 1 and -1 not in words


def test_addresses_of_any_number_vote(spark):
    text = "".join(f"https://x.test/{i}\n" for i in range(1200)) + "https://x.test/plaintiff\n"
    docs = spark.createDataFrame([(1, "s", text, "guide", "x", "x")], DOCS)
    (row,) = P.features(P.read_units(docs), lexicon(spark, [("plaintiff", 0, 2.0)]), (np.zeros(0, np.int64), np.zeros((0, 1))), 1).collect()
    assert row.v4 == 1


def test_a_large_lexicon_is_joined(spark, monkeypatch):
    """Rows are the same whether every task holds the lexicon or rows are joined to it."""
    texts = [" ".join([LAW[i % 4], FARM[i % 3], PLAIN[i % 2]]) if i % 5 else None for i in range(40)]
    docs = spark.createDataFrame([(i, "s", t, "guide", "law/x.md", "x") for i, t in enumerate(texts) if t], DOCS)
    words = lexicon(spark, [("plaintiff", 0, 2.0), ("affidavit", 0, 2.0), ("subpoena", 0, 1.5), ("tractor", 1, 2.0), ("pasture", 1, 2.0), ("law", 0, 3.0)])
    none = (np.zeros(0, np.int64), np.zeros((0, 2)))
    table = P.read_units(docs)

    def rows():
        return sorted(map(tuple, P.features(table, words, none, 2).collect())), sorted(map(tuple, P.count_decided(table, words, 2).collect()))

    held = rows()
    monkeypatch.setattr(P, "LEXICON_ROWS", 0)
    assert rows() == held and held[0]


def test_held_out_labels(spark):
    """The subjects of documents whose labels were withheld, against them and against a plain cut of the lexicon's share."""
    d = "/root/testdata/sf0.1"
    docs, subjects, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subjects", "subject_labels"))
    found = P.label_documents(docs, subjects, labels.filter("doc_id % 2 = 0")).toPandas()
    held = {(r.doc_id, (r.subject or "").strip().lower()) for r in labels.filter("doc_id % 2 = 1").collect()}
    ids = {i for i, _ in held}

    def right(rows):
        got = {(i, s) for i, s in zip(rows.doc_id, rows.subject) if i in ids}
        return len(got & held) / max(1, len(got)), len(got & held) / len(held)

    model, share = right(found[found.probability >= 0.5]), right(found[found.share >= P.QUARTER])
    assert model[0] > 0.93 and model[1] > 0.88 and sum(model) > sum(share)


def test_empty(spark):
    docs, subjects, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([("law", "")], SUBJECTS), spark.createDataFrame([], LABELS)
    assert P.label_documents(docs, subjects, labels).collect() == []
    some = spark.createDataFrame([(1, "s", "The plaintiff met the bailiff.", "guide", None, "x")], DOCS)
    assert P.label_documents(some, subjects.limit(0), labels).collect() == []
