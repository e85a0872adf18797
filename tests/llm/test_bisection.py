from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm import bisection as B

OPTIONS = "source_id string, chunk_size int, chunk_overlap int, max_unit_tokens int, use_ast boolean"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r漢é{", min_size=1, max_size=400), st.integers(1, 30), st.integers(0, 40))
def test_pieces_fit_and_give_the_text_back(text, size, overlap):
    cuts = B.split(text, size, overlap)
    assert "".join(text[a:z] for _, a, z in cuts) == text
    assert all(-(-(z - o) // 4) <= size and o <= a < z for o, a, z in cuts)
    assert all(o < a for o, a, _ in cuts[1:]) or overlap == 0 or size == 1 or len(cuts) == 1 or min(overlap * 4, size * 2) < 3


def test_cuts_at_blank_lines():
    text = "\n\n".join("word " * 20 + "end." for _ in range(20))
    cuts = B.split(text, 100, 0)
    assert len(cuts) > 3 and all(text[:a].endswith("\n\n") for _, a, _ in cuts[1:])


def test_cuts_at_places_far_from_the_middle():
    prose, literal = "word " * 80, "x" * 1700
    assert [(a, z) for _, a, z in B.split(prose + literal, 500, 50)] == [(0, 400), (400, 2100)]
    assert [(a, z) for _, a, z in B.split(literal + " " + prose, 500, 50)] == [(0, 1701), (1701, 2101)]


def test_cases(spark):
    chunks = spark.createDataFrame(
        [("a", "s", "x" * 5000, 1), ("a", "s", "x" * 5000, 1), ("b", "s", None, 1), ("c", "s", "", 1), ("d", "t", "y\n" * 90, 1), ("e", None, "z " * 3000, 1)],
        "id string, source_id string, content string, size int",
    )
    options = spark.createDataFrame([("s", None, None, None, None), ("t", 10, 50, 20, False)], OPTIONS)
    rows = B.split_oversized(chunks, options).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {"a", "d", "e"}
    assert all("".join(r.content[r.overlap :] for r in v) == t for k, v in by.items() for t in [{"a": "x" * 5000, "d": "y\n" * 90, "e": "z " * 3000}[k]])
    assert len(by["a"]) == by["a"][0].pieces and all(r.tokens <= 10 for r in by["d"])
    assert B.split_oversized(chunks.limit(0), options.limit(0)).count() == 0
