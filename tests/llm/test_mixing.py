import pytest

from skeinflow.llm import mixing as M

TARGETS = "mix_id int, source string, target_share double, max_repeats int, size_ratio double"


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(i, "a" if i % 3 else None, 10 + i % 7) for i in range(3000)] + [(9000 + i, "b", 5) for i in range(10)] + [(9900, "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_prefix_sums_are_exact(sizes):
    rows = M.prefix_sums(sizes, range_rows=100).collect()
    assert len(rows) == sizes.count()
    for s in ("a", "b", None):
        total = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.key, r.doc_id)):
            total += r.tokens
            assert r.upto == total
        assert all(r.whole == total for r in rows if r.source == s)


def test_targets(spark, sizes):
    total = sum(r.tokens for r in sizes.collect())
    targets = spark.createDataFrame([(1, "a", 0.5, 2, 1.0), (1, "b", 0.3, 4, 1.0), (1, None, 0.2, 1, 1.0), (2, "nowhere", 0.5, 3, 0.1), (2, "a", None, 1, 0.1), (3, "b", 100 / total, 3, 1.0)], TARGETS)
    rows = {(r.mix_id, r.source): r for r in M.report(sizes, targets, range_rows=100).collect()}
    assert abs(rows[1, "a"].selected_tokens - 0.5 * total) <= 16 and rows[1, "a"].reachable
    assert rows[1, "b"].selected_tokens == 200 and not rows[1, "b"].reachable and rows[1, "b"].most_repeats == 4
    assert abs(rows[1, None].selected_tokens - 0.2 * total) <= 16
    assert not rows[2, "nowhere"].reachable and rows[2, "nowhere"].selected_tokens == 0
    assert rows[2, "a"].selected_tokens == 0
    assert rows[3, "b"].selected_tokens == 100 and rows[3, "b"].most_repeats == 2
    chosen = M.select_mix(sizes, targets, range_rows=100).collect()
    assert len({(r.mix_id, r.doc_id) for r in chosen}) == len(chosen) and all(r.repeats <= r.cap for r in chosen)


def test_same_selection_for_any_range(spark, sizes):
    targets = spark.createDataFrame([(1, "a", 0.3, 2, 1.0)], TARGETS)
    a, b = ({(r.doc_id, r.repeats) for r in M.select_mix(sizes, targets, range_rows=n).collect()} for n in (50, 10_000))
    assert a == b


def test_empty(spark, sizes):
    targets = spark.createDataFrame([(1, "a", 0.3, 2, 1.0)], TARGETS)
    assert [r.selected_tokens for r in M.report(sizes.limit(0), targets).collect()] == [0]
    assert M.report(sizes, targets.limit(0)).collect() == []


def test_null_texts_count_nothing(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "two words")], "doc_id long, source string, text string")
    assert {r.doc_id: r.tokens for r in M.sized(docs).collect()} == {1: 0, 2: 0, 3: 2}
