from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import packing as p


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200))
def test_every_item_once_within_capacity(sizes):
    out = p.pack(sizes, 50)
    assert sorted(i for b in out for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in out)
    # At most one bin is half empty, else two would have been one.
    assert sum(2 * sum(sizes[i] for i in b) <= 50 for b in out) <= 1 or len(out) <= 1


def test_two_fit_beats_greedy():
    # Greedy gives 6 + 3 of 10; the 3 gives way to 2 + 2.
    assert sorted(map(len, p.pack([6, 3, 2, 2], 10))) == [1, 3]


def test_documents(spark):
    rows = [(1, "word " * 5000, "x"), (2, "short", "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x")]
    got = p.bins(spark.createDataFrame(rows, "doc_id long, text string, bin_id string"), 2048).collect()
    assert {(r["doc_id"]) for r in got} == {1, 2, 4}
    parts = sorted((r["part_no"], r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == 1)
    assert [s for _, s, _ in parts] == [2048 * k for k in range(len(parts))] and all(n <= 2048 for *_, n in parts)
    assert p.bins(spark.createDataFrame([], "doc_id long, text string"), 2048).count() == 0
