import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import splitting as s

TEXT = st.text(alphabet=st.sampled_from(list("ab c.\n。é漢😀")), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(20, 60), st.integers(0, 12), st.sampled_from(["chars", "bytes"]))
def test_pieces_cover_fit_and_overlap(text, most, overlap, unit):
    size = len if unit == "chars" else (lambda x: len(x.encode()))
    out = s.split(text, most, overlap, unit)
    assert all(size(text[a:b]) <= most for a, b in out)
    assert (out == []) == (text == "")
    if out:
        assert out[0][0] == 0 and out[-1][1] == len(text)
    for (_, end), (start, stop) in zip(out, out[1:]):
        shared = size(text[start:end])
        assert stop > end and overlap - 3 * (unit == "bytes") <= shared <= overlap
    if size(text) <= most and text:
        assert out == [(0, len(text))]


def test_cuts_at_paragraphs_where_they_fit():
    text = "one two three.\n\nfour five six.\n\nseven eight nine."
    assert [text[a:b] for a, b in s.split(text, 20, 0)] == ["one two three.\n\n", "four five six.\n\n", "seven eight nine."]


def test_bad_limits():
    with pytest.raises(ValueError):
        s.split("abc", 5, 5)


def test_table(spark):
    items = spark.createDataFrame([("m", "1", "f", "x" * 30, "k"), ("m", "1", "f", "x" * 30, "k"), ("m", "2", "f", "x" * 10, "k"), ("m", "3", "f", None, "k"), ("m", "4", "f", "", "k")], "table_name string, record_id string, field_name string, text string, unit string")
    limits = spark.createDataFrame([("m", "f", "chars", 10, 2)], "table_name string, field_name string, unit string, max_size long, overlap_size long")
    got = s.pieces(items.drop("unit"), limits).collect()
    assert {r["record_id"] for r in got} == {"1"} and max(r["size"] for r in got) <= 10
    assert s.pieces(items.drop("unit").limit(0), limits).count() == 0
