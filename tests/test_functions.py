import pytest
from pyspark.sql import functions as F

from mnemora.functions import text as t
from mnemora.functions import uri as u
from mnemora.functions.vectors import cosine


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "uri,want",
    [
        ("mem://user/u1/events/e.md", ("user", "u1", "events", "e.md")),
        ("mem://user/u1/profile.md", ("user", "u1", None, "profile.md")),
        ("mem://user/u1/events", ("user", "u1", "events", None)),
        ("mem://session/s/timeline/2025-01/02/x.md?a=1", ("session", "s", "timeline", "2025-01/02/x.md")),
        ("mem://user", ("user", None, None, None)),
        ("no uri", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_parse(spark, uri, want):
    assert tuple(_one(spark, uri, u.parse)) == want


def test_uri_parts(spark):
    assert _one(spark, "mem://user/test/path/file.md", u.parent) == "mem://user/test/path"
    assert _one(spark, "mem://user/file.md", u.parent) == "mem://user"
    assert _one(spark, "mem://user/a/b.md", u.ancestors) == ["mem://user", "mem://user/a"]
    assert _one(spark, "mem://user", u.ancestors) == []
    assert _one(spark, "mem://user/a/.abstract.md", u.canonical) == "mem://user/a"
    assert _one(spark, "mem://user/a/b.md", lambda c: u.layer(c, "L0")) == "mem://user/a/.abstract.md"
    assert _one(spark, "mem://user/a", lambda c: u.layer(c, "L1")) == "mem://user/a/.overview.md"
    assert tuple(_one(spark, "mem://user/u1/events/e1.md", u.owner)) == ("user", "u1", "e1")
    assert _one(spark, "mem://user/u1", u.owner) is None
    assert _one(spark, "x://y?a=1&b&c=2&a=3", u.params) == {"a": "3", "c": "2"}
    assert not _one(spark, "mem://other/x", u.is_valid) and _one(spark, "mem://agent/x", u.is_valid)


@pytest.mark.parametrize("scope,want", [(None, "mem://session"), ("abc", "mem://session/abc"), ("/abc", "mem://session/abc"), ("old://threads/t1", "mem://session/t1"), ("old://user/u", "mem://user/u"), ("old://x/y", "mem://session")])
def test_scope(spark, scope, want):
    assert _one(spark, scope, u.normal_scope) == want


def test_keywords_and_intent(spark):
    q = "When was the C++ rent-agreement moved to Zürich, and WHO asked?"
    assert _one(spark, q, t.keywords) == ["agreement", "and", "asked", "c++", "moved", "rent", "the", "was", "zürich"]
    assert _one(spark, q, t.entities) == ["C", "WHO", "When", "Zürich"] or "Zürich" in _one(spark, q, t.entities)
    assert _one(spark, q, t.intent) == "temporal"
    assert _one(spark, "without doubt", t.intent) == "relational"  # a substring test
    assert _one(spark, "tea", t.intent) == "factual"


def test_snippet(spark):
    body = "a" * 150 + "NEEDLE" + "b" * 150
    assert _one(spark, body, lambda c: t.snippet(c, F.lit("needle"))) == "..." + "a" * 100 + "NEEDLE" + "b" * 100
    assert _one(spark, "x" * 250, lambda c: t.snippet(c, F.lit("none"))) == "x" * 200 + "..."
    assert _one(spark, "short", lambda c: t.snippet(c, F.lit(""))) == "short"


def test_limits_and_summary(spark):
    assert _one(spark, "One. " * 600, t.limited_abstract).endswith("One.")
    assert len(_one(spark, "x" * 3000, t.limited_abstract)) == 2000
    assert "Title" in _one(spark, "# Title\n\nMain.\n\n**Added**: 2024", t.content_summary) and "Added" not in _one(spark, "# T\n**Added**: x", t.content_summary)
    assert _one(spark, "é漢", t.token_estimate) == 1
    assert _one(spark, " a  b\n c ", t.token_count) == 3


def test_word_similarity(spark):
    df = spark.createDataFrame([("a b c", "A c d"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(t.word_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]
