"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from mnemora.plans import catalogue


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return None
    if isinstance(v, pd.Timestamp):
        return (v.tz_convert("UTC").tz_localize(None) if v.tzinfo else v).isoformat()
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 5)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, zip(*[[_plain(v) for v in df[c].astype(object)] for c in cols], strict=True)))


@pytest.fixture(scope="module")
def duck(sf001):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf001):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf001}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, sf001, name):
    got = entry.queries()[name](spark, sf001).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_are_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"debounce_capped", "layer_rebuild"}


@pytest.mark.parametrize("name", ["hybrid_search", "lexical_scan"])
def test_keyword_searches_join_no_words(spark, sf001, name):
    # Such a join listed every pair of a query and a file that share a word.
    assert "Join [word#" not in entry.queries()[name](spark, sf001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["access_events", "hybrid_search", "lexical_scan"])
def test_keyword_searches_of_odd_rows_equal_sql(spark, tmp_path, name):
    words = "Alpha bravo charlie delta echo foxtrot golf hotel india".split()
    texts = [None, "", "alpha", "ALPHA bravo", " ".join(words), "Straße C++ ÉTÉ c#", *(" ".join(words[: n % 9]) + f" rare{n}" for n in range(40))]
    memories = pd.DataFrame([(f"m{i}", f"mem://user/u{i % 3}/{'entities/' * (i % 2)}{i % 41}.md", t) for i, t in enumerate(texts)] + [("x", None, "alpha"), ("y", "mem://user", "alpha bravo charlie"), ("z", "Ä", "rare1")], columns=["id", "uri", "content"])
    asked = [("a", "alpha BRAVO"), ("a", "alpha bravo Charlie"), ("a", "alpha BRAVO"), ("b", " ".join(words) * 2), ("b2", " ".join(words)), ("c", "été straße c++ c#"), ("d", ""), ("e", None), ("f", "nothing"), ("g", "rare7 rare8, rare7 golf"), ("h", "India? rare39")]
    intents = pd.DataFrame(asked, columns=["query_id", "original_query"])
    for n, df in (("memories", memories), ("query_intents", intents)):
        df.to_parquet(tmp_path / f"{n}.parquet")
    c = duckdb.connect()
    for n in ("memories", "query_intents"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tmp_path}/{n}.parquet')")
    want = _rows(c.execute(entry.oracle_sql()[name]).df())
    assert want and _rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == want


def test_hybrid_search_shuffles_no_whole_text_for_the_rerank(spark, sf001):
    # Its plan read every text again, told all rows apart by it, and lowered the snippet anew for each word.
    plan = entry.queries()["hybrid_search"](spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert "max(substring(content#" in plan and "max(content#" not in plan
    assert "Contains(lower(" not in plan


def test_hybrid_search_of_files_with_several_texts_equals_sql(spark, tmp_path):
    same = "Alpha " + "é" * 194  # 200 characters, more bytes
    texts = {"a": ["alpha bravo", "alpha charlie", None], "b": [same + " bravo", same + " charlie", same], "c": ["alpha \U0001f600 bravo", "alpha ～ charlie"], "d": ["", "Alpha"], "e": [same[:-1] + "ê", same + "z Charlie"]}
    rows = [(f"{k}{i}", f"mem://user/u/{'entities/' if k == 'c' else ''}{k}.md", t) for k, some in texts.items() for i, t in enumerate(some)]
    pd.DataFrame([*rows, *rows[:4]], columns=["id", "uri", "content"]).to_parquet(tmp_path / "memories.parquet")
    pd.DataFrame([("p", "Alpha Bravo"), ("q", "charlie, Alpha?"), ("q", "ALPHA charlie"), ("r", "É Charlie")], columns=["query_id", "original_query"]).to_parquet(tmp_path / "query_intents.parquet")
    c = duckdb.connect()
    for n in ("memories", "query_intents"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tmp_path}/{n}.parquet')")
    want = _rows(c.execute(entry.oracle_sql()["hybrid_search"]).df())
    assert len(want) > 10 and _rows(entry.queries()["hybrid_search"](spark, str(tmp_path)).toPandas()) == want
