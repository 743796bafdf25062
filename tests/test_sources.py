import json

from pyspark.sql import functions as F

from mnemora.operators import extraction
from mnemora.sources import files


def test_workspace_and_migration(spark, tmp_path):
    (tmp_path / "user" / "u1").mkdir(parents=True)
    (tmp_path / "user" / "u1" / "pref_1.md").write_text("Likes tea. é", encoding="utf-8")
    (tmp_path / "user" / "u1" / ".abstract.md").write_text("sum")
    df = files.workspace(spark, str(tmp_path))
    assert {(r["uri"], r["text"]) for r in df.collect()} == {("mem://user/u1/pref_1.md", "Likes tea. é")}
    assert [r["id"] for r in files.migrated(df).collect()] == ["pref_1"]


def test_index_json_and_parquet(spark, tmp_path):
    entry = {"id": "pref_001", "file": "preferences/pref_001.md", "memory_type": "preference", "key": "language", "content_hash": "abc", "source_sessions": ["s"], "confidence": 0.9, "content_summary": "x"}
    (tmp_path / "a.json").write_text(json.dumps({"scope": "user", "owner_id": "u", "memories": {"pref_001": entry}}))
    (tmp_path / "b.json").write_text("{broken")
    df = files.read_index(spark, str(tmp_path / "*.json"))
    row = df.collect()
    assert len(row) == 1 and row[0]["key"] == "language" and row[0]["access_count"] == 0 and row[0]["archived"] is False
    files.write_index(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("scope = 'user' AND key = 'language'").count() == 1
    assert df.where("key = 'none'").count() == 0


def test_evaluation_files(spark, tmp_path):
    sample = [{"sample_id": "c1", "conversation": {"speaker_a": "Al", "session_10": [{"speaker": "Al", "text": "late"}], "session_2": [{"speaker": "Bo", "text": "early", "blip_caption": "a cat"}]}, "qa": [{"question": "q", "answer": "a", "category": 1}, {"question": "x", "answer": "y", "category": 5}]}]
    (tmp_path / "s.json").write_text(json.dumps(sample))
    assert [(r["session_no"], r["text"]) for r in files.dialogues(spark, str(tmp_path / "s.json")).collect()] == [(2, "Bo: early [image: a cat]"), (10, "Al: late")]
    assert files.questions(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "t.txt").write_text("hello\n---\neval: why?\n---\n\n")
    assert [(r["kind"], r["text"]) for r in files.plain_cases(spark, str(tmp_path / "t.txt")).orderBy("block_no").collect()] == [("message", "hello"), ("eval", "why?")]
    g = {"question": "q", "category": 1, "grade": True, "time_cost": 1.5, "token_usage": {"total_tokens": 7}}
    (tmp_path / "a.jsonl").write_text(json.dumps(g) + "\n" + json.dumps(g) + "\n")
    (tmp_path / "a.json").write_text(json.dumps([g]))
    assert files.answers(spark, str(tmp_path / "a.jsonl")).count() == 2 and files.answers(spark, str(tmp_path / "a.json")).first()["tokens"] == 7


def test_extraction(spark):
    full = json.dumps({"preferences": [{"topic": " Tea ", "preference": "green", "confidence": 0.7}], "entities": [{"name": "Ada", "description": "x"}, {"name": "", "description": "y"}]})
    rows = [("s1", full), ("s2", "Here it is:\n" + full + "\nDone."), ("s3", "not json"), ("s4", ""), ("s5", None), ("s6", "{}")]
    got = {(r["session"], r["memory_type"], r["key_name"], r["confidence"]) for r in extraction.flattened(spark.createDataFrame(rows, "session string, response string")).collect()}
    assert got == {(s, k, n, c) for s in ("s1", "s2") for k, n, c in (("preference", "tea", 0.7), ("entity", "ada", 0.9))}
    one = spark.createDataFrame([("s", "Ada met Grace Hopper. Later more.")], "session string, text string").select("session", extraction.default_extractor(F.col("text")).alias("response"))
    assert {r["key_name"] for r in extraction.flattened(one).collect()} == {"grace", "hopper", "later"}


def test_ids(spark):
    df = spark.createDataFrame([("u", "L0"), ("u", "L1"), ("u", "L2"), ("v", "L2")], "uri string, layer string")
    ids = [r[0] for r in df.select(extraction.vector_id(F.col("uri"), F.col("layer"))).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 32 for i in ids)
