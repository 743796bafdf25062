from mnemora.llm import language as l
from mnemora.sources.tables import table

RECORDS = "table_name string, record_id string, content string, label string, lang string"


def test_held_out_accuracy_and_edges(spark, sf01):
    documents = table(spark, sf01, "documents")
    labelled = l.training_sentences(documents)
    train, test = [x for i, x in enumerate(labelled) if i % 5], [x for i, x in enumerate(labelled) if i % 5 == 0]
    model = l.fit(train)
    hits = 0
    for k in range(0, len(test), 200):
        for r, _, found in l.assign([x for _, x in test[k : k + 200]], model):
            hits += found[0][2] == test[k + r][0]
    assert hits >= 0.98 * len(test)

    rows = [
        ("m", "right", "The planning agent finished the reading list before lunch.", "en"),
        ("m", "wrong", "Der Bäcker überprüfte die Leseliste für den Vermieter.", "en"),
        ("m", "plain", "Der Backer uberprufte die Leseliste fur den Vermieter.", "de"),
        ("m", "missing", "Мой брат забыл расписание выпечки, потому что мы опаздывали.", None),
        ("m", "mixed", "The archive service lost the invoice folder. 我们把阅读书单搬到了新的地方，所以房东没有再检查它。", "en"),
        ("m", "upper", "THE PLANNING AGENT FINISHED THE READING LIST BEFORE LUNCH.", "en"),
        ("m", "none1", "https://docs.example.test/guide/page", "fr"),
        ("m", "none2", "", None),
        ("m", "none3", None, None),
        ("m", "none4", '{"ok": true, "n": 89}', "zh"),
        ("m", "none5", "👍", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:2]], RECORDS)
    aliases = spark.createDataFrame([("en", "en"), ("de", "de"), ("fr", "fr"), ("zh", "zh")], "alias string, lang string")
    got = {(r["record_id"], r["lang"]) for r in l.mislabelled(l.detect(df, documents), aliases).collect()}
    short = {r["record_id"]: r["segments"] for r in l.detect(spark.createDataFrame([("m", "a", "der Bäcker", None, ""), ("m", "b", "123", None, "")], RECORDS), documents).collect()}
    assert [x["lang"] for x in short["a"]] == ["de"] and short["a"][0]["confidence"] <= 0.5 and short["b"] == []
    assert got == {("wrong", "de"), ("missing", "ru"), ("mixed", "en"), ("mixed", "zh")}


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    r = spark.createDataFrame([("m", "1", "Some text here.", "en")], "table_name string, record_id string, content string, label string")
    assert l.detect(r, d).first()["langs"] == []
