import random

from mnemora.llm import leakage as l


def _norm(t):
    import unicodedata

    return "".join(c for c in t.lower() if unicodedata.category(c)[0] in "LN")


def test_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé漢字0") for _ in range(rnd.randint(1, 9)))
    items = [(i, " ".join(word() for _ in range(40)), word(), " ".join(word() for _ in range(30))) for i in range(12)]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(30))
        if d % 2:
            source = rnd.choice(rnd.choice(items)[1:])
            a = rnd.randint(0, max(0, len(source) - 40))
            text += "-- " + source[a : a + rnd.randint(30, 120)].upper().replace(" ", "*  ") + " " + word()
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    got = {(r["doc_id"], r["item_id"]) for r in l.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string, evidence string")).collect()}
    want = set()
    for d, t in docs:
        n = _norm(t or "")
        for i, *parts in items:
            for p in map(_norm, parts):
                if any(p[k : k + 50] in n for k in range(len(p) - 49)):
                    want.add((d, i))
    assert got == want and len(want) > 10


def test_every_run_is_found_and_removed(spark):
    q = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(200))
    text = f"Start. {q[:60]}! And then, {q[100:180].upper()}? The end."
    docs = spark.createDataFrame([(1, text), (1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, q, None, q[110:170])], "item_id long, question string, answer string, evidence string")
    spans = sorted((r["start_at"], r["end_at"]) for r in l.leaks(docs, items).collect())
    assert [text[a:b].lower() for a, b in spans if b - a in (60, 80)] == [q[:60], q[100:180], q[110:170]]
    (row,) = l.without_spans(docs, items).collect()
    assert (row["doc_id"], row["n_removed"], row["text"]) == (1, 140, "Start. ! And then, ? The end.")


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([], "item_id long, question string, answer string, evidence string")
    assert l.leaks(d, e).count() == 0 and l.without_spans(d, e).count() == 0
    assert l.without_leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), l.leaks(d, e)).count() == 1
