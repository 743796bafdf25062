import pytest

from mnemora.llm import privacy as p


def _kinds(text, lexicon=None):
    return {k for _, _, k in p.find(text, lexicon or p.Lexicon())}


def test_forms():
    assert _kinds("write to jo.doe@mail.example.test today") == {"email"}
    assert _kinds("jo (at) mail.example.test or jo at mail dot example dot test") == {"email"}
    assert _kinds("mobile +44 7700 900156") == {"phone"}
    assert _kinds("ring (744) 555 0163 now") == {"phone"}
    assert _kinds("it is 922-81-0305.") == {"id_number"}
    assert _kinds("NINO: QQ 16 84 45 A") == {"id_number"}
    assert _kinds("I live at Flat 14, 341 Marrow Hill Court, Haven ZZ9 2ZZ.") == {"address"}
    assert _kinds("Livraison : 427 rue des Genêts, 00835 Furt") == {"address"}
    assert _kinds("我住在槐荫街267号10栋592室。") == {"address"}
    assert _kinds("東京都渋谷区神南1丁目2番3号") == {"address"}


def test_no_cases():
    for text in ("order 4700-511-377", "lot 98671", "203.0.113.106", "2025-05-20 12:46:51", "5fb17648-d51d-46a8-fd2d-5d7be89d278b", "1,235,752 tokens", "@some-bot", "we met at least 19 on the way", "sha 51a7c50cd8028b6b", ""):
        assert _kinds(text) == set(), text


def test_bootstrap_finds_streets_of_unseen_kinds(spark):
    """Streets with a postcode teach what stands before a street and what kinds there are; none of the kinds sought is among them."""
    seeds = {
        "I live at {n} {s} Street, Leeds LS{d} 4AB.": "Marrow Hill|Ferry|Old Tannery|Kestrel|Pepperwood|Lantern",
        "Please deliver to {n} {s} Road, Hull HU{d} 2XY.": "Saltmarsh|Juniper|Ash|Kestrel Hollow|Lantern|Ferry",
        "Abito in Corso {s} {n}, 1012{d} Torino.": "Garibaldi|Dante|Cavour|Mazzini|Marconi|Volta",
        "Ich wohne in der {s}strasse {n}, 2009{d} Hamburg.": "Tuchmacher|Eschen|Linden|Mühlen|Rosen|Gerber",
        "Я живу на улице {s}, дом {n}, 10100{d} Москва.": "Пушкина|Гоголя|Чехова|Толстого|Герцена|Некрасова",
        "我住在{s}街{n}号{d}栋30{d}室。": "槐荫|青石|稻香|望槐|柳浦|长安",
    }
    rows = [(f"{k}-{i}-{d}", form.format(n=11 + 7 * i + d, s=s, d=d + 1)) for k, (form, names) in enumerate(seeds.items()) for i, s in enumerate(names.split("|")) for d in range(2)]
    rows += [(f"n{i}", f"There are {i} Notes in the list. Ich habe {i} Tassen.") for i in range(60)]
    unseen = {
        "a": "I live at 14 Kingfisher Gardens, Leeds",
        "b": "Please deliver to 221B Baker Mews. Thanks",
        "c": "Abito in Via Roma 12, Torino",
        "d": "Ich wohne in der Lange Reihe 14",
        "e": "Я живу на улице Ленина, дом 5",
        "f": "住所は東京都渋谷区神南1丁目2番3号です",
        "g": "it stands at 9 kestrel road, unlit",
    }
    got = {r["message_id"]: r for r in p.masked(spark.createDataFrame(rows + list(unseen.items()), "id string, content string")).collect()}
    assert {k for k in unseen if k in got and got[k]["kinds"] == ["address"]} == set(unseen)
    assert got["a"]["text"] == "I live at [ADDRESS]" and got["b"]["text"].startswith("Please deliver to [ADDRESS]")
    assert not any(k.startswith("n") for k in got)


def test_names_in_other_alphabets(spark):
    rows = [x for i, n in enumerate(["Иван", "Ольга", "Пётр", "Анна"] * 20) for x in ((f"e{i}", f"Ответ: {n} Орлов <a{i}@mail.example.test>"), (f"t{i}", f"Добрый день, меня зовут {n}. Пишу снова."))]
    rows += [("new", "Добрый день, меня зовут Глеб. Пишу снова."), ("none", "Добрый день, Москва")]
    got = {r["message_id"]: r["text"] for r in p.masked(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got["new"] == "Добрый день, меня зовут [NAME]. Пишу снова." and got["t0"].startswith("Добрый день, меня зовут [NAME]") and "none" not in got


def test_more_than_can_be_broadcast_is_refused(spark, monkeypatch):
    monkeypatch.setattr(p, "MOST_NAMES", 1)
    rows = [(f"e{i}{n}", f"{n.title()} wrote to {n}@mail.example.test") for i in range(3) for n in ("imogen", "petra", "dorian")]
    with pytest.raises(ValueError, match="names"):
        p.masked(spark.createDataFrame(rows, "id string, content string"))


def test_bootstrap_finds_names_and_bare_numbers(spark):
    names = ["Imogen", "Petra", "Dorian", "Sadie", "Felix", "Owen", "Tessa", "Maren"]
    rows = []
    for i in range(240):
        n = names[i % 8]
        rows += [
            (f"e{i}", f"Contact: {n.lower()}.stone{i}@mail.example.test please"),
            (f"t{i}", f"We met. My name is {n} Stone. The weather was fine."),
            (f"p{i}", f"Ring +44 7700 900{i:03d}, then hang up."),
            (f"q{i}", f"The index was ready. There are {i} notes about the garden."),
        ]
    rows += [("new", "My name is Quentin Stone. Bye."), ("alone", "It was Petra who lost it."), ("bare", "Ring 0123 456 78, then hang up."), ("null", None), ("empty", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "id string, content string, text string")
    got = {r["message_id"]: r for r in p.masked(df).collect()}
    assert got["t0"]["kinds"] == ["name"] and got["t0"]["text"] == "We met. My name is [NAME]. The weather was fine."
    assert got["alone"]["text"] == "It was [NAME] who lost it."
    assert got["e0"]["kinds"] == ["email"] and got["bare"]["kinds"] == ["phone"]
    assert not any(k.startswith("q") for k in got) and "null" not in got and "empty" not in got


def test_unseen_name_after_one_certain_pattern(spark):
    names = ["Imogen", "Petra", "Dorian", "Sadie", "Felix", "Owen", "Tessa", "Maren"]
    rows = [x for i in range(80) for x in ((f"e{i}", f"Contact: {names[i % 8].lower()}.stone{i}@mail.example.test please"), (f"t{i}", f"We met. My name is {names[i % 8]} Stone. Fine."))]
    rows += [("new", "My name is Quentin Stone. Bye."), ("none", "The index is Ready.")]
    got = {r["message_id"]: r["text"] for r in p.masked(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got["new"] == "My name is [NAME]. Bye." and "none" not in got


def test_a_word_mostly_written_small_is_no_name(spark):
    rows = [("e", "Write to notes@mail.example.test please"), ("c", "See NOTES here"), *((f"s{i}", f"see notes {i} here") for i in range(30))]
    df = spark.createDataFrame(rows, "id string, content string").coalesce(1)  # both forms in one batch
    assert {r["message_id"] for r in p.masked(df).collect()} == {"e"}


def test_empty(spark):
    assert p.masked(spark.createDataFrame([], "id string, content string")).count() == 0
