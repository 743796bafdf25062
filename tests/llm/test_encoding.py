import pytest

from mnemora.llm import encoding as e

CLEAN = [
    ("fr", "La bibliothécaire a vérifié l’horaire du pain, parce que nous étions en retard."),
    ("de", "Der Bäcker überprüfte die Leseliste und erklärte danach das Rezept für Linsensuppe."),
    ("es", "Mi hermano aplazó la lista de acampada para la próxima estación, ¿verdad?"),
    ("pt", "A bibliotecária comparou as configurações do inquilino, não é? NÃO APAGAR A ANOTAÇÃO."),
    ("ru", "Архивариус забыл расписание выпечки, потому что мы опаздывали."),
    ("zh", "如果评审同事再问起合并报告，就告诉对方这属于项目，然后又重命名了阅读书单。"),
    ("ja", "できるだけ早く読書リストを確認したいと思っています。"),
    ("en", "The café’s menu wasn’t ready — “tomorrow”, they said. 21 °C, £12"),
]


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("gbk", "latin-1"), ("koi8-r", "cp1251"), ("utf-8", "cp1252", "utf-8", "cp1252")])
def test_round_trip(chain):
    done = 0
    for _, x in CLEAN:
        g = e.garble(x, chain)
        if g is not None and g != x:
            assert e.ungarble(g, chain) == x
            done += 1
    assert done


def test_documents(spark):
    rows = [(i, x, lang) for i, (lang, x) in enumerate(CLEAN * 12)]
    bad = {1000: e.garble(CLEAN[0][1], ("utf-8", "cp1252")), 1001: e.garble(CLEAN[5][1], ("utf-8", "latin-1")), 1002: e.garble(CLEAN[4][1], ("cp1251", "latin-1")), 1003: "ein Bröt�hen, f�r", 1004: " \ufffd ".join([e.garble(CLEAN[0][1], ("utf-8", "cp1252"))] * 2)}
    rows += [(k, "plain line\n" + x if k < 1003 else x, None) for k, x in bad.items()] + [(2000, None, "en"), (2001, "", "en"), (2002, "ascii only", "en")]
    got = {r["doc_id"]: r for r in e.garbled(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(got) == set(bad)
    assert got[1000]["text"] == "plain line\n" + CLEAN[0][1] and got[1001]["text"].endswith(CLEAN[5][1])
    assert got[1003]["n_lost"] == 1
    assert got[1004]["n_lost"] == 1 and got[1004]["text"] == CLEAN[0][1] + " \ufffd " + CLEAN[0][1]  # what stands beside the loss is restored


def test_empty(spark):
    assert e.garbled(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
