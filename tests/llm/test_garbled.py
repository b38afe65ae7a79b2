import random

import pytest

from corpusloom.llm import garbled as G

SENTENCES = {
    "de": ["Die Kristalle zeigen eine grünlich-gelbe Färbung und zerfließen an der Luft.", "Für die Prüfung wird Säure über Stunden erwärmt.", "Größere Mengen löst man in heißem Öl."],
    "fr": ["Les propriétés mécaniques dépendent de la pureté.", "La synthèse part d’un mélange chauffé à reflux.", "Il se dissout très peu dans l’eau, même tiède."],
    "ru": ["Кристаллы темнеют на свету и плохо растворимы.", "Вещество плавится при нагревании до 80 °C.", "Применяется при окраске тканей и варке стекла."],
    "zh": ["晶体在潮湿的空气中会慢慢变暗。", "它主要用于玻璃抛光和水处理。", "产率通常高于百分之八十。"],
    "pt": ["Labels read “MAÇÃ – NÃO TOCAR” on the crates.", "NÃO É SOLÚVEL EM ÁGUA FRIA, MAS A REAÇÃO É RÁPIDA.", "São conhecidas três formas; a mais estável é âmbar."],
    "en": ["It melts at 80 °C and smells “burnt” to most.", "The cell edge is 5.1 Å, couldn’t be right.", "The sign Ð means a debt, and þ a payment."],
}
CASES = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1251"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1251", "koi8-r"),), (("cp1252", "mac_roman"),), (("gb18030", "latin-1"),)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(6)
    sample = [(lang, " ".join(rng.choice(s) for _ in range(4))) for lang, s in SENTENCES.items() for _ in range(60)]
    return G.fit(sample)


def test_round_trip(model):
    tried = restored = 0
    for sentences in SENTENCES.values():
        text = sentences[0] + "\n" + sentences[1]
        for chain in CASES:
            bad = G.wrong(text, chain)
            if bad is None or bad == text or "\ufffd" in bad:
                continue
            tried += 1
            hit, out, whole, chains = model.document(bad)
            assert hit, (chain, bad)
            restored += out == text and whole
    assert tried > 15 and restored >= 0.9 * tried


def test_clean_texts_stay(model):
    for sentences in SENTENCES.values():
        for s in sentences:
            assert model.document(s) == (False, None, False, [])
    for text in (None, "", "plain ASCII", "MAÇÃ – NÃO TOCAR", "सरल यौगिक", "مركب بسيط", "🧪⚗️"):
        assert model.document(text)[0] is False


def test_one_passage_and_lost_bytes(model):
    a, b = SENTENCES["fr"][:2]
    mixed = a + "\n" + G.wrong(b, (("utf-8", "cp1252"),)) + "\n" + a
    assert model.document(mixed)[:3] == (True, a + "\n" + b + "\n" + a, True)
    hit, out, whole, _ = model.document(a + "\nbent by 21\ufffd\ufffd now")
    assert hit and not whole and out == a + "\nbent by 21\ufffd\ufffd now"


def test_inverse_is_strict():
    chain = (("utf-8", "cp1252"),)
    assert G.right("NÃO", chain) is None and G.right("plain", chain) is None and G.right("Ã©", chain) == "é"


def test_table(spark):
    good = [(i, SENTENCES["de"][i % 3], "de", "x") for i in range(200)]
    bad = G.wrong(SENTENCES["de"][0], (("utf-8", "cp1252"),))
    rows = spark.createDataFrame([*good, (900, bad, None, "x"), (900, bad, None, "x"), (901, None, "de", "x"), (902, "", "de", "x"), (None, bad, "de", "x")], "doc_id bigint, text string, lang string, restored string")
    got = G.detect(rows).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 900, 900] and all(r.restored == SENTENCES["de"][0] and r.complete for r in got)
    assert G.detect(rows.limit(0)).count() == 0
