from corpusloom.llm import garbled as G


def test_only_texts_that_garble_back_are_restored():
    chain = (("utf-8", "cp1252"),)
    assert G.right(G.wrong("École", chain), chain) == "École"
    assert G.wrong("École", chain) != "Ã\x89cole" and G.right("Ã\x89cole", chain) is None  # that one is of latin-1
    assert G.right("Ã\x89cole", (("utf-8", "latin-1"),)) == "École"


def test_as_many_rounds_as_it_takes():
    clean = ["Die Lösung wird über Nacht geprüft und für später gekühlt.", "Après l’été, la synthèse a été répétée à Genève.", "Größe und Übergänge ändern sich früh."] * 30
    model = G.fit([("de", x) for x in clean])
    for rounds in (1, 2, 3, 4, 5):
        bad = clean[0]
        for _ in range(rounds):
            bad = bad.encode("utf-8").decode("latin-1")
        found, restored, whole, _ = model.document(bad)
        assert found and whole and restored == clean[0], rounds


def test_no_chain_is_left_out(monkeypatch):
    model = G.fit([("de", "Die Lösung wird über Nacht geprüft.")] * 30)
    monkeypatch.setattr(G, "UTF8_ODDS", -1e9)
    assert len(model.ranked("LÃ¶sung")) == len(model.chains)
