import random
import re

import pytest

from corpusloom.llm import splitting as S

LIMITS = [("*", 50, 5), ("uses", 30, 0), (None, 10, 1)]


def rows_of(spark, texts):
    return spark.createDataFrame([(f"k{i}", "t", s, x) for i, (s, x) in enumerate(texts)] + [("k0", "t", *texts[0])], "_id string, title string, section string, text string")


def limits_of(spark):
    return spark.createDataFrame(LIMITS, "section string, max_chars int, overlap_chars int")


@pytest.mark.parametrize("range_chars", [16, 1 << 16])
def test_pieces(spark, monkeypatch, range_chars):
    monkeypatch.setattr(S, "RANGE_CHARS", range_chars)
    rng = random.Random(4)
    words = ["a", "bb", "longer", "word.", "é𝛼", "x" * 70, "它主要。", "\n", "\n\n", "   "]
    texts = [(rng.choice([None, " USES ", "other"]), " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))) for _ in range(25)]
    texts += [(None, None), (None, ""), ("uses", "y" * 31), (None, "z" * 50), (None, "z" * 51), (None, " " * 120)]
    pieces = S.split(rows_of(spark, texts), limits_of(spark)).collect()
    by = {}
    for p in pieces:
        by.setdefault(p._1 if False else p["_id"], []).append(p)
    for i, (section, text) in enumerate(texts):
        limit, overlap = (30, 0) if (section or "").strip().lower() == "uses" else (50, 5)
        got = sorted(by.get(f"k{i}", []), key=lambda p: p.piece_no)
        if text is None or len(text) <= limit:
            assert not got
            continue
        assert all(len(p.piece) <= limit and text[p.start : p.end] == p.piece for p in got)
        assert got[0].start == 0 and got[-1].end == len(text)
        for a, b in zip(got, got[1:]):
            assert a.end - b.start == overlap
            if not a.forced:
                assert text[a.end - 1].isspace() or text[a.end : a.end + 1].isspace() or text[a.end - 1] in "。！？"
            else:
                assert not re.search(r"\s|[。！？].", text[a.start + overlap : a.end])


def test_found_by_brute_force(spark):
    texts = [(None, "w" * 51), (None, "w " * 40), ("uses", "词" * 29 + "。" + "词" * 30), ("uses", "词" * 30 + "。"), (None, None), (None, "ok")]
    rows = S.found(rows_of(spark, texts), limits_of(spark)).collect()
    want = set()
    for i, (section, text) in enumerate(texts):
        limit = 30 if section == "uses" else 50
        if text and len(text) > limit:
            want.add((f"k{i}", "oversize"))
            if max(map(len, re.split(r"\s+", re.sub("([。！？])", r"\1 ", text)))) > limit:
                want.add((f"k{i}", "forced"))
    assert {(r.corpus_id, r.kind) for r in rows} == want and len(rows) == len(want)


def test_empty_and_without_limits(spark):
    rows = rows_of(spark, [(None, "x" * 99)])
    assert S.found(rows.limit(0), limits_of(spark)).count() == 0
    assert S.found(rows, limits_of(spark).limit(0)).count() == 0


def test_files(spark, tmp_path):
    text = "".join(f"Satz {i} mit Wörtern。 und mehr\n" for i in range(400))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    pieces = S.split_files(spark, [str(path)], 300, 20, range_bytes=1000).orderBy("piece_no").collect()
    data = text.encode()
    assert pieces[0].start == 0 and pieces[-1].end == len(data) and all(p.end - p.start <= 300 for p in pieces)
    assert all(a.end - b.start == 20 for a, b in zip(pieces, pieces[1:])) and not any(p.forced for p in pieces)
