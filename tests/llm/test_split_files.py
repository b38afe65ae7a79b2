import random

import pytest

from corpusloom.llm import splitting as S


def pieces_of(spark, path, text, *args):
    path.write_bytes(text.encode())
    return S.split_files(spark, [str(path)], *args, range_bytes=100).orderBy("piece_no").collect()


@pytest.mark.parametrize("limit", [10, 11, 2])
def test_forced_cuts_keep_all_characters(spark, tmp_path, limit):
    text = "水素酸化物é𝛼" * 15 + "a"
    got = pieces_of(spark, tmp_path / "cjk.txt", text, limit, 0)
    assert "".join(p.piece for p in got) == text and all(a.end == b.start for a, b in zip(got, got[1:]))
    assert all(p.end - p.start <= limit or len(p.piece) == 1 for p in got)


def test_overlaps_start_at_characters(spark, tmp_path):
    text = "水素酸化物é𝛼" * 15
    data = text.encode()
    got = pieces_of(spark, tmp_path / "cjk.txt", text, 20, 4)
    assert got[0].start == 0 and got[-1].end == len(data) and all(data[p.start : p.end].decode() == p.piece for p in got)
    assert all(4 <= a.end - b.start < 8 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("space", ["\u00a0", "\u3000", "\u2009", "\x0b"])
def test_all_white_space_is_a_boundary(spark, tmp_path, space):
    got = pieces_of(spark, tmp_path / "space.txt", ("水素" + space) * 30, 20, 0)
    assert not any(p.forced for p in got)


def test_bytes_and_texts_have_the_same_boundaries():
    rng = random.Random(5)
    signs = ["a", "é", "水", "𝛼", " ", "\u00a0", "\u3000", "\n", "\r", ".", "!", "”", ")", "。", "？"]
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(30))
        at, kind = S.boundaries(text, 0, len(text))
        assert S.byte_boundaries(text.encode(), 0, len(text.encode())) == ([len(text[:p].encode()) for p in at], kind)


@pytest.mark.parametrize("range_bytes", [1, 7, 64])
def test_ranges_do_not_matter(spark, tmp_path, range_bytes):
    """Runs of white space and of sentence marks that are longer than a range keep their kinds."""
    rng = random.Random(8)
    parts = ["Wort", "水素。", "é", " " * 90, "\n" + " " * 80 + "\n", "end." + "”" * 40 + " ", ")", "　"]
    text = "".join(rng.choice(parts) for _ in range(30))
    path = tmp_path / "x.txt"
    path.write_bytes(text.encode())
    key = lambda p: (p.piece_no, p.start, p.end, p.forced, p.piece)
    one, many = (sorted(map(key, S.split_files(spark, ["file:" + str(path)], 120, 10, range_bytes=n).collect())) for n in (1 << 20, range_bytes))
    assert one == many and b"".join(text.encode()[a:b] for a, b in [(one[0][1], one[0][2]), *((x[2], y[2]) for x, y in zip(one, one[1:]))]) == text.encode()


def test_text_ranges_do_not_matter(monkeypatch):
    rng = random.Random(9)
    parts = ["Wort", "水素。", " " * 30, "\n" + " " * 40 + "\n", "end." + "”" * 30 + " ", "x" * 50]
    for _ in range(30):
        text = "".join(rng.choice(parts) for _ in range(25))
        want = S.plan(text, 60, 5)
        for size in (1, 5, 64):
            monkeypatch.setattr(S, "RANGE_CHARS", size)
            assert S.plan(text, 60, 5) == want
        monkeypatch.undo()


def test_a_stitch_holds_little():
    stitch, most = S.Stitch(100, 10), 0
    for _ in range(500):
        stitch.feed(list(range(6, 600, 6)), [1] * 99, 600)
        most = max(most, len(stitch.at))
    assert most < 250 and len(stitch.finish()) == 1
