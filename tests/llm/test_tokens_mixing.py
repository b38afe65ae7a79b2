import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import mixing
from corpusloom.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path, pattern = T.default_vocabulary()
    other = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    with open(path, "rb") as f:
        return T.Encoder(T.read_ranks(f.read()), pattern), other


CASES = ["", " ", "\n\n  x", "<|endoftext|>", "a" * 5000, "它主要用于玻璃" * 50, "é\u0301 \x00\x07", "🧪⚗️👩\u200d🔬", "can't we'VE", "\r\n\t", "ab" * 20000]


def test_against_library(both):
    own, other = both
    for text in CASES:
        assert own.ids(text) == other.encode(text, add_special_tokens=False).ids
    assert own.ids(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(both, text):
    own, other = both
    assert own.ids(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_table(spark):
    rows = spark.createDataFrame([(1, "ab c", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids) for r in T.encode(rows, "doc_id").collect()))
    assert got == [(0, [64]), (1, [397, 269]), (2, []), (3, []), (3, [])]
    counts = T.count_tokens(rows, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counts) == [(0, 1), (1, 2), (2, 0), (3, 0), (3, 0)]
    assert T.encode(rows.limit(0), "doc_id").count() == 0
    assert os.path.basename(T.default_vocabulary()[0]) not in os.listdir(os.path.dirname(os.path.abspath(__file__)))


def documents(spark):
    rng = random.Random(2)
    data = [(i, "big", rng.randrange(5, 300)) for i in range(900)] + [(1000 + i, "small", rng.randrange(5, 60)) for i in range(40)] + [(2000, "one", 5000)]
    data += [(3000, None, 50), (None, "big", 10), (3001, "big", 0), (3002, "small", None)]
    return spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")


TARGETS = "mix_id string, source string, target_share double, max_repeats int, total_factor double"


def test_shares_and_repeats(spark):
    targets = [("m", "big", 0.6, 1, 0.3), ("m", "small", 0.2, 10, 0.3), ("m", "none", 0.2, 3, 0.3), ("m", "big", 0.6, 1, 0.3), ("n", "small", 0.9, 2, 1.0), ("n", "big", 0.1, 1, 1.0), (None, "big", 0.5, 1, 1.0)]
    selection, report = mixing.mix(documents(spark), spark.createDataFrame(targets, TARGETS))
    rows = {(r.mix_id, r.source): r for r in report.collect()}
    assert set(rows) == {("m", "big"), ("m", "small"), ("m", "none"), ("n", "small"), ("n", "big")}
    for key, r in rows.items():
        used = selection.where(f"mix_id = '{key[0]}' AND source = '{key[1]}'").collect()
        assert sum(x.copies * x.n_tokens for x in used) == r.tokens_used and all(1 <= x.copies <= r.max_repeats for x in used)
        assert abs(r.tokens_used - r.tokens_budget) <= max(3, 0.002 * r.tokens_budget), (key, r)
        assert r.tokens_budget == pytest.approx(min(r.tokens_wanted, r.max_repeats * r.tokens))
    assert rows["m", "none"].tokens_used == 0 and rows["m", "none"].share_reached == 0
    assert rows["n", "small"].most_copies == 2 and rows["n", "small"].tokens_used == 2 * rows["n", "small"].tokens
    assert sum(r.share_reached for k, r in rows.items() if k[0] == "m") == pytest.approx(1)


def test_empty_tables(spark):
    docs, targets = documents(spark), spark.createDataFrame([("m", "big", 0.5, 1, 0.5)], TARGETS)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0)), (docs.limit(0), targets.limit(0))):
        selection, report = mixing.mix(d, t)
        assert selection.count() == 0 and report.count() == t.count()
