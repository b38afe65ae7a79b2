import numpy as np
import pytest

from corpusloom.llm import markup as M
from corpusloom.llm import pages as P
from corpusloom.llm.crf import Crf

CLEAN = [
    "It melts near 300 K, so a*b stays below c*d when T < 300 K and p > 8 bar.", "- 59 g of it -- not more -- were weighed == or so the log says.",
    "In the notation used here, H _{2} O ^{+} marks the form (x ^{2} < y).", "Row two of [[1,2],[3,4]] was read as x[[2]].", "The <100> and <110> directions differ, i.e. |a| < |b| || c.",
    "The '' mark means seconds and the ' mark minutes.", "Lot A_7 of x_1: the ratio was 3 * 4 / 5 ~ 2.4.", "The string C[C@H](N)C(=O)O and {111} faces.",
    "Path C:\\data\\run90 holds it, and R&D keeps a copy.", "A bottle costs between $40 and $60, and grade #3 about $25.", "The rule a<b then stop; see the <10 µm fraction.",
    "* denotes a run with p < 0.05, and ** a run with p < 0.01.", "Home > Metals > Zinc", "r = k_{5} [A]^{2}",
]
DIRTY = {
    "The <b>gas</b> was weighed.<br/>": "The gas was weighed.", "It &nbsp;melts&nbsp; here &#8211; now": "It melts here – now", "A **bold** and `coded` word.[^5]": "A bold and coded word.",
    "See [[Ash|the ash]] and '''this''' ''too''.": "See the ash and this too.", "An \\emph{odd} form, $k_{5}$ and \\ce{H2SO4}~\\cite{r1}.": "An odd form, k_{5} and H2SO4.",
    "See [notes](https://x.example/p) and ![curve](img/run1.png).": "See notes and curve.", "CO<sub>2</sub> and x<sup>2</sup><sup>[7]</sup>": "CO_{2} and x^{2}",
    "Nothing ~~at all~~ {{convert|3|kg}} __here now__.": "Nothing at all 3 kg here now.",
}
BLOCKS = "== Uses ==\nPlain text, as before.\n```python\nrate = 40 * k1\n```\n* [ ] repeat run\n| grade | use |\n|---|:--:|\n| 3 | ink |\n\\begin{equation}\nr = k_{5}\n\\end{equation}\n[[Category:Salts]]\n__NOTOC__\n{{Infobox x\n| density = 3\n}}\n<ul><li>one</li></ul>"


@pytest.fixture(scope="module")
def cleaner():
    return M.Cleaner(M.model())


def test_held_out_pages():
    assert min(M.scores(M.model(), P.pages(400, 99)).values()) > 0.95
    assert P.pages(20, 5) == P.pages(20, 5) != P.pages(20, 6)


def test_labels_are_decided_by_the_model_alone(cleaner):
    blind = Crf(M.FEATURES, len(M.LABELS))  # all labels alike: the first one, text
    assert M.Cleaner(blind).clean("A <b>bold</b> word") == (False, "A <b>bold</b> word", [("text", "A <b>bold</b> word")])
    context = ["```", "plain words only", "```"]
    assert cleaner.labels(context) == [P.CODE] * 3 and cleaner.labels(context[1:2]) == [P.TEXT]


def test_deep_nesting_is_cleaned(cleaner):
    deep = "x"
    for _ in range(9):
        deep = "\\emph{" + deep + "}"
    assert cleaner.clean(f"An {deep} here")[1] == "An x here"
    assert cleaner.clean("R" + "&amp;" * 1 + "amp;" * 8 + "lt;b> now")[1] == "R now"


def test_repeated_rows_once(spark):
    rows = spark.createDataFrame([("s", "1", "The <b>gas</b>"), ("s", "1", "The <b>gas</b>"), ("s", None, None), ("s", None, None), ("s", "1", None), ("s", "1", "")], "src string, row_key string, text string")
    got = sorted((r.row_key or "", r.clean_text or "", r.clean_text is None) for r in M.clean_texts(rows).collect())
    assert got == [("", "", True), ("1", "", False), ("1", "", True), ("1", "The gas", False)]


def test_content_signs_stay(cleaner):
    for line in CLEAN:
        assert cleaner.clean(line)[:2] == (False, line)


def test_inline(cleaner):
    for line, want in DIRTY.items():
        assert cleaner.clean(line)[:2] == (True, want)


def test_structure_is_kept(cleaner):
    found, text, blocks = cleaner.clean(BLOCKS)
    assert found and text.split("\n") == ["Uses", "Plain text, as before.", "    rate = 40 * k1", "- repeat run", "grade\tuse", "3\tink", "r = k_{5}", "- one"]
    assert [k for k, _ in blocks] == ["heading", "text", "code", "list", "table", "table", "formula", "list"]


def test_null_empty_long(cleaner):
    assert cleaner.clean(None) == (False, None, []) and cleaner.clean("") == (False, "", [])
    long_ = "\n".join(CLEAN * 200)
    assert cleaner.clean(long_)[0] is False
    assert cleaner.clean(long_ + "\n<b>x</b>")[0] is True


def test_found(spark):
    sections = spark.createDataFrame([("1", "The <b>gas</b>", "x"), ("1", "The <b>gas</b>", "x"), ("2", None, "x"), ("3", "", "x"), (None, "<i>x</i>", "x"), ("4", "Plain.", "x")], "id string, text string, src string")
    corpus = spark.createDataFrame([("9", "\\section{Uses}\nText", "y")], "_id string, text string, row_key string")
    got = M.found(sections, corpus)
    assert {tuple(r) for r in got.collect()} == {("article_sections", "1"), ("corpus", "9")} and got.count() == 2
    assert M.found(sections.limit(0), corpus.limit(0)).count() == 0


def test_crf_learns_context():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(200):
        seq, labels, inside = [], [], False
        for _ in range(8):
            if rng.integers(0, 3) == 0:
                seq.append([1 if inside else 0])
                labels.append(2 if inside else 1)
                inside = not inside
            else:
                seq.append([2])
                labels.append(1 if inside else 0)
        data.append((seq, labels, 1.0))
    model = Crf(4, 3).fit(data, epochs=10)
    assert sum(model.decode(s) == y for s, y, _ in data) >= 190  # a plain line takes its label from the line before

    def brute(rows):
        import itertools

        score = lambda ys: model.s[ys[0]] + sum(model.w[r].sum(0)[y] for r, y in zip(rows, ys)) + sum(model.t[a, b] for a, b in zip(ys, ys[1:]))
        return max(score(ys) for ys in itertools.product(range(3), repeat=len(rows))), score

    for s, _, _ in data[:4]:
        best, score = brute(s)
        assert abs(score(model.decode(s)) - best) < 1e-9
