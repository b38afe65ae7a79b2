from corpusloom.llm import boilerplate as B

PAGE = """<html><head><title>Zinc - Site</title><script>var t='<p>x</p>';</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>Forum</a></li></ul></nav><div class="c"><h1>Zinc</h1>
<p>Zinc is a <b>metal</b>&nbsp;of bluish white colour, and it melts at 419 degrees.</p><div class="box"><p>Advertisement</p></div>
<h2>Uses</h2><p>It is used to cover steel, since it keeps the rust away.</p><ul><li>First of all, coatings.</li><li>Alloys such as brass.</li></ul>
<blockquote>A most useful metal, said one.</blockquote><pre>Zn + 2 HCl</pre></div>
<div class="side"><h3>Related</h3><ul><li><a href=/x>Copper</a></li><li><a href=/y>Tin</a></li></ul></div>
<footer><p>Privacy policy</p><p>© 2020 Site. All rights reserved.</p></footer></body></html>"""
WANTED = ["Zinc", "Zinc is a metal of bluish white colour, and it melts at 419 degrees.", "Uses", "It is used to cover steel, since it keeps the rust away.", "First of all, coatings.", "Alloys such as brass.", "A most useful metal, said one.", "Zn + 2 HCl"]


def test_body():
    assert [t for t, k in B.body(PAGE) if k] == WANTED


def test_old_and_broken_pages():
    page = "<BODY><TABLE><TR><TD WIDTH=9><a href=/a>Aide</a><BR><a href=/b>Contact</a></TD><TD><H1>Fer</H1><P>Le fer est un métal, et il fond à 1538 degrés.<P>Il rouille, hélas, à l'air humide.<UL><LI>Un acier, par exemple.<LI>Une fonte, aussi.</UL></TD></TR></TABLE>"
    kept = [t for t, k in B.body(page) if k]
    assert kept == ["Fer", "Le fer est un métal, et il fond à 1538 degrés.", "Il rouille, hélas, à l'air humide.", "Un acier, par exemple.", "Une fonte, aussi."]
    for bad in (None, "", "<", "<p", "</div></div>", "<!-- open", "<script>never closed", "&amp", "<p>" * 3000):
        B.body(bad)


def test_break_separated_text():
    page = "<title>Gold - X</title><body><center>[ <a href=/a>A</a> | <a href=/b>B</a> ]</center><div id=t><h2>Gold</h2>It is heavy, and yellow as well.<br><br>It does not rust, which is why it is liked.<br></div><small>Terms of use<br>Page viewed 3 times</small></body>"
    assert [t for t, k in B.body(page) if k] == ["Gold", "It is heavy, and yellow as well.", "It does not rust, which is why it is liked."]


METALS = ["Copper", "Tin", "Lead", "Gold", "Silver", "Nickel", "Cobalt", "Iron"]


def many(end="Privacy policy", n=8):
    """Pages of other metals on the same site, each with its own sentences."""
    return [(str(i), PAGE.replace("Zinc", METALS[i % 8]).replace("419", str(300 + i)).replace("Privacy policy", end)) for i in range(n)]


def noise_of(spark, pages, text):
    sections = spark.createDataFrame([("s", text, "k"), *[(f"c{i}", f"{m} is a metal of dark colour.\nIt is used to cover steel, and it melts at {i} degrees.", "k") for i, m in enumerate(METALS)]], "id string, text string, keep string")
    rows = B.found(spark.createDataFrame(pages, "id string, html string"), sections).collect()
    return {r.unit_md5 for r in rows if r.kind == "section_noise"}


def test_noise_lines(spark):
    text = ["It melts near 5 degrees.", "- Home", "- Forum", "It is used to cover steel.", "Privacy policy", "Privacy screens were used in 1990, and it melts.", "© 2001 Site. All rights reserved."]
    assert noise_of(spark, many(), "\n".join(text)) == {B.md5(text[i]) for i in (1, 2, 4, 6)}


def test_found(spark):
    pages = spark.createDataFrame([("1", PAGE, "x"), ("1", PAGE, "y"), (None, PAGE, ""), ("2", None, ""), ("3", "", "")], "id string, html string, hash string")
    sections = spark.createDataFrame([("s", "A line of text, and more.", "k"), ("t", None, None), (None, "Privacy policy", None), ("u", "", None)], "id string, text string, keep string")
    rows = B.found(pages, sections).collect()
    assert {(r.row_key, r.unit_md5) for r in rows if r.kind == "page_main"} == {("1", B.md5(t)) for t in WANTED} and len(rows) == len(WANTED)
    assert B.found(pages.limit(0), sections.limit(0)).count() == 0
    assert B.found(pages.limit(0), sections).count() == 0


def test_words_of_the_body_stay_there(spark):
    """No phrase is furniture by itself: what stands in the bodies of a site is a part of its articles."""
    own = ["Settings", "See also", "He sent a newsletter to all owners of zinc roofs, and they were pleased.", "Accept all", "Privacy policy of the smiths"]
    pages = [(i, h.replace("<h2>Uses</h2>", "".join(f"<h2>{x}</h2><p>It was so, in {i}, as they say.</p>" for x in own))) for i, h in many("Made by the Guild")]
    got = {(r.row_key, r.unit_md5) for r in B.found(spark.createDataFrame(pages, "id string, html string"), spark.createDataFrame([], "id string, text string")).collect()}
    assert {(i, B.md5(x)) for i, _ in pages for x in own} <= got


def test_furniture_between_paragraphs(spark):
    """A text that other pages of a site have outside their bodies is taken out where it has the path of the paragraphs."""
    pages = many("Made by the Guild of Tin")
    pages[0] = "0", pages[0][1].replace("<h2>Uses</h2>", "<p>Made by the Guild of Tin</p><h2>Uses</h2>")
    got = {(r.row_key, r.unit_md5) for r in B.found(spark.createDataFrame(pages, "id string, html string"), spark.createDataFrame([], "id string, text string")).collect()}
    assert not {x for x in got if x[1] == B.md5("Made by the Guild of Tin")} and ("0", B.md5("Uses")) in got


def test_long_lines_of_the_lexicon(spark):
    end = "This site is run by the Guild of Tin, " + "and by the friends of the Guild of Tin, " * 6 + "since 1900."
    assert noise_of(spark, many(end), end + "\nIt melts, and it is used to cover steel.") == {B.md5(end)}


def test_the_lexicon_goes_by_a_confidence_bound(spark):
    row = lambda n, outside: ("p", [7] * n, [False] * outside + [True] * (n - outside), None, None, None, None)
    listed = lambda n, outside: B.lexicon(spark.createDataFrame([row(n, outside)], B.PAGE_UNITS)).count() == 1
    assert not listed(2, 2) and listed(5, 5) and not listed(40, 24) and listed(4000, 2400) and not listed(4000, 2200)


def test_repeated_lines_and_empty_statistics():
    assert B.path_odds({}, {})[0] == 0.0
    odds = B.path_odds({3: 50}, {3: {0: 20, -40: 30}, 4: {-8: 500}})
    assert odds[3] > 0 > odds[4]
