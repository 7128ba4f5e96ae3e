"""Web pages as sections."""

from quarry.functions import pages
from quarry.operators import fulltext

PAGE = """<html><head><title>B meson</title><style>p{}</style></head><body><p>outside</p><main><h1>B meson</h1><p>Intro <b>bold</b><script>no</script>
<h2>Decays</h2><p>One<p>Two<ul><li>x<li>y</ul><h3>Rates</h3><table><tr><td>a<td>b</table><h2>Empty</h2><h2>Mass</h2><pre>u  vw</pre></main><p>after</p></body></html>"""


def test_sections_of_a_page():
    got = [(s.level, s.title, s.parent, s.path, s.texts) for s in pages.sections(PAGE, ("PDG",))]
    assert got == [
        (1, "B meson", "PDG", "PDG / B meson", ["Intro bold"]),
        (3, "Decays", "B meson", "PDG / B meson / Decays", ["One", "Two", "x", "y"]),
        (4, "Rates", "Decays", "PDG / B meson / Decays / Rates", ["a", "b"]),
        (3, "Mass", "B meson", "PDG / B meson / Mass", ["u vw"]),
    ]


def test_roots_and_odd_pages():
    inner = '<body><p>a</p><main><p>b</p></main><div id="details"><h2>T</h2><p>c</p><div><p>d</p></div></div><p>e</p></body>'
    assert [s.texts for s in pages.sections(inner)] == [["c", "d"]]
    assert [s.texts for s in pages.sections("<p>a</p><p>b")] == [["a", "b"]]
    assert pages.sections(None) == pages.sections("") == pages.sections("<h1>only</h1>") == []
    assert len(pages.capsule("T", "x " * 2000)) == pages.CAPSULE
    assert pages.capsule("T", " a  b ") == "T\na b"


def test_pages_as_a_table(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<h2>A</h2><p>t")], "page_id long, html string")
    got = {(r.page_id, r.section): (r.title, r.n_chars) for r in fulltext.html_sections(df).collect()}
    assert got == {(1, 0): ("B meson", 10), (1, 1): ("Decays", 14), (1, 2): ("Rates", 4), (1, 3): ("Mass", 4), (3, 0): ("A", 1)}
