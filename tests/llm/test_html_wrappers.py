import html
import re
import time

from maskloom.llm import html_wrappers as hw
from maskloom.llm.common import table

SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string, task int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "w", "t", 1) for i, (u, h) in enumerate(rows)], SCHEMA)


def texts(df):
    return {r["page_id"]: r["text"] for r in hw.extract(df).collect()}


def test_small_pages_against_their_articles(spark):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    rows = {r["page_id"]: r for r in hw.extract(df).collect()}
    source = df.collect()
    assert len(rows) == len(source)
    for page in source:
        inner = page["html"].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        want = "\n".join(p for p in parts if p)
        assert rows[page["page_id"]]["text"] == want and rows[page["page_id"]]["n_chars"] == len(want)
        assert rows[page["page_id"]]["url"] == page["url"]


MAIN = """<header>Site</header><nav>Menu</nav><main><header><h1>Head &amp; line</h1><p>by me</p></header><p>one&nbsp; two<br>three
<aside>side</aside><ul><li>a<li>b</ul><form>ask</form><div class="share-bar">tell</div><div role=alert>now</div>
<script>if (a < b) "</p>"</script><p>last &lt;b&gt;</p><section id="comments"><p>reader</p></section></main><footer>f</footer>"""


def test_parts_that_are_not_text_go(spark):
    assert texts(pages(spark, [("http://a/x", MAIN)]))[0] == "Head & line\none two three\na\nb\nlast <b>"


def test_wrapper_tells_template_from_text_where_nothing_is_marked(spark):
    page = "<body><div class=top>Our great site</div><div><h2>{0}</h2><p>{0} text {1}<p>{1} more</div><p>All rights</p></body>"
    rows = [("http://h.example/%d" % i, page.format(f"t{i}", f"u{i}")) for i in range(5)]
    out = texts(pages(spark, rows + [("http://other.example/", page.format("x", "y"))]))
    for i in range(5):
        assert out[i] == f"t{i}\nt{i} text u{i}\nu{i} more"
    assert out[5].startswith("Our great site\nx")  # one page alone shows no template


MENU = "<ul><li>Home<li>News<li>About us</ul>"


def test_template_goes_where_nothing_is_marked(spark, monkeypatch):
    page = ("<body>" + MENU + "<div><h2>{0}</h2><p>{0} one<p>{0} two<p>Write to the editor<ul><li>{0} a<li>{0} b</ul></div>"
            "<dl><dt>Imprint<dd>us<dt>Terms<dd>none</dl></body>")
    rows = [("http://h.example/%d" % i, page.format(f"t{i % 4}")) for i in range(6)]  # the first two come twice
    df = pages(spark, rows)
    want = {i: "t{0}\nt{0} one\nt{0} two\nt{0} a\nt{0} b".format(i % 4) for i in range(6)}
    assert texts(df) == want
    html = rows[0][1]
    assert hw.main_text(html, [])[0] != want[0]  # without the wrapper the template stays


def test_copies_keep_their_text(spark):
    one, other = MENU + "<p>one text<p>and more", "<p>quite another page"
    rows = [("http://h.example/%d" % i, one) for i in range(3)]
    assert set(texts(pages(spark, rows)).values()) == {"Home\nNews\nAbout us\none text\nand more"}
    out = texts(pages(spark, rows + [("http://h.example/o", other), ("http://h.example/m", MENU + "<p>its own")]))
    assert [out[i] for i in (0, 1, 2, 3, 4)] == ["one text\nand more"] * 3 + ["quite another page", "its own"]


def test_ids_of_headings_and_sections_are_names_only(spark):
    page = ('<article><h2 id="social-impact">Impact</h2><p>a</p><section id="search-algorithms"><p>b</p></section>'
            '<h3 id="comments">On comments</h3><div id="comments"><p>reader</p></div></article>')
    assert texts(pages(spark, [("http://h/", page)]))[0] == "Impact\na\nb\nOn comments"


def test_paths_have_no_longest_length(spark):
    deep = lambda x: "<div>" * 30 + "<aside>" + "<div>" * 30 + "side" + "</div>" * 30 + "</aside>" + f"<p>{x} text" + "</div>" * 30
    a, b = (hw.page_stream(hw.blocks("<nav>" + "<div>" * 20 + "x" + "</div>" * 20 + "</nav>" + deep(x)))[0] for x in "ab")
    assert [i[0][-1:] == "!" for i in a] == [True, True, False] and len({i[0] for i in a}) == 3
    assert [bool(i[1]) for i in hw.merged(a, b)] == [True, True, False]


def test_odd_pages(spark):
    rows = [(None, None), ("", ""), ("nonsense", "no tags at all  "), ("http://h/", "<p>a<p>b"), ("http://h/", "<article></article>"),
            ("http://h/", "x < y & z &lt &#65;"), ("http://h/", "<article><p>one<div class='cookie-notice'>c</div>two")]
    out = texts(pages(spark, rows))
    assert [out[i] for i in range(7)] == ["", "", "no tags at all", "a\nb", "", "x < y & z < A", "one\ntwo"]
    assert hw.extract(pages(spark, [])).count() == 0
    assert len(hw.extract(pages(spark, rows).unionAll(pages(spark, rows))).collect()) == 14


def test_long_and_broken_pages_take_linear_time():
    start = time.time()
    for page in ("<div>" * 30_000, "<p>" * 50_000, '<a "' * 30_000, '</a "' * 30_000, "<b>" * 30_000 + "</i>" * 30_000,
                 "<!--" * 30_000, "<li><h2>a</h2><p>b</p>" * 10_000, "<script>" * 30_000, "a" * 1_000_000):
        hw.main_text(page, hw.page_stream(hw.blocks(page))[0])
    assert time.time() - start < 20


def test_wrappers_are_union_free():
    def stream(*paths):
        return hw.page_stream([hw.Block(p, t, False, False) for p, t in paths])[0]

    a = stream(("nav", "m"), ("h1", "x"), ("p", "1"), ("p", "2"), ("foot", "f"))
    b = stream(("nav", "m"), ("h1", "y"), ("ad", "buy"), ("p", "3"), ("foot", "f"))
    m = hw.merged(a, b)
    assert [(i[0], not i[1], i[2], i[3]) for i in m] == [
        ("nav", False, False, False), ("h1", True, False, False), ("ad", False, True, False), ("p", True, False, True),
        ("foot", False, False, False)]
    assert hw.as_expression(m).count("?") == 1 and hw.as_expression(m).count("+") == 1
    c = stream(*[("dt", str(i)) if i % 2 else ("dd", str(i)) for i in range(20)])
    assert [(i[0], i[3]) for i in c] == [("dd", True), ("dt", True)]
    assert all(x is not None for pair in hw.aligned(a, a) for x in pair)
