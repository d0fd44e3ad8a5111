import pytest

from textquarry.llm import main_text as m


def page(body, head=""):
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title>{head}<style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>{body}</body></html>'


LONG = "This sentence is a good deal longer than any entry of a menu would ever be."


def test_blocks_and_references():
    html = page(f"<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A &amp; B</h1><p>{LONG}\n  two&nbsp;words &lt;b&gt; <b>bold<br>line</b><p>Next &eacute;&#233;.</p><!-- <p>no</p> --><ul><li>One.<li>Two.</ul></article><footer>&copy; x</footer>")
    assert m.extract(html, []) == f"A & B\n{LONG} two words <b> bold line\nNext éé.\nOne.\nTwo."


@pytest.mark.parametrize(
    "extra",
    [
        '<div class="sidebar"><p>%s</p></div>',
        '<aside><p>%s</p></aside>',
        '<div class="ad-slot"><p>%s</p></div>',
        '<div id="cookie-notice"><p>%s</p></div>',
        '<section class="comments"><div class="comment"><p>%s</p></div></section>',
        '<form action="/s"><p>%s</p><input name=q><select><option>a</select></form>',
        '<header><p>%s</p></header>',
        '<div role="navigation"><p>%s</p></div>',
        '<noscript><p>%s</p></noscript>',
        '<div hidden><p>%s</p></div>',
        '<script>%s</script>',
    ],
)
@pytest.mark.parametrize("inside", [True, False])
def test_what_is_left_out(extra, inside):
    other = extra % ("Other running text that is here for some other end than the article. " * 2)
    text = f'<div class="story"><h2>Head</h2><p>{LONG}</p>{other if inside else ""}<p>{LONG}</p></div>{"" if inside else other}'
    assert m.extract(page(f'<div id="wrap">{text}</div>'), []) == f"Head\n{LONG}\n{LONG}"


def test_consensus_of_a_host(spark):
    """On one page the comments are longer than the article; the host's other pages outvote it."""
    def make(n, article, remarks):
        return page(f'<div class="ca n{n}"><p>{article}</p></div><div class="cb"><p>{remarks}</p></div>')

    rows = [(k, f"http://Host.org:80/{k}", make(k, LONG * 3, "Fine."), "x") for k in range(6)]
    rows += [(7, "http://host.org/7", make(7, LONG, LONG * 5), "x"), (8, "http://other.org/8", make(8, LONG, LONG * 5), "x")]
    rows += [(9, None, None, "x"), (10, "no url", "", "x"), (11, "http://host.org/", "<p>bare text", "x"), (11, "http://host.org/", "<p>bare text", "x"), (None, "http://host.org/z", "<div hidden>x</div>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    paths = {r.host: r.paths for r in m.host_paths(pages).collect()}
    assert paths["host.org"][0] == "html>body>div.ca.n#"
    found = m.main_text(pages).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    assert by[3] == LONG * 3 and by[7] == LONG and by[8] == LONG * 5
    assert by[9] == by[10] == by[None] == "" and by[11] == "bare text"


def test_odd_markup():
    assert m.extract("<p>a <b title='>'>b</b <i>c", []) == "a bc"
    assert m.extract("</p></div><p>one<div>two</p>three", []) == "one\ntwo\nthree"
    assert m.extract("plain &amp; simple", []) == "plain & simple"
    assert m.extract("<script>never closed <p>x", []) == ""
    assert m.extract("<!-- never closed <p>x", []) == ""
    assert m.extract('<div class="a>x">y</div', []) .startswith("y")
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert m.extract(deep, []) == LONG
    long = "<p>word</p>" * 50_000
    assert m.extract(long, []).count("\n") == 49_999


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert m.main_text(pages).count() == 0
