import itertools
import math

from paperloom.llm import htmltext


def errors(model, layouts, n=120):
    """Blocks of content lost and blocks of boilerplate kept, as shares of the blocks of content."""
    lost = extra = total = 0
    for page, content in htmltext.labelled_pages(n, seed=1234, layouts=layouts):
        got = set(htmltext.extract(page, model).split("\n")) - {""}
        lost += len(content - got)
        extra += len(got - content)
        total += len(content)
    return lost / total, extra / total


def test_held_out_blocks():
    lost, extra = errors(htmltext.default_model(), htmltext.LAYOUTS)
    assert lost < 0.03 and extra < 0.04


def test_held_out_layouts():
    """Trained on the other four kinds of layout alone."""
    for layout in htmltext.LAYOUTS:
        model = htmltext.train(htmltext.labelled_pages(400, layouts=tuple(x for x in htmltext.LAYOUTS if x != layout)))
        lost, extra = errors(model, (layout,), 60)
        assert lost < 0.05 and extra < 0.2, (layout, lost, extra)


def test_links_and_foreign_elements_in_content():
    model = htmltext.default_model()
    assert htmltext.extract("<article><p>Read <a href=x>this report</a> first.</p></article>", model) == "Read this report first."
    assert htmltext.extract("<article><p>Use <svg width=1/> icons here.</p><p>And <svg><path d=x /><text>no</text></svg> more of it.</p></article>", model) == "Use icons here.\nAnd more of it."
    assert htmltext.extract("<article><p>It says <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in this line.</p></article>", model) == "It says x=2 in this line."


def test_marginals_equal_enumeration():
    model = htmltext.default_model()
    tree = htmltext.parse("<body><nav><li><a>x</a></nav><article><p>Some text here.<p>More.</article>")
    n, below = len(tree.tag), htmltext._Below(tree)
    weight, total = [0.0] * n, 0.0
    for labels in itertools.product((0, 1), repeat=n):
        w = model.root[labels[0]]
        for i in range(1, n):
            w += model.pair[htmltext.child_kind(tree, i)][labels[tree.parent[i]]][labels[i]]
            w += sum(model.unary[f][labels[i]] for f in htmltext.node_features(tree, i, below) if f in model.unary)
        p = math.exp(w)
        total += p
        for i in range(n):
            weight[i] += p * (labels[i] == 0)
    for a, b in zip(model.marginals(tree), weight):
        assert abs(a - b / total) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now.</div><div class="cookie-notice"><p>We use cookies. Accept them all.</p></div>
<article><h1>Head &amp; tail</h1><p><b>First  bold&nbsp;text.<br><p>Second\n paragraph &lt;here&gt;.</p><ul><li>point one is a sentence.<li>point two is a sentence.</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Another</a></li></ul></aside><form class="search"><label>Search</label><input><button>Go</button></form>
<section class="comments"><h3>Comments</h3><div class="comment"><b>Bob</b><p>I like this a lot.</p></div></section><footer>&copy; 2024 Site</footer></body></html>"""


def test_page():
    assert htmltext.extract(PAGE, htmltext.default_model()) == "Head & tail\nFirst bold text.\nSecond paragraph <here>.\npoint one is a sentence.\npoint two is a sentence."


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p"), (3, "u", "<p"), (4, "u", "<div>" * 3000 + "deep text in here." + "</div>" * 10), (5, "u", "<article><p>" + "word " * 50000 + ".</p></article>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = htmltext.extract_pages(df).collect()
    assert len(got) == len(rows) and {(r["page_id"], r["text"]) for r in got if r["page_id"] in (2, None)} == {(2, ""), (None, "")}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 5)["n_chars"] == 5 * 50000 + 1
    assert htmltext.extract_pages(df.where("false")).count() == 0


#: Written by hand, apart from the generator: (html, text).
WRITTEN = {
    "reading list": (
        "<html><body><header><h1>My Site</h1><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav></header><article><h1>Ten books to read</h1><ul>"
        + "".join(f"<li><a href=/{i}>Book number {i} by someone</a></li>" for i in range(10))
        + "</ul></article><footer>&copy; 2024 My Site</footer></body></html>",
        "\n".join(["Ten books to read", *(f"Book number {i} by someone" for i in range(10))]),
    ),
    "comment list": (
        "<html><body><div id=masthead><h1>My Blog</h1><p>Just another blog</p></div><div class='hentry'><h2 class=entry-title>A walk in spring</h2><div class=entry-content><p>We went out early and walked along the river for two hours.</p><p>The trees were green again, and birds sang.</p></div></div>"
        "<h3 id=comments>2 Comments</h3><ol class='commentlist'><li class='comment even'><cite>Bob</cite><p>Great post, thank you for sharing it with us!</p></li><li class='comment odd'><cite>Ann</cite><p>I was there last year as well. It is lovely.</p></li></ol></body></html>",
        "A walk in spring\nWe went out early and walked along the river for two hours.\nThe trees were green again, and birds sang.",
    ),
    "deep": ("<html><body>" + "<div>" * 3000 + "<p>This is a paragraph with some text in it, deep down in the page.</p>" + "</div>" * 3000 + "</body></html>", "This is a paragraph with some text in it, deep down in the page."),
    "german": ("<html><body><div class=navigation><a href=/>Start</a> <a href=/k>Kontakt</a></div><div class=inhalt><h1>Der Fluss</h1><p>Der Fluss stieg über Nacht um einen Meter und trat über die Ufer.</p></div><div id=footer>Impressum | Datenschutz</div></body></html>", "Der Fluss\nDer Fluss stieg über Nacht um einen Meter und trat über die Ufer."),
    "glossary": ("<html><body><nav><a href=/>Home</a></nav><main><h1>Glossary</h1><dl><dt>Anchor</dt><dd>What holds a ship in its place.</dd><dt>Bow</dt><dd>The front end of a ship.</dd></dl></main><footer><p>All rights reserved.</p></footer></body></html>", "Glossary\nAnchor\nWhat holds a ship in its place.\nBow\nThe front end of a ship."),
    "promo box": ("<html><body><main><article><h1>News</h1><p>The council met on Monday to talk about the new bridge.</p><div class='promo-box'><p>Subscribe now and save half the price!</p></div><p>It will be built next year, the mayor said.</p></article></main></body></html>", "News\nThe council met on Monday to talk about the new bridge.\nIt will be built next year, the mayor said."),
    "comments": ("<html><body><article><h1>News</h1><p>The council met on Monday to talk about the new bridge.</p></article><section class=comments><h2>Comments</h2><div class=comment><b>Joe</b><p>I do not think that we need it at all.</p></div></section></body></html>", "News\nThe council met on Monday to talk about the new bridge."),
}


def test_pages_written_by_hand():
    model = htmltext.default_model()
    assert {k: htmltext.extract(page, model) for k, (page, _) in WRITTEN.items()} == {k: text for k, (_, text) in WRITTEN.items()}


def test_hints_inside_longer_words():
    assert [htmltext.hint_of(w) for w in ("commentlist", "hentry", "sitefooter", "navbar", "navigation", "x", "subheader")] == ["talk", "main", "foot", "menu", None, None, "head"]
