import re
from html import unescape

import pytest

from partloom.llm import html, queries


def plain(page):
    """The article of the generated pages, read by their known layout."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    inner = re.sub(r"<[^>]*\Z", "", m[1]).replace("<br>", " ") if m else ""
    blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op1_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def page(i, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"""<!doctype html><html><head><title>T {i}</title><style>p > a {{}}</style><script>if (a<b) {{ document.write("<p>no</p>") }}</script></head>
    <body class="has-sidebar page-{i}"><div id="top-banner" class="cookie-notice"><p>We use cookies {i}</p></div>
    <header><h2>Site</h2><a href="/">home</a></header><div class="menu"><ul><li><a>One</a><li><a>Two</a></ul></div>
    <div class="wrap"><div id="post-{i}" class="entry"><h1>Title&nbsp;{i}</h1>{body}
    <div class="share">Share this</div><div class="box">Brought to you by nobody in particular</div>
    <table><tr><td>a{i}</td><td>b</td></tr></table></div>
    <div class="sidebar"><p>Popular posts, which are long enough to be seen as text by a careless reader {i}</p></div></div>
    <form action="/s"><p>Search</p><input name=q></form><section id="comments"><div class="comment"><p>Reader {i} says hello</p></div></section>
    <footer>&copy; site</footer></body></html>"""


def test_layout_without_article():
    texts = [[f"Paragraph {i} {k} " + "lorem ipsum dolor sit amet " * 6 + "&amp; more &lt;b&gt;" for k in range(1 + i % 4)] for i in range(6)]
    pages = [page(i, t) for i, t in enumerate(texts)]
    wrapper = html.infer(pages)
    assert wrapper["root"][-1] == ["div#post-0.entry", 1]
    assert "+" in wrapper["wrapper"] and "#SLOT" in wrapper["wrapper"] and wrapper["pages"] == 6
    for i, t in enumerate(texts):
        want = [f"Title {i}", *(" ".join(unescape(x).split()) for x in t), f"a{i} b"]
        assert html.extract(pages[i], wrapper) == "\n".join(want)


def test_article_without_surroundings():
    doc = """<body><main><article class="post"><header><h1>A &quot;b&quot;</h1><p>By me</p></header><p>One<b> two</b>
      three<br>four <script>x()</script><!-- <p>gone</p> -->five<p>six<ul><li>s<li>t</ul><aside>also read</aside>
      <div style="display: none">hidden</div><pre>a  b</pre></article><article class="comment"><p>A very long reader comment that goes on and on and on and on and on and on and on</p></article></main>"""
    assert html.extract(doc, html.infer([doc])) == 'A "b"\nOne two three four five\nsix\ns\nt\na b'


@pytest.mark.parametrize("doc", ["", "plain words", "<", "<p", "<p>a", "</p></div>x", "<<b>>", "<p>&am", "<script>never closed <p>", "<!-- open", "<a href='x>y'>z</a>", "<p " * 500, "<div>" * 3, "&#0;&#x110000;&bogus;"])
def test_broken_markup_never_fails(doc):
    assert isinstance(html.extract(doc, html.infer([doc])), str)


def test_wrapper_grows_by_alignment():
    w = html.infer(["<body><article><h1>a</h1><p>x y</p></article></body>", "<body><article><h1>b</h1><p>z</p><p>q</p><hr></article></body>", "<body><article><p>r</p></article></body>"])
    assert w["wrapper"] == "<#page><body><article>(<h1>#SLOT</h1>)? (<p>#SLOT</p>)+ (<hr></hr>)?</article></body></#page>"


def test_edges(spark):
    long = "<body><article>" + "<p>word &eacute; " * 20_000
    rows = [(1, "http://a.b/x", None), (2, None, "<p>n</p>"), (3, "http://A.B:80/y", "<body><article><p>t</p></article>"), (3, "http://a.b/y", "<body><article><p>t</p></article>"), (None, "odd", ""), (4, "https://u@a.b?q", long)]
    df = spark.createDataFrame([(*r, 5, "m") for r in rows], "page_id long, url string, html string, id int, host string")
    got = sorted(((r.id, r.url, r.host, r.text) for r in html.main_text(df).collect()), key=str)
    want = [(1, "http://a.b/x", "a.b", ""), (2, None, "", "n"), (3, "http://A.B:80/y", "a.b", "t"), (3, "http://a.b/y", "a.b", "t"), (None, "odd", "", ""), (4, "https://u@a.b?q", "a.b", "\n".join(["word é"] * 20_000))]
    assert got == sorted(want, key=str)
    assert html.main_text(df.limit(0)).collect() == []


def test_template_is_dropped_only_where_it_says_the_same():
    def doc(i, box):
        return f"<body><article><h1>Title {i}</h1><p>Words of page {i} " + f"and more {i} " * 20 + f"</p><ul><li>{box}</li></ul></article></body>"

    wrapper = html.infer([doc(i, "Same list on every page") for i in range(12)])
    assert "Same list" not in html.extract(doc(1, "Same list on every page"), wrapper)
    assert html.extract(doc(99, "A list of the article itself"), wrapper).endswith("\nA list of the article itself")


def test_deep_and_wide_pages_beside_good_ones(spark):
    deep = "<body><article>" + "<div>" * 100_000 + "deep text" + "</div>" * 100_000 + "<p>tail</p></article></body>"
    open_ended = "<body>" + "<div>" * 100_000 + "never closed"
    wide = "<body><article>" + "".join(f"<p>p{i}</p>" for i in range(50_000)) + "</article>"
    kinds = "<body><article>" + "".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}'>d{i}</div>" for i in range(50_000)) + "</article>"
    good = "<body><article><p>good {}</p></article>"
    docs = [deep, good.format(1), open_ended, good.format(2), wide, kinds, kinds.replace("<article>", "<article><p>x</p>"), "<b>" * 50_000 + "<p>y</p>" * 50_000, good.format(3)]
    got = {r.id: r.text for r in html.main_text(spark.createDataFrame([(i, "http://one.host/", d) for i, d in enumerate(docs)], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 8)] == ["deep text\ntail", "good 1", "never closed", "good 2", "good 3"]
    assert got[4] == "\n".join(f"p{i}" for i in range(50_000)) and got[5] == "\n".join(f"d{i}" for i in range(50_000))
    assert got[6] == "x\n" + got[5] and got[7] == "\n".join("y" * 50_000)


@pytest.mark.parametrize(
    ("doc", "text"),
    [
        ('<main><p class="menu-item-description">Soup of the day</p><div class="share-price">12</div><div class="share-buttons">Tell</div></main>', "Soup of the day\n12"),
        ('<main><p>a</p><div class="related-work"><a href="/1">all</a> <a href="/2">links</a></div><div class="related-work">mostly text <a href="/1">link</a></div></main>', "a\nmostly text link"),
        ('<article><p>one <b title="x>bold</b></p><p>two</p></article>', "one bold\ntwo"),
        ('<article><h1>Maps</h1><h2 id="search">Search</h2><p>a</p><h2 id="comments">Comments on the law</h2><p>b</p></article>', "Maps\nSearch\na\nComments on the law\nb"),
        ('<article><p class="share">Each share is worth five.</p><p class="widget">A widget turns.</p><p class="share"><a href="/s">Tell all</a></p></article>', "Each share is worth five.\nA widget turns."),
        ('<article><blockquote class="reply">Said so.</blockquote><p class="hidden" hidden>never</p></article>', "Said so."),
        ('<main><p>a</p><h2 id="comments">Comments</h2> <!-- x --> <div id="commentlist">me too</div><h2 id="related">Related</h2></main>', "a\nRelated"),
        ("<article><header><h1>T</h1><p>By me</p><p>" + "A lead that tells what the article is about. " * 2 + "</p></header><p>b</p></article>", "T\n" + ("A lead that tells what the article is about. " * 2).strip() + "\nb"),
        ("<body><svg><p>after</p>", "after"),
        ("<body><select><option>one<p>after</p>", "after"),
        ("<body><object><p>inside</p>", "inside"),
        ("<body><math><p>after</p>", "after"),
        ("<head><title>never closed<body><p>after</p>", "after"),
        ("<body><svg><text>drawn</text></svg><p>after</p>", "after"),
    ],
)
def test_names_and_open_ends(doc, text):
    assert html.extract(doc, html.infer([doc])) == text


def test_wrapper_comes_from_all_pages_whatever_the_parts():
    """Pages merged in any number of parts tell the same template; copies of a page are one page as evidence."""
    def doc(i, box):
        return f"<body><article><h1>Title {i}</h1><p>Words of page {i}</p><div>{box}</div></article></body>"

    docs = [doc(i, "Follow us everywhere" if i % 10 < 6 else f"Own box {i}") for i in range(100)] + [doc(1000, "A box that copies share")] * 300
    for parts in (1, 3, 40):
        tops = []
        for k in range(parts):
            top = None
            for d in docs[k::parts]:
                top = html.page(d) if top is None else html.merge(top, html.page(d))
            tops.append(html.unpack(html.pack(top)))
        whole = tops[0]
        for t in tops[1:]:
            whole = html.merge(whole, t)
        model = html.decide(whole)
        assert html.extract(doc(0, "Follow us everywhere"), model) == "Title 0\nWords of page 0"
        assert html.extract(doc(7, "Own box 7"), model).endswith("\nOwn box 7")
        assert html.extract(docs[-1], model).endswith("\nA box that copies share")


def test_same_shared_paragraph_stays():
    docs = [f"<body><article><p>Shared by all.</p><p>Own words of {i}</p></article></body>" for i in range(20)]
    assert html.extract(docs[3], html.infer(docs)) == "Shared by all.\nOwn words of 3"


def test_cycles_meet_single_rounds():
    w = html.infer(["<body><dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl></body>", "<body><dl><dt>e</dt><dd>f</dd></dl></body>"])
    assert w["wrapper"] == "<#page><body><dl>((<dt>#SLOT</dt> <dd>#SLOT</dd>))+</dl></body></#page>"


@pytest.mark.parametrize("tag", ["ul", "ol", "table"])
def test_lists_that_some_pages_share_stay(tag):
    cell = "<tr><td>{}</td></tr>" if tag == "table" else "<li>{}</li>"

    def doc(i, same):
        return f"<body><article><h1>Title {i}</h1><p>Words of page {i}</p><{tag}>{cell.format('Salt and pepper' if same else f'Own item {i}')}</{tag}></article></body>"

    for pages, same in ((6, 4), (6, 6), (40, 30)):
        docs = [doc(i, i < same) for i in range(pages)]
        assert html.extract(docs[0], html.infer(docs)).endswith("\nSalt and pepper")
