import pytest
from pyspark.sql import functions as F

from gridloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body class="x">
<header><div class="logo">Site name</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><div id="wrap"><div class="content-{n}"><h1>Title &amp; more {n}</h1>
<p>First   paragraph with <b>bold</b>, <a href="x">a link</a> &#8212; and an &eacute;.</p><!-- <p>no</p> -->
<p>Second paragraph, which is unclosed<p>Third one <br>after a break.<ul><li>item one<li>item two</ul></div>
<div class="sidebar"><p>Also read this and that, and another thing as well.</p></div></div>
<div id="comments"><p>Reader: I do not agree at all with what was said above.</p></div>
<form><input name="q"><button>Search</button></form><div class="ads">Buy now</div><footer>&copy; 2020</footer></body></html>"""
TEXT = "Title & more {n}\nFirst paragraph with bold, a link — and an é.\nSecond paragraph, which is unclosed\nThird one after a break.\nitem one\nitem two"
SCHEMA = "page_id bigint, url string, html string"


def shown(df):
    return {r.page_id: (r.text, r.n_chars) for r in df.collect()}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://h{k % 3}.example.com/p/{k}", PAGE.format(n=k)) for k in range(30)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_articles_without_their_surroundings(pages):
    for k, (text, n) in shown(html_text.extract(pages)).items():
        assert text == TEXT.format(n=k) and n == len(text)


def test_the_hosts_vote_decides(spark):
    # one page whose aside-like block is longer than its article: alone it would win, the host's path keeps it out
    normal = "<html><body><div class='story{k}'><p>" + "The article itself has this text here. " * 6 + "</p></div><div class='teaser'><p>short</p></div></body></html>"
    odd = "<html><body><div class='story7'><p>A brief article.</p></div><div class='teaser'><p>" + "Something much longer stands beside it. " * 9 + "</p></div></body></html>"
    rows = [(k, "http://one.example/x", normal.format(k=k)) for k in range(8)] + [(50, "HTTP://user:pw@ONE.example:80/y", odd), (51, "http://other.example/", odd)]
    found = shown(html_text.extract(spark.createDataFrame(rows, SCHEMA)))
    assert found[50][0] == "A brief article." and found[51][0].startswith("Something much longer")


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<main><h1>Head</h1><div class='text'><p>One long paragraph of the article stands here.</p></div></main><aside>no</aside>", "Head\nOne long paragraph of the article stands here."),
        ("<div class='article-body'><div class='lead'><p>A lead of some words.</p></div><div class='rest'><p>And the rest, which is a good deal longer than the lead.</p></div></div><div class='sidebar'>x</div>", "A lead of some words.\nAnd the rest, which is a good deal longer than the lead."),
        ("<div class='content has-sidebar'><p>The text beside a sidebar.</p></div><div id='sidebar-1'><p>Links</p></div>", "The text beside a sidebar."),
        ("<article><header><h1>Head</h1></header><p>Body text.</p><footer>tags</footer><section class='comments'><article><p>I disagree with all of this at length.</p></article></section></article>", "Head\nBody text."),
        ("<div role='banner'>top</div><td><p>In a cell</p></td><div style='display: none'>hidden</div><div class='newsletter-signup'>mail</div>", "In a cell"),
        ("<article><p>a&nbsp;b&#x41;&copy;&unknown; \n c</p><pre>x\n  y</pre><blockquote>q</blockquote></article>", "a bA©&unknown; c\nx y\nq"),
    ],
)
def test_templates(body, text):
    page = html_text.Page(f"<html><head><title>t</title></head><body>{body}</body></html>")
    assert page.text(None) == text and page.text(page.paths[page.best(1)[0][0]]) == text


def test_deep_and_unbalanced_pages_take_linear_time():
    n = 50_000
    assert html_text.Page("<div>" * n + "<p>deep</p>" + "</div>" * n).text(None) == "deep"
    assert html_text.Page("<b>" * n + "x" + "</i>" * n).text(None) == "x"
    assert len(html_text.Page("<div>y" * n).text(None).split("\n")) > 0


@pytest.mark.parametrize(
    ("body", "text"),
    [
        *[(f"<nav>menu</nav><div class='{c}'><p>The sole article of this page.</p></div><footer>f</footer>", "The sole article of this page.") for c in ("story social-science", "story alert-free", "post related-work", "chapter comment-on-law")],
        ("<div class='content-sidebar-wrap'><article><h1>Head</h1><p>All of the article.</p></article></div>", "Head\nAll of the article."),
        ("<form id='aspnetForm'><div class='sidebar'><p>Links here</p></div><article><p>All of the article.</p></article></form>", "All of the article."),
        ("<article><p>Short.</p></article><div id='comments'>" + "<p>Readers write far more than the author did.</p>" * 9 + "</div>", "Short."),
        ("<article></article><div class='ad'>Buy this now, it is cheap and good.</div>", ""),
        ("<article><p>The rule <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", "The rule x=2 holds."),
    ],
)
def test_class_words_alone_drop_no_article(body, text):
    assert html_text.Page(f"<html><body>{body}</body></html>").text(None) == text


def test_hosts_settle_what_class_words_leave_open(spark):
    # on one host the suspected element is the article on most pages, on the other it is a box beside it
    page = "<html><body><div class='a'><p>{}</p></div><div class='related-box'><p>{}</p></div></body></html>"
    long, short = "A long run of sentences that goes on and on. " * 30, "One short line."
    rows = [(k, "http://x.example/", page.format("", long)) for k in range(6)] + [(6, "http://x.example/", page.format("Tiny", short))]
    rows += [(k + 10, "http://y.example/", page.format(long, short)) for k in range(6)] + [(16, "http://y.example/", page.format("Tiny", long))]
    found = shown(html_text.extract(spark.createDataFrame(rows, SCHEMA)))
    assert found[0][0] == long.strip() and found[6][0] == short and found[10][0] == long.strip() and found[16][0] == "Tiny"


@pytest.mark.parametrize("part", ["<a ", "<ul>", "<svg>", "<a \"", "<p", "<td>", "<li><ul>", "<!--", "<x '>", "<a \"<b '>", "<div class='ad'>", "<p><b>", "<! ", "<script", "</p>", "<dl><dt>", "<a href='x\">y</a>"])
def test_a_million_characters_of_anything_are_read_in_seconds(part):
    import time

    began = time.process_time()
    html_text.Page("<p>start</p>" + part * (1_000_000 // len(part))).text(None)
    assert time.process_time() - began < 30


def slow_scores(page):
    """Scores of containers by walking up from every block, one container at a time."""
    out = {}
    for n, (_, _, _, good, _) in enumerate(page.nodes):
        total, found = 0.0, False
        for node, text, linked in page.blocks:
            at, steps = node, 0
            while at != n and at >= 0 and not page.nodes[at][4]:
                at, steps = page.nodes[at][0], steps + 1
            if at == n and 0.75**steps > 1e-6:
                total, found = total + (max(0.0, len(text) - 2.0 * linked) + 5.0) * 0.75**steps, True
        if found:
            doubts, at = 0, n
            while at >= 0:
                doubts, at = doubts + page.nodes[at][4], page.nodes[at][0]
            out[n] = (total * (1 + 0.25 * good) * 0.2**doubts, doubts)
    if any(t in ("article", "main") and not _doubts(page, n) for n, (_, t, *_) in enumerate(page.nodes)):
        out = {n: x for n, x in out.items() if not x[1]}
    return {n: s for n, (s, _) in out.items()}


def _doubts(page, n):
    return 0 if n < 0 else page.nodes[n][4] + _doubts(page, page.nodes[n][0])


def _steps(page, n):
    return () if n <= 0 else (*_steps(page, page.nodes[n][0]), page.nodes[n][2])


def slow_extract(rows):
    """Voting and extraction over dictionaries; paths are tuples of steps."""
    pages = {k: (url, html_text.Page(source)) for k, url, source in rows}
    votes = {}
    for url, page in pages.values():
        host = url.split("/")[2]
        ranked = sorted(slow_scores(page).items(), key=lambda x: (-x[1], x[0]))[:3]
        for place, (n, s) in enumerate(ranked):
            by = votes.setdefault(host, {})
            by[_steps(page, n)] = by.get(_steps(page, n), 0) + round(1000 * s / sum(x for _, x in ranked)) + 1000 * (place == 0)
    out = {}
    for k, (url, page) in pages.items():
        by = votes.get(url.split("/")[2], {})
        path = max(by, key=by.get) if by else None
        chosen = [n for n in range(len(page.nodes)) if _steps(page, n) == path] or [n for n, _ in sorted(slow_scores(page).items(), key=lambda x: (-x[1], x[0]))[:1]]
        lines = []
        for node, text, _ in page.blocks:
            at = node
            while at >= 0 and at not in chosen and not page.nodes[at][4]:
                at = page.nodes[at][0]
            if at in chosen:
                lines.append(text)
        out[k] = ("\n".join(lines), len("\n".join(lines)))
    return out


def test_scores_and_votes_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    names = ["", " class='story'", " class='ad box'", " id='comments'", " class='main-col'", " class='related'", " class='p7'"]

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{'word ' * rng.randint(0, 40)}<a href='x'>{'link ' * rng.randint(0, 3)}</a></p>"
        tag = rng.choice(["div", "section", "div", "article", "ul", "form", "td"])
        return f"<{tag}{rng.choice(names)}>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    templates = [[part(3) for _ in range(2)] for _ in range(6)]
    rows = []
    for k in range(90):
        host = k % 5
        rows.append((k, f"http://h{host}.example/{k}", "<html><body>" + "".join(rng.sample(templates[host], 2)) + part(2) + "</body></html>"))
    assert shown(html_text.extract(spark.createDataFrame(rows, SCHEMA).repartition(3))) == slow_extract(rows)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "http://h.example", "just text &lt;here&gt; &nbsp; now"), (4, "http://h2.example", "<p>"), (5, "http://h3.example", "<div><p>unclosed <b>all <i>the way"), (6, "http://h4.example", "</div></p>stray <p>ends</div> here"), (7, "http://h5.example", "<script>never ends <p>x</p>"), (8, "http://h6.example", "<p>a < b and c > d & e</p>"), (None, "http://h7.example", "<article><p>no key</p></article>"), (9, "", "<article>" + "<p>long paragraph text here</p>" * 20_000 + "</article>"), (10, "http://h8.example", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    found = shown(html_text.extract(spark.createDataFrame(rows, SCHEMA)))
    assert found[1] == ("", 0) and found[2] == ("", 0) and found[3][0] == "just text <here> now" and found[4][0] == "" and found[5][0] == "unclosed all the way"
    assert found[6][0].replace("\n", " ") == "stray ends here" and found[7] == ("", 0) and found[8][0] == "a < b and c > d & e" and found[None][0] == "no key"
    assert found[9][0] == "\n".join(["long paragraph text here"] * 20_000) and found[10][0] == "deep"


def test_repeated_rows_and_clashing_names(pages):
    twice = pages.union(pages)
    wide = twice.select("*", *[F.lit("q").alias(c) for c in ("host", "path", "votes", "n", "text", "n_chars", "id", "_host", "best")])
    out = html_text.extract(wide)
    assert out.count() == 60 and shown(out) == shown(html_text.extract(pages))


def test_many_hosts_take_the_join(pages, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_text, "HOT_KEYS", 2)  # the larger hosts are looked up by broadcast all the same
    assert shown(html_text.extract(pages)) == {k: (TEXT.format(n=k), len(TEXT.format(n=k))) for k in range(30)}


def test_empty(spark):
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
