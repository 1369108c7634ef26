import html
import re

import pytest

from stackmeter.llm import html_extract as hx


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        ("<article><h1>T</h1><p>a<b>b</b>  c<br>d</p></article>", "T\nab c d"),
        ("<body><nav><ul><li><a href=x>Menu entry</a></ul></nav><article><h1>T</h1><p>Short.</p><aside><p>side</p><p>bar</p><p>text</p><p>long</p></aside><p>End.</article><footer>&copy; f</footer>", "T\nShort.\nEnd."),
        ("<article><p>A</p><div class='ad-slot'><div>buy</div> now</div><p>B</p><section id=comments><p>reader</p></section></article>", "A\nB"),
        ("<article><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>x &lt; y</p></article>", "x < y"),
        ("<article><form><p>mail</p><input></form><p class=notice>cookies<p>Body &#233;&nbsp;z</p></article>", "Body é z"),
        ("<article><p>cut off at the end <a href='x", "cut off at the end"),
        ("<div><ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>" + "word " * 40 + "</p><p>tail.</p></div>", ("word " * 40).strip() + "\ntail."),
    ],
)
def test_pages(page, text):
    assert hx.main_text(page) == text


LINKS = "<ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Words of a class that only look like furniture.
        ("<article><h1>T</h1><p>one</p><p class='notice-period'>The notice period is two weeks.</p><p>two</p></article>", "T\none\nThe notice period is two weeks.\ntwo"),
        ("<article><h1>T</h1><section id='related-work'><h2>Related work</h2><p>Others did it.</p></section></article>", "T\nRelated work\nOthers did it."),
        # A short lead before furniture on a page that marks no article.
        (f"<p>Short lead.</p><nav>{LINKS}</nav><p>" + "word " * 40 + "</p>", "Short lead.\n" + ("word " * 40).strip()),
        ("<article><p>End.</p><div class='site-footer'>f</div><p>x</p><div class=ad>a</div></article>", "End.\nx"),
        # Short text alone between furniture.
        (f"<nav>{LINKS}</nav><p>Tiny text here.</p><footer>f</footer>", "Tiny text here."),
        (f"<nav>{LINKS}</nav><p>Opening hours</p><aside>side</aside><p>Closed today.</p><footer>f</footer>", "Opening hours\nClosed today."),
        # A form around the page.
        ("<body><form action=x><p>search</p><input><article><h1>T</h1><p>Body text.</p></article><p>send</p></form></body>", "T\nBody text."),
        ("<article><p>One.</p><form><p>mail</p></form><p>Two.</p></article>", "One.\nTwo."),
    ],
)
def test_nothing_else_is_lost(page, text):
    assert hx.main_text(page) == text


@pytest.mark.parametrize("kind", ["class", "id"])
@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "post-comments", "disqus_thread", "google-ad", "related-posts", "cookie-policy", "share-tools"])
def test_marked_furniture_goes(kind, name):
    prose = "<p>" + "word " * 30 + "</p>"
    for page in (f"<article>{prose}<div {kind}='{name}'>{prose.replace('word', 'other')}</div>{prose}</article>", f"<div>{prose}<section {kind}={name}><p>other</p></section>{prose}</div>"):
        assert "other" not in hx.main_text(page) and hx.main_text(page).count("\n") == 1


def plain_rule(page, region_only):
    """Ablation: what the marks alone would keep."""
    lines = hx.lines_of(page)
    region = max((x.region for x in lines if x.hint < 2), default=0)
    return "\n".join(x.text for x in lines if x.hint < 2 and (x.region == region or not region_only))


def test_sums_decide_where_marks_are_silent():
    """Pages without an article: menus and related links in plain elements between paragraphs of many lengths."""
    import random

    changed = right = 0
    for seed in range(50):
        rng = random.Random(seed)
        prose = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(12, 60))) + "." for _ in range(rng.randint(3, 6))]
        links = "<div>" + "".join(f"<div><a href=/{k}>link {seed} {k}</a></div>" for k in range(rng.randint(3, 8))) + "</div>"
        at = rng.randrange(1, len(prose))
        page = links + "".join(f"<p>{p}</p>" for p in prose[:at]) + links + "".join(f"<p>{p}</p>" for p in prose[at:]) + links
        want, got = "\n".join(prose), hx.main_text(page)
        right += re.sub("\n?link [0-9 ]+", "", got) == want and got.count("link") <= 6  # the ends of a row lean on the prose beside them
        changed += got != plain_rule(page, True)
    assert changed == 50 and right == 50


def test_neighbours_decide():
    """The same line stays or goes by the sums over what stands around it; without neighbours (ablation) it can't."""
    prose, link = "<p>" + "word " * 30 + "</p>", "<p><a href=x>more on this</a></p>"
    among, row = prose + link + prose, prose + LINKS + link
    assert "more on this" in hx.main_text(among) and "more on this" not in hx.main_text(row)
    heading, menu = "<main><h2>Heading</h2>{}</main>", "<nav>a</nav>"
    beside, far = heading.format("<article>" + prose + "</article>"), heading.format(menu) .replace("<h2>", menu + "<h2>") + "<article>" + prose + "</article>"
    assert "Heading" in hx.main_text(beside) and "Heading" not in hx.main_text(far)
    alone = 10**9  # so heavy a centre that neighbours count for nothing
    assert "more on this" not in hx.main_text(among, centre=alone) and "Heading" in hx.main_text(far, centre=alone)


def test_stretches_surge_and_dive():
    assert hx.sums([1.0, -1.0, 1.0], 3) == [2.0, -1.0, 2.0]
    assert hx.stretches([-1, 0.2, 3, 0, -2, 1]) == [(1, 3), (5, 6)]
    assert hx.stretches([]) == []


def brute(page):
    """The text of the test tables' pages by their template: headline and paragraphs of the article."""
    body = re.search("<article>(.*)</article>", re.sub("<!--.*?-->", "", page, flags=re.S), re.S)[1]
    blocks = [html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))) for x in re.split("</?(?:p|h1)>", body)]
    return "\n".join(" ".join(x.split()) for x in blocks if x.split())


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in hx.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()} and len(want) > 20


def test_frame(spark):
    rows = [(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (2, None, None, None), (None, "v", "<article>" + "<p>para graph</p>" * 5000 + "</article>", 1)]
    out = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    got = {(r.page_id, r.url, r.n_chars) for r in out}
    assert len(out) == 4 and got == {(1, "u", 1), (2, None, 0), (None, "v", 5000 * 11 - 1)}
    assert hx.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
