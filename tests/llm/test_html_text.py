"""Main text of pages: layouts that the tree wasn't trained on, the parser's cases, and the given pages."""

import html
import re

import pytest

LONG = "The river rose over its banks in the night and by the morning most of the lower town stood under water, which nobody who lived there had seen before in their lives."
MORE = "Engineers who came the next day found that two of the three gates had failed to close, and that the third had been left open for repairs since the spring of that year."
SHORT = "Nobody was hurt."

#: (page, text that must stay, in order; text that must go)
PAGES = {
    "blog": (
        f"""<html><head><title>Floods</title><meta name=x><link rel=a></head><body class="single post sidebar-right"><div id="page"><header id="masthead" class="site-header">
        <p>Daily Post</p><p>News from the valley since 1904</p><nav class="main-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News of the day</a></ul></nav></header>
        <div id="content"><article id="post-7" class="post hentry"><header class="entry-header"><h1 class="entry-title">The river rose</h1></header><div class="entry-content"><p>{LONG}</p><p>{SHORT}</p>
        <h2>What failed</h2><ul><li>Gate one</li><li>Gate <b>t</b>wo</li></ul><p>{MORE}</p><div class="adsbygoogle">Buy boats now, half price while they last</div><p>End.</p></div></article>
        <div id="comments" class="comments-area"><h2>2 Comments</h2><ol class="comment-list"><li><article><p>{MORE} I saw it too.</p></article><li><p>Me too!</p></ol>
        <form id="commentform"><p>Leave a reply</p><textarea>hm</textarea><button>Send</button></form></div></div>
        <aside class="widget-area"><h3>About</h3><p>{LONG} All about us.</p></aside><footer class="site-footer"><p>&copy; 2020 Daily Post. {SHORT} Imprint.</p></footer></div></body></html>""",
        ["The river rose", LONG, SHORT, "What failed", "Gate one", "Gate two", MORE, "End."],
        ["Daily Post", "Home", "Floods", "Buy boats", "Comments", "Me too", "saw it", "Leave", "Send", "All about us", "Imprint", "hm"],
    ),
    "classes only": (
        f"""<div class=topbar><a href=a>Login</a></div><div class="cookieNotice">{LONG} We use cookies.</div><div class="leftSidebar"><p>{MORE} Weather.</p></div><div class="storyText"><h1>Gates</h1><p>{LONG}<p>{MORE}<p>{SHORT}</div>
        <div class="relatedArticles"><p>{SHORT} See also.</p></div><div class="pageFooter">{SHORT} Contact.</div>""",
        ["Gates", LONG, MORE, SHORT],
        ["Login", "cookies", "Weather", "See also", "Contact"],
    ),
    "no names": (
        f"""<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h1>Water in the lower town</h1><p>{LONG}</p><p>{MORE}</p><p>{LONG} {MORE}</p></div><div><a href=5>Imprint</a></div><p>Copyright by us</p>""",
        ["Water in the lower town", LONG, MORE, f"{LONG} {MORE}"],
        ["Home", "News", "Imprint", "Copyright"],
    ),
    "main": (
        f"""<header><h1>Site</h1></header><main><section><h2>One</h2><p>{LONG}</section><section><h2>Two</h2><p>{MORE}<table><tr><th>Gate<th>State<tr><td>1<td>shut</table></section></main><dialog>Sign up today</dialog>""",
        ["One", LONG, "Two", MORE, "Gate", "State", "1", "shut"],
        ["Site", "Sign up"],
    ),
    "whole-page form": (
        f"""<form method=post id=aspnetForm><div class=menu><a href=1>a</a></div><div id=main><p>{LONG}</p><p>{MORE}</p></div></form>""",
        [LONG, MORE],
        ["a\n"],
    ),
}


@pytest.fixture(scope="module")
def tree(spark):
    from assaykit.llm.html_text import trained

    return trained(spark)


def test_layouts_it_was_not_trained_on(spark, tree):
    from assaykit.llm.html_text import main_texts

    rows = [(i, name, page, "clash") for i, (name, (page, _, _)) in enumerate(PAGES.items())]
    got = {r.url: r for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), tree).collect()}
    for name, (_, stay, go) in PAGES.items():
        assert got[name].text == "\n\n".join(stay), name
        assert not [g for g in go if g in got[name].text], name
        assert got[name].n_chars == len(got[name].text)


def test_given_pages(spark):
    from assaykit.llm.html_text import main_texts

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id", "url", "CAST(NULL AS STRING)").limit(1))
    got = {(r.page_id, r.text) for r in main_texts(pages).collect()}
    want = set()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html or "<article>", re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        want.add((r.page_id, "\n\n".join(p for p in parts if p)))
    assert got == want


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("a < b &amp; c", ["a < b & c"]),
        ("<p>a\n\t b&nbsp;c<br>d<p>e", ["a b c d", "e"]),
        ("<p>x<b>y</b>z</p>", ["xyz"]),
        ("<p title='a>b' data-x=\"</p>\">t</p>", ["t"]),
        ("<p title=it's>t</p><p>u", ["t", "u"]),
        ("<script>if (a<b) '</p>'</script>t<style>p{}</style><!-- no --><!-->u", ["tu"]),
        ("<script>never closed <p>t", []),
        ("t<!-- never closed <p>u", ["t"]),
        ("t<p class='never closed <p>u", ["t"]),
        ("a &am", ["a &am"]),
        ("&#0;&#99999999999;&#xD800;&#0000000065;" + "&#" + "9" * 6000 + ";", ["���A�"]),
        ("</p></div>t</nav>", ["t"]),
        ("<DIV>t</DIV><TITLE>no</TITLE>", ["t"]),
        ("<svg><text>no</text></svg>t", ["t"]),
        ("<div><svg>no</div>t", ["t"]),
    ],
)
def test_blocks(page, texts):
    from assaykit.llm.html_text import blocks

    assert [b.text for b in blocks(page)] == texts


def test_very_long_pages_take_time_in_proportion():
    from assaykit.llm.html_text import blocks

    for page in ("<a " * 400_000 + '"', "<div>" * 200_000 + "</p>" * 200_000 + "t", "&" * 500_000, "<!" * 500_000, "<p =" * 300_000, "<li>x" * 100_000, '<a b="' * 300_000):
        blocks(page)


def test_tables_without_rows_or_values(spark, tree):
    from assaykit.llm.html_text import main_texts

    schema = "page_id long, url string, html string"
    assert main_texts(spark.createDataFrame([], schema), tree).collect() == []
    rows = [(None, None, None), (None, None, None), (1, "u", ""), (1, "u", "<nav>x</nav>"), (2, None, f"<article>{LONG}")]
    got = sorted(tuple(r) for r in map(lambda r: (r.page_id or 0, r.url or "", r.text, r.n_chars), main_texts(spark.createDataFrame(rows, schema), tree).collect()))
    assert got == [(0, "", "", 0), (0, "", "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, "", LONG, len(LONG))]
