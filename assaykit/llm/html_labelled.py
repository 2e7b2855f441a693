"""The labelled table that the block classifier of html_text.py is trained on: some small page layouts, written for this purpose.

`+{n}` is a block of n words that belongs to the main text, `-{n}` one that doesn't; `+{n:words}` and `-{n:words}` begin with
the given words. Each layout is taken with its numbers of words times each of SCALES, parsed like any page, and each of its
blocks is a row of the table.
"""

SCALES = (0.6, 1.0, 1.7, 2.9)

LAYOUTS = (
    # a marked article between menu, advert and footer, with short and long paragraphs
    """<body><nav><ul><li><a href=1>-{1}</a><li><a href=2>-{2}</a><li><a href=3>-{1}</a></ul></nav><div class="ad">-{8}</div>
    <article><h1>+{7}</h1><p>+{60}<p>+{3}<p>+{1}<p>+{120}</article><footer>-{9:© example}</footer>""",
    """<body><nav><a href=1>-{1} -{1}</a></nav><div class="ad-slot">-{30}</div><article><h1>+{2}</h1><p>+{1}</p><p>+{4}</p></article><footer>-{25:©}</footer>""",
    """<body><div class="ad">-{5}</div><article><p>+{2}</p></article><footer>-{14}</footer>""",
    """<body><nav><ul><li><a href=1>-{3}</a></ul></nav><article><h1>+{9}</h1><p>+{40}<ul><li>+{4}<li>+{9}<li><a href=9>+{3}</a></ul>
    <p>+{25}<blockquote>+{18}</blockquote><h2>+{3}</h2><p>+{2}<table><tr><td>+{1}<td>+{2}<tr><td>+{1}<td>+{3}</table></article><footer>-{6}</footer>""",
    # heads and notes within the article
    """<body><header><a href=0>-{2}</a><p>-{6}</p></header><main><article><header><h1>+{8}</h1><p>+{5}</p></header><p>+{70}
    <aside><h3>-{2}</h3><p>-{22}</p></aside><p>+{55}<figure><figcaption>+{7}</figcaption></figure><div class="share"><a href=1>-{1}</a> <a href=2>-{1}</a></div>
    <footer>-{8}</footer></article></main><footer><p>-{12:copyright}</p></footer>""",
    # reader comments below or within the article
    """<body><div id="content"><article><h1>+{5}</h1><p>+{80}<p>+{35}<section class="comments"><h2>-{2:comments}</h2><article><p>-{40}</p></article>
    <article><p>-{90}</p></article><form><label>-{2}</label><p>-{5}</p></form></section></article></div><footer>-{5}</footer>""",
    """<body><main><h1>+{6}</h1><p>+{50}</p><p>+{12}</p></main><div id="comment-list"><ul><li><b>-{2}</b><p>-{25}</p><li><p>-{60}</p></ul></div>""",
    """<body><div><h1>+{6}</h1><p>+{90}</p><p>+{45}</p><h3>-{2:comments}</h3><p>-{3}</p><p>-{35}</p><p>-{70}</p></div>""",
    """<body><div><h2>+{4}</h2><p>+{65}</p><h3>-{3:leave a reply}</h3><p>-{12}</p></div>""",
    # boxes named by their class only
    """<body class="no-sidebar"><div class="top-menu"><a href=1>-{1}</a> <a href=2>-{1}</a></div><div id="sidebar"><h3>-{2}</h3><p>-{30}</p><p>-{4}</p></div>
    <div class="post-content"><h2>+{6}</h2><p>+{45}<p>+{2}<p>+{38}</div><div class="related-posts"><h3>-{2}</h3><p>-{14}</p><p><a href=1>-{9}</a></p></div>
    <div class="site-footer"><p>-{20}</p></div>""",
    """<body><div class="cookie-banner"><p>-{34:we use cookies}</p><button>-{1}</button></div><div class="entry"><p>+{25}<p>+{6}<p>+{19}</div>
    <div class="newsletter-signup"><p>-{15:subscribe}</p></div><div class="promo"><p>-{28}</p></div>""",
    """<body><div class="header"><h1>-{3}</h1><p>-{9}</p></div><div class="story"><h1>+{8}</h1><p>+{15}<p>+{100}<p>+{8}</div><div class="widget"><p>-{18}</p></div><div class="footer">-{7}</div>""",
    """<body><div class="sidebar-layout"><main><h1>+{4}</h1><p>+{30}<p>+{5}<p>+{60}</main><div class="sidebar"><p>-{21}</p><ul><li><a href=1>-{4}</a><li><a href=2>-{6}</a></ul></div></div>""",
    """<body><div id="notice">-{20}</div><div id="main"><p>+{12}<p>+{33}</div><div class="login"><form>-{3}</form></div>""",
    # tables and boxes without names: words and links must do
    """<body><table><tr><td><a href=1>-{1}</a><br><a href=2>-{2}</a><br><a href=3>-{1}</a><td><p>+{75}</p><p>+{40}</p><p>+{55}</p><td><a href=1>-{3}</a></table>""",
    """<body><div><a href=1>-{2}</a> | <a href=2>-{1}</a> | <a href=3>-{1}</a></div><div><h1>+{5}</h1><div>+{48}</div><div>+{90}</div><div>+{30}</div></div><div><a href=4>-{3}</a> <a href=5>-{2}</a></div><div>-{5:copyright}</div>""",
    """<body><ul><li><a href=1>-{1}</a><li><a href=2>-{1}</a><li><a href=3>-{2}</a></ul><h1>+{6}</h1><p>+{52}</p><p>+{33}</p><p>+{14}</p><p>+{47}</p><ul><li><a href=4>-{5}</a><li><a href=5>-{6}</a></ul><p>-{6:all rights reserved}</p>""",
    """<body><p>+{140}</p>""",
    """<body>+{80}<p>+{60}<p>+{11}<p>+{33}""",
    """<body><h1>+{3}</h1><p>+{22}</p><p>+{17}</p><p>+{9}</p><p>+{41}</p>""",
    """<body><div><p><a href=1>-{6}</a></p><p><a href=2>-{8}</a></p><p><a href=3>-{7}</a></p></div><p>-{4:© by}</p>""",
    """<body><div><a href=1>-{2}</a></div><div>-{3}</div><div><a href=2>-{2}</a></div><div>-{2}</div><div><a href=3>-{4}</a></div>""",
    """<body><h2>+{4}</h2><p>+{28}</p><h2>+{3}</h2><p>+{36}</p><h2>+{5}</h2><p>+{19} <a href=1>{2}</a> {20}</p><p>+{26} <a href=2>{9}</a> {8}</p>""",
    """<body><table><tr><td><table><tr><td><a href=1>-{2}</a><td><a href=2>-{1}</a></table><tr><td><p>+{37}</p><p>+{58}</p><ul><li>+{16}<li>+{21}</ul><p>+{64}</p><tr><td>-{7:copyright}</table>""",
    """<body><h1>+{5}</h1><p>+{3}</p><p>+{85}</p><p>+{4}</p><p>+{72}</p><div><a href=1>-{3}</a></div><div><a href=2>-{5}</a></div>""",
    """<body><div><h3><a href=1>-{7}</a></h3><p>-{11}</p><h3><a href=2>-{6}</a></h3><p>-{13}</p><h3><a href=3>-{8}</a></h3><p>-{10}</p></div>""",
    """<body><div>-{2}</div><div><a href=1>-{1}</a></div><div>-{1}</div><div>+{6}</div><div>+{43}</div><div>+{61}</div><div>+{8}</div><div>+{39}</div><div>-{2}</div><div><a href=2>-{2}</a></div>""",
    """<body><div><a href=1>-{2}</a></div><div>-{6:sponsored}</div><div>+{55}</div><div>-{4:subscribe}</div><div>+{47}</div><div>+{29}</div><div>-{8:share this}</div><div>-{14:this site uses cookies}</div>""",
    # forms, alone and around the whole page
    """<body><form class="search"><p>-{2}</p></form><article><p>+{31}<p>+{3}</article><form><p>-{12}</p><label>-{2}</label></form>""",
    """<body><form id="page"><div class="menu"><a href=1>-{2}</a></div><div class="content"><h1>+{4}</h1><p>+{66}<p>+{50}<p>+{31}</div><div class="footer">-{8}</div></form>""",
    # pages without a main text
    """<body><nav><ul><li><a href=1>-{2}</a><li><a href=2>-{1}</a></ul></nav><footer>-{10:©}</footer>""",
    """<body><aside><p>-{45}</p></aside><footer><p>-{30}</p><p>-{3}</p></footer>""",
)
