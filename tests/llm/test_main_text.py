from riskloom.llm import main_text as M

SENTENCE = "This is the text of an article that has been written for the readers of the site and it is long enough to be told from a menu. "

PAGE = f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home of the site</a><p>{SENTENCE}</p></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice">{SENTENCE}</div><!-- <p>{SENTENCE}</p> -->
<main><article><header><h1>A head&shy;line &amp; more</h1></header><p>{SENTENCE}<b>Bold</b>&nbsp;end<br>of  it.</p><p>Of.<p>Open paragraph
with a <a href="/x">link</a>.</p><div class="advert"><p>{SENTENCE}</p></div><ul><li>First point</li><li>Second point</li></ul>
<aside>{SENTENCE}</aside><form><label>Name</label><input value="x"></form><section id="comments"><p>{SENTENCE}</p></section><p>Last.</p></article></main>
<div class="sidebar"><p>{SENTENCE}</p></div><footer>&copy; {SENTENCE}</footer></body></html>"""


def test_article_only():
    line = SENTENCE.strip()
    assert M.main_text(PAGE) == "\n\n".join(["A head­line & more", f"{line} Bold end of it.", "Of.", "Open paragraph with a link.", "First point", "Second point", "Last."])


def test_rules_without_article():
    """Long blocks with stop words are text, menus are not, and short blocks go with their neighbours."""
    body = f"<div><a href='/'>Home</a> <a href='/b'>All</a></div><h2>Head</h2><p>{SENTENCE * 2}</p><p>Short one.</p><p>{SENTENCE * 2}</p><div>{'lorem ' * 60}</div><p>Imprint</p>"
    assert M.main_text(body) == "\n\n".join([" ".join((SENTENCE * 2).split()), "Short one.", " ".join((SENTENCE * 2).split())])


def test_cut_and_broken_pages():
    assert M.main_text(f"<article><p>{SENTENCE}</p><p>Cut &amp") == f"{SENTENCE.strip()}\n\nCut &"
    assert M.main_text(f"<article><p>{SENTENCE}</p><p>Cut <a hre") == f"{SENTENCE.strip()}\n\nCut"
    assert M.main_text(f"<article><p>{SENTENCE}</p><script>never closed <p>no</p>") == SENTENCE.strip()
    assert M.main_text("</p></div><b>") == M.main_text("") == M.main_text(None) == M.main_text("<!-- never closed <p>x</p>") == ""
    assert M.main_text("<article>1 < 2 and 3 > 2</article>") == "1 < 2 and 3 > 2"


def test_very_long_page():
    assert len(M.main_text(f"<article>{'<p>' + SENTENCE + '</p>'}" * 5000)) == 5000 * (len(SENTENCE) - 1) + 4999 * 2


def test_table(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = from_ = M.extract_pages(pages)
    assert from_.columns == ["page_id", "url", "text", "n_chars"]
    text = M.main_text(PAGE)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert M.extract_pages(pages.limit(0)).count() == 0


def test_layout_names_keep_the_article():
    three = "".join(f"<p>{SENTENCE}{SENTENCE[:90]}</p>" for _ in range(3))
    want = "\n\n".join([f"{SENTENCE}{SENTENCE[:90]}".strip()] * 3)
    for page in (
        f'<article class="post no-sidebar">{three}</article>', f'<div class="site has-sidebar">{three}</div>', f'<div id="page" class="sticky-header">{three}</div>',
        f'<div class="header-fixed"><nav>x</nav><div class="menu-open"><h1></h1>{three}</div><div class="cookie-notice">{SENTENCE}</div></div>',
    ):
        assert M.main_text(page) == want, page


def test_named_parts_stay_out():
    three = "".join(f"<p>{SENTENCE}</p>" for _ in range(3))
    for name in ("comments", "sidebar", "cookie-notice", "related", "newsletter"):
        assert M.main_text(f'<article><p>{SENTENCE}</p></article><div class="{name}">{three}</div>') == SENTENCE.strip()
    assert M.main_text(f'<div class="comments"><h1>x</h1>{three}</div>') == ""
    assert M.main_text(f'<div class="cookie-notice"><p>{SENTENCE}</p></div><nav>Home</nav>') == ""


def test_short_paragraphs_without_article():
    page = f"<div><a href='/'>Home</a> <a href='/b'>All</a></div><h2>Head</h2><p>{SENTENCE}</p><p>Short.</p><p>{SENTENCE}</p><div><a href='/c'>Imprint</a></div>"
    assert M.main_text(page) == f"{SENTENCE.strip()}\n\nShort.\n\n{SENTENCE.strip()}"


def test_links_of_thrown_out_anchors_end_with_them():
    page = f"<p>{SENTENCE * 2}<a class='share' href='/s'>Share</a></p><p>{SENTENCE * 2}</p>"
    assert M.main_text(page) == "\n\n".join([" ".join((SENTENCE * 2).split())] * 2)
