import re
import time

import pyarrow.parquet as pq

from foldspark.llm import html
from foldspark.llm.html import content_lines, extract, extract_pages, smooth

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies.</div><div class="ad">Buy   this now, it is a very long advertisement text indeed.</div>
<article><h1>Head&amp;line</h1><p>One <b>bold</b>&nbsp;word.<br>Next<p>Short.<form><input name=q>Search here</form>
<div class="related">See also this</div><section id="comments"><p>I disagree with all of this.</p></section><p>Last &eacute;&#233; end.</p></article>
<aside>Side</aside><footer>&copy; all</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert extract(PAGE) == "Head&line\nOne bold word. Next\nShort.\nLast éé end."


def test_pages_without_an_article_element():
    page = "<body><div id=menu><a>x</a><a>y</a></div><div id=content><p>" + "A long paragraph of text. " * 8 + "<p>Tiny.<p>" + "Another long one it is. " * 8 + "</div><div id=footer>foot</div></body>"
    assert extract(page).split("\n")[1] == "Tiny." and "foot" not in extract(page) and "x" not in extract(page).split("\n")


def test_odd_pages():
    assert extract(None) == extract("") == extract("<nav>only</nav>") == extract("<script>x</script>") == ""
    assert extract("just text") == "just text"
    assert extract("<article><p>open <b>never closed") == "open never closed"
    assert extract("<article>" + "<p>x" * 3000) == "\n".join("x" * 3000)
    assert extract("<div>a</span></p></div>b") in ("a\nb", "a", "b")


def test_end_tags_may_be_left_out():
    assert extract("<body><form><select><option>A<option>B</select></form><p>" + "The text of the page. " * 5) == ("The text of the page. " * 5).strip()
    assert extract("<body><div><datalist><option>A<option>B</datalist></div><p>The text of the page.") == "The text of the page."
    assert extract("<article><p>One.<datalist><option>A<option>B</datalist><p>Two.</article>") == "One.\nTwo."
    assert extract("<html><head><title>T</title><body><p>The text of the page.") == "The text of the page."
    assert extract("<head><title>T</title><p>The text of the page.") == "The text of the page."
    assert extract("<head><title>T</title><script>x</script></head><p>The text of the page.") == "The text of the page."


def test_all_articles_and_a_main_beside_small_ones():
    long = ("A long paragraph of text, and more of it. " * 6).strip()
    two = f"<body><main><article><p>{long}</article><article><p>Second. {long}</article></main>"
    assert extract(two) == f"{long}\nSecond. {long}"
    assert extract(two.replace("main>", "div>")) == f"{long}\nSecond. {long}"
    assert extract(f"<body><main><p>{long}<p>{long}<article><p>A card.</article></main>") == f"{long}\n{long}\nA card."
    assert extract(f"<body><main><p>{long}<p>{long}</main><article><p>A card.</article>") == f"{long}\n{long}"


def test_smoothing_and_threshold():
    assert smooth([5.0] * 4) == [5.0] * 4
    good = content_lines([1.0, 1.0, 90.0, 5.0, 80.0, 1.0, 1.0, 1.0])
    assert good[2] and good[3] and good[4] and not good[-1]


LONG = ("A long paragraph of text, and more of it. " * 6).strip()
BARE = (
    "<body><div><h2><a href=/>The paper</a></h2>" + "".join(f"<div><a href=/{i}>A link to story number {i}</a></div>" for i in range(40)) + "</div>"
    f"<div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>" + "".join(f"<div><a href=/{i}>Read {i}</a></div>" for i in range(10)) + "</div></body>"
)


def test_the_clusters_choose_the_region(monkeypatch):
    """Links that hold more text than the article: only ratios tell them apart."""
    want = f"Title\n{LONG}\nShort.\n{LONG}"
    assert extract(BARE) == want
    for other in (lambda r: [True] * len(r), lambda r: [n % 2 == 0 for n in range(len(r))], lambda r: [not x for x in content_lines(r)]):
        monkeypatch.setattr(html, "content_lines", other)
        assert extract(BARE) != want
        monkeypatch.setattr(html, "content_lines", content_lines)


def test_the_clusters_bound_a_region_without_an_element_of_its_own(monkeypatch):
    page = "<body>" + "".join(f"<div><a href=/{i}>Go {i}</a></div>" for i in range(9)) + f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>End.</p>" + "".join(f"<div><a href=/{i}>To {i}</a></div>" for i in range(9))
    want = f"Title\n{LONG}\nShort.\n{LONG}\nEnd."
    assert extract(page) == want
    monkeypatch.setattr(html, "content_lines", lambda r: [True] * len(r))
    assert extract(page) != want


def test_pages_need_no_article_element():
    """The method alone against the tags: the same texts with every article and main element renamed, and nearly all of them without any tag or class that marks a part."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    want = [extract(p) for p in pages]
    assert [extract(re.sub(r"<(/?)(article|main)\b", r"<\1div", p)) for p in pages] == want
    bare = [extract(re.sub(r"<(/?)(article|main|nav|footer|aside|header)\b", r"<\1div", p).replace(' class="ad"', "")) for p in pages]
    assert sum(a == b for a, b in zip(want, bare, strict=True)) >= 0.97 * len(pages)


def test_names_hide_parts_and_never_wrappers():
    assert extract(f'<body><div class="layout has-sidebar"><p>{LONG}<div class="sidebar">Side</div><p>{LONG}</div>') == f"{LONG}\n{LONG}"
    assert extract(f'<body class="with-ads"><div class="ads"><h1>T</h1><p>{LONG}</div>') == f"T\n{LONG}"
    assert extract(f'<article><div class="article-header"><h1>Title</h1></div><div class="header"><p>By me</div><p>{LONG}</article>') == f"Title\nBy me\n{LONG}"
    assert extract(f'<article><p>{LONG}<p class="advert">Buy<p>More.<div class="siteFooter">x</div><div id="cookie-notice">x</div><div class="ad-slot-3">x</div></article>') == f"{LONG}\nMore."
    comments = "".join(f'<article class="comment"><p>{LONG} {i}</article>' for i in range(9))
    assert extract(f'<body><article><h1>T</h1><p>{LONG}</article><div class="comments">{comments}</div>') == f"T\n{LONG}"
    assert extract(f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo></math>1, <button>Like</button>so.<svg><text>no</text></svg></article>") == f"{LONG} x=1, so."


def test_lists_and_tables_at_the_edges_stay_whole():
    parts = ["alpha", "beta", "gamma"]
    items = "<ul>" + "".join(f"<li>{x}</li>" for x in parts) + "</ul>"
    assert extract(f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p>{items}</div>").split("\n") == ["T", LONG, LONG, *parts]
    assert extract(f"<div>{items}<p>{LONG}</p><p>{LONG}</p></div>").split("\n") == [*parts, LONG, LONG]
    assert extract(f"<div><p>{LONG}</p><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c<td>d</table></div>").split("\n") == [LONG, LONG, *"abcd"]
    assert extract(f"<div><p>{LONG}</p><p>{LONG}</p><pre>x = 1</pre></div>").split("\n") == [LONG, LONG, "x = 1"]
    assert extract(f"<div><div>{LONG}</div><div>{LONG}</div><div>The end.</div></div>").split("\n") == [LONG, LONG, "The end."]
    links = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a></li>" for x in parts) + "</ul>"
    assert extract(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div>{links}</div><div>{items}</div>") == f"{LONG}\n{LONG}"
    assert extract(f"<div><p>{LONG}</p><p>{LONG}</p>{links}</div>") == f"{LONG}\n{LONG}"


def test_forms_around_a_page_hide_nothing():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    wrapped = [re.sub("</body>", "</form></body>", re.sub("(<body[^>]*>)", r"\1<form action=/>", p)) for p in pages]
    assert [extract(p) for p in wrapped] == [extract(p) for p in pages] and wrapped != pages
    inner = f"<h1>T</h1><p>{LONG}<form><p>Search <input></form><p>{LONG}"
    assert extract(f"<body><form><fieldset>{inner}</fieldset></form>") == f"T\n{LONG}\n{LONG}"
    assert extract(f"<body><p>{LONG}<form><p>Your name <input><p>Your mail <input></form>") == LONG


def test_elements_without_an_end_tag_mute_only_up_to_the_next_block():
    for tag in ("iframe", "button", "select", "video"):
        assert extract(f"<div><p>{LONG}<{tag}>No.<p>More.<{tag}>No.</{tag}><p>{LONG}</div>") == f"{LONG}\nMore.\n{LONG}"
        assert extract(f"<div><p>{LONG}<p>One.<{tag}>No.</p>Two.<p>{LONG}</div>") == f"{LONG}\nOne.\nTwo.\n{LONG}"
        assert extract(f"<div><p>{LONG}<{tag}><div>No.</div></{tag}> End.<p>{LONG}</div>") in (f"{LONG}\nEnd.\n{LONG}", f"{LONG} End.\n{LONG}")


def test_deep_pages_take_time_in_proportion():
    def seconds(page):
        began = time.process_time()
        extract(page)
        return time.process_time() - began

    for tag in ("article", "main"):
        assert extract(f"<{tag}>x" * 100_000) == "\n".join("x" * 100_000)
    small, large = (max(seconds("<div>x" * n + "</section>" * n + "</div>" * n) for _ in range(2)) for n in (10_000, 80_000))
    assert large < 24 * small + 0.5


def test_rows(spark):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, None)]
    found = sorted(tuple(r) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).na.fill("-").collect())
    text = extract(PAGE)
    assert found == [(1, "u", text, len(text))] * 2 + [(2, "-", "", 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
