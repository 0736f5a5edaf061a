"""HTML extraction: the style tree against a plain version, its verdicts, and hostile pages."""

import html
import math
import random
import time
from collections import defaultdict

import pytest

from icekeel.llm import html_text

WORDS = [f"w{k}" for k in range(900)]
PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><div class="site-hint">Same on all pages</div><article><h1>{0} &amp; title</h1><p><b>Bold {0}<br><p>Text\n\tof  {0}&nbsp;&lt;b&gt;</p><aside>Side</aside><div class="comments"><p>Reader</p></div><script>1</script></article><footer>&copy; x</footer></body></html>'


def frame(spark, pages):
    """Pages with other columns, whose names also occur inside."""
    return spark.createDataFrame([(*p, 7, "x", "y", "z") for p in pages], "page_id long, url string, html string, text int, host string, low string, site string").repartition(3)


def test_html_pages(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(12)]
    pages += [(100, None, None), (101, "http://h.example/", ""), (102, "x", "<p>open <i>tag</i><div>one<p>two &eacute;"), (103, "x", "a < b <!-- c --> d"), (0, "http://h.example/0", PAGE.format(0)), (104, "x", "<" * 3000 + "p")]
    df = frame(spark, pages)
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert html_text.extract(df).count() == len(pages)
    for i in range(12):
        assert got[i].text == f"{i} & title\nBold {i}\nText of {i} <b>" and got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[100].n_chars, got[101].text) == ("", 0, "")
    assert got[102].text == "open tag\none\ntwo " + html.unescape("&eacute;") and got[103].text == "a < b d"
    assert html_text.extract(df.limit(0)).collect() == []


def nameless(r, site, k):
    """(html, text) of a page whose tags and classes say nothing: menu, advert and footer vary a little, as the number of their parts does."""
    words = lambda a, b: " ".join(r.choices(WORDS, k=r.randint(a, b)))
    title, body = words(3, 6), [words(20, 60) for _ in range(r.randint(1, 6))]
    menu = "".join(f"<div class=e><a href=/>{x}</a></div>" for x in r.sample(WORDS[:12], r.randint(4, 6)))
    page = f"<html><body><div class=a>{menu}</div><div class=b>{words(3, 6)}</div><div id=t><h1>{title}</h1><div class=c>{''.join(f'<p>{x}</p>' for x in body)}<div class=d>Like this page of {site}</div></div></div><div class=f>{site} {words(2, 4)}</div></body></html>"
    return page, "\n".join([title, *body])


@pytest.mark.parametrize("bound", [html_text.BOUND_LOW, -1])
def test_the_tree_alone_finds_the_article(spark, monkeypatch, bound):
    monkeypatch.setattr(html_text, "BOUND_LOW", bound)
    r = random.Random(3)
    made = [(f"https://Host{s}.example:80/{k}", *nameless(r, f"host{s}", k)) for s, n in enumerate((20, 9, 3, 3, 3)) for k in range(n)]
    df = frame(spark, [(i, url, page) for i, (url, page, _) in enumerate(made)])
    got = {x.page_id: x.text for x in html_text.extract(df).collect()}
    for i, (_, page, text) in enumerate(made):
        small = i >= 29  # one tree for all small hosts: what each of them repeats isn't the same on all pages
        assert got[i] == text or small and got[i].startswith(text), i
        # Without the tree the page keeps all that isn't named.
        assert "\n".join(html_text.blocks(html_text.parse(page))) != got[i]


def plain_tree(pages):
    """style_tree() in plain loops."""
    by = defaultdict(dict)
    for url, page in pages:
        by[url.split("/")[2].lower()][page] = html_text._tree_rows(html_text.parse(page))
    sites = defaultdict(list)
    for host, own in by.items():
        sites[host if len(own) >= html_text.LEAST_PAGES else ""] += own.values()
    out = {}
    for site, rows in sites.items():
        m = len(rows)
        counts = defaultdict(lambda: [0, 0])
        for page in rows:
            for path, value, words in page:
                c = counts[path, value, words > 0]
                c[0], c[1] = c[0] + 1, c[1] + words
        words, content, quiet = defaultdict(float), defaultdict(float), defaultdict(float)
        for (path, _, text), (c, w) in counts.items():
            if text:
                parts = path.split(">") if path else []
                for k in range(len(parts) + 1):
                    at = ">".join(parts[:k])
                    words[at] += w
                    content[at] += w * (1 - math.log(c) / math.log(max(m, 2)))
                    quiet[at] += 0 if "~" in path else w * (1 - math.log(c) / math.log(max(m, 2)))
        for path in words:
            same = [c for (p, _, text), (c, _) in counts.items() if p == path and not text]
            n = sum(same)
            out[site, path] = (n, 1 - sum(c * math.log(c) for c in same) / n / math.log(max(n, 2)), words[path], content[path], quiet[path] / quiet[""] if quiet[""] else 0.0)
    return out


def test_style_tree_is_what_plain_loops_give(spark):
    r = random.Random(5)
    pages = [(f"http://h{s}.example/{k}", nameless(r, f"h{s}", k)[0]) for s, n in enumerate((12, 8, 7, 2)) for k in range(n)]
    pages = [(u, p.replace("class=b>", "class=comments>") if k % 2 else p) for k, (u, p) in enumerate(pages)]
    pages += [("http://h0.example/x", pages[0][1]), ("http://h3.example/y", "")]
    got = {(x.site, x.path): x for x in html_text.style_tree(frame(spark, [(i, *p) for i, p in enumerate(pages)])).collect()}
    want = plain_tree(pages)
    assert set(got) == set(want) and {s for s, _ in got} == {"h0.example", "h1.example", ""}
    for key, (n, presentation, words, content, share) in want.items():
        x = got[key]
        assert (x.n_pages, x.words) == (n, words)
        assert abs(x.presentation - presentation) < 1e-9 and abs(x.content - content) < 1e-6 and abs(x.share - share) < 1e-9


BARE = '<html><body><div class="hint">Same on all pages</div><div class="text"><p>Story {0} goes on</p></div></body></html>'


@pytest.mark.parametrize("bound", [html_text.BOUND_LOW, -1])
def test_style_tree_drops_what_all_pages_share(spark, monkeypatch, bound):
    monkeypatch.setattr(html_text, "BOUND_LOW", bound)
    df = frame(spark, [(i, f"https://Site.example:80/{i}", BARE.format(i)) for i in range(10)] + [(50, "http://small.example/", BARE.format("x"))] * 3)
    found = {(r.site, r.path, r.main) for r in html_text.verdicts(html_text.style_tree(df)).collect()}
    assert found == {("site.example", "html>body>div.text", True), ("site.example", "html>body>div.hint", False), ("", "html>body", True)}
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[3] == "Story 3 goes on" and got[50] == "Same on all pages\nStory x goes on"


def test_comments_are_not_the_main_node(spark):
    """However long the comments are, and wherever they stand."""
    r = random.Random(8)
    words = lambda n: " ".join(r.choices(WORDS, k=n))
    made = [(words(30), words(200)) for _ in range(12)]
    page = "<body><div class=post><h1>T {k}</h1><p>{a}</p></div><div class=box><div class=comments><p>{b}</p></div></div></body>"
    got = html_text.extract(frame(spark, [(k, f"http://h/{k}", page.format(k=k, a=a, b=b)) for k, (a, b) in enumerate(made)])).collect()
    assert {x.page_id: x.text for x in got} == {k: f"T {k}\n{a}" for k, (a, _) in enumerate(made)}


def test_marked_articles():
    text = lambda page, *a: html_text.blocks(html_text.parse(page), *a)
    assert text("<main><p>whole</p><article>one</article><article>two</article></main>") == ["one"]
    assert text("<main>only</main><div>other</div>") == ["only"]
    assert text("<div class=x><article>teaser</article></div><div class=y><p>the long text itself</p></div>", {"div.x"}, "div.y") == ["the long text itself"]
    assert text("<div class=z>another kind of page</div>", {"div.x"}, "div.y") == ["another kind of page"]
    assert text('<p>a</p><script>if(a<b){x="y"}</script><style>p>a</style><textarea>q</textarea><p>c</p><script>z') == ["a", "c"]


@pytest.mark.parametrize(
    "page",
    ["<div>" * 5000 + "x" + "</div>" * 5000, "<x>" * 5000 + "x", "<p>a<x>" * 3000, '<p "' * 250_000, "<p " * 330_000, "<!x" * 300_000, "<" * 1_000_000, "<p '>x\"</p>" * 50_000, "<div>" * 2000 + "</x>" * 20_000, "<script>" + "</scrip" * 140_000, "<div>" * 3000 + "</p>" * 30_000, "<ul>" + "<li>x" * 50_000],
    ids=str.__len__,
)
def test_hostile_pages_take_seconds(page):
    began = time.perf_counter()
    nodes = html_text.parse(page)
    html_text.blocks(nodes)
    html_text._tree_rows(nodes)
    assert time.perf_counter() - began < 10
