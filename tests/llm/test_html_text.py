"""HTML extraction: composite text density against a recursive brute force over random trees; layouts; malformed markup."""

import random
import time
from html import escape
from math import e, log

import pytest

from relief.llm import html_text as X

# ---- brute force: nested lists (tag, class, [children or text]), densities by recursion from their definition

SKIP = {"nav", "footer", "aside", "script", "form"}
INLINE = {"a", "b", "span"}


def gone(t):
    return t[0] in SKIP or t[1] in ("ad", "sidebar", "comments")


def count(t, link=False):
    """(characters, tags, link characters, link tags) of a subtree."""
    if isinstance(t, str):
        n = len("".join(t.split()))
        return n, 0, n if link else 0, 0
    link = link or t[0] == "a"
    parts = [(c, count(c, link)) for c in t[2] if isinstance(c, str) or not gone(c)]
    tags = sum(p[1] + (not isinstance(c, str)) for c, p in parts)
    links = sum(p[3] + (not isinstance(c, str) and c[0] == "a") for c, p in parts)
    return sum(p[0] for _, p in parts), tags, sum(p[2] for _, p in parts), links


def dens(c, t, lc, lt, share):
    if not c:
        return 0.0
    base = log(c / max(c - lc, 1) * max(lc, 1) + share * c + e**2)
    return c / max(t, 1) * max(0.0, log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base))


def every(t, up=(), link=False):
    yield t, up, link
    for c in t[2]:
        if not isinstance(c, str) and not gone(c):
            yield from every(c, (*up, t), link or c[0] == "a")


def total(t, share, link):
    out = 0.0
    for c in t[2]:
        if isinstance(c, str):
            out += 0 if link else dens(count(c)[0], 1, 0, 0, share)
        elif not gone(c):
            out += dens(*count(c, link), share)
    return out


def has_paragraph(t):
    return t[0] in ("p", "pre") or any(has_paragraph(c) for c in t[2] if not isinstance(c, str) and not gone(c))


def brute(body):
    c, _, lc, _ = count(body)
    if not c:
        return ""
    share = lc / c
    nodes = list(every(body))
    sums = [total(t, share, link) for t, _, link in nodes]
    at = max(range(len(nodes)), key=lambda k: (sums[k], -k))
    if not sums[at]:
        chosen = [body]
    else:
        best, up, _ = nodes[at]
        way = [*up, best]
        around = [t for t in way if t[0] == "article"] or [t for t in way if t[0] == "main"]
        if around:
            chosen = [around[0]]
        else:
            chosen = [best]
            least = min(dens(*count(t, any(x[0] == "a" for x in u)), share) for t, u, _ in nodes if any(t is w for w in way))
            for k, (t, u, link) in enumerate(nodes):
                if any(t is w for w in way) or any(x is best for x in u):
                    continue
                if t[0] in X.HEADING and any(u[-1] is w for w in way) and k < at:
                    chosen.append(t)
                elif dens(*count(t, link), share) >= least and has_paragraph(t):
                    sub = [j for j, (s, v, _) in enumerate(nodes) if s is t or any(x is t for x in v)]
                    top = max(sums[j] for j in sub)
                    chosen.append(nodes[[j for j in sub if sums[j] == top][-1]][0])
    marked = {id(t) for t in chosen}

    def walk(t, on):
        if isinstance(t, str):
            return [t] if on else []
        on = on or id(t) in marked
        inside = [x for c in t[2] for x in ([None] if not isinstance(c, str) and gone(c) else walk(c, on))]  # what leaves still ends a block
        return inside if t[0] in INLINE else [None, *inside, None]

    out, held = [], []
    for x in [*walk(body, False), None]:
        if x is None:
            out.append(" ".join("".join(held).split()))
            held = []
        else:
            held.append(x)
    return "\n".join(b for b in out if b)


def random_tree(rng, tag="body", depth=0):
    children = []
    for _ in range(rng.randint(1, 5) if depth < 4 else 1):
        if depth >= 4 or tag in ("p", "h1", "li") or rng.random() < 0.25:
            children.append(" ".join(rng.choice(["word", "é&<x>", "  two\n", "a"]) for _ in range(rng.randint(0, 30))))
            if tag in ("p", "li") and rng.random() < 0.4:
                children.append((rng.choice(["a", "b"]), "", [rng.choice([" inside ", "x"])]))
        else:
            kind = rng.choice(["div", "div", "div", "p", "p", "h1", "section", "nav", "footer", "aside", "article", "main"] if depth else ["div", "div", "p", "section"])
            children.append(random_tree(rng, kind, depth + 1))
    for k in range(len(children) - 1, 0, -1):  # neighbouring texts are one run
        if isinstance(children[k], str) and isinstance(children[k - 1], str):
            children[k - 1 : k + 1] = [children[k - 1] + children[k]]
    return (tag, rng.choice(["", "", "", "", "ad", "post", "sidebar"]) if tag in ("div", "section") else "", children)


def write(t):
    if isinstance(t, str):
        return escape(t)
    return f'<{t[0]} class="{t[1]}">' + "".join(map(write, t[2])) + f"</{t[0]}>"


def plain(t):
    """No named or leaving element holds an article or main element (that keeps it, which the brute force doesn't know)."""
    def holds(x):
        return not isinstance(x, str) and (x[0] in ("article", "main") or any(map(holds, x[2])))

    return isinstance(t, str) or (not (gone(t) and holds(t)) and all(map(plain, t[2])))


@pytest.mark.parametrize("seed", range(300))
def test_selection_equals_recursion(seed):
    rng = random.Random(seed)
    tree = random_tree(rng)
    if plain(tree):
        assert X.main_text(write(tree)) == brute(tree)


# ---- layouts

ARTICLE = "<h1>A title &amp; more</h1><p>First paragraph of the text, long enough to be one.</p><ul><li>item one</li><li>item two</li></ul><p>Second paragraph with <a href='/x'>a link</a> inside it.</p>"
TEXT = "A title & more\nFirst paragraph of the text, long enough to be one.\nitem one\nitem two\nSecond paragraph with a link inside it."
AROUND = [
    "<nav><ul>" + "<li><a href='/m'>menu entry</a></li>" * 8 + "</ul></nav>",
    "<header><h1>Site name</h1><p>A motto of the whole site that is rather long.</p></header>",
    '<div class="menu"><a href="/">Home</a> | <a href="/b">About us</a></div>',
    '<div class="ad">Buy this now, it is the best thing that you can buy today.</div>',
    '<div id="cookie-notice"><p>We use cookies to give you the best of all sites.</p></div>',
    '<aside><p>Something else entirely that stands at the side of the page.</p></aside>',
    '<div class="widget sidebar-right"><p>Another side text that is quite long for a sidebar.</p></div>',
    '<form action="/s"><p>Subscribe to our news by leaving your address here</p><input name=q><button>Go</button></form>',
    "<script>var t='</p><p>not a text</p>';</script><style>p{margin:0}</style><noscript><p>Please turn scripts on, really.</p></noscript>",
    '<section id="comments"><article class="comment"><p>What a good article this is, I read it twice.</p></article></section>',
    '<div style="display: none"><p>Hidden words that nobody can see on the page.</p></div>',
    "<footer><p>&copy; example.org, all rights reserved, and so on and so forth.</p></footer>",
    "<!-- <p>an old paragraph that was commented out</p> -->",
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="post has-sidebar">{}</div>', "<article><header>{}</header></article>", "<table><tr><td>{}</td></tr></table>", "{}"])
def test_only_the_article_is_left(shell):
    body = shell.format(ARTICLE)
    for k in range(len(AROUND) + 1):
        page = "<!DOCTYPE html><html><head><title>A title</title></head><body>" + "".join(AROUND[:k]) + body + "".join(AROUND[k:]) + "</body></html>"
        assert X.main_text(page) == TEXT, k


def test_one_short_paragraph_wins_over_a_longer_advert():
    assert X.main_text('<body><div class="ad">A much longer advert than the article itself is.</div><article><h1>Be.</h1><p>Be.</p></article><footer>x y z</footer></body>') == "Be.\nBe."


def test_parts_inside_an_article_leave():
    page = f'<article>{ARTICLE}<div class="share"><a>tweet</a></div><footer>tags</footer><ol class="commentlist"><li>nice</li></ol><figure><img src=x><figcaption>A caption</figcaption></figure></article>'
    assert X.main_text(page) == TEXT + "\nA caption"


@pytest.mark.parametrize("name", ["post ad-free", "social-science", "menu-of-the-day", "has-sidebar", "no-comments", "related-work", "noticeable", "adverbs", "comments-open", "headers"])
def test_names_that_only_look_like_boilerplate(name):
    assert X.main_text(f'<div class="{name}">{ARTICLE}</div>') == TEXT
    assert X.main_text(f'<article class="ad sidebar {name}">{ARTICLE}</article>') == TEXT


@pytest.mark.parametrize("name", ["ad", "x ADS y", "google-ad", "ad-slot-3", "ad_728x90", "main-menu", "sidebar-left", "cookie-notice-bar", "comment-list", "user_comments", "site-footer", "newsletter-box", "header", "page-header", "masthead-wrap"])
def test_names_of_boilerplate(name):
    assert X.main_text(f'<div class="{name}"><p>Some words that are no part of the article at all.</p></div><div>{ARTICLE}</div>') == TEXT
    assert X.main_text(f'<div>{ARTICLE}</div><section id="{name}"><p>Some words that are no part of the article at all.</p></section>' if " " not in name else f"<div>{ARTICLE}</div>") == TEXT


def test_a_header_inside_the_article_is_its_heading():
    assert X.main_text(f'<div class="header">Site</div><article><div class="article-header"><h1>Title</h1></div><p>Words.</p></article>') == "Title\nWords."


def test_whole_page_in_a_form():
    assert X.main_text(f"<form id=aspnet><div>{ARTICLE}</div><input type=hidden value=x></form>") == TEXT


# ---- markup


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        ("<p></p><div> &nbsp; </div>", ""),
        ("just text &lt;b&gt; &#233;&eacute;&#x1F600; &unknown; &amp", "just text <b> éé😀 &unknown; &"),
        ("a < b and c > d <3", "a < b and c > d <3"),
        ("<p>one<p>two<br>three<p><b>four<br><p>five</b> six", "one\ntwo three\nfour\nfive six"),
        ("<p>a  \n\t b c</p>", "a b c"),
        ("<P CLASS=x>upper</P><DIV>case</DIV>", "upper\ncase"),
        ('<p title="a > b" data-x=\'<p>\'>quoted</p>', "quoted"),
        ('<p title="never closed>text</p><p>more words</p>', "text\nmore words"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>after", "a\nb\nc\nafter"),
        ("<dl><dt>t<dd>d<dt>t2<dd>d2</dl>", "t\nd\nt2\nd2"),
        ("<p>x</p><script>if (a < b) { '</p>' }</SCRIPT ><p>y</p>", "x\ny"),
        ("<p>x</p><textarea><p>no</textarea><p>y</p>", "x\ny"),
        ("<p>x<!-- a > b --> y<!-- never closed <p>z", "x y"),
        ("<p>x<!--> y --!> z</p>", "x y --!> z"),
        ("<p>x <![CDATA[y]]> <?php z ?> w</p>", "x w"),
        ("<p>x</div></span></p></p> y</p>", "x\ny"),
        ("<div><b><p>x</p></b> y</div>", "x\ny"),
        ("<head><title>t</title><p>no body tag</p>", "no body tag"),
        ("<head><meta charset=utf-8>text ends the head", "text ends the head"),
        ("<p>cut off in a ta<a href=", "cut off in a ta"),
        ("<p>cut off in a reference &am", "cut off in a reference &am"),
        ("<pre>  a\n   b </pre>", "a b"),
        ("<p>in<i>line</i>d <span>x</span>y</p>", "inlined xy"),
        ("<custom-tag>own <x-y>elements</x-y></custom-tag>", "own elements"),
    ],
)
def test_markup(html, text):
    assert X.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000 + "deep", "<b>" * 100_000 + "x</b>" * 100_000, "<p><i>" * 50_000 + "</b>" * 50_000, '<a b="' * 100_001, "<a b='>\"" * 50_001, "<" * 300_000, "<!--" * 100_000, "<p>word " * 100_000, "&amp" * 200_000, "</" * 100_000, "<li>" * 100_000 + "</ul>" * 1000],
    ids=range(11),
)
def test_long_pages_take_time_in_proportion(html):
    start = time.perf_counter()
    X.main_text(html)
    assert time.perf_counter() - start < 20


def test_table_nulls_repeats_clashing_names(spark):
    page = f"<article>{ARTICLE}</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, "v", None, "x"), (3, None, "", "x"), (4, "w", f"<article><p>{'long ' * 400_000}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted([tuple(r) for r in X.extract(df).collect()], key=str)
    assert got == sorted([(i, u, t, len(t)) for i, u, h, _ in rows for t in [X.main_text(h)]], key=str)
    assert [r for r in got if r[0] == 1] == [(1, "u", TEXT, len(TEXT))] * 2 and [r[3] for r in got if r[0] == 4] == [len("long " * 400_000) - 1]
    assert X.extract(df.limit(0)).collect() == []
