"""Operators on pages: archives and their merged history, main text, URL filter."""

import gzip
import hashlib
import io
import random
import time
from urllib.parse import urlsplit

import numpy as np
import pytest

from rankweave.llm import main_text, url_filter, warc
from rankweave.runtime import work_path

SCHEMA = "page_id long, url string, html string, id string, ts string, type string, digest string, host string, path string, `rule` string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], SCHEMA)


LONG = "<p>" + "x" * 200 + "</p>"
ROWS = [(5, "http://b.org/1", LONG), (3, "http://b.org/2", LONG), (9, "http://a.org/1", LONG), (1, None, None), (2, "http://a.org/1?q=WARC/1.1\r\nX: y", "short"), (4, "http://a.org/1", "short"), (None, "http://c.org", LONG), (6, "x", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 10), (7, "", ""), (3, "http://b.org/2", LONG)]


@pytest.mark.parametrize("limit", [1, 64 << 20])
def test_history(spark, limit):
    captures = warc.page_captures(pages(spark, ROWS))
    out = warc.capture_history(captures, max_bytes=limit, range_rows=3).collect()
    assert len(out) == len(ROWS)
    got = sorted(((r.id, r.length, r.digest, r.type, r.refers_to) for r in out), key=repr)
    want = []
    for page_id, _, html in ROWS:
        raw = (html or "").encode()
        again = html == LONG and page_id != 3
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=repr)
    order = [(r.urlkey, r.ts, r.id is None, r.id or 0) for r in sorted(out, key=lambda r: (r.range_no, r.pos))]
    assert order == sorted(order)


def test_history_of_nothing(spark):
    assert warc.capture_history(warc.page_captures(pages(spark, []))).count() == 0


def test_archives_are_warc(spark):
    folder = work_path(spark, "t")
    manifest = warc.write_archives(warc.mark_revisits(warc.page_captures(pages(spark, ROWS))), folder)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(ROWS)
    for row in manifest.collect():
        data = gzip.open(row.path).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        with open(row.path, "rb") as f:
            raw = f.read()
        for offset, headers, _ in warc.read_records(io.BytesIO(raw)):
            _, again, _ = next(warc.read_records(io.BytesIO(raw[offset:])))
            assert again == headers
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(raw[:-5])))


def test_loser_tree_merges():
    rng = random.Random(6)
    for k in range(12):
        runs = [sorted((rng.randint(0, 30), i) for _ in range(rng.choice([0, 1, 5, 40]))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.org/A?b#c") == "org,example)/a?b" and warc.url_key(None) == "-"
    assert warc.url_key("http://u:p@x.com:8080") == "com,x:8080)/"


# Main text.

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- c <p>no</p> -->
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text.<p>Second &lt;tag&gt; &#233;<br>third</p><div class="ad">Buy</div><form><p>Mail</p><input></form><p>Short.</p><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer><p>&copy; us</p></footer></body></html>"""


def test_article(spark):
    out = {r.page_id: r for r in main_text.extract(pages(spark, [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)])).collect()}
    assert out[1].text == "Head & line First bold text. Second <tag> é third Short."
    assert out[1].n_chars == len(out[1].text) and (out[2].text, out[3].n_chars) == ("", 0)
    assert main_text.extract(pages(spark, [])).count() == 0


def test_surges_without_a_container():
    para = "Many words stand in this paragraph, which goes on for quite a while and is no menu. "
    page = f"<body><div>Home</div><div><a href=x>Links only, one after another, of some length or other, up here</a></div><div>{para}</div><div>Short middle.</div><div>{para}</div><div>x</div><div>y</div><div>z</div></body>"
    found = main_text.main_text(page)
    assert found.startswith("Many words") and "Short middle." in found and "Links" not in found


def test_broken_and_long_pages():
    assert main_text.main_text("<p>un<b>closed") == "unclosed"
    assert main_text.main_text("a < b and c > d") == "a < b and c > d"
    assert main_text.main_text("plain\ntext &amp; more") == "plain text & more"
    assert main_text.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    long = "<article>" + "<p>word " * 50_000 + "</article>"
    assert main_text.main_text(long) == " ".join(["word"] * 50_000)
    assert main_text.main_text("<script>never closed <p>x") == "" and main_text.main_text("<article></article>") == ""


# URL filter.

URLS = [None, "", "no scheme", "http://A.Example.NET/en/1?q#f", "http://x.net", "http://example.com/de/1", "http://notexample.com/de/1", "http://m.example.com/fr/", "https://spam-farm.example.org/es/1", "https://a.adult-x.example.org/fr/1", "http://z.org/fr/x", "http://casino-win.example.com?x=/de/", "ftp://h#f", "x://y://z/p", "http://example.com/de/1"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0] or [len(tail)])]
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        best = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, best[1] + best[2], best[0]
    return host, path, None, "block" if any(host == k or host.endswith("." + k) for k in url_filter.LISTED) else "allow"


def test_verdicts(spark):
    out = url_filter.judge(pages(spark, [(i, u, "") for i, u in enumerate(URLS)])).collect()
    assert {r.page_id: tuple(r)[1:] for r in out} == {i: expected(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(pages(spark, [])).count() == 0
    assert urlsplit(URLS[3]).hostname == expected(URLS[3])[0]


def test_cascade_is_exact_for_its_universe(spark):
    rng = random.Random(2)
    universe = [f"h{i}.example.org" for i in range(5000)]
    listed = rng.sample(universe, 60) + ["unseen.example.org"]
    hosts = spark.createDataFrame([(h,) for h in universe], "host string")
    for most in (1000, 20):  # one cascade; several shards
        found = list(url_filter.cascades(hosts, listed, most))
        assert len(found) == (1 if most == 1000 else 4)
        for h in universe:
            assert any(h.encode() in c for c in found) == (h in listed)


def test_cascade_without_keys(spark):
    empty = spark.createDataFrame([], "host string")
    (found,) = url_filter.cascades(empty, [])
    assert url_filter.judge(pages(spark, [(1, "http://a.org/x", "")]), (), []).first().verdict == "allow"
    assert b"a.org" not in found


def test_a_list_from_a_table_in_shards(spark):
    hosts = [f"h{i}.{'a' if i % 3 else 'b'}.test" for i in range(300)]
    listed = [h for h in hosts if int(h[1:].split(".")[0]) % 7 == 0] + ["B.test", None, "never.seen"]
    rows = [(i, f"http://x.{h}/p", "") for i, h in enumerate(hosts)] + [(1000, None, "")]
    for most in (5, 10_000):
        out = url_filter.judge(pages(spark, rows), (), spark.createDataFrame([(h,) for h in listed], "host string"), most)
        assert {r.page_id for r in out.collect() if r.verdict == "block"} == {i for i, h in enumerate(hosts) if h in listed or h.endswith("b.test")}


def test_a_poor_first_level_is_built_anew(spark, monkeypatch):
    monkeypatch.setattr(url_filter.Cascade, "rate", staticmethod(lambda listed, universe: 0.5))
    universe = [f"h{i}.test" for i in range(600)]
    (found,) = url_filter.cascades(spark.createDataFrame([(h,) for h in universe], "host string"), universe[:3], 10)
    assert [h for h in universe if h.encode() in found] == universe[:3]


def test_a_url_in_a_query_is_no_path(spark):
    urls = ["http://example.net?u=http://x.org/fr/a", "http://example.com#http://y.com/de/1", "https://z.org?next=https://example.com/de/", "http://a.net/?u=http://x.org/fr/a"]
    out = url_filter.judge(pages(spark, [(i, u, "") for i, u in enumerate(urls)])).collect()
    assert {r.page_id: tuple(r)[1:] for r in out} == {i: expected(u) for i, u in enumerate(urls)}
    assert {r.page_id: r.path for r in out} == {0: "", 1: "", 2: "", 3: "/"}


@pytest.mark.parametrize("middle", [["First item", "Second item", "Third item"], ["a", "b", "c", "d", "e", "f"], ["Heading"]])
def test_short_lines_without_a_container(middle):
    para = "Many words stand in this paragraph, which goes on for quite a while and is no menu."
    for end in (para, "A closing paragraph of 30 signs"):
        if end == para or len(middle) == 1:
            page = "<body>" + "".join(f"<div>{x}</div>" for x in (para, *middle, end, "x", "y")) + "</body>"
            assert main_text.main_text(page) == " ".join((para, *middle, end))


def test_the_distribution_decides(monkeypatch):
    """Menus inside a container and short lines about it go by the sums of weights alone; without them all would stay."""
    menu = "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(5))
    page = f"<article><h1>Title</h1><p>Short lead.</p><ul>{menu}</ul><p>{'Prose of the article. ' * 8}</p><p><a href=x>The full report</a></p><p>The end.</p><p>Short final.</p></article>"
    kept = main_text.main_text(page)
    assert kept == " ".join(["Title", "Short lead.", ("Prose of the article. " * 8).strip(), "The full report", "The end.", "Short final."])
    flat = f"<body><div>Home</div><div>News</div><div>{'Prose. ' * 30}</div><div>More</div><div>x</div><div>y</div></body>"
    assert main_text.main_text(flat) == ("Prose. " * 30).strip()
    monkeypatch.setattr(main_text, "weights_of", lambda lines, *_: np.ones(len(lines), dtype=np.int64))
    assert "Page 1" in main_text.main_text(page) and "Home" in main_text.main_text(flat)


def slow_blocks(weights, window, surge):
    """Heavy windows one by one; what they hold, from and to a strong line; joined unless a window of nothing lies between."""
    n = len(weights)
    inside = [range(max(0, s), min(n, s + window)) for s in range(1 - window, n)]
    sums = [sum(weights[i] for i in w) for w in inside]
    least, strong = min(surge, max(sums)), min(main_text.SHORT, max(weights))
    heavy = sorted({i for w, s in zip(inside, sums, strict=True) if s >= least for i in w})
    out = []
    for i in heavy:
        if weights[i] < strong:
            continue
        if out and all(j in heavy for j in range(out[-1][1], i)):
            out[-1][1] = i + 1
        elif out and not any(all(weights[k] == 0 for k in range(j, j + window)) for j in range(out[-1][1], i - window + 1)):
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [tuple(b) for b in out]


def test_blocks_match_brute_force():
    rng = random.Random(12)
    for _ in range(600):
        weights = [rng.choice([0, 0, 0, 3, 15, 25, 60, 90, 300]) for _ in range(rng.randint(1, 30))]
        if any(weights):
            assert main_text.text_blocks(np.array(weights), 3, 80) == slow_blocks(weights, 3, 80), weights
    assert main_text.text_blocks(np.zeros(4, dtype=np.int64)) == []


def test_short_paragraphs_about_a_block_without_a_container():
    long = "Many words stand in this paragraph, which goes on for quite a while and is no menu."
    assert main_text.main_text(f"<body><p>Short lead.</p><p>{long}</p><p>The end.</p><p>Short final.</p></body>") == f"Short lead. {long} The end. Short final."
    assert main_text.main_text(f"<body><div>Home</div><div class=x><div>Lead</div><div>{long}</div><div>End</div></div><div>Shop</div></body>") == f"Lead {long} End"


def test_classes_that_articles_use():
    long = "Many words stand in this paragraph, which goes on for quite a while and is no menu."
    for name in ("search-guide", "tags", "related-work", "hidden", "share"):
        assert main_text.main_text(f'<article><h1>T</h1><div class="{name}"><p>{long}</p><p>{long}</p></div></article>') == f"T {long} {long}"
        assert main_text.main_text(f'<article><p>{long}</p><div class="{name}"><a href=x>one</a> <a href=y>two</a></div></article>') == long
    comments = f'<section id="comments"><article class="comment even"><p>{long}</p></article></section><article class="comment"><p>{long}</p></article>'
    assert main_text.main_text(f"<article><p>Text.</p></article>{comments}") == "Text."


@pytest.mark.parametrize("name", ["object", "svg", "canvas", "title", "textarea", "iframe", "noscript"])
def test_unclosed_raw_elements_swallow_nothing(name):
    assert main_text.main_text(f"<article><p>One.</p><{name}><p>Two.</p></article>") == "One. Two."
    assert main_text.main_text(f"<article><p>One.</p><{name}>gone</{name}><p>Two.</p></article>") == "One. Two."


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 100_000 + "<p>x</p>" * 100_000, "<a href=\"" * 100_000, "<a x='\"" * 100_000 + ">", "<svg>" * 200_000, "<" * 1_000_000, "<div " + "a" * 1_000_000 + ">x", "<div " + "a =" * 300_000 + ">x", "<!-- " * 200_000, "<p>a < b " * 100_000, "</b>" * 200_000, "<b>" * 200_000 + "</i>" * 100_000, "<div style='display" + " " * 1_000_000 + "'>x"])
def test_large_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text.main_text(page)
    assert time.perf_counter() - began < 6


def test_random_pages_never_fail():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<a href=x>", "</a>", "word ", "<", ">", "&amp;", "<!--", "-->", "<script>", "</script>", "'", '"', "<li>", "<br/>", "<svg>", "</svg>", "\n", "<title>", "<b", "<![CDATA[x]]>", "<main>", "x" * 90]
    for _ in range(2000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert main_text.main_text(page) == " ".join(main_text.main_text(page).split())


_LONG = "This sentence of the article goes on for a good while, and then some more words follow it. " * 2
_PROSE = _LONG.strip()
_ARTICLE = f"<article><h1>T</h1><p>{_LONG}</p><p>{_LONG}</p></article>"
_WHOLE = f"T {_PROSE} {_PROSE}"


@pytest.mark.parametrize(
    "page,text",
    [
        *[(f'<div {about}>{_ARTICLE}</div>', _WHOLE) for about in ('class="content no-sidebar"', 'class="post has-comments"', 'class="layout sidebar-right"', 'id="public-notice-text"', 'class="page-with-nav two"')],
        (f"<form action=x>{_ARTICLE}<input name=q></form>", _WHOLE),
        (f"<body><form><div>{_LONG}</div><p>{_LONG}</p></form></body>", f"{_PROSE} {_PROSE}"),
        (f"<article><h1>T</h1><fieldset><p>{_LONG}</p><p>{_LONG}</p></fieldset></article>", _WHOLE),
        (f"{_ARTICLE}<form><p>Your name and address, please, and what you think of this.</p></form>", _WHOLE),
        (f'<article><h1>T</h1><p title="a hidden gem">{_LONG}</p><p class="not hidden here" data-x="display: none">{_LONG}</p></article>', _WHOLE),
        *[(f"<article><h1>T</h1><p>{_LONG}</p><p {how}>{_LONG}</p><p>{_LONG}</p></article>", _WHOLE) for how in ("hidden", 'hidden=""', "class=x hidden", 'style="color: red; display:none"', 'aria-hidden="true"')],
        (f"<body><div><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></div><footer>End</footer><div><article><div>Teaser</div></article></div></body>", " ".join([_PROSE] * 3)),
        (f"<article><h1>T</h1><p>{_LONG}</p><ul>" + "".join(f"<li><a href={i}>Source number {i} of this article</a></li>" for i in range(3)) + f"</ul><p>{_LONG}</p></article>", f"T {_PROSE} " + "".join(f"Source number {i} of this article " for i in range(3)) + _PROSE),
        (f"<article><h1>T</h1><ul><li><a href=1>Home</a></li><li><a href=1>Shop</a></li><li><a href=1>About us</a></li></ul><p>{_LONG}</p><p>{_LONG}</p></article>", _WHOLE),
        (f"<article><h1>T</h1><p>{_LONG}</p><p><a href=1>One link</a></p><p>{_LONG}</p></article>", f"T {_PROSE} One link {_PROSE}"),
        (f"<article><h1>T</h1><p>{_LONG}</p><p>{_LONG} <math><mi>x</mi><mo>=</mo></math> <label>Label</label></p></article>", f"{_WHOLE} x= Label"),
        (f'{_ARTICLE}<div id="comments-area"><article class="comment"><p>{_LONG * 9}</p></article></div>', _WHOLE),
        (f'<body><p>{_LONG}</p><div class="comments-area"><p>{_LONG * 9}</p></div></body>', _PROSE),
        (f'{_ARTICLE}<div class="sidebar-right"><article><p>Teaser here</p></article></div><div class="cookie-banner"><p>{_LONG * 9}</p></div>', _WHOLE),
        (f'<article><h1>T</h1><p>{_LONG}</p><div class="ad-box"><p>{_LONG}</p></div><p>{_LONG}</p></article>', _WHOLE),
    ],
)
def test_wrappers_of_the_main_text_are_no_noise(page, text):
    assert main_text.main_text(page) == text


def test_pages_made_of_known_parts():
    """Random pages: what was put in as the article comes out, whole and in order, whatever stands about it."""
    draw = random.Random(8)
    words = "river stone quiet morning letter window garden travel nobody seven number people carry".split()
    say = lambda n: (" ".join(draw.choice(words) for _ in range(n)) + ".").capitalize()
    noise = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{i}>{draw.choice(words)}</a></li>' for i in range(draw.randrange(1, 6)))}</ul></nav>",
        lambda: f"<aside><p>{say(20)}</p></aside>",
        lambda: f'<div class="{draw.choice(("sidebar", "cookie-banner", "ad-slot", "newsletter", "site-footer"))}"><p>{say(30)}</p></div>',
        lambda: f"<script>var x = '<p>{say(9)}</p>';</script><!-- {say(9)} -->",
        lambda: f'<form><label>{say(2)}</label><input name=a></form>',
        lambda: f'<section class="comments"><div class="comment"><p>{say(40)}</p></div></section>',
    ]
    for _ in range(150):
        text = [say(60)]
        parts = [f"<p>{text[0]}</p>"]
        for _ in range(draw.randrange(1, 8)):
            n = draw.choice((2, 4, 25, 40))
            tag, line = draw.choice(("p", "h2", "li", "blockquote", "div")), say(n)
            parts.append(f"<{tag}>{line}</{tag}>")
            text.append(line)
            if draw.random() < 0.3:
                parts.append(draw.choice(noise)())
        wrap = draw.choice(("{}", '<div class="no-sidebar">{}</div>', "<form>{}</form>", '<div id="main-nav-layout">{}</div>'))
        around = ["".join(draw.choice(noise)() for _ in range(draw.randrange(3))) for _ in range(2)]
        page = f"<html><body>{around[0]}{wrap.format('<article>' + ''.join(parts) + '</article>')}{around[1]}</body></html>"
        assert main_text.main_text(page) == " ".join(text), page
