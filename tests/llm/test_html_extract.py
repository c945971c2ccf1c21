import math
from collections import Counter, defaultdict

from sondage.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style>
<script>var t="</p>";</script></head><body><header class="top">Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- <p>not me</p> --><div class="ad">Buy &amp; buy</div><div class="cookie-notice">OK?</div>
<article><h1>Title&nbsp;one</h1><p><b>Title one<br><p>First   para &amp;amp; more &lt;b&gt; &#233;.
next</p><ul><li>one<li>two</ul><p>a < b and 1<2</p><form>Mail <input name=x></form>tail <span class="ad">gone</span><span>words</span></article>
<section id="comments"><p>nice</p></section><div>{}</div><aside>side</aside><footer>&copy; host</footer>"""


def run(spark, pages, **how):
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string").repartition(3)
    return [r["text"] for r in sorted(hx.extract(df, **how).collect(), key=lambda r: r["page_id"])]


def one(spark, page):
    return run(spark, [("http://h.example/", page)])[0].split("\n")


def test_page(spark):
    assert one(spark, PAGE.replace("{}", "loose")) == ["Title one", "Title one", "First para &amp; more <b> é. next", "one", "two", "a < b and 1<2", "tail words", "loose"]
    assert hx.main_text(None) == hx.main_text("") == hx.main_text("<p>") == ""
    assert hx.main_text("plain &lt;text&gt;\n here") == "plain <text> here"
    assert hx.main_text("<p title='a>b'>x</p") == "x"
    assert hx.main_text("<" * 3000 + "<a '" * 3000) != ""
    assert hx.main_text("<div>" * 5000 + "deep") == "deep"


def test_markup_that_is_let_out(spark):
    assert one(spark, "<html><head><meta charset=utf-8><title>T</title><body><p>one<p>two<ul><li>a<div>b</div><li>c</ul><table><tr><td>x<td>y<tr><td>z</table>") == ["one", "two", "a", "b", "c", "x", "y", "z"]
    assert one(spark, "<head><p>text</p>") == ["text"]
    assert one(spark, "<title-bar>bar</title-bar><p>a</p><select-box>box</select-box><p>b</p><script-x>c</script-x>") == ["bar", "a", "box", "b", "c"]
    assert one(spark, "<p>a</p><select><option>x</select><svg><title>s</title></svg><noscript>n</noscript><p>b") == ["a", "b"]
    assert one(spark, "<td>a</p></div>b</td>") == ["a", "b"]


def test_names_in_articles(spark):
    page = "<article><div id='related-work'><p>Related work</p></div><div class='search'><p>Search trees</p></div><nav>toc</nav><p>End</p></article>"
    assert one(spark, page) == ["Related work", "Search trees", "End"]
    # A share bar that says the same in different articles is cut, one that a single article has is not.
    pages = [(f"http://h.example/{i}", f"<article><p>Text {i}</p><div class='share'>Tell a friend</div></article>") for i in range(6)]
    assert run(spark, pages) == [f"Text {i}" for i in range(6)]
    assert run(spark, pages[:1]) == ["Text 0\nTell a friend"]


def test_tree_needs_no_names(spark):
    article = lambda i: f"<article><h1>Head {i}</h1><p>{' '.join(f'w{i}x{j}' for j in range(80))}</p></article>"
    box = lambda i: f"<div class='k7'>Buy this {i * 7919}</div>"
    pages = [(f"http://h.example/{i}", f"<body><div class='k1'><div>One</div><div>Two</div></div>{box(i)}{article(i)}<div class='k9'>Since 1999</div></body>") for i in range(30)]
    got = run(spark, pages)
    assert all(t.split("\n")[0] == f"Head {i}" and len(t.split("\n")) == 2 for i, t in enumerate(got))
    assert len(run(spark, pages[:1])[0].split("\n")) == 6  # one page: nothing but what it is for by name or tag
    # Equal and mirrored pages are one page: no evidence, nothing lost.
    same = [(f"http://h.example/{i}", f"<body>{article(0)}<p class='x'>ok</p></body>") for i in range(12)]
    assert set(run(spark, same)) == {"Head 0\n" + " ".join(f"w0x{j}" for j in range(80)) + "\nok"}
    # A form around the whole page is no furniture.
    assert run(spark, [("u", f"<form class='page'>{article(1)}</form>")])[0].startswith("Head 1")


def brute(pages):
    """Texts by a merge-and-cut over whole pages in plain Python, of pages and hosts."""
    hosts = defaultdict(dict)
    for host, page in pages:
        main, rows = hx.page_nodes(page)
        hosts[host].setdefault(main, []).append(rows)
    cut = defaultdict(set)
    for host, mains in hosts.items():
        assert all(len({str(r) for r in own}) == 1 for own in mains.values())
        seen = defaultdict(list)
        for own in mains.values():
            for row in own[0]:
                seen[row[0]].append(row)
        for key, rows in seen.items():
            m, (_, _, tag, role, inside) = len(rows), rows[0][:5]
            entropy = lambda c: -sum(n / m * math.log(n / m, m) for n in Counter(r[c] for r in rows).values()) if m > 1 else 1.0
            holds, chars, main = max(r[5] for r in rows), sum(r[8] for r in rows), sum(r[9] for r in rows)
            share = min(1, chars / (0.25 * main)) if tag in hx._BOXES and not inside and not holds and main else 1
            evidence = 0.1 * entropy(6) + 0.9 * entropy(7) * share
            factor = 1 if not role else 0.5 if role == 1 and inside else 0.2
            importance = factor * (1 + (m - 1) * evidence) / m
            if holds < 2 and tag not in ("article", "main", "html", "body") and not (inside and not role) and importance < 0.25:
                cut[host].add(key)
    return [hx.main_text(page, frozenset(cut[host])) for host, page in pages]


def test_against_brute_force(spark):
    pages = []
    for i in range(60):
        host = "a" if i < 40 else "b" if i < 57 else "c"
        legal = "<div class='legal'>Same words everywhere</div>" if i % 4 else ""
        tail = "<section id=comments>c</section>" * (i % 2) + f"<ul class='more'><li>{i % 3}</li></ul>"
        main = f"<article><p>Own words {i}</p><div class='search'>find {i % 2}</div></article>" if i % 5 else f"<div class=text><p>No article {i}</p></div>"
        pages.append((host, f"<html><body class=p{i}><div class='x y'>{legal}{main}</div>{tail}<div class=z{i}>Box {i}</div></body></html>"))
    pages += pages[3:9]
    want = brute(pages)
    assert run(spark, [(f"http://{h}/x", p) for h, p in pages]) == want
    assert run(spark, [(f"http://{h}/x", p) for h, p in pages], broadcast_nodes=0) == want
    assert want != [hx.main_text(p) for _, p in pages]


def test_hazards(spark):
    pages = [(100, None, None, ""), (None, "x", "<p>y</p>", ""), (100, None, None, ""), (7, "http://h/", "", ""), (8, "http://h/", "퟿<p>" + "z " * 200_000, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(3)
    got = {(r["page_id"], r["url"]): r for r in hx.extract(df).collect()}
    assert (got[None, "x"]["text"], got[None, "x"]["n_chars"]) == ("y", 1)
    assert got[8, "http://h/"]["n_chars"] == 400_001
    assert sorted(r["text"] for r in hx.extract(df).collect() if r["page_id"] == 100) == ["", ""]
    assert hx.extract(df.limit(0)).count() == 0
