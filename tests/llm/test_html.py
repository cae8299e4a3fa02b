import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import html_main as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header>Top</header><nav><ul><li><a href=/>Home</a><li>More</ul></nav><!-- c --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>two<br>three&nbsp;four
<p>Five&copy;</p><aside>Side</aside><form><input><p>Mail?</p></form><div id="comments"><p>First!</p></div><p>Last</p></article><footer>&copy; me</footer></body>"""


def text(html):
    b = H.blocks(html)
    return [t for t, m in b if m] if any(m for _, m in b) else [t for t, _ in b]


def test_markup():
    assert text(PAGE) == ["Head & line", "One two three four", "Five©", "Last"]
    assert text("<div>a</div>plain<p>b<div>c</div>") == ["a", "plain", "b", "c"]
    assert text("") == [] and text("<p>unclosed <b>bold") == ["unclosed bold"] and text("a < b & c") == ["a < b & c"]
    assert text("<nav>x<p>y</nav><P>Z</P><SCRIPT>no</SCRIPT><br/>w") == ["Z", "w"]
    assert text("<p hidden>h</p><p style='display: none'>n</p><p>s") == ["s"]


@given(st.text(alphabet="<>/ab \"'=!-pdiv&;\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text_parses(html):
    H.blocks(html)


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
@settings(max_examples=200, deadline=None)
def test_longest_common_subsequence(a, b):
    best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _within(c, b)), default=0)
    got = sorted(H.shared(a, b))
    assert len(got) == best and _within([a[i] for i in got], b)


def _within(c, b):
    it = iter(b)
    return all(x in it for x in c)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS key", "2 AS part")


@pytest.mark.parametrize("unit", [1 << 30, 600])
def test_shared_lines_go(spark, unit):
    own = lambda k: "".join(f"<p>story {k} line {i}</p>" for i in range(4))
    rows = [(k, f"https://h.x/news/{k:02d}", f"<div>Site</div>{own(k)}<div>Imprint</div>") for k in range(12)]
    rows += [(20, "https://alone.x/", "<div>Site</div>"), (21, None, "<p>a</p>"), (22, "https://h.x/zz", None), (23, "nope", "")]
    rows += [(30 + k, f"https://art.x/{k}", f"<article><p>only {k}</p><p>more {k}</p><p>both</p><p>{'pair' if k < 2 else 'solo'}</p></article>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows), unit_bytes=unit).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k] == "\n\n".join(f"story {k} line {i}" for i in range(4))
    assert got[20] == "Site" and got[21] == "a" and got[22] == "" and got[23] == ""
    # of an article only what both neighbours share goes: the middle page has two neighbours
    assert got[31] == "only 1\n\nmore 1\n\npair" and got[30].endswith("both\n\npair")


@pytest.mark.parametrize("unit", [1 << 30, 600])
def test_paragraphs_of_some_articles_stay(spark, unit):
    """What three neighbours of ten have in common is text; what all ten have is the site's."""
    body = lambda k: f"<p>first {k}</p><p>second {k}</p>{'<p>quoted</p>' if k in (3, 4, 5) else '<p>third ' + str(k) + '</p>'}<p>more {k}</p><p>last {k}</p><p>Read on</p>"
    rows = [(k, f"https://art.x/{k}", f"<article>{body(k)}</article>") for k in range(10)]
    got = {r["page_id"]: r["text"] for r in H.extract(pages(spark, rows), unit_bytes=unit).collect()}
    assert got[4] == "first 4\n\nsecond 4\n\nquoted\n\nmore 4\n\nlast 4" and all("quoted" in got[k] for k in (3, 4, 5))
    assert ["Read on" in got[k] for k in range(10)] == [True, *[False] * 8, True]


def test_copies_delete_nothing(spark):
    rows = [(k, f"https://h.x/{k}", "<p>a</p><p>b</p>") for k in range(4)] + [(9, "https://h.x/1", "<p>a</p><p>b</p>")]
    assert {r["text"] for r in H.extract(pages(spark, rows)).collect()} == {"a\n\nb"}


def test_empty(spark):
    assert H.extract(pages(spark, []).limit(0)).collect() == []


def brute(rows):
    """Page differencing by the plain definition: pages of a host in order, a table for the common subsequence."""

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
                out.add(i)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    hosts = {}
    for i, url, html in rows:
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut : min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        hosts.setdefault(rest[:cut].lower(), []).append((path.replace("/", "\1"), str(i), i, H.parts(html or "")))
    out = {}
    for group in hosts.values():
        group.sort(key=lambda r: r[:2])
        kinds = {(x, k == H.BODY) for *_, p in group for x, k in p}
        different = {tuple(p) for *_, p in group if p}
        holds = {x: sum(x in {(t, k == H.BODY) for t, k in p} for p in different) for x in kinds}
        pages = {body: sum(any((k == H.BODY) == body for _, k in p) for p in different) for body in (True, False)}
        site = {x for x, n in holds.items() if n >= H.LEAST and n >= H.SITE * pages[x[1]]}
        for at, (path, _, i, p) in enumerate(group):
            wanted = H.BODY if any(k == H.BODY for _, k in p) else H.PLAIN
            mine = {x for x, (t, k) in enumerate(p) if k == wanted and (t, k == H.BODY) not in site}
            found, near = [], []
            for other in (group[at - 1] if at else None, group[at + 1] if at + 1 < len(group) else None):
                both = common([t for t, _ in p], [t for t, _ in other[3]]) if other else set()
                found.append(set() if 2 * len(both & mine) > len(mine) else both)
                near.append(-1 if other is None else next((n for n, (a, b) in enumerate(zip(path, other[0], strict=False)) if a != b), min(len(path), len(other[0]))))
            nearer = found[near[1] > near[0]]
            gone = {x for x, (t, k) in enumerate(p) if (x in found[0] & found[1] and (t, True) in site if k == H.BODY else x in nearer or (t, False) in site)}
            out[i] = ("\n\n".join(t for x, (t, k) in enumerate(p) if x not in gone and k == wanted), len(gone))
    return out


@pytest.mark.parametrize("unit", [1 << 30, 2000])
def test_whole_query_by_brute_force(spark, unit):
    """Pages as given, and made ones whose furniture only differencing can tell."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    wrap = ["<div>{}</div>", "<article>{}</article>", "<article>{}</article>"]
    for k in range(60):
        body = "".join(f"<p>own {k} {i}</p>" for i in range(k % 4 + 1)) + ("<p>quoted</p>" if k % 5 == 0 else "") + "<p>everywhere</p>"
        rows.append((10_000 + k, f"https://made.x/{k % 7}/{k:02d}", f"<div>Site {k % 2}</div><nav>Menu</nav>{wrap[k % 3].format(body)}<div>Imprint</div>"))
    got = {r["page_id"]: r for r in H.extract(pages(spark, rows), unit_bytes=unit).collect()}
    want = brute(rows)
    assert {i: (r["text"], r["n_shared"]) for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and sum(n for _, n in want.values()) > 150
    assert not any("Imprint" in r["text"] or "Menu" in r["text"] for i, r in got.items() if i >= 10_000)


def test_classes_of_running_text(spark):
    assert text("<article><p class='related-work'>a</p><p class='ad'>b</p><div class='related-links'>c</div><p>x <math><mi>y</mi></math></p></article>") == ["a", "x y"]
