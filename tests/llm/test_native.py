"""The native operators, against brute force, SQL and their plans."""

import os
import re

import duckdb
import pytest

from terrane.llm import decontam, urls
from terrane.llm import queries as Q
from terrane.llm.components import components

from .conftest import EDGE, SF, prose


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    c = sorted(df.columns)
    rows = lambda r: sorted(map(str, (tuple(x) for x in r)))
    assert rows(df.select(*c).collect()) == rows(con.sql(Q.oracle_sql()[name]).select(", ".join(c)).fetchall())
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def grams(t):
    w = [x for x in re.split(r"[\x09-\x0D ]+", (t or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment(spark, edge, nothing):
    long = prose(2, 30000).split(" ")
    items = [(1, " ".join(long[100:140])), (2, " ".join([*long[500:540], "new", "end"])), (3, " ".join([*long[900:920], "x", *long[921:940]])), (4, "too short here"), (5, None), (6, prose(77, 30)), (7, prose(1, 200)), (7, prose(1, 200)), (8, " ".join(long[10:17]).upper())]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontam.contained(edge, it).collect())
    want = sorted({(d, i, len(grams(u)), len(grams(u) & grams(t))) for d, t in EDGE for i, u in items if grams(u) and 5 * len(grams(u) & grams(t)) >= 4 * len(grams(u))})
    assert got == want and len(want) > 5
    assert sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontam.contained(edge, it, most_broadcast=0).collect()) == want
    bad = {d for d, *_ in want}
    kept = decontam.clean(edge, it)
    assert kept.columns == edge.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, _ in EDGE if i not in bad)
    assert decontam.contained(nothing, it).collect() == [] and decontam.contained(edge, it.limit(0)).collect() == []


def page(url, html=None):
    return (None, url, html, "x", "y", 1)


def verdicts(spark, rows, **k):
    p = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "page_id long, url string, html string, host string, key string, rule int")
    return [(r["rule"], r["verdict"], r["source"]) for r in urls.judge(p, **k).orderBy("page_id").collect()]


def test_rules(spark):
    rows = [page("http://A.example.COM/en/1?q"), page("https://example.com/en/71"), page("http://x.net/de/"), page("http://a.example.net/de/80"), page("http://a.example.net/DE/80"), page("ftp://x.org"), page(None), page("no-scheme.com/en/"), page("http://notexample.com/en/7"), page("http://com/en/"), page("http://x.com#/en/"), page("")]
    assert verdicts(spark, rows) == [("com/en/", "block", "rule"), ("example.com/en/7", "allow", "rule"), ("net/de/", "allow", "rule"), ("example.net/de/8", "block", "rule"), (None, "allow", "default"), (None, "allow", "default"), (None, "allow", "default"), (None, "allow", "default"), ("com/en/", "block", "rule"), ("com/en/", "block", "rule"), (None, "allow", "default"), (None, "allow", "default")]


def test_aliases(spark):
    canon = lambda u: f"<link rel='canonical' href=\"{u}\">"
    fresh = lambda u: f'<META HTTP-EQUIV=refresh content="0; URL={u}">'
    rows = [page("http://a.uk/1", canon("https://a.uk/2")), page("http://a.uk/2", fresh("http://b.com/en/x")), page("http://b.com/en/x"), page("http://c.uk/", canon("http://c.com/en/1") + fresh("http://c.net/de/1")), page("http://d.uk/", canon("/relative")), page("http://a.uk/1#frag", "<p>")]
    assert [v[1:] for v in verdicts(spark, rows)] == [("block", "alias"), ("block", "alias"), ("block", "rule"), ("allow", "alias"), ("allow", "default"), ("block", "alias")]
    edges = spark.createDataFrame([("http://e.uk/", "http://e.com/en/"), (None, "x")], "u string, v string")
    assert verdicts(spark, [page("http://e.uk/")], edges=edges) == [(None, "block", "alias")]


def test_many_rules_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    few = sorted(map(str, urls.judge(pages).collect()))
    monkeypatch.setattr(urls, "INLINE", 0)
    assert sorted(map(str, urls.judge(pages).collect())) == few
    assert urls.judge(pages.limit(0)).collect() == [] and {r["verdict"] for r in urls.judge(pages, rules=[]).collect()} == {"allow"}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(30)] + [(100, 101), (101, 100)], [(i * 7 % 31, i * 11 % 31) for i in range(12)]])
def test_components(spark, edges):
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {k: root(k) for k in parent}


def test_relative_targets(spark):
    canon = lambda u: f"<link rel='canonical' href=\"{u}\">"
    rows = [page("http://a.com/x/1?q", canon("/en/9")), page("http://b.com/en/1", "<p>"), page("http://c.uk/d/e", canon("//b.com/en/1")), page("http://b.com/x/y", canon("z")), page("http://b.com/x/z", canon("http://org/es/")), page("http://b.com", canon("en/")), page("http://d.uk/", canon("#top")), page(None, canon("/en/")), page("http://b.com/x/q", canon("?en=1")), page("mailto:me", canon("/en/"))]
    assert [v[1:] for v in verdicts(spark, rows)] == [("block", "alias"), ("block", "rule"), ("block", "alias"), ("block", "alias"), ("block", "alias"), ("block", "alias"), ("allow", "default"), ("allow", "default"), ("allow", "default"), ("allow", "default")]


def test_relative_targets_in_sql(spark, tmp_path):
    link = "<link rel=canonical href={}>"
    rows = [(i, u, link.format(t)) for i, (u, t) in enumerate((u, t) for u in ("http://a.com/x/1?q#f", "http://a.uk", "https://B.org/es/", "x", "ftp://n.net/de/8/../9") for t in ("/en/1", "//b.com/en/", "y/z", "?a=1", "#", "http://c.com/en/", "mailto:x", "../up"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    c = duckdb.connect()
    c.register("pages", df.toPandas())
    got = urls.judge(df)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, c.sql(urls.oracle()).select(", ".join(cols)).fetchall()))


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_long_items(spark, most):
    long = prose(50, 50_000)
    words = long.split(" ")
    docs = spark.createDataFrame([(1, "before " + long + " after"), (2, " ".join(words[:42_000])), (3, " ".join(words[:30_000])), (4, "short")], "doc_id long, text string")
    items = spark.createDataFrame([("a", long), ("b", " ".join(words[100:110]))], "item_id string, text string")
    want = sorted((d, i, len(g & h) / len(g)) for d, t in map(tuple, docs.collect()) for i, u in map(tuple, items.collect()) for g, h in [(grams(u), grams(t))] if 5 * len(g & h) >= 4 * len(g))
    assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontam.contained(docs, items, most_broadcast=most).collect()) == want and len(want) == 5


def test_clean_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, prose(1, 30), 5, 6, 7), (2, "other", 8, 9, 10)], "doc_id long, text string, bad int, _BAD int, own int")
    assert [tuple(r) for r in decontam.clean(docs, spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")).collect()] == [(2, "other", 8, 9, 10)]
