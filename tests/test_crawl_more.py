"""The crawl's stylesheets, repeated contents, redirects and cache."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import frontier
from crawlspark.plans import crawl, recrawl
from crawlspark.sources.config import CrawlConfig

OPTIONS = CrawlConfig.of(junkfilter=False, maxfiles=-1)


def site(spark, pages):
    return spark.createDataFrame([(f"http://a.org/{k}" if "://" not in k else k, v) for k, v in pages.items()], "url string, html string")


def taken(c):
    return {r.url.removeprefix("http://a.org/"): r.generation for r in c.ledger.collect()}


def test_stylesheets_lead_on(spark):
    pages = {"index.html": '<link rel="stylesheet" href="s.css"><link rel="stylesheet" href="style.php">', "s.css": '@import "t.css"; b { background: url(bg.png) url(bg.png) }', "t.css": '<a href="no.html">', "style.php": "@import url(u.css); i { background: url('/i/x.gif') }"}
    c = crawl.crawl(site(spark, pages), site(spark, {"index.html": ""}), OPTIONS)
    assert taken(c) == {"index.html": 0, "s.css": 1, "style.php": 1, "t.css": 2, "bg.png": 2, "u.css": 2, "i/x.gif": 2}
    assert {(r.link, r.context) for r in c.verdicts.collect()} == {("s.css", "style"), ("style.php", "style"), ("t.css", "css2"), ("bg.png", "css"), ("u.css", "css2"), ("/i/x.gif", "css")}


def test_repeated_contents_are_not_followed_and_survive_a_restart(spark, tmp_path):
    body = '<a href="kid.html">k</a>'
    pages = site(spark, {"index.html": '<a href="x/p.html">1</a><a href="y/p.html">2</a><a href="z/q.html">3</a><a href="http://b.org/p.html">4</a>', "x/p.html": body, "y/p.html": body, "z/q.html": '<a href="p.html">5</a>', "z/p.html": body, "http://b.org/p.html": body})
    seeds = site(spark, {"index.html": ""})
    wide = CrawlConfig.of(junkfilter=False, maxfiles=-1, fetchlevel=4)
    want = {"index.html": 0, "x/p.html": 1, "y/p.html": 1, "z/q.html": 1, "http://b.org/p.html": 1, "x/kid.html": 2, "http://b.org/kid.html": 2, "z/p.html": 2}
    whole = crawl.crawl(pages, seeds, wide)
    assert taken(whole) == want and {r.url for r in whole.ledger.where("repeats").collect()} == {"http://a.org/y/p.html", "http://a.org/z/p.html"}
    state = str(tmp_path / "s")
    crawl.crawl(pages, seeds, CrawlConfig.of(junkfilter=False, maxfiles=2, fetchlevel=4), state=state)
    again = crawl.crawl(pages, seeds, wide, state=state)
    assert taken(again) == want and again.ledger.where("repeats").count() == 2 and again.verdicts.count() == whole.verdicts.count()


def test_redirects_are_judged_before_and_behind(spark):
    pages = {"d/index.html": '<a href="old.html">1</a><a href="out.html">2</a><a href="loop.html">3</a><a href="bad.html">4</a>', "d/new.html": '<a href="kid.html">k</a>', "d/fine.html": "x"}
    moved = spark.createDataFrame([(f"http://a.org/d/{a}", b) for a, b in (("old.html", "mid.html"), ("mid.html", "http://a.org/d/new.html"), ("out.html", "http://c.org/x.html"), ("loop.html", "pool.html"), ("pool.html", "loop.html"), ("bad.html", "fine.html"), ("first.html", "index.html"))], "src string, dst string")
    c = crawl.crawl(site(spark, pages), site(spark, {"d/first.html": ""}), CrawlConfig.of(junkfilter=False, urlfilter="-bad"), redirects=moved)
    assert taken(c) == {"d/index.html": 0, "d/new.html": 1, "d/kid.html": 2}
    assert {(r.link, r.url.rsplit("/", 1)[1], r.reject_reason) for r in c.verdicts.collect()} == {("old.html", "new.html", None), ("out.html", "x.html", "external"), ("loop.html", "loop.html", "redirect"), ("bad.html", "bad.html", "url_filter"), ("kid.html", "kid.html", None)}


def followed(src, to, repeats=4, most=20):
    """Redirects that a client follows from ``src`` by the rule of repeats and different URLs, and whether it is refused."""
    met, n = {}, 0
    while src in to:
        src = to[src]
        if met.get(src, 0) >= repeats or len(met) >= most:
            return n, True
        met[src] = met.get(src, 0) + 1
        n += 1
    return n, False


@pytest.mark.parametrize("seed", [0, 1])
def test_contracted_chains_equal_following_them(spark, seed):
    rnd = random.Random(seed)
    to = {i: i - rnd.randint(1, 3) if rnd.random() < 0.8 else rnd.randint(0, 400) for i in range(1, 400)} | {900: 900, 901: 902, 902: 901} | {1000 + i: 1001 + i for i in range(70)}
    got = {r.url: r for r in frontier.redirects_followed(frontier.contracted(spark.createDataFrame(list(to.items()), "src bigint, dst bigint"))).collect()}
    assert got.keys() == to.keys()
    for url in to:
        path, at = [], url
        while at in to and at not in path:
            path.append(at)
            at = to[at]
        r = got[url]
        if at in path:
            assert (r.target, r.hops, r.loop, r.cycle) == (at, path.index(at), True, len(path) - path.index(at))
        else:
            assert (r.target, r.hops, r.loop, r.cycle) == (at, len(path), False, None)
        assert (r.followed, r.refused) == followed(url, to)
    assert frontier.contracted(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_the_second_crawl_reads_the_cache(spark, tmp_path):
    store, columns = str(tmp_path / "c"), "url string, html string, status int, modified timestamp"
    row = lambda k, html, status=200, at=None: (f"http://a.org/{k}", html, status, at and datetime(2020, 1, at))
    index = '<a href="a.html">a</a><a href="b.html">b</a><a href="c.html">c</a><a href="gone.html">g</a>'
    seeds = site(spark, {"index.html": ""})
    one = recrawl.recrawl(spark.createDataFrame([row("index.html", index, at=1), row("a.html", "A", at=1), row("b.html", "B"), row("c.html", "C secret", at=1)], columns), seeds, store, CrawlConfig.of(wordfilter="secret"))
    codes = lambda r: {x.url.removeprefix("http://a.org/"): (x.code, x.data) for x in r.outcomes.collect()}
    assert codes(one) == {"index.html": (1, index), "a.html": (1, "A"), "b.html": (1, "B"), "c.html": (5, "C secret"), "gone.html": (0, None)} and one.version == 1
    disk = spark.createDataFrame([("http://a.org/index.html",), ("http://a.org/b.html",)], "url string")
    two = recrawl.recrawl(spark.createDataFrame([row("index.html", None, 304), row("a.html", "A later", at=1), row("b.html", "B"), row("c.html", "C", at=2)], columns), seeds, store, CrawlConfig.of(wordfilter="secret"), on_disk=disk)
    assert codes(two) == {"index.html": (3, index), "a.html": (4, "A"), "b.html": (3, "B"), "c.html": (1, "C"), "gone.html": (0, None)} and two.version == 2
    assert {r.url for r in recrawl.read_cache(spark, store, 1).collect()} == {f"http://a.org/{k}.html" for k in ("index", "a", "b")}
    assert {r.url: r.data for r in recrawl.read_cache(spark, store).collect()}["http://a.org/c.html"] == "C"


def test_one_page_takes_the_least_of_each_key(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("l", "z", 3)], "key string, url string, n int")
    assert {tuple(r) for r in crawl.one_page(df, "key").select("key", "url", F.col("n")).collect()} == {("k", "a", 2), ("l", "z", 3)}


def test_rows_that_repeat_a_page_are_localised_alike(spark):
    pages = site(spark, {"d/i.html": '<a href="x.html">1</a><a href="y.html">2</a>'})
    saved = site(spark, {"d/x.html": ""})
    got = [r.html for r in crawl.localised(pages.unionByName(pages), saved).collect()]
    assert len(got) == 2 and set(got) == {r.html for r in crawl.localised(pages, saved).collect()} == {'<a href="x.html">1</a><a href="http://a.org/d/y.html">2</a>'}
