"""The crawl plan: links of pages, rules, limits, the fixpoint, resuming and localisation."""

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import links, urls
from crawlspark.operators import cache, reports, rules
from crawlspark.plans import crawl
from crawlspark.sources import tables
from crawlspark.sources.config import CrawlConfig

PAGES = {
    "http://a.org/d/index.html": '<title>T</title><a href="x.html">x</a><a href="../up.html">u</a><img src="i.png"><a href="http://b.org/p.html">b</a><a href="mailto:x@y">m</a><a href="q?b=1">q</a>',
    "http://a.org/d/x.html": '<base href="http://a.org/d/sub/"><a href="y.html#s">y</a><a href="index.html">i</a><script src="s.js"></script>',
    "http://a.org/d/sub/y.html": '<a href=deep/er/z.html>z</a><form action="f.cgi"><a href="/ads/banner.gif">ad</a>',
    "http://a.org/up.html": '<a href="d/late.html">l</a>',
    "http://b.org/p.html": '<meta name="robots" content="nofollow"><a href="never.html">n</a>',
    "http://a.org/d/late.html": "<p>forbidden words</p>",
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(PAGES.items()), "url string, html string")


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([("a.org/d/index.html",)], "url string")


def run(pages, seeds, files=None, bad=None, state=None, **options):
    return crawl.crawl(pages, seeds, CrawlConfig.of(**options), files, bad, state=state)


def taken(c):
    return {r.url: r.generation for r in c.ledger.collect()}


def reasons(c):
    return {(r.link, r.reject_reason) for r in c.verdicts.where("reject_reason is not null").collect()}


def test_fixpoint_follows_base_and_stays_in_scope(pages, seeds):
    c = run(pages, seeds)
    assert taken(c) == {"http://a.org/d/index.html": 0, "http://a.org/d/x.html": 1, "http://a.org/d/i.png": 1, "http://a.org/d/sub/y.html": 2, "http://a.org/d/sub/index.html": 2, "http://a.org/d/sub/s.js": 2, "http://a.org/d/sub/deep/er/z.html": 3, "http://a.org/d/sub/f.cgi": 3}
    assert {("../up.html", "external"), ("http://b.org/p.html", "external"), ("/ads/banner.gif", "junk")} <= reasons(c)
    by = {r.url: r for r in c.ledger.collect()}
    assert by["http://a.org/d/x.html"].saved and not by["http://a.org/d/i.png"].fetched and by["http://a.org/d/sub/y.html"].parent_url == "http://a.org/d/x.html"


def test_fetch_levels_and_limits(pages, seeds):
    near = run(pages, seeds, fetchlevel=1, maxfiles=5)
    assert "http://b.org/p.html" not in taken(near) and "http://a.org/up.html" in taken(near) and len(taken(near)) == 5
    wide = taken(run(pages, seeds, fetchlevel=2))
    assert "http://b.org/p.html" in wide and "http://b.org/never.html" not in wide and "http://a.org/d/late.html" in wide
    far = run(pages, seeds, fetchlevel=4, robots=False, depth=2)
    assert "http://b.org/never.html" in taken(far) and "http://a.org/d/sub/deep/er/z.html" not in taken(far) and ("deep/er/z.html", "depth") in reasons(far)
    assert ("http://b.org/p.html", "external") in reasons(run(pages, seeds, fetchlevel=4, serverfilter="-b.org", maxfiles=2))
    assert taken(run(pages, seeds, timelimit=0)) == {"http://a.org/d/index.html": 0}


def test_type_gates_filters_and_words(pages, seeds):
    c = run(pages, seeds, images=False, javascript=False, querylinks=True, fetchlevel=1, wordfilter="forbidden")
    assert not {"http://a.org/d/i.png", "http://a.org/d/sub/s.js"} & set(taken(c)) and "http://a.org/d/q?b=1" in taken(c)
    saved = {r.url for r in c.ledger.where("saved").collect()}
    assert "http://a.org/d/late.html" in taken(c) and "http://a.org/d/late.html" not in saved and "http://a.org/up.html" in saved
    c = run(pages, seeds, urlfilter="-x.html", simulate=True)
    assert taken(c).keys() == {"http://a.org/d/index.html", "http://a.org/d/i.png"} and c.ledger.where("saved").count() == 0
    assert taken(run(pages, seeds, maxfilesize=10)) == {"http://a.org/d/index.html": 0}
    assert taken(run(pages, seeds, offset_start=0, offset_end=1)).keys() == {"http://a.org/d/index.html", "http://a.org/d/x.html", "http://a.org/d/sub/y.html", "http://a.org/d/sub/deep/er/z.html"}


def test_robots_known_bad_and_external_limits(spark, pages, seeds):
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /d/sub", 200)], "host string, robots_txt string, http_status int")
    c = run(pages, seeds, robots)
    assert ("y.html#s", "robots") in reasons(c) and "http://a.org/d/sub/y.html" not in taken(c)
    bad = spark.createDataFrame([("http://a.org/d/i.png",)], "url string")
    dead = pages.withColumn("status", F.when(F.col("url").endswith("x.html"), 404).otherwise(200))
    assert {("x.html", "known_bad"), ("i.png", "known_bad")} <= reasons(run(dead, seeds, bad=bad))
    many = spark.createDataFrame([("http://a.org/d/index.html", "".join(f'<a href="http://s{i}.org/">' for i in range(5)))], "url string, html string")
    c = run(many, seeds, fetchlevel=4, maxextservers=2)
    assert len(taken(c)) == 3 and sum(r == "ext_servers" for _, r in reasons(c)) == 3
    dirs = spark.createDataFrame([("http://a.org/d/index.html", "".join(f'<a href="/e{i}/p.html">' for i in range(5)))], "url string, html string")
    assert len(taken(run(dirs, seeds, fetchlevel=1, maxextdirs=3))) == 4


def test_priorities_order_a_generation(pages, seeds):
    c = run(pages, seeds, urlpriority="png+3")
    first = {r.url: r.priority for r in c.ledger.where("generation = 1").collect()}
    assert first["http://a.org/d/i.png"] < first["http://a.org/d/x.html"]


def test_crawl_goes_on_where_it_ended(pages, seeds, tmp_path):
    whole = taken(run(pages, seeds))
    cut = taken(run(pages, seeds, state=str(tmp_path), maxfiles=2))
    assert len(cut) == 2
    assert taken(run(pages, seeds, state=str(tmp_path))) == whole


def test_presets_and_parts(spark):
    assert CrawlConfig().browsing().skipruletypes == ("image", "stylesheet") and CrawlConfig().simulated().simulate
    files = spark.createDataFrame([("u", 10, True), ("v", 10, False), ("w", 0, True)], "url string, n_bytes bigint, accepts_ranges boolean")
    got = [(r.url, r.part, r.start, r.end) for r in crawl.file_parts(files, CrawlConfig.of(numparts=3)).orderBy("url", "part").collect()]
    assert got == [("u", 0, 0, 2), ("u", 1, 3, 5), ("u", 2, 6, 9), ("v", 0, 0, 9)]


def test_localised_links(spark, pages):
    page = "http://a.org/d/index.html"
    one = spark.createDataFrame([(page, "<base href=\"x\"><a href='x.html'>x</a><a href=../up.html>u</a><img src=\"i.png\"><a href=\"http://b.org/p.html\">b</a><a href=\"y.html#s\">y</a>".replace('<base href="x">', ""))], "url string, html string")
    saved = spark.createDataFrame([("http://a.org/d/x.html",), ("http://a.org/up.html",), ("http://a.org/d/y.html",)], "url string")
    html = crawl.localised(one, saved).first().html
    assert html == '<a href="x.html">x</a><a href="../up.html">u</a><img src="http://a.org/d/i.png"><a href="http://b.org/p.html">b</a><a href="y.html#s">y</a>'
    absolute = crawl.localised(one, saved, CrawlConfig.of(localise=1), root="/r").first().html
    assert 'href="file:///r/a.org/d/x.html"' in absolute
    renamed = spark.createDataFrame([("a.org/d/x.html", "a.org/d/x.html.1")], "old string, new string")
    assert 'href="x.html.1"' in crawl.localised(one, saved, renamed=renamed).first().html
    assert crawl.localised(one, saved, CrawlConfig.of(localise=0)).first().html == one.first().html


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_small_url_functions(spark):
    u = urls.parse(F.lit("http://www.a.b.org:8080/x/y/f.html"))
    assert value(spark, urls.full_url_sans_port(u)) == "http://www.a.b.org/x/y/f.html" and value(spark, urls.base_domain_with_port(u)) == "b.org:8080"
    assert value(spark, urls.relative_url(u)) == "/x/y/f.html" and value(spark, urls.relative_url(u, compat=True)) == "/x/y//f.html" and value(spark, urls.directory_sans_domain(u)) == "/x/y/"
    assert value(spark, urls.is_cgi(F.lit("a.php?x"), F.lit("generic"))) and value(spark, urls.css_child_type(F.lit("A.CSS"))) == "stylesheet"
    assert value(spark, urls.lower_keys(F.create_map(F.lit("A"), F.lit(1), F.lit("a"), F.lit(2)))) == {"a": 2}
    assert value(spark, urls.escapes_decoded(F.lit("a%7eb%20c%41"))) == "a~b c%41" and value(spark, urls.eta_label(F.lit(7300), F.lit(2))) == "1:00:50" and value(spark, urls.byte_label(F.lit(2048))) == "2.0K"
    assert value(spark, urls.with_base_port(urls.parse(F.lit("http://c.org/")), u))["port"] == 8080 and value(spark, urls.is_mirror(F.lit("M.org"), ["m.org"]))
    assert value(spark, urls.relative_depth(F.lit("http://a/b/c/"), F.lit("http://a/"), 2)) == 2 and value(spark, urls.relative_depth(F.lit("http://a/b/"), F.lit("http://a/c/"), 1, F.lit(True))) == 0
    df = spark.createDataFrame([("http://a.org/x/y.html", "../z.html"), ("http://a.org/q", None)], "url string, to string")
    got = {r.u.full_url: (r.u_old and r.u_old.full_url, r.reresolved) for r in urls.reresolved(urls.resolved(df, F.col("url"), F.lit("generic"), F.lit(None).cast("string"), "u"), F.col("to")).collect()}
    assert got == {"http://a.org/z.html": ("http://a.org/x/y.html", True), "http://a.org/q": (None, False)}
    assert value(spark, links.kept_link(F.lit("x?N=D"), F.lit("Index of /"))) is False and value(spark, links.kept_link(F.lit("x?n=d"), F.lit("T"), by_list=True)) is False
    extra = links.html_links(F.lit('<video poster="v.jpg">'), links.LINK_TAGS | {"video": ("poster", "image")})
    assert value(spark, extra)[0]["url"] == "v.jpg"


def test_filter_precedence(spark):
    text = "-/images+/images/ok"
    url = F.lit("http://a/images/ok/1")
    assert value(spark, rules.url_filter_blocks(url, text)) is False and value(spark, rules.url_filter_blocks(url, text, "order")) is True


def test_plan_of_resolution_is_small(spark, pages):
    found = crawl.resolved_links(crawl.page_links(pages)).where("u.full_url like '%x%' and u.filelike")
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 150_000


def test_cache_tables(spark, tmp_path):
    cached = spark.createDataFrame([("a.org", "http://a.org/x/y.html", "body", {"ETag": "1"}), ("b.org", "http://b.org/", None, None)], "domain string, url string, data string, headers map<string,string>")
    tables.write_cache(cached, str(tmp_path / "c"))
    back = tables.read_cache(spark, str(tmp_path / "c"), ["a.org"])
    assert [r.url for r in back.collect()] == ["http://a.org/x/y.html"]
    assert [tuple(r) for r in tables.rebuilt(cached).collect()] == [("a.org/x/y.html", "body")]
    assert [tuple(r) for r in tables.cached_headers(cached).collect()] == [("http://a.org/x/y.html", "ETag", "1")]
    seen = spark.createDataFrame([("http://a.org/x/y.html", {"ETag": "2", "Age": "3"})], "url string, headers map<string,string>")
    assert {r.url: r.headers for r in cache.with_headers(cached, seen, ["url"]).collect()} == {"http://a.org/x/y.html": {"ETag": "2", "Age": "3"}, "http://b.org/": {}}
    tables.save_session({"urls": cached.select("url")}, str(tmp_path / "s" / "1"))
    assert tables.restore_session(spark, str(tmp_path / "s"), ["urls"])["urls"].count() == 2 and tables.restore_session(spark, str(tmp_path / "none"), ["urls"]) is None
    (tmp_path / "junk.txt").write_text("# list\nx.org\n\ny.org\n")
    assert sorted(tables.lines(spark, str(tmp_path / "junk.txt"))) == ["x.org", "y.org"]


def test_paths_and_collections(spark):
    df = spark.createDataFrame([("h/a",), ("h/a/b.html",), ("h/c",)], "path string")
    assert {r.path: r.saved_path for r in tables.repaired_paths(df).collect()} == {"h/a": "h/a/index.html", "h/a/b.html": "h/a/b.html", "h/c": "h/c"}
    found = reports.collections(spark.createDataFrame([("p", "webpage", "generic", "x", 0), ("p", "webpage", "generic", "x", 3), ("p", "webpage", "stylesheet", "s", 1), ("p", "webpage", "generic", "w", 2)], "source string, source_type string, type string, child string, ordinal int"))
    assert {r.context: r.children for r in found.collect()} == {"page": ["x", "w"], "style": ["s"]}
    assert reports.of_context(found, "page", ["x"]).first().children == ["w"]
    named = reports.with_urls(spark.createDataFrame([(1, 2)], "source_id int, child_id int"), spark.createDataFrame([(1, "a"), (2, "b")], "url_id int, url string")).first()
    assert (named.source_url, named.child_url) == ("a", "b")
    assert reports.tree_is_html("t.HTM") and not reports.tree_is_html("tree")
    with pytest.raises(ValueError):
        reports.tree_is_html("t.pdf")
    page = spark.createDataFrame([("u", '<meta name="robots" content="noindex">x'), ("v", "y")], "url string, html string")
    assert reports.swish_records(page).count() == 1


def test_directory_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    (tmp_path / "a.org.txt").write_text("User-agent: *\nDisallow: /")
    assert [r.name for r in tables.directory(spark, str(tmp_path / "d")).collect()] == ["a.txt"]
    assert tables.robots_files(spark, str(tmp_path / "a.org.txt")).first().host == "a.org"
