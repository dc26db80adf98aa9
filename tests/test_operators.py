"""Rules, dedupe, frontier, plans, config and streams."""

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import cache, dedupe, frontier, robots, rules
from crawlspark.plans.stages import Plan
from crawlspark.sources import tables
from crawlspark.sources.config import CrawlConfig
from crawlspark.streaming import frontier as streaming


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "url", "blocked"), [("", "http://a/x", False), ("+*.gif", "http://a/x.gif", False), ("+*.gif", "http://a/x.png", True), ("-*.gif", "http://a/x.gif", True), ("-*.gif", "http://a/x.png", False), ("+/preferred/images-/images", "http://a/preferred/images/1", False), ("+/preferred/images-/images", "http://a/images/1", True)])
def test_url_filter(spark, text, url, blocked):
    assert value(spark, rules.url_filter_blocks(F.lit(url), text)) is blocked


def test_server_filter_quirk(spark):
    assert value(spark, rules.server_filter_blocks(F.lit("a.org"), "-b.org")) is False
    assert value(spark, rules.server_filter_blocks(F.lit("a.org"), "-b.org", compat=True)) is True


def test_boolean_word_filter_refuses_bad_expressions():
    for bad in ("(a", "a &", "a b", "| a"):
        with pytest.raises(ValueError):
            rules.boolean_word_filter(F.lit("x"), bad)


def test_robots_compat_flags(spark):
    text = "User-agent: *\nDisallow:"
    assert value(spark, robots.allowed(robots.parse(F.lit(text)), F.lit(200), F.lit("x"), F.lit("/"))) is True
    assert value(spark, robots.allowed(robots.parse(F.lit(text), compat=True), F.lit(200), F.lit("x"), F.lit("/"))) is False
    assert value(spark, robots.allowed(robots.parse(F.lit("")), F.lit(403), F.lit("x"), F.lit("/"), compat=True)) is True


def test_content_duplicates_of_one_domain_only(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "x"), (4, "B", "x"), (5, "A", "x")], "seq int, domain string, body string")
    got = dedupe.content_duplicates(df, "body", "domain", "seq").orderBy("seq").collect()
    assert [r.is_dup for r in got] == [False, True, False, False, True]


def test_admission_by_first_sight(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, "d"), (6, "a")], "i int, server string")
    ok = lambda **k: {r.i for r in rules.admitted(df, "server", ["i"], 2, **k).where("admitted").collect()}
    assert ok() == {1, 2, 6}
    assert ok(compat=True) == {1, 2, 4, 6}


def test_ranges_round_trip(spark):
    df = spark.createDataFrame([("u", "0123456789")], "url string, data string")
    parts = df.select("url", "data", F.explode(cache.range_parts(F.length("data"), F.lit(3))).alias("p"))
    assert [(r.p.end - r.p.start + 1) for r in parts.collect()] == [3, 3, 4]
    chunks = parts.select("url", F.col("p.start").alias("s"), F.expr("substring(data, p.start + 1, p.end - p.start + 1)").alias("d"))
    assert cache.reassembled(chunks, "url", "s", "d").first().data == "0123456789"


def test_link_slice(spark):
    df = spark.createDataFrame([("p", i) for i in range(5)], "src string, o int")
    ids = lambda *a, **k: sorted(r.o for r in frontier.slice_links(df, "src", "o", *a, **k).collect())
    assert ids(1, 3) == [1, 2] and ids(0, -1) == [0, 1, 2, 3, 4] and ids(0, -2) == [0, 1, 2, 3] and ids(0, -2, compat=True) == [0, 1, 2, 3, 4]


def test_bfs_ends_at_the_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2, "page"), (2, 3, "page"), (3, 1, "page"), (2, 9, "style")], "src int, dst int, context string")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.generation) for r in frontier.bfs(seeds, edges).collect()} == {(1, 0), (2, 1), (3, 2), (9, 2)}
    assert {r.node for r in frontier.bfs(seeds, edges, contexts=["page"]).collect()} == {1, 2, 3}


def test_hooks_are_checked():
    plan = Plan([("a", lambda df: df)])
    with pytest.raises(KeyError):
        plan.before("b", lambda df: df)
    with pytest.raises(TypeError):
        plan.after("a", lambda df: df)


def test_config_spellings():
    c = CrawlConfig.from_xml("<h><depth value='3'/><robots>off</robots><urlfilter>-*.gif</urlfilter></h>")
    assert (c.depth, c.robots, c.urlfilter) == (3, False, "-*.gif")
    assert CrawlConfig.from_json(c.to_json()) == c
    with pytest.raises(KeyError):
        CrawlConfig.of(nonsense=1)


def test_seed_and_feed_files(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("www.a.org\n\nhttps://b.org/x\n")
    assert sorted(r.url for r in tables.seeds(spark, str(tmp_path / "seeds.txt")).collect()) == ["http://www.a.org", "https://b.org/x"]
    (tmp_path / "f.xml").write_text("<rss><link>u1</link><item><link>u2</link></item><item><link>u1</link></item></rss>")
    assert [r.url for r in tables.feeds(spark, str(tmp_path / "f.xml")).orderBy("ordinal").collect()] == ["u1", "u2"]


def test_streaming_frontier(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [f'{{"domain":"a","full_url":"http://a/{i % 7}","ts":"2024-01-01T00:00:{i:02d}"}}' for i in range(14)]
    (src / "1.json").write_text("\n".join(rows))
    stream = streaming.frontier_source(spark, str(src), "domain string, full_url string, ts timestamp")
    q = streaming.dedupe(stream).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("deduped").count() == 7
    for name, given in (("turns", {}), ("timed_turns", {"ts": "ts"})):
        q = streaming.paced(stream, delay=2.0, **given).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        got = sorted((r.turn, r.due) for r in spark.table(name).collect())
        assert [t for t, _ in got] == [0] * 5 + [1] * 5 + [2] * 4 and got[5][1] - got[0][1] == got[10][1] - got[5][1] == 2.0


def test_saved_names_do_not_clash(spark, tmp_path):
    rows = spark.createDataFrame([("d", "a", "x", "u1", "h"), ("d", "a", "x", "u2", "h"), ("d", "a", "x", "u3", ""), ("e", "a", "x", "u4", "h")], "domain string, directory string, filename string, url string, html string")
    tables.write_pages(rows, str(tmp_path / "saved"))
    saved = spark.read.parquet(str(tmp_path / "saved"))
    assert {(r["url"], r["saved_name"]) for r in saved.collect()} == {("u1", "x"), ("u2", "x.1"), ("u4", "x")}


def test_redirect_chains_are_joined_once(spark):
    """The result reads written hops: nothing that made the redirects is computed, or sorted beside them, again."""
    from crawlspark.operators import frontier

    moved = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (7, 7), (8, 7)], "s int, d int").groupBy("s").agg({"d": "min"}).toDF("src", "dst")
    got = frontier.redirect_chains(moved, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {tuple(r) for r in got.collect()} == {(1, 3, 2, False, True), (2, 4, 2, False, False), (3, 4, 1, False, False), (7, 7, 1, True, False), (8, 7, 2, True, False)}
