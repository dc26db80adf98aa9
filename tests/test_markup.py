"""The tokenizer on broken markup, its links against those of expressions, and response headers."""

import time

from pyspark.sql import functions as F

from crawlspark.functions import links, urls
from crawlspark.functions.markup import tags_of
from crawlspark.plans import crawl
from crawlspark.sources.config import CrawlConfig

DIR = "/root/testdata/sf0.001"


def test_tokens_of_broken_markup():
    cases = {
        "": [],
        "a < b <": [],
        "<A HREF=x/y>": [("a", {"href": "x/y"})],
        "<a href='x>y' HREF=z a>": [("a", {"href": "x>y", "a": ""})],
        '<a/href="x"/><br/>': [("a", {"href": "x"}), ("br", {})],
        '<a href = "x"title=t>': [("a", {"href": "x", "title": "t"})],
        "<a href=x<b>c": [("a", {"href": "x<b"})],
        '<b><a href="x': [("b", {})],
        "<b><a href=": [("b", {})],
        "<a href=><i>": [("a", {"href": ""}), ("i", {})],
        "<!--<a>--><b>": [("b", {})],
        "<!--><b><!---><i><!--x--!><u><!-- <a>": [("b", {}), ("i", {}), ("u", {})],
        "<!doctype html><?x <a>?><b>": [("b", {})],
        "</a href='>'><b></><i></ <a>>": [("b", {}), ("i", {})],
        "<script>'<a>' </scripty></SCRIPT ><b>": [("script", {}), ("b", {})],
        "<title><a></title><style><i>": [("title", {}), ("style", {})],
        "<a =x=y>": [("a", {"=x": "y"})],
        "<a\n\tb\f=\r'c'>é<ü><p é=ü>": [("a", {"b": "c"}), ("p", {"é": "ü"})],
    }
    assert {h: tags_of(h) for h in cases} == cases


def test_time_is_linear():
    for piece in ("<", "<a", "<!--", "<a href='", "</", "<a b=c ", "<script>", "<!", "<a " + " ", "<a =", "<b>"):
        began = time.time()
        tags_of(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 5, piece


def test_links_equal_those_of_expressions_on_sound_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    both = pages.select(links.html_links(F.col("html")).alias("a"), links.strict_links(F.col("html")).alias("b"))
    assert both.where("size(a) > 0").count() > 0 and both.where("a <> b").count() == 0
    odd = spark.createDataFrame([(None,), ("",), ("<a href=' p.html#s '><a href='a>b'><link href=x rel=StyleSheet>",)], "html string")
    got = [[(x.type, x.url) for x in r[0]] for r in odd.select(links.strict_links(F.col("html"))).collect()]
    assert got == [[], [], [("anchor", "p.html#s"), ("webpage", "p.html"), ("generic", "a>b"), ("stylesheet", "x")]]
    page = spark.createDataFrame([("http://h.org/", "<textarea><a href=no.html></textarea><a title='>' href=yes.html>")], "url string, html string")
    found = lambda n: [r.link for r in crawl.page_links(page, CrawlConfig.of(htmlparser=n)).orderBy("ordinal").collect()]
    assert found(1) == ["yes.html"] and "no.html" in found(0)


def test_meta_in_any_order_titles_with_markup_and_bad_escapes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(links.meta_refresh(F.lit("<meta name=x content='1; url=no'><META content='5; URL=next.html' http-equiv=Refresh>"))) == "next.html"
    assert one(links.meta_refresh(F.lit('<meta http-equiv="refresh" content="5; x; URL=a">'))) is None
    assert one(links.meta_robots(F.lit("<meta content='NoIndex' name='robots'>"))).asDict() == {"nofollow": False, "noindex": True}
    assert one(links.meta_robots(F.lit("<p>"))).asDict() == {"nofollow": False, "noindex": False}
    assert [one(links.title(F.lit(t))) for t in ("<title> a <b>c</b></title>x", "<TITLE>open <p>", "<p>", "<title></title>")] == ["a <b>c</b>", "open", "", ""]
    assert one(urls.percent_decoded(F.lit("a%20b%zz%2Bc%+%4"))) == "a b%zz+c%+%4"


def test_headers(spark):
    h = lambda **k: F.create_map(*[F.lit(x) for n, v in k.items() for x in (n.replace("_", "-"), v)]) if k else F.expr("cast(map() as map<string,string>)")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(urls.content_length(h(content_length=v), F.lit("abc"))) for v in ("7", " 7 , 9", "x")] == ["7", "7", "x"]
    assert one(urls.content_length(h(), F.lit("abc"))) == "3" and one(urls.content_length(h(), F.lit(None).cast("string"))) == "0"
    assert [one(urls.content_type(h(content_type=v))) for v in ("a/b", "a/b; c", "; c", "")] == ["a/b", "a/b", "; c", ""] and one(urls.content_type(h())) == ""
    assert one(urls.content_encoding(h())) == "plain" and one(urls.last_modified(h(last_modified="x"))) == "x"
    assert [one(urls.is_mirror(F.lit(x))) for x in ("Kent.dl.sourceforge.net", "downloads.sourceforge.net", "sourceforge.net")] == [True, True, False]
