"""Registered queries of the crawl library and their SQL.

Facts that the test tables lack are given to both engines alike: golden cases (frames,
junk, robots files) as the same VALUES, and over all pages by one expression that adds
them to each page's html (``RICH``) or makes the pages a site of linked names (``SITE``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import links, urls
from .operators import cache, dedupe, frontier, reports, robots, rules, search
from .plans import crawl, recrawl, stages
from .sources import tables
from .sources.config import CrawlConfig
from .sources.scratch import durable, shared_dir
from .streaming import frontier as streaming

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, values: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


# Shared SQL: the parts of a page URL
PARTS = r"""p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) host, regexp_extract(url, '^(.*?://)', 1) scheme FROM pages)"""
HREFS = r"""a AS (SELECT page_id, host, scheme, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1)) href FROM pages JOIN p USING (page_id))"""


# Both engines: pages with a script redirect, a refresh, a stylesheet, an image, a deep link, a link elsewhere, and tags in comments and scripts
RICH = """concat('<!-- <a href="/hidden">x</a> --><script>var s = "<a href=/script>"; location.href = "', regexp_extract(html, '<a href="([^"]*)"', 1), '";</script><meta http-equiv="refresh" content="5; URL=next', page_id, '.html"><link rel="stylesheet" href="s.css"><img src="pic.png"><a href="sub/a/b/c/d/page.html">x</a><a href="http://far.example.org/x">y</a>', html)"""
# Both engines: each page is named by its second link, so that the pages link to one another
SITE = """concat('http://site.example.com', regexp_extract(html, '</li><li><a href="([^"]*)"', 1))"""
# SQL: the directory of each page; the links of rich pages in order; what they resolve to
DIRS = r"""h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) origin, list_filter(string_split(regexp_replace(regexp_replace(url, '/$', ''), '^[a-z]+://[^/?#]*', ''), '/'), lambda s: trim(s) <> '') q FROM pages),
g AS (SELECT page_id, url, origin, regexp_extract(origin, '://(.*)$', 1) host, origin || '/' || array_to_string(list_transform(CASE WHEN len(q) > 0 AND (instr(q[-1], '.') = 0 OR (instr(q[-1], '.') > 1 AND instr(q[-1], '.') < length(q[-1]))) THEN q[:-2] ELSE q END, lambda s: s || '/'), '') dir FROM h)"""
LINKS = r"""x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) h FROM pages),
l AS (SELECT page_id, list_concat([{'t': 'webpage', 'u': h[1]}, {'t': 'generic', 'u': 'next' || page_id || '.html'}, {'t': 'stylesheet', 'u': 's.css'}, {'t': 'generic', 'u': 'sub/a/b/c/d/page.html'}, {'t': 'generic', 'u': 'http://far.example.org/x'}],
 list_transform(h, lambda v: {'t': CASE WHEN contains(v, '#') THEN 'anchor' ELSE 'generic' END, 'u': v}), [{'t': 'image', 'u': 'pic.png'}]) a FROM x),
e AS (SELECT page_id, unnest(a) l, generate_subscripts(a, 1) o FROM l), d AS (SELECT page_id, l.t t, l.u u, min(o) o FROM e GROUP BY ALL),
links AS (SELECT page_id, t, u, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 ordinal FROM d)"""
RESOLVED = DIRS + ", " + LINKS + r""", c AS (SELECT links.*, g.* EXCLUDE (page_id), rtrim(replace(replace(replace(CASE WHEN t = 'anchor' THEN regexp_extract(u, '^[^#]*', 0) ELSE u END, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) k FROM links JOIN g USING (page_id)),
n AS (SELECT *, CASE WHEN starts_with(k, '/') THEN substr(k, 2) END w FROM c),
r AS (SELECT * EXCLUDE (k, w), CASE WHEN w IS NOT NULL THEN origin || '/' || w || CASE WHEN instr(w, '.') = 0 OR (instr(w, '.') > 1 AND instr(w, '.') < length(w)) THEN '' ELSE '/' END WHEN starts_with(k, 'http') THEN k ELSE dir || k END full_url FROM n)"""


def _rich(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", F.expr(RICH).alias("html"))


def _site(spark, d):
    named = _t(spark, d, "pages").select("page_id", F.expr(SITE).alias("url"), "html")
    return named.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("x")).select("x.page_id", "url", "x.html")


@query(rf"""WITH {PARTS}, {HREFS}, u AS (SELECT DISTINCT host, scheme, href FROM a)
SELECT host, count(*) AS n_links, count(*) FILTER (starts_with(href, '/')) AS n_internal FROM u GROUP BY host""")
def link_summary_by_host(spark, d):
    found = _t(spark, d, "pages").select(urls.parse(F.col("url")).alias("p"), "url", F.explode(links.hrefs(F.col("html"))).alias("href"))
    done = found.select(F.col("p.domain").alias("host"), F.col("p.protocol").alias("scheme"), "href").distinct()
    return done.groupBy("host").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("href").startswith("/")).alias("n_internal"))


@query(rf"""WITH {PARTS} SELECT page_id, scheme AS protocol, host AS domain, CASE WHEN len(string_split(host, '.')) > 2 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS base_domain, CASE WHEN scheme = 'https://' THEN 443 ELSE 80 END AS port FROM p""")
def url_parts(spark, d):
    p = urls.parse(F.col("url"))
    return _t(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", "p.protocol", "p.domain", urls.base_domain(F.col("p.domain")).alias("base_domain"), "p.port")


@query("SELECT page_id, md5(url) AS url_id, sha1(html) AS page_hash FROM pages")
def url_hashes(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_id"), F.sha1("html").alias("page_hash"))


@query(rf"""WITH {PARTS}, h AS (SELECT *, substr(rtrim(url, '/'), length(scheme) + 1) rest FROM p), x AS (SELECT *, list_filter(string_split(CASE WHEN url LIKE '%/' THEN substr(url, length(scheme) + 1, length(url) - length(scheme) - 1) ELSE substr(url, length(scheme) + 1) END, '/'), lambda s: trim(s) <> '')[2:] q FROM h),
f AS (SELECT *, len(q) > 0 AND (instr(q[-1], '.') = 0 OR (instr(q[-1], '.') > 1 AND instr(q[-1], '.') < length(q[-1]))) fl FROM x)
SELECT page_id, scheme || host || '/' || array_to_string(list_transform(CASE WHEN fl THEN q[:-2] ELSE q END, lambda s: s || '/'), '') AS directory, len(CASE WHEN fl THEN q[:-2] ELSE q END) AS depth, CASE WHEN fl THEN q[-1] ELSE 'index.html' END AS filename FROM f""")
def url_dirs_depth(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.parse(F.col("url")).alias("u")).select("page_id", urls.url_directory(F.col("u")).alias("directory"), F.size("u.dirpath").alias("depth"), F.col("u.filename").alias("filename"))


# Golden cases of URL resolution
RESOLVE = """(0, 'http://www.yahoo.com/photos/my photo.gif', 'generic', ''), (3, '/sports/2003/jun/25beck1.htm', 'generic', 'http://www.rediff.com'), (5, 'http://www.python.org/doc/2.3b2/', 'generic', ''),
(6, '//images.sourceforge.net/div.png', 'image', 'http://sourceforge.net'), (13, '#anchor', 'anchor', 'http://www.foo.com/bar/index.html'), (15, '../icons/up.png', 'image', 'http://www.python.org/doc/current/tut/node2.html'),
(17, 'fileadmin/dz.gov.si/templates/../../../index.php', 'generic', 'http://www.dz-rs.si'), (19, 'http://arstechnica.com/reviews/os/macosx-10.4.ars', 'generic', ''), (20, 'http://www.fylkesmannen.no/../fmt_hoved.asp', 'generic', 'http://www.fylkesmannen.no/osloogakershu')"""


@query("""SELECT * FROM (VALUES (0, 'http://www.yahoo.com/photos/my%20photo.gif', false, true, ''), (3, 'http://www.rediff.com/sports/2003/jun/25beck1.htm', true, true, ''), (5, 'http://www.python.org/doc/2.3b2', false, true, ''), (6, 'http://images.sourceforge.net/div.png', false, true, ''), (13, 'http://www.foo.com/bar/index.html', false, true, '#anchor'), (15, 'http://www.python.org/doc/current/icons/up.png', true, true, ''), (17, 'http://www.dz-rs.si/index.php', true, true, ''), (19, 'http://arstechnica.com/reviews/os/macosx-10.4.ars/', false, false, ''), (20, 'http://www.fylkesmannen.no/fmt_hoved.asp', false, true, '')) t(id, full_url, is_rel, filelike, anchor)""")
def url_resolve_relative(spark, d):
    v = _values(spark, RESOLVE, "id, url, typ, base")
    return v.select("id", urls.resolve(F.col("url"), F.col("typ"), F.nullif("base", F.lit(""))).alias("u")).select("id", "u.full_url", "u.is_rel", "u.filelike", "u.anchor")


@query("SELECT id, replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS decoded FROM (VALUES (1, 'a?b=1&amp;c=2'), (2, 'x&lt;y&gt;'), (3, 'plain')) t(id, u)")
def url_entities(spark, d):
    return _values(spark, "(1, 'a?b=1&amp;c=2'), (2, 'x&lt;y&gt;'), (3, 'plain')", "id, u").select("id", urls.decode_entities(F.col("u")).alias("decoded"))


@query("""SELECT page_id, translate(url, '?*"<>!:/\\', '') AS valid FROM pages""")
def filename_sanitise(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.valid_filename(F.col("url")).alias("valid"))


KINDS = "(1, 'a.GIF', 'generic'), (2, 'b.pdf', 'generic'), (3, 'c.css', 'generic'), (4, 'd', 'image'), (5, 'e.html', 'anchor'), (6, 'f.jpg', 'generic'), (7, 'g.xyz', 'generic')"


@query(f"SELECT id, CASE WHEN typ = 'image' THEN 'image' WHEN typ = 'anchor' THEN 'webpage' WHEN regexp_matches(lower(name), '\\.(gif|jpg)$') THEN 'image' WHEN name LIKE '%.pdf' THEN 'document' ELSE 'webpage' END AS kind FROM (VALUES {KINDS}) t(id, name, typ)")
def url_type_by_extension(spark, d):
    return _values(spark, KINDS, "id, name, typ").select("id", urls.kind(F.col("name"), F.col("typ")).alias("kind"))


MIMES = "(1, 'text/html; charset=utf-8'), (2, 'image/png'), (3, 'text/css'), (4, ''), (5, 'application/pdf'), (6, 'application/zip')"


@query(f"SELECT id, CASE WHEN m = '' THEN 'webpage' WHEN m LIKE 'image/%' THEN 'image' WHEN m = 'text/css' THEN 'stylesheet' WHEN m LIKE '%html%' THEN 'webpage' WHEN m = 'application/pdf' THEN 'document' ELSE 'file' END AS kind FROM (VALUES {MIMES}) t(id, m)")
def mime_type_classify(spark, d):
    return _values(spark, MIMES, "id, m").select("id", urls.mime_kind(F.col("m"), F.lit("webpage")).alias("kind"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title FROM pages")
def title_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", links.title(F.col("html")).alias("title"))


# Golden pages
HTML = """(1, '<a href="p.html#s">x</a><img src="i.png"><link rel="stylesheet" href="s.css"><a href="p.html#s">again</a>'), (2, '<meta http-equiv="refresh" content="5; URL=next.html"><meta name="robots" content="noindex,nofollow">'), (3, '<applet codebase="lib/" code="a.class"></applet><frame src="f.html">'), (4, '<script>location.href = "go.html"; window.location.replace("z.html"); location.replace("bad);</script>'), (5, '<!-- <a href="no.html"> --><script>x = "<img src=no.png>"</script><a href=bare.html><a href=\\'single.html\\'>')"""


@query("SELECT * FROM (VALUES (1, 'anchor', 'p.html#s', 0), (1, 'webpage', 'p.html', 1), (1, 'image', 'i.png', 2), (1, 'stylesheet', 's.css', 3), (3, 'frame', 'f.html', 0), (5, 'generic', 'bare.html', 0), (5, 'generic', 'single.html', 1)) t(id, type, url, ordinal)")
def anchor_split(spark, d):
    return _values(spark, HTML, "id, html").select("id", F.posexplode(links.html_links(F.col("html"))).alias("ordinal", "l")).select("id", "l.type", "l.url", "ordinal")


@query(f"WITH {LINKS} SELECT page_id, ordinal, t AS link_type, u AS link FROM links")
def page_link_union(spark, d):
    return crawl.page_links(_rich(spark, d)).select("page_id", "ordinal", "link_type", "link")


@query(f"WITH {RESOLVED} SELECT page_id, ordinal, full_url, NOT starts_with(u, 'http') AS is_rel FROM r")
def page_links_resolved(spark, d):
    return crawl.resolved_links(crawl.page_links(_rich(spark, d))).select("page_id", "ordinal", "u.full_url", "u.is_rel")


@query(r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) h FROM pages),
l AS (SELECT page_id, list_concat([{'t': 'stylesheet', 'u': 's.css'}, {'t': 'image', 'u': 'pic.png'}, {'t': 'generic', 'u': 'sub/a/b/c/d/page.html'}, {'t': 'generic', 'u': 'http://far.example.org/x'}, {'t': 'generic', 'u': 'a>b.html'}], list_transform(h, lambda v: {'t': CASE WHEN contains(v, '#') THEN 'anchor' ELSE 'generic' END, 'u': v})) a FROM x),
e AS (SELECT page_id, unnest(a) l, generate_subscripts(a, 1) o FROM l), d AS (SELECT page_id, l.t t, l.u u, min(o) o FROM e GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS ordinal, t AS link_type, u AS link FROM d""")
def strict_links(spark, d):
    """The links of rich pages by the tokenizer; a tag in a text area, one in a quoted value and a quoted ``>`` are added, which expressions take wrongly."""
    told = F.regexp_replace(F.expr(RICH), '<a href="http://far.example.org/x">y</a>', '<a href="http://far.example.org/x" title="<a href=no1>">y</a><textarea><a href=no2></textarea><a href="a>b.html">z</a>')
    found = _t(spark, d, "pages").select("page_id", F.posexplode(links.strict_links(told)).alias("ordinal", "l"))
    return found.select("page_id", "ordinal", F.col("l.type").alias("link_type"), F.col("l.url").alias("link"))


# Both engines: the headers that a server sends with a page
HEADERS = ["CASE page_id % 3 WHEN 0 THEN '12, 34' WHEN 1 THEN ' 56 ' END AS len", "CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN '; charset=x' END AS typ", "CASE WHEN page_id % 5 = 0 THEN 'gzip' END AS enc", "CASE WHEN page_id % 2 = 0 THEN 'Sun, 06 Nov 1994 08:49:37 GMT' END AS since"]


@query(f"""WITH h AS (SELECT page_id, length(html) n, {", ".join(HEADERS)} FROM pages) SELECT page_id, CASE page_id % 3 WHEN 0 THEN '12' WHEN 1 THEN '56' ELSE n::VARCHAR END AS content_length,
 CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 3 THEN '' ELSE typ END AS content_type, coalesce(enc, 'plain') AS content_encoding, coalesce(since, '') AS last_modified FROM h""")
def header_fields(spark, d):
    """What the headers of a response say of its body."""
    sent = _t(spark, d, "pages").selectExpr("page_id", "html", *HEADERS)
    named = F.create_map(F.lit("content-length"), "len", F.lit("content-type"), "typ", F.lit("content-encoding"), "enc", F.lit("last-modified"), "since")
    told = sent.select("page_id", "html", F.map_filter(named, lambda k, v: v.isNotNull()).alias("h"))
    h = F.col("h")
    return told.select("page_id", urls.content_length(h, F.col("html")).alias("content_length"), urls.content_type(h).alias("content_type"), urls.content_encoding(h).alias("content_encoding"), urls.last_modified(h).alias("last_modified"))


@query(rf"""WITH {DIRS} SELECT page_id, origin || '/b/c/s.css' AS full_url FROM g""")
def base_href_applied(spark, d):
    based = _t(spark, d, "pages").withColumn("html", F.lit('<html><base href="/b/c/x.html"><link rel=stylesheet href=s.css>')).select("page_id", "url", "html")
    return crawl.resolved_links(crawl.page_links(based)).select("page_id", "u.full_url")


@query("SELECT page_id, 'next' || page_id || '.html' AS url FROM pages")
def meta_refresh(spark, d):
    return _rich(spark, d).select("page_id", links.meta_refresh(F.col("html")).alias("url"))


@query("SELECT page_id, contains(url, '/en/') AS nofollow, NOT contains(url, '/en/') AS noindex FROM pages")
def meta_robots(spark, d):
    says = F.when(F.col("url").contains("/en/"), "nofollow").otherwise("noindex")
    tagged = F.concat(F.lit('<meta name="robots" content="'), says, F.lit('">'), F.col("html"))
    return _t(spark, d, "pages").select("page_id", links.meta_robots(tagged).alias("m")).select("page_id", "m.nofollow", "m.noindex")


@query("""SELECT page_id, regexp_extract(html, '<a href="([^"]*)"', 1) AS url FROM pages""")
def js_redirects(spark, d):
    return _rich(spark, d).select("page_id", F.explode(links.js_redirects(F.col("html"))).alias("url"))


@query("SELECT * FROM (VALUES (4, 'go.html'), (4, 'z.html')) t(id, url)")
def js_redirect_cases(spark, d):
    return _values(spark, HTML, "id, html").select("id", F.explode(links.js_redirects(F.col("html"))).alias("url"))


@query("SELECT page_id, 'lib/p' || page_id || '.class' AS url FROM pages")
def applet_links(spark, d):
    tagged = F.concat(F.lit('<applet codebase="lib/" code="p'), F.col("page_id").cast("string"), F.lit('.class"></applet>'), F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.explode(links.applet_links(tagged)).alias("url"))


@query("SELECT page_id, unnest(['a' || page_id || '.css', 'b.css', 'b.css', 'i.png']) AS url FROM pages")
def css_urls(spark, d):
    css = F.concat(F.lit('@import "a'), F.col("page_id").cast("string"), F.lit('.css"; @import url(b.css); p{background:url(i.png)}'))
    return _t(spark, d, "pages").select("page_id", F.explode(links.css_urls(css)).alias("url"))


@query(f"""WITH {LINKS}, k AS (SELECT page_id AS source, CASE WHEN t = 'stylesheet' THEN 'style' ELSE 'page' END context, u, min(ordinal) o FROM links GROUP BY ALL)
SELECT source, context, count(*) AS n, string_agg(u, ' ' ORDER BY o) AS children FROM k GROUP BY source, context""")
def link_collections(spark, d):
    found = crawl.page_links(_rich(spark, d)).select(F.col("page_id").alias("source"), F.lit("webpage").alias("source_type"), F.col("link_type").alias("type"), F.col("link").alias("child"), "ordinal")
    return reports.collections(found).withColumn("children", F.array_join("children", " "))


CONTEXTS = "(1, 'webpage', 'stylesheet'), (2, 'stylesheet', 'stylesheet'), (3, 'webpage', 'image'), (4, 'stylesheet', 'image'), (5, 'webpage', 'frame')"


@query(f"SELECT id, CASE WHEN t = 'frame' THEN 'frame' WHEN t = 'stylesheet' AND s = 'stylesheet' THEN 'css2' WHEN t = 'stylesheet' THEN 'style' WHEN s = 'stylesheet' THEN 'css' ELSE 'page' END AS context FROM (VALUES {CONTEXTS}) v(id, s, t)")
def link_contexts(spark, d):
    return _values(spark, CONTEXTS, "id, s, t").select("id", reports.context(F.col("s"), F.col("t")).alias("context"))


@query(r"SELECT page_id, NOT (regexp_matches(url, '(?i)example') AND NOT regexp_matches(url, '(?i)zzz')) AS include_only, regexp_matches(url, '(?i)/en/') AS exclude_only FROM pages")
def url_filter_truth(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", rules.url_filter_blocks(u, "+example-/en/").alias("include_only"), rules.url_filter_blocks(u, "-/en/").alias("exclude_only"))


# Golden cases of the junk filter
JUNK = "(1, 'http://a.tribalfusion.com/images/1.gif', 'domain'), (2, 'http://stats.webtrendslive.com/cgi-bin/stats.pl', 'domain'), (3, 'http://stats.cyberclick.net/cgi-bin/stats.pl', 'base-domain'), (4, 'http://m.doubleclick.net/images/anim.gif', 'base-domain'), (5, 'http://www.foo.com/popupads/ad.gif', 'pattern'), (6, 'http://www.foo.com/htmlad/1.html', 'pattern'), (7, 'http://www.foo.com/logos/nbclogo.gif', 'pattern'), (8, 'http://www.foo.com/bar/siteads/1.ad', 'pattern'), (9, 'http://www.foo.com/banners/world-banners/banner.gif', 'pattern'), (10, 'http://ads.foo.com/', 'pattern'), (11, 'http://www.foo.com/doc/logo.gif', ''), (12, 'http://www.foo.org/bar/vodka/pattern.html', '')"


@query(f"SELECT id, nullif(expected, '') AS reason FROM (VALUES {JUNK}) t(id, url, expected)")
def junk_filter(spark, d):
    v = _values(spark, JUNK, "id, url, expected").withColumn("p", urls.parse(F.col("url")))
    return v.select("id", rules.junk_reason(F.col("url"), F.col("p.domain"), urls.base_domain(F.col("p.domain"))).alias("reason"))


# Golden cases of robots exclusion
ROBOTS = r"""(1, '', 401, 'x', '/x/', false), (2, '', 404, 'x', '/x/', true), (3, 'User-agent: *\nDisallow: /search', 200, 'spam', '/search', false), (4, 'User-agent: *\nDisallow: /search', 200, 'spam', '/Musician/me', true), (5, 'User-agent: CherryPickerSE\nDisallow: /', 200, 'CherryPickerSE/1.0', '/cgi-bin/event-search', false), (6, 'User-agent: ExtractorPro\nDisallow: /', 200, 'extractorpro', '/blubba', false), (7, 'User-agent: *\nAllow: /a/b\nDisallow: /a', 200, 'x', '/a/b', true), (8, 'User-agent: foo\nDisallow: /', 200, 'bar', '/', true), (9, 'User-agent: *\nDisallow: /p # note', 200, 'x', '/p', false), (10, 'User-agent: *\nDisallow:', 200, 'x', '/', true), (11, 'User-agent: *\nAllow: /', 200, 'x', '/', true)"""


@query(f"SELECT id, expected AS allowed FROM (VALUES {ROBOTS}) t(id, txt, status, agent, path, expected)")
def robots_verdict(spark, d):
    v = _values(spark, ROBOTS, "id, txt, status, agent, path, expected")
    return v.select("id", robots.allowed(robots.parse(F.col("txt")), F.col("status"), F.col("agent"), F.col("path")).alias("allowed"))


# SQL: every link with its page (the parent) and with the start of the page: the first page of its base domain
SCOPE = RESOLVED + r""", b AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') bd FROM g), s AS (SELECT bd, min(page_id) page_id FROM b GROUP BY bd),
st AS (SELECT s.bd, b.host s_host, b.dir s_dir FROM s JOIN b USING (page_id)), j AS (SELECT r.*, s_host, s_dir, regexp_replace(regexp_extract(full_url, '://([^/]*)', 1), '^www\.', '') u_host FROM r JOIN b USING (page_id) JOIN st USING (bd)),
k AS (SELECT page_id, ordinal, t, starts_with(full_url, s_dir) under, u_host = regexp_replace(s_host, '^www\.', '') same, regexp_replace(host, '^www\.', '') = regexp_replace(s_host, '^www\.', '') parent_same, r_dir = s_dir in_start_dir FROM (SELECT *, dir r_dir FROM j))"""


def _scope(level: int):
    def run(spark, d):
        found = crawl.resolved_links(crawl.page_links(_rich(spark, d))).withColumn("_base", urls.base_domain(F.col("page_domain")))
        places = urls.parsed(_t(spark, d, "pages").select("page_id", "url"), F.col("url"), "p")
        starts = places.groupBy(urls.base_domain(F.col("p.domain")).alias("_base")).agg(F.min(F.struct("page_id", F.col("p.domain").alias("d"), urls.url_directory(F.col("p")).alias("t"))).alias("s"))
        placed = found.join(starts.select("_base", F.col("s.d").alias("start_domain"), F.col("s.t").alias("start_directory")), "_base")
        judged = crawl.judged_links(placed, CrawlConfig.of(fetchlevel=level, junkfilter=False, depth=-1))
        return judged.select("page_id", "ordinal", (F.col("reject_reason").eqNullSafe("external")).alias("is_external"))

    return run


for _level, (_same, _other) in enumerate([("true", "true"), ("false", "true"), ("false", "NOT parent_same"), ("NOT in_start_dir", "NOT parent_same"), ("false", "false")]):
    QUERIES[f"scope_fetchlevel_{_level}"] = _scope(_level)
    ORACLE[f"scope_fetchlevel_{_level}"] = f"WITH {SCOPE} SELECT page_id, ordinal, CASE WHEN under OR t IN ('image', 'stylesheet') THEN false WHEN same THEN {_same} ELSE {_other} END AS is_external FROM k"


@query(r"SELECT page_id, len(list_filter(string_split(regexp_replace(regexp_replace(url, '/$', ''), '^.*?://[^/]*', ''), '/'), lambda s: s <> '')) > 2 AS beyond FROM pages")
def depth_limit(spark, d):
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "/$", ""), "^.*?://[^/]*", ""), "/"), lambda s: s != "")
    return _t(spark, d, "pages").select("page_id", rules.beyond_depth(F.size(parts), 2).alias("beyond"))


@query(rf"WITH {PARTS}, f AS (SELECT host, min(page_id) first FROM p GROUP BY host), r AS (SELECT host, row_number() OVER (ORDER BY first) n FROM f) SELECT page_id, n <= 10 AS admitted FROM p JOIN r USING (host)")
def ext_server_limit(spark, d):
    p = _t(spark, d, "pages").select("page_id", urls.parse(F.col("url"))["domain"].alias("host"))
    return rules.admitted(p, "host", ["page_id"], 10).select("page_id", "admitted")


@query("SELECT doc_id, regexp_matches(text, '(?i)idiot') AS blocked FROM documents")
def word_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", rules.word_filter(F.col("text"), "idiot").alias("blocked"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)[\s+<>]the') AND (regexp_matches(text, '(?i)[\s+<>]idiot') OR NOT regexp_matches(text, '(?i)[\s+<>]of')) AS matched FROM documents")
def word_filter_bool(spark, d):
    return _t(spark, d, "documents").select("doc_id", rules.boolean_word_filter(F.col("text"), "the & (idiot | !of)").alias("matched"))


@query(rf"""WITH {RESOLVED} SELECT CASE WHEN ends_with(full_url, 'a') THEN 'known_bad' WHEN regexp_matches(full_url, '(?i)the') THEN 'url_filter' WHEN regexp_matches(full_url, 'spam-farm|/on$') THEN 'junk'
 WHEN t NOT IN ('image', 'stylesheet') AND starts_with(full_url, 'http://far.') AND host <> 'far.example.org' THEN 'external' WHEN regexp_matches(full_url, '^[a-z]+://[^/]*example\.net/t') THEN 'robots' WHEN contains(full_url, '/sub/a/b/c/d/') THEN 'depth' ELSE 'accepted' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def reject_funnel(spark, d):
    found = crawl.resolved_links(crawl.page_links(_rich(spark, d)))
    hosts = urls.parsed(_t(spark, d, "pages").select("url"), F.col("url"), "p").select(F.col("p.domain").alias("host")).distinct()
    files = hosts.where("host like '%example.net'").select("host", F.lit("User-agent: *\nDisallow: /t").alias("robots_txt"), F.lit(200).alias("http_status"))
    bad = found.select(F.col("u.full_url").alias("url")).where(F.col("url").endswith("a"))
    judged = crawl.judged_links(found, CrawlConfig.of(fetchlevel=1, urlfilter="-the", depth=4), files, bad, junk_lists=(("nowhere.example",), ("spam-farm", "/on$")))
    return judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# SQL: the site's pages by name, and its links as far as the rules of the crawl allow
SITE_SQL = rf"""n AS (SELECT {SITE} url, min(page_id) page_id FROM pages GROUP BY 1), x AS (SELECT n.url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) h FROM n JOIN pages USING (page_id)),
k AS (SELECT url, rtrim(replace(replace(replace(regexp_extract(h, '^[^#]*', 0), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) w FROM x),
e AS (SELECT url, 'http://site.example.com' || w || CASE WHEN instr(substr(w, 2), '.') = 0 OR (instr(substr(w, 2), '.') > 1 AND instr(substr(w, 2), '.') < length(w) - 1) THEN '' ELSE '/' END dst FROM k),
p AS (SELECT *, regexp_extract(rtrim(replace(replace(replace(url, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '[^/]*$', 0) f FROM n), c AS (SELECT url, 'http://site.example.com/' || f || CASE WHEN instr(f, '.') = 0 OR (instr(f, '.') > 1 AND instr(f, '.') < length(f)) THEN '' ELSE '/' END src FROM p),
a AS (SELECT DISTINCT src, dst FROM e JOIN c USING (url) WHERE NOT regexp_matches(dst, '(?i)ment')), s AS (SELECT src FROM c JOIN n USING (url) ORDER BY page_id LIMIT 1)"""


def _crawled(spark, d):
    site = _site(spark, d)
    seeds = site.orderBy("page_id").limit(1).select("url")
    return crawl.crawl(site.select("url", "html"), seeds, CrawlConfig.of(fetchlevel=0, urlfilter="-ment", junkfilter=False, maxfiles=-1))


@query(f"WITH RECURSIVE {SITE_SQL}, r AS (SELECT src url, 0 AS generation FROM s UNION SELECT dst, generation + 1 FROM r JOIN a ON src = r.url WHERE generation < 40) SELECT url, min(generation) AS generation, coalesce(bool_or(src IS NOT NULL), false) AS fetched FROM r LEFT JOIN (SELECT DISTINCT src FROM c) ON src = url GROUP BY url")
def crawl_fixpoint(spark, d):
    return _crawled(spark, d).ledger.select("url", "generation", "fetched")


@query("WITH h AS (SELECT doc_id, source, text FROM documents), f AS (SELECT text, min(doc_id) o, arg_min(source, doc_id) s FROM h GROUP BY text) SELECT doc_id, doc_id > o AND h.source IS NOT DISTINCT FROM f.s AS is_dup FROM h JOIN f USING (text)")
def content_dup_same_domain(spark, d):
    return dedupe.content_duplicates(_t(spark, d, "documents").select("doc_id", "source", "text"), "text", "source", "doc_id").select("doc_id", "is_dup")


@query(rf"WITH {PARTS} SELECT host, count(*) AS n_urls FROM (SELECT DISTINCT host, url FROM p) GROUP BY host")
def url_dedupe(spark, d):
    p = _t(spark, d, "pages").select(urls.parse(F.col("url"))["domain"].alias("host"), F.col("url").alias("full_url"))
    return dedupe.distinct_urls(p).groupBy("host").agg(F.count(F.lit(1)).alias("n_urls"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def seen_anti(spark, d):
    return dedupe.unseen(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def saved_semi(spark, d):
    return dedupe.already_saved(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(rf"WITH {PARTS} SELECT page_id, 3 - 1 - CASE WHEN regexp_matches(lower(url), '\.html$') THEN 2 ELSE 0 END - CASE WHEN instr(host, 'blog') > 0 THEN 1 ELSE 0 END AS priority FROM p")
def frontier_priority(spark, d):
    p = _t(spark, d, "pages").withColumn("u", urls.parse(F.col("url")))
    return p.select("page_id", frontier.priority(F.lit(3), F.lit(True), urls.extension(F.col("u.filename")), F.col("u.domain"), "html+2", "blog+1").alias("priority"))


@query("SELECT page_id, length(url) AS priority FROM pages ORDER BY length(url), page_id LIMIT 20")
def frontier_topk(spark, d):
    return frontier.max_files(_t(spark, d, "pages").select("page_id", F.length("url").alias("priority")), ["priority", "page_id"], 20)


@query(f"WITH RECURSIVE {SITE_SQL}, r AS (SELECT src node, 0 AS generation FROM s UNION SELECT dst, generation + 1 FROM r JOIN a ON src = node WHERE generation < 40) SELECT node, min(generation) AS generation FROM r GROUP BY node")
def bfs_levels(spark, d):
    found = urls.parsed(crawl.resolved_links(crawl.page_links(_site(spark, d))), F.col("url"), "p")
    edges = durable(found.select(urls.full_url(F.col("p")).alias("src"), F.col("u.full_url").alias("dst")).where("dst not rlike '(?i)ment'").distinct())
    first = urls.parsed(_site(spark, d), F.col("url"), "p").orderBy("page_id").limit(1).select(urls.full_url(F.col("p")).alias("node"))
    return frontier.bfs(first, edges)


@query(rf"WITH {PARTS}, {HREFS}, o AS (SELECT host url, count(*) n_out FROM a GROUP BY host), i AS (SELECT href url, count(*) n_in FROM a GROUP BY href) SELECT url, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (url)")
def link_in_out_degree(spark, d):
    found = _t(spark, d, "pages").select(urls.parse(F.col("url"))["domain"].alias("src"), F.explode(links.hrefs(F.col("html"))).alias("dst"))
    return reports.link_degrees(found)


@query("""WITH n AS (SELECT o_orderkey k, CASE WHEN o_orderpriority LIKE '1%' THEN 304 ELSE 200 END status, CASE WHEN o_orderpriority LIKE '2%' THEN '' WHEN o_orderpriority NOT LIKE '1%' THEN o_orderstatus END b, o_orderdate m FROM orders),
c AS (SELECT o_orderkey k, CASE WHEN o_orderstatus = 'F' THEN sha1('F') ELSE sha1('other') END s, CASE WHEN o_totalprice > 200000 THEN o_orderdate ELSE o_orderdate - INTERVAL 1 DAY END m2, CASE WHEN o_totalprice < 150000 THEN 'kept' END data FROM orders WHERE o_totalprice > 50000)
SELECT k AS url, CASE WHEN status = 304 OR coalesce(m2 >= m, false) OR coalesce(s = sha1(b), false) THEN CASE WHEN data IS NOT NULL AND b IS NULL THEN 'restored' ELSE 'up_to_date' END WHEN coalesce(length(b), 0) = 0 THEN CASE WHEN data IS NOT NULL THEN 'restored' ELSE 'empty' END ELSE 'written' END AS outcome FROM n LEFT JOIN c USING (k)""")
def cache_freshness(spark, d):
    o = _t(spark, d, "orders")
    first, body = F.col("o_orderpriority"), F.col("o_orderstatus")
    fetched = o.select(F.col("o_orderkey").alias("url"), F.when(first.startswith("1"), 304).otherwise(200).alias("status"), F.col("o_orderdate").alias("modified"), F.when(first.startswith("2"), "").when(~first.startswith("1"), body).alias("body"))
    cached = o.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("url"), F.when(body == "F", F.sha1(F.lit("F"))).otherwise(F.sha1(F.lit("other"))).alias("cached_sha"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate")).otherwise(F.expr("o_orderdate - INTERVAL 1 DAY")).alias("cached_modified"), F.when(F.col("o_totalprice") < 150000, "kept").alias("cached_data"))
    return cache.freshness(fetched, cached, ["url"]).select("url", "outcome")


@query("SELECT o_orderkey AS url, o_totalprice * 2 AS checksum FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0")
def cache_upsert(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("checksum"))
    return cache.upsert(o, o.where("url % 5 = 0").withColumn("checksum", F.col("checksum") * 2), ["url"])


# Both engines: a fetch log, one fetch per line item
LOG = "l_orderkey AS url, l_returnflag = 'A' AS ok, l_returnflag <> 'A' AND l_quantity > 48 AS fatal, l_suppkey = 1 AS seed"


@query(f"WITH l AS (SELECT {LOG} FROM lineitem) SELECT url FROM l GROUP BY url HAVING bool_or(NOT ok) AND NOT bool_or(ok) AND NOT bool_or(fatal) AND NOT bool_or(seed)")
def retry_set(spark, d):
    return cache.retry_set(_t(spark, d, "lineitem").selectExpr(*LOG.split(", ")), "url")


@query(f"WITH l AS (SELECT {LOG} FROM lineitem) SELECT url FROM l GROUP BY url HAVING bool_or(NOT ok) AND bool_or(ok)")
def retried(spark, d):
    return cache.retried(_t(spark, d, "lineitem").selectExpr(*LOG.split(", ")), "url")


@query("SELECT bool_or(n.o_totalprice > 100000) AS updated FROM orders n")
def cache_any_updated(spark, d):
    old = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("v"))
    return cache.any_updated(old, old.withColumn("v", F.when(F.col("v") > 100000, -F.col("v")).otherwise(F.col("v"))), ["url"], "v")


@query("SELECT o_orderkey AS url, o_orderpriority AS domain, o_orderpriority IN ('1-URGENT', '2-HIGH') AS accepts_ranges FROM orders")
def range_support(spark, d):
    files = _t(spark, d, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderpriority").alias("domain"))
    return cache.with_servers(files, _values(spark, "('1-URGENT', 'bytes'), ('2-HIGH', 'Bytes'), ('5-LOW', 'none')", "domain, accept_ranges"))


@query("SELECT l_orderkey AS url, round(100 * sum(l_linenumber) / sum(l_linenumber + 10), 6) AS percent, round(sum(l_linenumber) / max(l_linenumber), 6) AS rate FROM lineitem GROUP BY l_orderkey")
def part_totals(spark, d):
    parts = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), (F.col("l_linenumber") + 10).alias("n_bytes"), F.col("l_linenumber").alias("done_bytes"), F.col("l_linenumber").alias("seconds"))
    return cache.part_totals(parts).select("url", F.round("percent", 6).alias("percent"), F.round("rate", 6).alias("rate"))


@query("SELECT user_id AS fetcher, max(value) AS waited FROM events GROUP BY user_id ORDER BY max(value) DESC, user_id LIMIT 1")
def longest_block(spark, d):
    return reports.longest_block(_t(spark, d, "events").groupBy(F.col("user_id").alias("fetcher")).agg(F.max("value").alias("waited")))


@query("WITH l AS (SELECT user_id AS project, max(ts) m FROM events GROUP BY user_id) SELECT project, m + INTERVAL 6 HOUR AS ended FROM l WHERE (SELECT max(ts) FROM events) - INTERVAL 6 HOUR > m")
def project_timeout(spark, d):
    return streaming.quiet(_t(spark, d, "events").withColumnRenamed("user_id", "project"), "6 HOUR")


STATUSES = "(200), (304), (401), (404), (407), (500), (503), (504), (418)"


@query(f"SELECT status, status IN (401, 404, 407) OR status BETWEEN 500 AND 504 AS fatal, CASE WHEN status < 300 THEN 'ok' WHEN status = 304 THEN 'not_modified' WHEN status IN (404, 503, 504) THEN 'add_to_filter' WHEN status = 401 THEN 'stop' WHEN status = 407 THEN 'proxy' WHEN status BETWEEN 500 AND 502 THEN 'give_up' ELSE 'retry' END AS action FROM (VALUES {STATUSES}) t(status)")
def error_classify(spark, d):
    fatal, action = rules.error_action(F.col("status"))
    return _values(spark, STATUSES, "status").select("status", fatal.alias("fatal"), action.alias("action"))


@query("SELECT count(DISTINCT user_id) AS links, count(DISTINCT event_type) AS servers, count(DISTINCT user_id % 10) AS dirs, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error' AND value > 90) AS fatal, count(DISTINCT event_id) FILTER (event_id % 6 IN (1, 2)) AS files, count(*) FILTER (event_id % 6 = 3) AS repos, count(*) FILTER (event_id % 6 = 4) AS cache, sum(event_id) AS bytes FROM events")
def crawl_stats(spark, d):
    e = _t(spark, d, "events")
    log = e.select(F.col("user_id").alias("url"), F.col("event_type").alias("server"), (F.col("user_id") % 10).alias("directory"), F.col("event_id").alias("filename"), (F.col("event_id") % 6).alias("code"), (F.col("event_type") != "error").alias("ok"), ((F.col("event_type") == "error") & (F.col("value") > 90)).alias("fatal"), F.col("event_id").alias("bytes"))
    return reports.crawl_stats(log)


@query("SELECT event_type, floor(count(*) / 60 * 100) / 100 AS fps, floor(sum(event_id) / 1024 / 60 * 100) / 100 AS kbps FROM events GROUP BY event_type")
def crawl_rates(spark, d):
    g = _t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("b"))
    fps, kbps = reports.rates(F.col("n"), F.col("b"), F.lit(60))
    return g.select("event_type", fps.cast("double").alias("fps"), kbps.cast("double").alias("kbps"))


@query("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 500")
def max_files_limit(spark, d):
    return frontier.max_files(_t(spark, d, "events"), ["ts", "event_id"], 500).select("event_id", "value")


@query("SELECT o_orderkey AS url, i AS part, i * ((o_orderkey + 10) // 4) AS start, CASE WHEN i = 3 THEN o_orderkey + 10 ELSE (i + 1) * ((o_orderkey + 10) // 4) END - 1 AS \"end\" FROM orders, unnest([0, 1, 2, 3]::BIGINT[]) AS u(i)")
def range_split(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("url"), F.explode(cache.range_parts(F.col("o_orderkey") + 10, F.lit(4))).alias("p")).select("url", "p.part", "p.start", "p.end")


@query("SELECT l_orderkey AS url, string_agg(l_returnflag || l_linenumber, '' ORDER BY l_linenumber, l_returnflag) AS data FROM lineitem GROUP BY l_orderkey")
def range_reassemble(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("s"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("d"))
    return cache.reassembled(li, "url", "s", "d")


@query(r"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) h FROM pages), y AS (SELECT page_id, url, unnest(h) c, generate_subscripts(h, 1) o FROM x), z AS (SELECT page_id, any_value(url) url, c, min(o) o FROM y GROUP BY page_id, c)
SELECT any_value(url) AS url, any_value(url) || string_agg(chr(10) || chr(9) || c, '' ORDER BY o) AS tree FROM z GROUP BY page_id""")
def url_tree_text(spark, d):
    found = _t(spark, d, "pages").select("page_id", "url", F.posexplode(links.hrefs(F.col("html"))).alias("o", "c"))
    return reports.url_tree(found, "url", "c", "o", key="page_id").select("url", "tree")


@query(r"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1) h FROM pages), y AS (SELECT page_id, url, unnest(h) c, generate_subscripts(h, 1) o FROM x), z AS (SELECT page_id, any_value(url) url, c, min(o) o FROM y GROUP BY page_id, c)
SELECT any_value(url) AS url, '<li>' || any_value(url) || '<ul>' || string_agg('<li>' || c || '</li>', '' ORDER BY o) || '</ul></li>' AS tree FROM z GROUP BY page_id""")
def url_tree_html(spark, d):
    found = _t(spark, d, "pages").select("page_id", "url", F.posexplode(links.hrefs(F.col("html"))).alias("o", "c"))
    return reports.url_tree(found, "url", "c", "o", html=True, key="page_id").select("url", "tree")


@query("SELECT 'url:' || source || ',files:' || count(*) || ',links:' || count(DISTINCT lang) AS line FROM documents GROUP BY source")
def stats_line(spark, d):
    g = _t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("l"))
    return g.select(reports.stats_line({"url": F.col("source"), "files": F.col("n"), "links": F.col("l")}).alias("line"))


@query(r"WITH b AS (SELECT url, trim(regexp_replace(html, '[^\x00-\x7F]', '', 'g'), ' ') b FROM pages) SELECT 'Path-Name: ' || url || chr(10) || 'Content-Length: ' || length(b) || chr(10) || chr(10) || b AS record FROM b")
def swish_feed(spark, d):
    return _t(spark, d, "pages").select(reports.swish_feed(F.col("url"), F.col("html")).alias("record"))


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM documents), g AS (SELECT term, doc_id, count(*) uses FROM t GROUP BY ALL) SELECT term, count(*) AS n_docs, sum(uses)::BIGINT AS n_uses, min(doc_id) AS first_doc FROM g GROUP BY term")
def inverted_index(spark, d):
    return reports.inverted_index(_t(spark, d, "documents"), "doc_id", "text")


@query("WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x IN ('license', 'mit')) t FROM documents) SELECT doc_id, len(t)::BIGINT AS uses FROM t WHERE len(list_distinct(t)) = 2")
def term_search(spark, d):
    return reports.term_search(reports.postings(_t(spark, d, "documents"), "doc_id", "text"), "doc_id", ["license", "mit"])


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') a FROM documents), u AS (SELECT doc_id, unnest(a) term, generate_subscripts(a, 1) - 1 p FROM t) SELECT term, doc_id, count(*) AS uses, min(p) AS \"first\" FROM u GROUP BY ALL")
def index_postings(spark, d):
    return reports.postings(_t(spark, d, "documents"), "doc_id", "text")


# SQL: the index of the documents and the terms of the benchmark's items
INDEX = r"""a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') t FROM documents), l AS (SELECT doc_id, len(t) n FROM a WHERE len(t) > 0),
i AS (SELECT doc_id, term, count(*) uses FROM (SELECT doc_id, unnest(t) term FROM a) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM benchmark))"""


@query(rf"""WITH {INDEX}, z AS (SELECT count(*) n, avg(n) mean FROM l), w AS (SELECT term, ln(1 + (any_value(z.n) - count(*) + 0.5) / (count(*) + 0.5)) idf FROM i, z WHERE term IN (SELECT term FROM q) GROUP BY term),
p AS (SELECT item_id, doc_id, term, idf * uses * 2.2 / (uses + 1.2 * (0.25 + 0.75 * l.n / mean)) x FROM q JOIN w USING (term) JOIN i USING (term) JOIN l USING (doc_id), z),
s AS (SELECT item_id, doc_id, sum(round(x * 1e9)::BIGINT) / 1e9 score FROM p GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def ranked_search(spark, d):
    """The ten documents that answer each item of the benchmark best."""
    wanted = search.asked(_t(spark, d, "benchmark"), "item_id", "text")
    best = search.ranked_texts(_t(spark, d, "documents"), "doc_id", "text", wanted, "item_id", 10)
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(r"""WITH a AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' ' t FROM documents), q AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' ' p FROM benchmark)
SELECT item_id, doc_id, (len(t) - len(replace(t, p, ''))) // len(p) AS uses FROM q JOIN a ON contains(t, p)""")
def phrase_search(spark, d):
    """The documents that hold the words of a benchmark item one after the other, and how often."""
    wanted = search.asked(_t(spark, d, "benchmark"), "item_id", "text")
    return search.phrases(search.index(_t(spark, d, "documents"), "doc_id", "text", wanted=wanted), "doc_id", wanted, "item_id")


@query()
def stemmed_index(spark, d):
    """How many documents and uses each stem has, stop words excluded."""
    held = search.index(_t(spark, d, "documents"), "doc_id", "text", reports.STOP_WORDS, stemmed=True)
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"))


@query("""SELECT page_id, md5(CASE WHEN instr(html, 'href="/the"') > 0 THEN substr(html, 1, instr(html, 'href="/the"') - 1) || 'href="the.html"' || substr(html, instr(html, 'href="/the"') + 11) ELSE html END) AS html_md5 FROM pages""")
def localise_links(spark, d):
    child = F.array(F.struct(F.lit("/the").alias("original"), F.lit("the.html").alias("replacement")))
    return _t(spark, d, "pages").select("page_id", F.md5(reports.localise(F.col("html"), child)).alias("html_md5"))


@query(rf"WITH {PARTS}, q AS (SELECT string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] base_domain, host AS \"domain\" FROM p) SELECT base_domain, \"domain\", count(*) AS n FROM q GROUP BY ROLLUP (base_domain, \"domain\")".replace('\\"', '"'))
def rollup_by_domain_type(spark, d):
    p = _t(spark, d, "pages").select(urls.parse(F.col("url"))["domain"].alias("domain")).withColumn("base_domain", urls.base_domain(F.col("domain")))
    return p.rollup("base_domain", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_failed, sum(event_id)::DOUBLE AS bytes FROM events GROUP BY 1")
def fetch_tumbling(spark, d):
    return streaming.telemetry(_t(spark, d, "events").withColumn("value", F.col("event_id").cast("double")), "1 hour")


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) start_ts, event_type, event_id FROM events) SELECT start_ts, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_failed, sum(event_id)::DOUBLE AS bytes FROM w GROUP BY 1")
def fetch_sliding(spark, d):
    return streaming.telemetry(_t(spark, d, "events").withColumn("value", F.col("event_id").cast("double")), "2 hours", "1 hour")


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) k FROM l) SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n_events FROM s GROUP BY user_id, k")
def fetch_sessions(spark, d):
    return streaming.sessions(_t(spark, d, "events"))


REDIRECTS = "('a', 'b'), ('b', 'c'), ('c', 'd'), ('x', 'y'), ('y', 'x'), ('s', 's')"


@query("SELECT * FROM (VALUES ('a', 'd', 3, false, false), ('b', 'd', 2, false, false), ('c', 'd', 1, false, false), ('x', 'x', 2, true, false), ('y', 'y', 2, true, false), ('s', 's', 1, true, false)) t(url, target, hops, loop, cut)")
def redirect_chain(spark, d):
    return frontier.redirect_chains(_values(spark, REDIRECTS, "src, dst"))


@query("WITH RECURSIVE e AS (SELECT o_orderkey s, min(o_custkey) d FROM orders GROUP BY 1), r AS (SELECT s url, d target, 1 hops, [s] path FROM e UNION ALL SELECT url, d, hops + 1, list_append(path, target) FROM r JOIN e ON e.s = target WHERE hops < 5 AND NOT list_contains(path, target)) SELECT url, arg_max(target, hops) AS target, max(hops) AS hops FROM r GROUP BY url")
def redirect_orders(spark, d):
    moved = _t(spark, d, "orders").groupBy(F.col("o_orderkey").alias("src")).agg(F.min("o_custkey").alias("dst"))
    return frontier.redirect_chains(moved, 5).select("url", "target", "hops")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https') AND length(url) > 35")
def hooked_stage(spark, d):
    plan = stages.Plan([("scan", lambda df: df.select("page_id", "url")), ("keep", lambda df: df.where("length(url) > 20"))])
    plan.before("keep", lambda df: df.where("url like 'https%'")).replace("keep", lambda df: df.where("length(url) > 35")).after("keep", lambda out, given: out.select("page_id"))
    return plan.run(_t(spark, d, "pages"))


@query(r"""WITH n AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS folder, page_id % 7 || '.html' AS filename FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, filename ORDER BY page_id) - 1 k FROM n)
SELECT page_id, folder, CASE WHEN k = 0 THEN filename ELSE filename || '.' || k END AS saved_name FROM r""")
def saved_name_clash(spark, d):
    named = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("folder"), F.concat((F.col("page_id") % 7).cast("string"), F.lit(".html")).alias("filename"))
    return tables.clash_free(named, ("folder",), "filename", "page_id").select("page_id", "folder", "saved_name")


@query(r"""WITH c AS (SELECT page_id, url, unnest(['http://m1.net/a/', 'http://m2.net/b/', 'http://m3.net/']) m FROM pages WHERE starts_with(url, 'https://')),
r AS (SELECT page_id, m || substr(url, 9) AS mirror_url, row_number() OVER (PARTITION BY page_id ORDER BY md5(url || m || substr(url, 9))) k FROM c)
SELECT page_id, mirror_url FROM r WHERE k <= 2""")
def mirror_pick(spark, d):
    found = urls.mirror_urls(F.col("url"), {"https://": ["http://m1.net/a/", "http://m2.net/b/", "http://m3.net/"]})
    return _t(spark, d, "pages").select("page_id", F.explode(urls.pick_mirrors(found, 2, F.col("url"))).alias("mirror_url"))


# Both engines: the site with a stylesheet on each page; stylesheets import each other and name pictures
STYLED = """concat('<link rel="stylesheet" href="/css/s', page_id % 7, '.css">', html)"""
SHEETS_SQL = """t AS (SELECT DISTINCT page_id % 7 k FROM pages), sheets AS (SELECT 'http://site.example.com/css/s' || k || '.css' src, 'http://site.example.com/css/t' || k || '.css' dst FROM t UNION ALL
SELECT 'http://site.example.com/css/s' || k || '.css', 'http://site.example.com/css/bg' || k || '.png' FROM t UNION ALL SELECT 'http://site.example.com/css/t' || k || '.css', 'http://site.example.com/css/s' || ((k + 1) % 7) || '.css' FROM t UNION ALL
SELECT 'http://site.example.com/css/t' || k || '.css', 'http://site.example.com/pic/' || k || '.gif' FROM t)"""


def _styled(spark, d):
    """The pages of the site and its stylesheets as (url, html)."""
    site = _site(spark, d)
    kinds = _t(spark, d, "pages").select((F.col("page_id") % 7).alias("k")).distinct()
    k = F.col("k").cast("string")
    s = kinds.select(F.concat(F.lit("http://site.example.com/css/s"), k, F.lit(".css")).alias("url"), F.concat(F.lit('@import "t'), k, F.lit('.css";\nbody { background: url(bg'), k, F.lit(".png) }")).alias("html"))
    t = kinds.select(F.concat(F.lit("http://site.example.com/css/t"), k, F.lit(".css")).alias("url"), F.concat(F.lit("@import url('s"), ((F.col("k") + 1) % 7).cast("string"), F.lit(".css');\np { background: url(/pic/"), k, F.lit(".gif) }")).alias("html"))
    return site, site.select("url", F.expr(STYLED).alias("html")).unionByName(s).unionByName(t)


@query(f"""WITH RECURSIVE {SITE_SQL}, {SHEETS_SQL}, o AS (SELECT DISTINCT src, 'http://site.example.com/css/s' || (page_id % 7) || '.css' dst FROM c JOIN n USING (url)),
every AS (SELECT src, dst FROM a UNION SELECT src, dst FROM o UNION SELECT src, dst FROM sheets),
r AS (SELECT src url, 0 AS generation FROM s UNION SELECT dst, generation + 1 FROM r JOIN every ON src = r.url WHERE generation < 40), g AS (SELECT url, min(generation) AS generation FROM r GROUP BY url)
SELECT g.url, generation, g.url IN (SELECT src FROM c UNION SELECT src FROM sheets) AS fetched,
 CASE WHEN EXISTS (SELECT 1 FROM sheets WHERE dst = g.url AND src IN (SELECT url FROM g)) THEN CASE WHEN ends_with(g.url, '.css') THEN 'css2' ELSE 'css' END END AS sheet_context FROM g""")
def crawl_css(spark, d):
    """The crawl through stylesheets: what it takes, and the context in which a stylesheet leads there."""
    site, pages = _styled(spark, d)
    done = crawl.crawl(pages, site.orderBy("page_id").limit(1).select("url"), CrawlConfig.of(fetchlevel=0, urlfilter="-ment", junkfilter=False, maxfiles=-1))
    by_sheet = done.verdicts.where("context IN ('css', 'css2')").select("url", F.col("context").alias("sheet_context")).distinct()
    return done.ledger.select("url", "generation", "fetched").join(by_sheet, "url", "left")


@query("""WITH x AS (SELECT 'http://h' || (page_id % 3) || '.example.org/d' || page_id url, page_id % 3 h, page_id % 5 body FROM pages),
f AS (SELECT body, arg_min(h, url || '/index.html') h, min(url || '/index.html') first FROM x GROUP BY body),
y AS (SELECT url, x.h = f.h AND url || '/index.html' <> first AS repeats FROM x JOIN f USING (body))
SELECT url || '/index.html' AS url, 0 AS generation, repeats FROM y UNION ALL SELECT url || '/kid.html', 1, false FROM y WHERE NOT repeats""")
def crawl_dedup(spark, d):
    """Pages of three servers with five contents: only the first of a content on the first server that shows it is followed there."""
    at = F.concat(F.lit("http://h"), (F.col("page_id") % 3).cast("string"), F.lit(".example.org/d"), F.col("page_id").cast("string"), F.lit("/index.html"))
    pages = _t(spark, d, "pages").select(at.alias("url"), F.concat(F.lit("<p>"), (F.col("page_id") % 5).cast("string"), F.lit('</p><a href="kid.html">k</a>')).alias("html"))
    done = crawl.crawl(pages, pages.select("url"), CrawlConfig.of(junkfilter=False, maxfiles=-1))
    return done.ledger.select("url", "generation", "repeats")


# Both engines: orders redirect to nearby keys of their block of 64; the low ones of some blocks lead up again
MOVED = "o_orderkey - o_orderkey % 64 + CASE WHEN o_orderkey % 64 > o_custkey % 3 THEN o_orderkey % 64 - 1 - o_custkey % 3 ELSE 5 + o_custkey % 40 END"
MOVES = "o_orderkey % 64 > o_custkey % 3 OR o_orderkey // 64 % 2 = 0"


@query(f"""WITH RECURSIVE e AS (SELECT o_orderkey s, min({MOVED}) d FROM orders WHERE {MOVES} GROUP BY 1),
r AS (SELECT s url, [s] path, d nxt FROM e UNION ALL SELECT url, list_append(path, nxt), d FROM r JOIN e ON s = nxt WHERE NOT list_contains(path, nxt)),
z AS (SELECT url, arg_max(path, len(path)) path, arg_max(nxt, len(path)) nxt FROM r GROUP BY url),
y AS (SELECT url, len(path) n, nxt, list_position(path, nxt) p, path FROM z)
SELECT url, nxt AS target, CASE WHEN p IS NULL THEN n ELSE p - 1 END::BIGINT AS hops, p IS NOT NULL AS loop, CASE WHEN p IS NOT NULL THEN n - p + 1 END::BIGINT AS cycle,
 CASE WHEN p IS NULL THEN least(n, 20) WHEN greatest(p - 2, 0) + n - p + 1 >= 20 THEN 20 ELSE greatest(p - 2, 0) + 4 * (n - p + 1) END::BIGINT AS followed, p IS NOT NULL OR n > 20 AS refused FROM y""")
def redirect_contracted(spark, d):
    """Redirect chains over orders by pointer doubling, with loops and the limits of repeats and redirects."""
    moved = _t(spark, d, "orders").where(MOVES.replace("o_orderkey // 64", "o_orderkey div 64")).groupBy(F.col("o_orderkey").alias("src")).agg(F.min(F.expr(MOVED)).alias("dst"))
    return frontier.redirects_followed(frontier.contracted(moved))


@query(f"""WITH RECURSIVE {SITE_SQL}, r AS (SELECT src url, 0 AS generation FROM s UNION SELECT dst, generation + 1 FROM r JOIN a ON src = r.url WHERE generation < 40),
m AS (SELECT src, arg_min(page_id, url) page_id, arg_min(html, url) html FROM c JOIN n USING (url) JOIN (SELECT page_id, html FROM pages) USING (page_id) GROUP BY src)
SELECT DISTINCT r.url, CASE WHEN m.src IS NULL THEN 0 WHEN page_id % 3 = 2 THEN 1 WHEN page_id % 5 = 0 THEN 4 ELSE 3 END AS code, md5(CASE WHEN page_id % 3 = 2 THEN html || '<p>new</p>' ELSE html END) AS data_md5, page_id % 3 = 2 AS cached_anew FROM r LEFT JOIN m ON m.src = r.url""")
def crawl_recrawl(spark, d):
    """Two crawls in a row: the second gets a third of the pages as unmodified without data, a third unchanged and a third changed; some files are gone."""
    site, options = _site(spark, d), CrawlConfig.of(fetchlevel=0, urlfilter="-ment", junkfilter=False, maxfiles=-1)
    seeds, store = site.orderBy("page_id").limit(1).select("url"), f"{shared_dir(spark)}/crawlspark/recrawl-{uuid.uuid4().hex}"
    first = site.select("url", "html", F.lit(200).alias("status"), F.timestamp_seconds(F.when(F.col("page_id") % 3 != 1, 1000)).alias("modified"))
    recrawl.recrawl(first, seeds, store, options)
    k = F.col("page_id") % 3
    then = site.select("page_id", "url", F.when(k == 1, F.col("html")).when(k == 2, F.concat("html", F.lit("<p>new</p>"))).alias("html"), F.when(k == 0, 304).otherwise(200).alias("status"), F.timestamp_seconds(F.when(k == 2, 2000)).alias("modified"))
    kept = crawl.canonical(site.where("page_id % 5 <> 0")).select(F.col("full_url").alias("url"))
    done = recrawl.recrawl(then, seeds, store, options, on_disk=kept)
    new = recrawl.read_cache(spark, store, done.version).join(recrawl.read_cache(spark, store, done.version - 1).select("url", F.col("sha").alias("before")), "url").select("url", (F.col("sha") != F.col("before")).alias("cached_anew"))
    return done.outcomes.join(new, "url", "left").select("url", "code", F.md5("data").alias("data_md5"), "cached_anew")


def _listed(values, key: str) -> str:
    """SQL of both engines: the value that a key picks from a fixed list, in turn."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


# Both engines: every link of a page as a URL on a junk server, below one, or on the page's own server in one of some folders
_FOLDERS = ("/", "/popupads/", "/htmlad/", "/banners/world-banners/", "/doc/", "/bar/siteads/")
JUNK_HOST = f"CASE page_id % 3 WHEN 0 THEN {_listed(rules.DOMAINS, 'page_id')} WHEN 1 THEN concat('a.', {_listed(rules.DOMAINS, 'page_id')}) ELSE concat('www.site', page_id, '.org') END"
JUNK_URL = f"concat('http://', host, {_listed(_FOLDERS, 'page_id')}, ltrim(href, '/'))"
_IN_DOMAINS = ", ".join(f"'{x}'" for x in rules.DOMAINS)


@query(rf"""WITH x AS (SELECT page_id, {JUNK_HOST} host, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*"([^"]*)"', 1)) href FROM pages),
u AS (SELECT DISTINCT page_id, host, {JUNK_URL} url, CASE WHEN len(string_split(host, '.')) > 2 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END base FROM x)
SELECT page_id, url, CASE WHEN host IN ({_IN_DOMAINS}) THEN 'domain' WHEN base IN ({_IN_DOMAINS}) THEN 'base-domain' WHEN {' OR '.join(f"regexp_matches(url, '{p}')" for p in rules.PATTERNS)} THEN 'pattern' END AS reason FROM u""")
def junk_links(spark, d):
    """Every link of the pages against the whole lists of junk servers and patterns."""
    found = _t(spark, d, "pages").select("page_id", F.expr(JUNK_HOST).alias("host"), F.explode(links.hrefs(F.col("html"))).alias("href"))
    u = found.select("page_id", "host", F.expr(JUNK_URL.replace("ltrim(href, '/')", "ltrim('/', href)")).alias("url")).distinct()
    return u.select("page_id", "url", rules.junk_reason(F.col("url"), F.col("host"), urls.base_domain(F.col("host"))).alias("reason"))


_NAMES = (".GIF", ".pdf", ".css", "", ".html", ".jpg", ".xyz", ".txt", ".php", ".svg")
_TYPES = ("generic", "image", "anchor", "stylesheet", "document", "frame", "webpage")
_ENDS = lambda xs: " OR ".join(f"ends_with(lower(name), '{x}')" for x in xs)


@query(f"""WITH x AS (SELECT page_id, 'f' || page_id || {_listed(_NAMES, 'page_id')} AS name, {_listed(_TYPES, 'page_id')} AS typ FROM pages)
SELECT page_id, CASE WHEN typ IN ('image', 'stylesheet', 'document', 'webpage') THEN typ WHEN typ IN ('anchor', 'frame') THEN 'webpage' WHEN {_ENDS(urls.IMAGE_EXTENSIONS)} THEN 'image' WHEN {_ENDS(urls.DOCUMENT_EXTENSIONS)} THEN 'document' ELSE 'webpage' END AS kind FROM x""")
def page_kinds(spark, d):
    """The kind of a file for every page, by link type and extension."""
    x = _t(spark, d, "pages").select("page_id", F.expr(f"concat('f', page_id, {_listed(_NAMES, 'page_id')})").alias("name"), F.expr(_listed(_TYPES, "page_id")).alias("typ"))
    return x.select("page_id", urls.kind(F.col("name"), F.col("typ")).alias("kind"))


_MIMES = ("text/html; charset=utf-8", "image/png", " Text/CSS", "", "application/pdf", "application/zip", "application/javascript", "application/xhtml+xml")
_STATUSES = ("200", "304", "401", "404", "407", "418", "500", "502", "503", "504", "301")


@query(f"""WITH x AS (SELECT event_id, lower(trim(string_split({_listed(_MIMES, 'event_id')}, ';')[1])) m, ({_listed(_STATUSES, 'event_id')})::INT status FROM events)
SELECT event_id, CASE WHEN m = '' THEN 'webpage' WHEN starts_with(m, 'image/') THEN 'image' WHEN m = 'text/css' THEN 'stylesheet' WHEN contains(m, 'javascript') THEN 'javascript' WHEN contains(m, 'html') THEN 'webpage' WHEN m = 'application/pdf' THEN 'document' ELSE 'file' END AS kind,
 status IN (401, 404, 407) OR status BETWEEN 500 AND 504 AS fatal, CASE WHEN status < 300 THEN 'ok' WHEN status = 304 THEN 'not_modified' WHEN status IN (404, 503, 504) THEN 'add_to_filter' WHEN status = 401 THEN 'stop' WHEN status = 407 THEN 'proxy' WHEN status BETWEEN 500 AND 502 THEN 'give_up' ELSE 'retry' END AS action FROM x""")
def response_classify(spark, d):
    """Kind by MIME type, and what follows from the status, for every event taken as a response."""
    x = _t(spark, d, "events").select("event_id", F.expr(_listed(_MIMES, "event_id")).alias("m"), F.expr(_listed(_STATUSES, "event_id")).cast("int").alias("status"))
    fatal, action = rules.error_action(F.col("status"))
    return x.select("event_id", urls.mime_kind(F.col("m"), F.lit("webpage")).alias("kind"), fatal.alias("fatal"), action.alias("action"))


@query(rf"""WITH {PARTS}, x AS (SELECT page_id, 'http://' || host || '/d' || page_id || '.ars' AS ars, url || ' and  more' AS spaced FROM p)
SELECT page_id, ars || '/' AS ars_url, CASE WHEN regexp_matches(spaced, '\w+\s+\w+') THEN regexp_replace(spaced, '\s', '%20', 'g') ELSE spaced END AS valid FROM x""")
def url_ars_and_spaces(spark, d):
    """A directory by its extension, and white space within a URL, for every page."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    p = urls.parsed(_t(spark, d, "pages"), F.concat(F.lit("http://"), host, F.lit("/d"), F.col("page_id").cast("string"), F.lit(".ars")), "p")
    return p.select("page_id", urls.full_url(F.col("p")).alias("ars_url"), urls.valid_url(F.concat("url", F.lit(" and  more"))).alias("valid"))
