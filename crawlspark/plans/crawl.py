"""The offline crawl as a plan: pages to links, links to verdicts, accepted links to the next generation, until nothing is new.

Links are taken from all pages and resolved once, into a table of edges without html; a
generation is a join of the frontier with it. Of the rules only those that depend on where
a crawl came from (start, parent, limits) are judged again in each generation. Every
generation is a written table, so nothing is computed twice and a lost executor costs at
most one step; with ``state`` they are kept in a folder and a crawl can be resumed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, urls
from ..functions.base import remembered
from ..operators import cache, reports, robots, rules
from ..operators import frontier as fr
from ..sources.config import CrawlConfig
from ..sources.scratch import durable


def page_links(pages: DataFrame, config: CrawlConfig | None = None, tags: dict[str, tuple[str, str]] = links.LINK_TAGS) -> DataFrame:
    """``pages`` (url, html, ...) without html, with base_url (of the page's base element, else its own), ordinal, link_type, link and cgi for every link.

    Type gates, the link filter, nofollow and the slice of links of ``config`` apply; without one, all links are taken.
    """
    kept = F.col("_found")
    images, scripts, applets = (True, True, True) if config is None else (config.images, config.javascript, config.javaapplet)
    read = _reading(tuple(tags.items()), images, scripts, applets, config is not None and config.htmlparser == 1)
    if config is not None:
        kept = F.filter(kept, lambda x: links.kept_link(x["url"], F.col("_title"), config.querylinks))
        if config.robots:
            kept = F.when(read["_robots"]["nofollow"], links.no_links()).otherwise(kept)
    staged = pages.withColumns({k: read[k] for k in ("_title", "_found", "_base")}).withColumn("_kept", _sliced(kept, config)).drop("_found", "_title", "html")
    base = F.col("_base")
    located = urls.resolved(staged, base, F.lit("base"), F.col("url"), "_b")
    whole = F.when(base.rlike("^[a-zA-Z]+://"), base).otherwise(F.col("_b.full_url"))
    folder = F.when(base.endswith("/"), F.lit(f"/{urls.DEFAULT_FILE}")).otherwise("")  # a base that ends in / is a directory
    based = located.withColumn("base_url", F.when(base.isNotNull(), F.concat(F.rtrim(whole, F.lit("/")), folder)).otherwise(F.col("url"))).drop("_base", "_b")
    found = based.select("*", F.posexplode("_kept").alias("ordinal", "_l")).drop("_kept")
    return found.withColumns({"link_type": F.col("_l.type"), "link": F.col("_l.url"), "cgi": urls.is_cgi(F.col("_l.url"), F.col("_l.type"))}).drop("_l")


@remembered
def _reading(tags: tuple, images: bool, scripts: bool, applets: bool, strict: bool) -> dict[str, Column]:
    html = F.col("html")
    return {"_title": links.title(html), "_found": links.all_links(html, dict(tags), images, scripts, applets, strict), "_base": links.base_href(html), "_robots": links.meta_robots(html)}


def _sliced(found: Column, config: CrawlConfig | None) -> Column:
    """The links of a page or stylesheet that the slice of ``config`` takes."""
    if config is None or (config.offset_start, config.offset_end) == (0, -1):
        return found
    stop = F.lit(config.offset_end) if config.offset_end >= 0 else F.size(found) + config.offset_end + 1
    return F.slice(found, F.lit(config.offset_start + 1), F.greatest(stop - config.offset_start, F.lit(0)))


def sheet_links(sheets: DataFrame, config: CrawlConfig | None = None) -> DataFrame:
    """As ``page_links``, for stylesheets (url, html: their text): imports and other urls, distinct; their own URL is the base."""
    held = sheets.withColumn("_kept", _sliced(F.array_distinct(links.css_urls(F.col("html"))), config)).drop("html")
    found = held.select("*", F.col("url").alias("base_url"), F.posexplode("_kept").alias("ordinal", "link")).drop("_kept")
    return found.withColumns({"link_type": urls.css_child_type(F.col("link")), "cgi": F.lit(False)})


def resolved_links(found: DataFrame) -> DataFrame:
    """``found`` with the resolved URL struct ``u`` and the place of its page: page_domain, page_directory."""
    at = urls.parsed(urls.resolved(found, F.col("link"), F.col("link_type"), F.col("base_url"), "u"), F.col("url"), "_p")
    return at.withColumns({"page_domain": F.col("_p.domain"), "page_directory": urls.url_directory(F.col("_p"))}).drop("_p")


def judged_links(resolved: DataFrame, config: CrawlConfig, robots_files: DataFrame | None = None, known_bad: DataFrame | None = None, agent: str = "*", junk_lists: tuple | None = None) -> DataFrame:
    """``resolved`` with ``reject_reason`` (null: may be fetched) and ``same`` (on the start's server).

    ``start_domain`` and ``start_directory`` say where the crawl began; without them each page is its own start.
    ``robots_files``: host (with the port where it isn't the default), robots_txt, http_status; ``known_bad``: url.
    """
    if "start_domain" not in resolved.columns:
        resolved = resolved.withColumns({"start_domain": F.col("page_domain"), "start_directory": F.col("page_directory")})
    u, start, page = F.col("u"), F.col("start_domain"), F.col("page_domain")
    base_of = urls.base_domain
    placed = resolved.withColumns({
        "_dir": urls.url_directory(u),
        "same": rules.same_server(u["domain"], start, base_of(u["domain"]), base_of(start), config.subdomain),
        "_parent": rules.same_server(page, start, base_of(page), base_of(start), config.subdomain),
        "_bad": F.lit(False),
        "_robots": F.lit(False),
    })
    if known_bad is not None:
        bad = known_bad.select(F.col("url").alias("_url")).distinct()
        placed = placed.join(bad, F.col("u.full_url") == F.col("_url"), "left").withColumn("_bad", F.col("_url").isNotNull()).drop("_url")
    if robots_files is not None and config.robots:
        asked = placed.withColumns({"host": urls.domain_with_port(u), "path": urls.relative_url(u)})
        placed = robots.apply(asked, robots_files, agent).withColumn("_robots", ~F.col("robots_allowed")).drop("robots_allowed", "host", "path")
    lists = junk_lists or (rules.DOMAINS, rules.PATTERNS)
    outside = rules.external(
        config.fetchlevel,
        under_start=F.col("_dir").startswith(F.col("start_directory")),
        same=F.col("same"),
        parent_same=F.col("_parent"),
        parent_in_start_dir=F.col("page_directory") == F.col("start_directory"),
        typ=F.col("link_type"),
        page_links=config.extpagelinks,
        server_links=config.extserverlinks,
        images=config.imagelinks,
        styles=config.stylesheetlinks,
        server_blocked=rules.server_filter_blocks(u["domain"], config.serverfilter),
        too_deep=rules.beyond_depth(F.size(u["dirpath"]), config.extdepth or -1),
    )
    reason = rules.reject_reason(
        F.col("link_type"),
        skip_types=config.skipruletypes,
        known_bad=F.col("_bad"),
        filtered=rules.url_filter_blocks(u["full_url"], config.urlfilter),
        junk=rules.junk_reason(u["full_url"], u["domain"], base_of(u["domain"]), *lists).isNotNull() if config.junkfilter else F.lit(False),
        outside=outside,
        robots=F.col("_robots"),
        deep=rules.beyond_depth(urls.relative_depth(F.col("_dir"), F.col("start_directory")), config.depth),
    )
    return placed.withColumn("reject_reason", reason).drop("_dir", "_parent", "_bad", "_robots")


def _limited(judged: DataFrame, key: Column, counts: Column, limit: int, admitted: DataFrame | None, reason: str) -> tuple[DataFrame, DataFrame]:
    """``judged`` with accepted rows that ``counts`` rejected beyond the first ``limit`` keys, and the keys (so many at most) that are in."""
    keyed = judged.withColumn("_key", F.when(counts & F.col("reject_reason").isNull(), key))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct("url", "ordinal")).alias("_first"))
    room = limit
    if admitted is not None:
        first = first.join(F.broadcast(admitted), "_key", "left_anti")
        room -= admitted.count()
    new = first.orderBy("_first").limit(max(0, room)).select("_key")
    inside = durable(new if admitted is None else new.unionByName(admitted))
    marked = keyed.join(F.broadcast(inside.withColumn("_in", F.lit(True))), "_key", "left")
    late = F.col("_key").isNotNull() & F.col("_in").isNull()
    return marked.withColumn("reject_reason", F.when(late, F.lit(reason)).otherwise(F.col("reject_reason"))).drop("_key", "_in"), inside


@dataclass(frozen=True)
class Crawl:
    """``ledger``: one row per URL that the crawl takes; ``verdicts``: one row per link that it judged."""

    ledger: DataFrame
    verdicts: DataFrame


class _State:
    """The tables of each generation: in a folder of the user's, where a crawl can go on, or as scratch tables."""

    def __init__(self, spark, root: str | None):
        self.spark, self.root = spark, root and root.rstrip("/")

    def put(self, name: str, generation: int, df: DataFrame) -> DataFrame:
        if not self.root:
            return durable(df)
        path = f"{self.root}/{name}/{generation:06d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, name: str) -> list[DataFrame]:
        """The tables that were written whole, by generation."""
        if not self.root:
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        return [self.spark.read.parquet(f"{self.root}/{name}/{n}") for n in names if fs.exists(path(f"{self.root}/{name}/{n}/_SUCCESS"))]


def one_page(named: DataFrame, key: str) -> DataFrame:
    """One row of ``named`` per ``key``, the least of those that share it; only these few are sorted and sent with their html."""
    shared = durable(named.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    rest = [c for c in named.columns if c != key]
    least = named.join(shared, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])
    return named.join(shared, key, "left_anti").select(key, *rest).unionByName(least)


def canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the URL struct ``p`` and ``full_url``."""
    return urls.parsed(df, F.col(url), "p").withColumn("full_url", urls.full_url(F.col("p")))


def redirect_chains(redirects: DataFrame, most: int = 20) -> DataFrame:
    """(url, target, failed) of redirects(src, dst): canonical URLs, dst as seen from src; ``failed`` where no page is reached (a loop, or more than ``most`` redirects)."""
    here = canonical(redirects.select(F.col("src").alias("url"), F.col("dst").alias("_dst"))).select(F.col("full_url").alias("src"), "_dst")
    there = urls.resolved(here, F.col("_dst"), F.lit("generic"), F.col("src"), "t").select("src", F.col("t.full_url").alias("dst")).where("src <> dst")
    chains = fr.redirects_followed(fr.contracted(there.groupBy("src").agg(F.min("dst").alias("dst"))), most=most)
    return chains.select("url", "target", F.col("refused").alias("failed"))


def redirected(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Resolved ``edges`` with ``hop`` 0 as linked (``moved``: leads elsewhere; ``failed``: to no page), and once more with hop 1 and the URL that is reached."""
    found = chains.select(F.col("url").alias("_from"), F.col("target").alias("_target"), F.col("failed").alias("_failed"))
    joined = durable(edges.join(found, F.col("u.full_url") == F.col("_from"), "left").drop("_from"))
    failed = F.coalesce(F.col("_failed"), F.lit(False))
    here = joined.withColumns({"hop": F.lit(0), "moved": F.col("_target").isNotNull() & ~failed, "failed": failed})
    there = urls.reresolved(joined.where(F.col("_target").isNotNull() & ~failed), F.col("_target")).drop("u_old", "reresolved")
    there = there.withColumns({"hop": F.lit(1), "moved": F.lit(False), "failed": F.lit(False)})
    return here.unionByName(there).drop("_target", "_failed")


def _arrived(judged: DataFrame) -> DataFrame:
    """Of the verdicts on ``redirected`` edges those that count: on the link where it stays or is rejected, else on the URL that it leads to."""
    judged = durable(judged.withColumn("reject_reason", F.when(F.col("failed") & F.col("reject_reason").isNull(), "redirect").otherwise(F.col("reject_reason"))))
    key = ["url", "ordinal", "sheet", "start_url"]
    stopped = judged.where("hop = 0 and moved and reject_reason is not null").select(*key)
    return judged.where("hop = 0 and (not moved or reject_reason is not null)").unionByName(judged.where("hop = 1").join(stopped, key, "left_anti"))


class _Bodies:
    """Which pages repeat the content of an earlier one of their own domain, generation by generation.

    Only the first domain of a content is remembered. Pages whose content no other page of their domain has can't repeat one and are left out at once.
    """

    def __init__(self, facts: DataFrame, seen: list[DataFrame]):
        shared = facts.groupBy("sha", "domain").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha").distinct()
        self.pages = durable(facts.join(shared, "sha", "left_semi").select("url", "sha", "domain"))
        self.any = bool(self.pages.take(1))
        self.seen = reduce(DataFrame.unionByName, seen) if seen else self.pages.sparkSession.createDataFrame([], "sha string, owner string")

    def take(self, generation: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((url) of the pages of ``generation`` (url, priority) that repeat a content, (sha, owner) of what is new)."""
        met = durable(generation.join(self.pages, "url"))
        first = met.groupBy("sha").agg(F.min(F.struct("priority", "url", "domain")).alias("f")).join(self.seen, "sha", "left")
        first = durable(first.select("sha", F.coalesce("owner", "f.domain").alias("owner"), F.when(F.col("owner").isNull(), F.col("f.url")).alias("first")))
        repeats = met.join(first, "sha").where((F.col("domain") == F.col("owner")) & ~F.col("url").eqNullSafe(F.col("first"))).select("url")
        new = first.where("first is not null").select("sha", "owner")
        self.seen = self.seen.unionByName(new)
        return repeats, new


def crawl(pages: DataFrame, seeds: DataFrame, config: CrawlConfig = CrawlConfig(), robots_files: DataFrame | None = None, known_bad: DataFrame | None = None, agent: str = "*", state: str | None = None, redirects: DataFrame | None = None) -> Crawl:
    """Follows the links of ``pages`` (url, html and, where known, status) from ``seeds`` (url) by the rules of ``config`` to the fixpoint.

    Of pages with one canonical URL the least counts. Seeds are exempt from the rules. Pages with an HTTP status that
    says so join the known-bad list. ``maxfiles`` (below 0: no limit) takes the first URLs by generation, priority and URL; ``timelimit`` seconds
    after its begin a crawl starts no further generation. With ``state``, a folder, every generation stays there, and a call with
    the same folder goes on after the last whole one.

    A page that is linked as a stylesheet, or named like one, is read as one: its imports and other URLs are its links. The links of a page whose content
    was met before on the same domain (earlier by generation, priority and URL) are not taken. ``redirects`` (src, dst): a link
    that leads elsewhere is judged as it stands and then by the URL it reaches, which takes its place; a loop or a chain of over 20 is rejected.
    """
    begun, kept = time.monotonic(), _State(pages.sparkSession, state)
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    named = canonical(pages.select("url", "html", status.cast("int").alias("status"))).select("full_url", "url", "html", "status", F.col("p.domain").alias("domain"))
    site = durable(one_page(named, "full_url").where(F.col("html").isNotNull()).select(F.col("full_url").alias("url"), "html", "status", "domain"))
    size = F.octet_length("html")
    facts = durable(site.select("url", "domain", F.sha1("html").alias("sha"), size.alias("n_bytes"), rules.size_allowed(size, config.maxfilesize).alias("fits"), rules.word_filter(F.col("html"), config.wordfilter).alias("worded"), rules.error_action(F.col("status"))[1].alias("action")))
    bad = facts.where("action = 'add_to_filter'").select("url")
    known_bad = bad if known_bad is None else bad.unionByName(known_bad.select("url"))
    bodies, by_name = site.where(rules.size_allowed(size, config.maxfilesize)).select("url", "html"), F.lower("url").endswith(".css")
    edges = durable(resolved_links(page_links(bodies.where(~by_name), config)).withColumn("sheet", F.lit(False)))
    linked = edges.where("link_type = 'stylesheet'").select(F.col("u.full_url").alias("url")).distinct()
    sheets = durable(bodies.where(by_name).unionByName(bodies.where(~by_name).join(linked, "url", "left_semi")))
    if sheets.take(1):
        edges = durable(edges.unionByName(resolved_links(sheet_links(sheets, config)).withColumn("sheet", F.lit(True))))
    chains = None if redirects is None else durable(redirect_chains(redirects))
    if chains is not None:
        edges = durable(redirected(edges, chains))

    frontiers = kept.all("frontier")
    judgements, repeats, seen = (kept.all(name)[: max(0, len(frontiers) - 1)] for name in ("verdicts", "repeats", "seen"))  # what a generation wrote before it was cut off is written again
    if not frontiers:
        first = canonical(seeds.select(urls.fix_seed(F.col("url")).alias("url")))
        if chains is not None:
            first = canonical(first.select("full_url").join(chains.where("not failed").select(F.col("url").alias("full_url"), "target"), "full_url", "left").select(F.coalesce("target", "full_url").alias("url")))
        first = first.groupBy("full_url").agg(F.min(F.struct(F.col("p.domain").alias("d"), urls.url_directory(F.col("p")).alias("t"), F.col("p.filename").alias("f"))).alias("s"))
        first = first.select(F.col("full_url").alias("url"), F.lit(0).alias("generation"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("parent_url"), F.lit("generic").alias("link_type"), F.col("s.f").alias("filename"), F.col("full_url").alias("start_url"), F.col("s.d").alias("start_domain"), F.col("s.t").alias("start_directory"))
        frontiers = [kept.put("frontier", 0, first)]
    generation = len(frontiers) - 1
    contents = _Bodies(facts.where("fits"), seen)
    servers = directories = None
    count = sum(f.count() for f in frontiers)
    while (config.maxfiles < 0 or count < config.maxfiles) and (config.timelimit < 0 or time.monotonic() - begun < config.timelimit) and frontiers[-1].take(1):
        generation += 1
        sheet = (F.col("link_type") == "stylesheet") | F.lower("url").endswith(".css")
        last = frontiers[-1].withColumn("sheet", sheet)
        if contents.any:
            webpage = ~F.col("sheet") & (urls.kind(F.col("filename"), F.col("link_type")) == "webpage")
            again, new = contents.take(last.where(webpage).select("url", "priority"))
            repeats.append(kept.put("repeats", generation, again))
            kept.put("seen", generation, new)
            last = last.join(repeats[-1], "url", "left_anti")
        last = last.select("url", "sheet", F.col("generation").alias("from"), "start_url", "start_domain", "start_directory")
        judged = judged_links(edges.join(last, ["url", "sheet"]), config, robots_files, known_bad, agent)
        if chains is not None:
            judged = _arrived(judged)
        if config.maxextservers:
            judged, servers = _limited(judged, F.col("u.domain"), ~F.col("same"), config.maxextservers, servers, "ext_servers")
        if config.maxextdirs:
            beside = F.col("same") & ~urls.url_directory(F.col("u")).startswith(F.col("start_directory"))
            judged, directories = _limited(judged, urls.url_directory(F.col("u")), beside, config.maxextdirs, directories, "ext_dirs")
        u = F.col("u")
        kind = urls.kind(u["filename"], F.col("link_type"))
        context = reports.context(F.when(F.col("sheet"), "stylesheet").otherwise("webpage"), F.col("link_type"))
        judged = judged.select(F.lit(generation).alias("generation"), F.col("url").alias("page_url"), "ordinal", "link_type", context.alias("context"), "link", u["full_url"].alias("url"), u["filename"].alias("filename"), fr.priority(F.col("from"), kind == "webpage", urls.extension(u["filename"]), u["domain"], config.urlpriority, config.serverpriority).alias("priority"), "reject_reason", "start_url", "start_domain", "start_directory")
        judged = kept.put("verdicts", generation, judged)
        judgements.append(judged)
        best = F.min(F.struct("priority", "page_url", "ordinal", "link_type", "filename", "start_url", "start_domain", "start_directory")).alias("x")
        fresh = judged.where("reject_reason is null").groupBy("url").agg(best)
        known = reduce(DataFrame.unionByName, [f.select("url") for f in frontiers])
        fresh = fresh.join(known, "url", "left_anti").select("url", F.lit(generation).alias("generation"), "x.priority", F.col("x.page_url").alias("parent_url"), "x.link_type", "x.filename", "x.start_url", "x.start_domain", "x.start_directory")
        frontiers.append(kept.put("frontier", generation, fresh))
        count += frontiers[-1].count()

    ledger = reduce(DataFrame.unionByName, frontiers)
    if 0 <= config.maxfiles < count:
        ledger = fr.max_files(ledger, ["generation", "priority", "url"], config.maxfiles)
    ledger = ledger.join(facts.drop("domain", "sha"), "url", "left")
    repeated = reduce(DataFrame.unionByName, repeats, pages.sparkSession.createDataFrame([], "url string"))
    ledger = ledger.join(repeated.withColumn("repeats", F.lit(True)), "url", "left")
    kind = urls.kind(F.col("filename"), F.col("link_type"))
    fetched = F.coalesce("fits", F.lit(False))
    wanted = rules.type_allowed(kind, html=config.html, images=config.images) & ((F.col("generation") == 0) | ~F.coalesce("worded", F.lit(False)))
    saved = fetched & wanted & F.lit(not config.simulate)
    ledger = ledger.select("url", "generation", "priority", "parent_url", "start_url", "link_type", kind.alias("kind"), fetched.alias("fetched"), saved.alias("saved"), "n_bytes", F.coalesce("repeats", F.lit(False)).alias("repeats"))
    columns = "generation bigint, page_url string, ordinal int, link_type string, context string, link string, url string, reject_reason string"
    none = pages.sparkSession.createDataFrame([], columns)
    return Crawl(ledger, reduce(DataFrame.unionByName, [j.select(*none.columns) for j in judgements], none))


def localised(pages: DataFrame, saved: DataFrame, config: CrawlConfig = CrawlConfig(), renamed: DataFrame | None = None, root: str = "") -> DataFrame:
    """``pages`` (url, html) whose links point to the files of saved URLs (``saved``: url), or else to absolute URLs.

    Mode 0 leaves html as it is, mode 1 names files by ``file://`` under ``root``, mode 2 relative to the page's own file.
    ``renamed`` (old, new) overrides file names; forms and queries of scripts are left alone, anchors keep their fragment.
    """
    if not config.localise:
        return pages
    found = resolved_links(page_links(pages.select("url", "html"))).where(~F.col("cgi"))
    known = saved.select(F.col("url").alias("_u")).distinct().withColumn("_saved", F.lit(True))
    joined = found.join(known, F.col("u.full_url") == F.col("_u"), "left").withColumn("_file", F.col("u.full_filename"))
    if renamed is not None:
        joined = joined.join(renamed.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col("_file") == F.col("_old"), "left").withColumn("_file", F.coalesce("_new", "_file"))
    own = urls.parsed(joined, F.col("url"), "_p").withColumn("_own", urls.full_filename(F.col("_p")))
    local = F.concat(F.lit(f"file://{root}/"), F.col("_file")) if config.localise == 1 else urls.relative_filename(F.col("_file"), F.col("_own"))
    target = F.concat(F.when(F.col("_saved"), local).otherwise(F.col("u.full_url")), F.col("u.anchor"))
    children = own.groupBy("url").agg(F.transform(F.array_sort(F.collect_set(F.struct("ordinal", F.col("link").alias("original"), target.alias("replacement")))), lambda c: F.struct(c["original"].alias("original"), c["replacement"].alias("replacement"))).alias("_children"))
    empty = F.array().cast("array<struct<original:string,replacement:string>>")
    return pages.join(children, "url", "left").withColumn("html", reports.localise(F.col("html"), F.coalesce("_children", empty))).drop("_children")


def file_parts(files: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """url, part, start, end: the byte ranges in which files (url, n_bytes, accepts_ranges) are fetched; one where the server takes no ranges."""
    n = F.when(F.col("accepts_ranges"), F.lit(config.numparts)).otherwise(1)
    return files.where("n_bytes > 0").select("url", F.explode(cache.range_parts(F.col("n_bytes"), n)).alias("p")).select("url", "p.part", "p.start", "p.end")

