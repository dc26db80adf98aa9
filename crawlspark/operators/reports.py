"""Reports over crawl tables: statistics, trees, feeds, link rewriting and the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..functions.links import meta_robots
from ..sources.scratch import discard, durable


def crawl_stats(log: DataFrame) -> DataFrame:
    """One row of counters; ``log``: url, server, directory, filename, code, ok, fatal, bytes."""
    return log.agg(
        F.count_distinct("url").alias("links"),
        F.count_distinct("server").alias("servers"),
        F.count_distinct("directory").alias("dirs"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if("fatal").alias("fatal"),
        F.count_distinct(F.when(F.col("code").isin(1, 2), F.col("filename"))).alias("files"),
        F.count_if(F.col("code") == 3).alias("repos"),
        F.count_if(F.col("code") == 4).alias("cache"),
        F.sum("bytes").alias("bytes"),
    )


def rates(files: Column, size: Column, seconds: Column) -> tuple[Column, Column]:
    """(files per second, KB per second), cut to two decimals."""
    cut = lambda x: F.floor(x * 100) / 100
    return cut(files / seconds), cut(size / 1024 / seconds)


def stats_line(fields: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in fields.items()])


def url_tree(links: DataFrame, source: str, child: str, ordinal: str, html: bool = False, key: str | None = None) -> DataFrame:
    """One text (or HTML list) per source: its URL, then its distinct children in order.

    ``key`` names the page where its URL does not. Repeats of a child go before children are gathered, so a list holds distinct ones only.
    """
    keys = [source] if key is None else [key, source]
    distinct = links.groupBy(*keys, child).agg(F.min(ordinal).alias("o"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("o"), F.col(child).alias("c")))), lambda x: x["c"])
    grouped = distinct.groupBy(*keys).agg(ordered.alias("children"))
    if html:
        body = F.concat(F.lit("<li>"), F.col(source), F.lit("<ul>"), F.array_join(F.transform("children", lambda c: F.concat(F.lit("<li>"), c, F.lit("</li>"))), ""), F.lit("</ul></li>"))
    else:
        body = F.concat(F.col(source), F.array_join(F.transform("children", lambda c: F.concat(F.lit("\n\t"), c)), ""))
    return grouped.select(*keys, body.alias("tree"))


def tree_is_html(file: str) -> bool:
    """Whether a tree file of this name is written as HTML; names without extension and ``.txt`` are text."""
    ext = file[file.rfind(".") :].lower() if "." in file.rsplit("/", 1)[-1] else ""
    if ext not in ("", ".txt", ".htm", ".html"):
        raise ValueError(f"a tree file ends in .txt, .htm or .html, not {ext}")
    return ext in (".htm", ".html")


def swish_records(pages: DataFrame) -> DataFrame:
    """The indexer's records of ``pages`` (url, html); pages that robots must not index are left out."""
    return pages.where(~meta_robots(F.col("html"))["noindex"]).select(swish_feed(F.col("url"), F.col("html")).alias("record"))


def swish_feed(url: Column, body: Column) -> Column:
    """The indexer's record: header lines, an empty line, the ASCII part of the body."""
    return let(F.trim(F.regexp_replace(body, r"[^\x00-\x7F]", "")), lambda b: F.concat(F.lit("Path-Name: "), url, F.lit("\nContent-Length: "), F.length(b).cast("string"), F.lit("\n\n"), b))


# English words that an index may leave out
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """The lower-case terms of a text in order, less the stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def runs(entries: Column, name, built) -> Column:
    """``built(start, end)`` for each run of entries of one ``name`` in a sorted array, in linear time (``slice`` would copy the array for each); null if there are none."""
    n = F.size(entries)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (name(F.get(entries, i)) != name(F.get(entries, i - 1))))
    return F.when(n > 0, let(starts, lambda b: F.transform(b, lambda start, j: built(start, F.coalesce(F.get(b, j + 1), n)))))


def of_run(entries: Column, start: Column, end: Column, value) -> Column:
    """The array of ``value(entry)`` of a run."""
    return F.transform(F.sequence(start, end - 1), lambda k: value(F.get(entries, k)))


def counted(found: Column, places: bool = False) -> Column:
    """array<struct<term, uses, first>> of an array of terms, by term, on request with all places in order. It is made within the row: a task holds one text's terms at a time."""
    pairs = F.transform(found, lambda t, i: F.struct(t.alias("term"), i.alias("place")))

    def built(x: Column):
        at = lambda start, end: [of_run(x, start, end, lambda e: e["place"]).alias("places")] if places else []
        return lambda start, end: F.struct(F.get(x, start)["term"].alias("term"), (end - start).cast("bigint").alias("uses"), F.get(x, start)["place"].alias("first"), *at(start, end))

    return let(F.sort_array(pairs), lambda x: runs(x, lambda e: e["term"], built(x)))


def by_key(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and those that share one (null counts as a key; None if there are none). Reads the keys once, at the call."""
    several = durable(docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    if not several.take(1):
        discard(several)
        return docs, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return docs.join(several, same, "left_anti"), docs.join(several, same, "left_semi")


def dealt(docs: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions; they are not merged into a few large ones, whose last would be waited for."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def postings(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """The index: (term, key, uses, first) with the number of uses of a term in a document and the place of the first.

    Texts are dealt by key and counted within their row; rows that share a key are grouped beyond that.
    """
    alone, shared = by_key(docs.select(F.col(key), F.col(text).alias("_x")), key)

    def each(rows: DataFrame) -> DataFrame:
        spread = rows.select(key, F.explode_outer(counted(terms(F.col("_x"), stop_words))).alias("_e")).where("_e is not null")  # outer: the plain one would look for terms a second time
        return spread.select(F.col("_e.term").alias("term"), key, F.col("_e.uses").alias("uses"), F.col("_e.first").alias("first"))

    one = each(dealt(alone, key))
    return one if shared is None else one.unionByName(each(shared).groupBy("term", key).agg(F.sum("uses").alias("uses"), F.min("first").alias("first")))


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, n_docs, n_uses, first document) of the index, with counts combined before the shuffle."""
    return postings(docs, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"), F.min(key).alias("first_doc"))


def term_search(index: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Documents of an index (``postings``) that hold all the terms, with the number of uses."""
    found = index.where(F.col("term").isin(*wanted)).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))
    return found.where(F.col("n") == len(set(wanted))).select(key, "uses")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of a literal replaced."""
    return F.when(F.position(old, text) > 0, F.overlay(text, new, F.position(old, text), F.length(old))).otherwise(text)


def localise(html: Column, children: Column) -> Column:
    """``html`` without base element and with each child's first ``attr="original"`` pointing to its replacement.

    ``children``: array<struct<original, replacement>>, applied in order; literal, so that no character of a URL acts as a pattern.
    A value may stand in double quotes, single quotes or none.
    """
    start = F.regexp_replace(html, r"(?i)<base\s+href=[^>]*>", "")

    def pointed(acc: Column, c: Column, attr: str) -> Column:
        new = F.concat(F.lit(f'{attr}="'), c["replacement"], F.lit('"'))
        forms = [F.concat(F.lit(f"{attr}={q}"), c["original"], F.lit(q)) for q in ('"', "'")]
        bare = F.concat(F.lit(f"{attr}="), c["original"])

        def replaced(x: Column) -> Column:
            quoted = F.coalesce(*[F.when(F.instr(x["a"], x[q]) > 0, replace_first(x["a"], x[q], new)) for q in ("q0", "q1")])
            ends = F.substring(x["a"], F.position(x["q2"], x["a"]) + F.length(x["q2"]), F.lit(1)).isin(" ", ">", "\n", "\t")
            return F.coalesce(quoted, F.when((F.position(x["q2"], x["a"]) > 0) & ends, replace_first(x["a"], x["q2"], new)), x["a"])

        return let(F.struct(acc.alias("a"), forms[0].alias("q0"), forms[1].alias("q1"), bare.alias("q2")), replaced)

    def one(acc: Column, c: Column) -> Column:
        return pointed(pointed(acc, c, "href"), c, "src")

    return F.aggregate(children, start, one)


def link_degrees(links: DataFrame) -> DataFrame:
    """(url, n_out, n_in) from links(src, dst)."""
    out = links.groupBy(F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("n_out"))
    into = links.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "url", "full").select("url", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def context(source_type: Column, typ: Column) -> Column:
    """The kind of edge from a page or stylesheet to a child."""
    sheet = source_type == "stylesheet"
    return F.when(typ.isin("frame", "frameset"), "frame").when((typ == "stylesheet") & sheet, "css2").when(typ == "stylesheet", "style").when(sheet, "css").otherwise("page")


def collections(links: DataFrame, pages_type: str = "source_type") -> DataFrame:
    """(source, context, n, children): the children of each source by the kind of edge, in order; ``links``: source, source_type, type, child, ordinal."""
    placed = links.withColumn("context", context(F.col(pages_type), F.col("type")))
    distinct = placed.groupBy("source", "context", "child").agg(F.min("ordinal").alias("o"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("o", "child"))), lambda x: x["child"])
    return distinct.groupBy("source", "context").agg(F.count(F.lit(1)).alias("n"), gathered.alias("children"))


def of_context(collections_: DataFrame, wanted: str, removed: list[str] | None = None) -> DataFrame:
    """Collections bound to one context, less some URLs."""
    kept = collections_.where(F.col("context") == wanted)
    return kept.withColumn("children", F.filter("children", lambda c: ~c.isin(*removed))).withColumn("n", F.size("children").cast("bigint")) if removed else kept


def with_urls(links: DataFrame, urls: DataFrame) -> DataFrame:
    """``links`` (source_id, child_id) with the URLs of both ends; ``urls``: url_id, url."""
    source = urls.select(F.col("url_id").alias("source_id"), F.col("url").alias("source_url"))
    child = urls.select(F.col("url_id").alias("child_id"), F.col("url").alias("child_url"))
    return links.join(source, "source_id").join(child, "child_id")


def longest_block(fetchers: DataFrame, key: str = "fetcher", waited: str = "waited") -> DataFrame:
    """The fetcher that has been blocked longest (the least name of equal ones), and for how long."""
    return fetchers.agg(F.min(F.struct((-F.col(waited)).alias("w"), F.col(key).alias("k"))).alias("x")).where("x.k is not null").select(F.col("x.k").alias(key), (-F.col("x.w")).alias(waited))
