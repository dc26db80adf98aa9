"""Link extraction from HTML, CSS, script redirects and feeds as array-valued Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup
from .base import let
from .urls import IMAGE_EXTENSIONS

# The attribute that holds the link of each tag, and the type of the link
LINK_TAGS = {
    "a": ("href", "anchor"),
    "base": ("href", "base"),
    "frame": ("src", "frame"),
    "iframe": ("src", "frame"),
    "img": ("src", "image"),
    "form": ("action", "form"),
    "link": ("href", "link"),
    "body": ("background", "image"),
    "script": ("src", "javascript"),
    "area": ("href", "generic"),
    "embed": ("src", "generic"),
    "object": ("data", "generic"),
}


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute inside a start tag; empty where it has none."""
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s>\"']+)", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(single, F.lit("")), bare)


def visible(html: Column) -> Column:
    """``html`` without comments and the bodies of scripts, whose text holds no tags."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    return F.when(html.rlike(r"(?i)<!--|<script"), F.regexp_replace(bare, r"(?is)(<script\b[^>]*>).*?(?:</script\s*>|$)", "$1")).otherwise(html)


def start_tags(html: Column, names: list[str]) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<(?:{'|'.join(names)})\b[^>]*>)"), F.lit(1))


def html_links(html: Column, tags: dict[str, tuple[str, str]] = LINK_TAGS) -> Column:
    """array<struct<type, url>> of the page's links in order, distinct; anchors also give their page.

    ``tags`` is the table of tags with the attribute and the type of their links, which may be extended.
    """

    def one(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^<(\w+)", 1))
        value = F.coalesce(*[F.when(name == t, attribute(tag, a)) for t, (a, _) in tags.items()])
        return _link(name, value, attribute(tag, "rel"), tags)

    return F.array_distinct(F.flatten(F.transform(start_tags(visible(html), list(tags)), one)))


def strict_links(html: Column, tags: dict[str, tuple[str, str]] = LINK_TAGS) -> Column:
    """As ``html_links``, from the tokenizer of ``markup``: it also reads markup that expressions take wrongly."""

    def one(tag: Column) -> Column:
        held = lambda a: F.coalesce(F.try_element_at(tag["attributes"], F.lit(a)), F.lit(""))
        value = F.coalesce(*[F.when(tag["name"] == t, held(a)) for t, (a, _) in tags.items()])
        return _link(tag["name"], value, held("rel"), tags)

    return F.array_distinct(F.flatten(F.transform(markup.strict_tags(html, list(tags)), one)))


def _link(name: Column, value: Column, rel: Column, tags: dict[str, tuple[str, str]]) -> Column:
    """The links of one tag: none, one, or the two of an anchor."""
    typ = F.coalesce(F.when(name == "link", F.when(F.lower(rel) == "stylesheet", "stylesheet").otherwise("generic")), *[F.when(name == t, F.lit(k)) for t, (_, k) in tags.items()])

    def typed(x: Column) -> Column:
        link = lambda t, v: F.struct(t.alias("type"), v.alias("url"))
        anchored = (x["n"] == "a") & (F.instr(x["v"], "#") > 0)
        page = F.regexp_extract(x["v"], r"(?i)^(.*\.html?)#", 1)
        plain = F.array(link(F.when(x["n"] == "a", F.lit("generic")).otherwise(x["t"]), x["v"]))
        both = F.when(page != "", F.array(link(F.lit("anchor"), x["v"]), link(F.lit("webpage"), page))).otherwise(F.array(link(F.lit("anchor"), x["v"])))
        return F.when(x["v"] == "", no_links()).otherwise(F.when(anchored, both).otherwise(plain))

    return let(F.struct(typ.alias("t"), F.trim(value).alias("v"), name.alias("n")), typed)


def no_links() -> Column:
    return F.array().cast("array<struct<type:string,url:string>>")


def all_links(html: Column, tags: dict[str, tuple[str, str]] = LINK_TAGS, images: bool = True, javascript: bool = True, applets: bool = True, strict: bool = False) -> Column:
    """array<struct<type, url>>: script redirects, then the refresh target, tags and applets, images last.

    Without ``images`` links of type image go, and so do others whose extension is that of an image. ``strict`` takes the tags from the tokenizer.
    """
    typed = lambda urls, t: F.transform(urls, lambda u: F.struct(F.lit(t).alias("type"), u.alias("url")))
    refresh = let(meta_refresh(html), lambda r: F.when(r.isNotNull(), typed(F.array(r), "generic")).otherwise(no_links()))
    before, after = [typed(js_redirects(html), "webpage"), refresh], [typed(applet_links(html), "javaapplet")] if applets else []

    def joined(found: Column) -> Column:
        plain = F.concat(*before, F.filter(found, lambda x: ~x["type"].isin("image", "base", *(() if javascript else ("javascript",)))), *after)
        if images:
            return F.array_distinct(F.concat(plain, F.filter(found, lambda x: x["type"] == "image")))
        pattern = r"(?i)(?:" + "|".join(e.replace(".", r"\.") for e in IMAGE_EXTENSIONS) + ")$"
        return F.array_distinct(F.filter(plain, lambda x: ~x["url"].rlike(pattern)))

    return let(strict_links(html, tags) if strict else html_links(html, tags), joined)


def hrefs(html: Column) -> Column:
    """The ``href`` of every ``a`` tag that has one, in order."""
    return F.filter(F.transform(start_tags(visible(html), ["a"]), lambda t: attribute(t, "href")), lambda v: v != "")


def _meta(html: Column, by: str, value: str) -> Column:
    """The content of the first ``meta`` whose attribute ``by`` has this value, in any order of its attributes; null where there is none."""
    fitting = F.filter(start_tags(html, ["meta"]), lambda t: F.lower(attribute(t, by)) == value)
    return let(F.get(fitting, 0), lambda t: F.when(t.isNotNull(), attribute(t, "content")))


def meta_refresh(html: Column) -> Column:
    """The URL of ``<meta http-equiv=refresh content="n; URL=x">`` with exactly one semicolon."""
    return F.nullif(F.regexp_extract(_meta(html, "http-equiv", "refresh"), r"(?is)^[^\"';]*;\s*url\s*=\s*([^\"';]+)$", 1), F.lit(""))


def meta_robots(html: Column) -> Column:
    """struct(nofollow, noindex)."""
    content = F.coalesce(F.lower(_meta(html, "name", "robots")), F.lit(""))
    return F.struct((F.instr(content, "nofollow") > 0).alias("nofollow"), (F.instr(content, "noindex") > 0).alias("noindex"))


def title(html: Column) -> Column:
    """The text up to ``</title>``, markup in it included; up to the next tag where the end tag is missing."""
    closed = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.trim(F.when(closed != "", closed).otherwise(F.regexp_extract(html, r"(?is)<title\b[^>]*>([^<]*)", 1)))


def base_href(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<base\b[^>]*\shref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


def applet_links(html: Column) -> Column:
    """codebase and code of each applet, joined by one slash."""
    return F.transform(start_tags(html, ["applet"]), lambda t: F.concat_ws("/", F.nullif(F.rtrim(attribute(t, "codebase"), F.lit("/")), F.lit("")), attribute(t, "code")))


def css_urls(css: Column) -> Column:
    """Imports by string, imports by url(), all url(); duplicates are kept."""
    found = [r"@import\s+[\"']([^\"']+)[\"']", r"@import\s+url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)", r"url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"]
    return F.concat(*[F.regexp_extract_all(css, F.lit(p), F.lit(1)) for p in found])


def js_redirects(html: Column) -> Column:
    """Targets of location.replace/assign(...) and location.href = ..., if their quotes match."""
    call = F.regexp_extract_all(html, F.lit(r"location\.(?:replace|assign)\s*\(\s*([^()]*?)\s*\)"), F.lit(1))
    assign = F.regexp_extract_all(html, F.lit(r"location(?:\.href)?\s*=\s*([\"'][^;\n]*?[\"'])\s*(?:;|\n|<|$)"), F.lit(1))
    matched = F.filter(F.concat(call, assign), lambda s: (F.length(s) > 1) & F.when(s.rlike("^[\"']"), F.left(s, F.lit(1)) == F.right(s, F.lit(1))).otherwise(True))
    return F.transform(matched, lambda s: F.regexp_replace(s, "^[\"']|[\"']$", ""))


def feed_links(xml: Column) -> Column:
    return F.array_distinct(F.xpath(xml, F.lit("//link/text()")))


# Sort links of index pages, as older versions list them
INDEX_LINKS = ("?m=a", "?n=d", "?s=a", "?d=a")


def kept_link(url: Column, page_title: Column, query_links: bool = True, by_list: bool = False) -> Column:
    """False for script, mail and news links, sort links of index pages (``by_list``: by a fixed list, on any page), and query links where they are off."""
    if by_list:
        sort = F.lower(F.regexp_extract(url, r"(\?.*)$", 1)).isin(*INDEX_LINKS)
    else:
        sort = page_title.startswith("Index of") & url.rlike(r"\?[A-Za-z]=[A-Za-z]")
    keep = ~url.rlike(r"^(?i)(javascript|mailto|news):") & ~F.coalesce(sort, F.lit(False))
    return keep if query_links else keep & (F.instr(url, "?") == 0)
