"""The rules engine: filters, junk, scope, depth, limits and word filters as boolean Columns.

``reject_reason`` chains them in the crawl's order; it is null for a URL that may be fetched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import any_of
from .junk_lists import DOMAINS, PATTERNS


def compile_filter(text: str) -> tuple[list[str], list[str]]:
    """``+include-exclude`` as lists of Java patterns; ``*`` is any text, ``.ext`` alone is a suffix."""
    include, exclude = [], []
    for sign, body in re.findall(r"([+-])([^+-]+)", text or ""):
        body = body.strip()
        prefix, _, ext = body.rpartition("/.")
        if re.fullmatch(r"\*?\.\w+", body):
            pattern = re.escape(body.lstrip("*")) + "$"
        elif prefix:
            pattern = re.escape(prefix) + r"/(?=\w+\." + re.escape(ext) + ")"
        else:
            pattern = ".*".join(re.escape(p) for p in body.split("*"))
        (include if sign == "+" else exclude).append("(?i)" + pattern)
    return include, exclude


def url_filter_blocks(url: Column, text: str, precedence: str = "include") -> Column:
    """An include list lets only its matches pass; without one, an exclude list blocks its matches.

    Where a URL matches both, ``precedence`` decides: ``include`` lets it pass, ``order`` goes by the first matching part of the text.
    """
    include, exclude = compile_filter(text)
    if precedence == "order" and include and exclude:
        ordered = [(sign == "-", p) for sign, body in re.findall(r"([+-])([^+-]+)", text) for ps in compile_filter(sign + body) for p in ps]
        first = F.coalesce(*[F.when(url.rlike(p), blocks) for blocks, p in ordered])
        return F.coalesce(first, F.lit(True))
    if include:
        return ~any_of([url.rlike(p) for p in include])
    return any_of([url.rlike(p) for p in exclude])


def server_filter_blocks(domain: Column, text: str, compat: bool = False) -> Column:
    """As the URL filter; ``compat`` keeps the quirk that a list of excludes alone blocks every server."""
    include, exclude = compile_filter(text)
    if compat and exclude and not include:
        return F.lit(True)
    return url_filter_blocks(domain, text)


def junk_reason(url: Column, domain: Column, base: Column, domains=DOMAINS, patterns=PATTERNS) -> Column:
    """domain, base-domain or pattern (in that order); null for a URL that is none."""
    return F.when(domain.isin(*domains), "domain").when(base.isin(*domains), "base-domain").when(url.rlike("|".join(f"(?:{p})" for p in patterns)), "pattern")


def same_server(a: Column, b: Column, base_a: Column, base_b: Column, subdomains_differ: bool = True) -> Column:
    bare = lambda d: F.regexp_replace(F.lower(d), r"^www\.", "")
    return bare(a) == bare(b) if subdomains_differ else F.lower(base_a) == F.lower(base_b)


def external(level: int, *, under_start: Column, same: Column, parent_same: Column, parent_in_start_dir: Column, typ: Column, page_links: bool = True, server_links: bool = False, images: bool = True, styles: bool = True, server_blocked: Column | None = None, too_deep: Column | None = None) -> Column:
    """Whether a link leaves the crawl's scope, by fetch level 0..4.

    Levels over 0 allow pages beside the start directory (``page_links`` is for none of them then), levels over 3 other servers
    (and so for ``server_links``); both only as far as ``too_deep`` and, for servers, ``server_blocked`` let them.
    """
    no = F.lit(False)
    checks = too_deep if too_deep is not None else no
    on_server = F.lit(True) if level == 0 else ~parent_in_start_dir if level == 3 else checks | F.lit(not (page_links or level > 0))
    other = checks | (server_blocked if server_blocked is not None else no) | F.lit(not (server_links or level > 3))
    elsewhere = F.lit(True) if level in (0, 1) else ~parent_same if level in (2, 3) else other
    asset = (typ == "stylesheet") & F.lit(styles) | (typ == "image") & F.lit(images)
    return F.when(under_start | asset, False).when(same, on_server).otherwise(elsewhere)


def beyond_depth(depth: Column, limit: int) -> Column:
    return F.lit(False) if limit < 0 else depth > limit


def admitted(df: DataFrame, key: str, order: list[str], limit: int, compat: bool = False) -> DataFrame:
    """``df`` with ``admitted``: rows of the first ``limit`` keys in order of first sight.

    ``compat`` lets key ``limit + 1`` pass except for its first row. Of all keys only the first ``limit + 1`` are ordered, as a top-k.
    """
    if not limit:
        return df.withColumn("admitted", F.lit(True))
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    ahead = first.orderBy("_first").limit(limit + 1)
    ranked = ahead.withColumn("_rank", F.row_number().over(Window.orderBy("_first")))
    joined = df.join(F.broadcast(ranked), key, "left")  # limit + 1 rows
    ok = F.col("_rank") <= limit
    if compat:
        ok = ok | ((F.col("_rank") == limit + 1) & (F.struct(*order) > F.col("_first")))
    return joined.withColumn("admitted", F.coalesce(ok, F.lit(False))).drop("_first", "_rank")


def size_allowed(length: Column, most: int) -> Column:
    return length <= most


def type_allowed(typ: Column, *, images: bool = True, javascript: bool = True, applets: bool = True, html: bool = True) -> Column:
    """Whether links and pages of a type are wanted at all."""
    off = [t for t, on in (("image", images), ("javascript", javascript), ("javaapplet", applets), ("webpage", html)) if not on]
    return ~typ.isin(*off) if off else F.lit(True)


def word_filter(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern) if pattern else F.lit(False)


def boolean_word_filter(text: Column, expression: str) -> Column:
    """``a & (b | !c)`` over words that stand after white space, ``+``, ``<`` or ``>``."""
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", expression)
    at = 0

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(parts) and parts[at] == "|":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = single()
        while at < len(parts) and parts[at] == "&":
            at += 1
            left = left & single()
        return left

    def single() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"word missing at the end of {expression!r}")
        part = parts[at]
        at += 1
        if part == "!":
            return ~single()
        if part == "(":
            inner = either()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"parenthesis not closed in {expression!r}")
            at += 1
            return inner
        if part in "&|)":
            raise ValueError(f"word expected at {part!r} in {expression!r}")
        return text.rlike(r"(?i)[\s+<>]" + re.escape(part))

    found = either()
    if at != len(parts):
        raise ValueError(f"{parts[at]!r} not expected in {expression!r}")
    return found


def reject_reason(typ: Column, *, skip_types=(), known_bad: Column, filtered: Column, junk: Column, outside: Column, robots: Column, deep: Column) -> Column:
    """The first rule that blocks, in the crawl's order; null if none does."""
    skip = typ.isin(*skip_types) if skip_types else F.lit(False)
    chain = F.when(skip, F.lit(None).cast("string"))
    for reason, blocks in (("known_bad", known_bad), ("url_filter", filtered), ("junk", junk), ("external", outside), ("robots", robots), ("depth", deep)):
        chain = chain.when(F.coalesce(blocks, F.lit(False)), reason)
    return chain


def error_action(status: Column) -> tuple[Column, Column]:
    """(fatal, action) of an HTTP status."""
    fatal = status.isin(401, 404, 407) | status.between(500, 504)
    action = F.when(status.isNull() | (status < 300), "ok").when(status == 304, "not_modified").when(status.isin(404, 503, 504), "add_to_filter").when(status == 401, "stop").when(status == 407, "proxy").when(status.between(500, 502), "give_up").otherwise("retry")
    return F.coalesce(fatal, F.lit(False)), action
