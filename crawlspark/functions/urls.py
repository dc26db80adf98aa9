"""URL algebra: parsing, resolution, canonical form, hashes, file names and classification.

Everything is a pure Column expression. ``resolve`` gives a struct with the parts of a URL:
full_url, protocol, domain, port, dirpath, filename, valid_filename, filelike, is_rel,
is_rel_server, anchor, cgi. Two scheme names inside one string count as absolute wherever
they stand, and query strings are part of the path; both are the crawler's definition.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, named, remembered, strings

# Schemes with their default ports
PORTS = {"http://": 80, "ftp://": 21, "https://": 443, "file://": 0}
DEFAULT_FILE = "index.html"
# Extensions of directories
DIRECTORY_EXTENSIONS = (".ars",)
# Extensions by kind
IMAGE_EXTENSIONS = (".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".tif", ".tiff", ".webp", ".xbm")
WEBPAGE_EXTENSIONS = ("", ".asp", ".aspx", ".cfm", ".cgi", ".htm", ".html", ".jsp", ".php", ".php3", ".php4", ".pl", ".py", ".shtml", ".xhtml")
DOCUMENT_EXTENSIONS = (".doc", ".pdf", ".ppt", ".ps", ".rtf", ".tex", ".txt", ".xls")
MARKUP = {"lt": "<", "gt": ">", "amp": "&"}
ENTITIES = {"quot": '"'} | {n: chr(c) for n, c in sorted(name2codepoint.items()) if 160 <= c <= 255}


def decode_entities(url: Column) -> Column:
    """Named references decoded: those of markup in turn, then the others (the Latin-1 ones come from the standard table) in one pass over the pieces between ``&``."""
    plain = reduce(lambda u, e: F.replace(u, F.lit(f"&{e[0]};"), F.lit(e[1])), MARKUP.items(), F.rtrim(url))
    known = F.map_from_arrays(F.split(F.lit(" ".join(ENTITIES)), " "), F.split(F.lit(",".join(ENTITIES.values())), ","))

    def decoded(piece: Column, i: Column) -> Column:
        end = F.instr(piece, ";")
        found = F.when((i > 0) & (end > 1), F.try_element_at(known, F.substring(piece, F.lit(1), end - 1)))
        return F.when(found.isNotNull(), F.concat(found, F.substring(piece, end + 1, F.length(piece)))).when(i > 0, F.concat(F.lit("&"), piece)).otherwise(piece)

    named_ = let(plain, lambda p: F.when(F.instr(p, "&") == 0, p).otherwise(F.array_join(F.transform(F.split(p, "&"), decoded), "")))
    return F.when(F.instr(url, "&") == 0, F.rtrim(url)).otherwise(named_)


def percent_decoded(s: Column) -> Column:
    """Every ``%xx`` decoded; other characters (``+`` and a ``%`` without two hex digits too) are kept."""
    guarded = F.replace(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.instr(s, "%") == 0, s).otherwise(F.coalesce(F.try_url_decode(guarded), s))


def valid_filename(name: Column) -> Column:
    return F.translate(percent_decoded(name), '?*"<>!:/\\', "")


def valid_url(url: Column) -> Column:
    return F.when(url.rlike(r"\w+\s+\w+"), F.regexp_replace(url, r"\s", "%20")).otherwise(url)


def fix_seed(url: Column) -> Column:
    """A seed with a scheme in front where it has none."""
    return F.when(url.rlike(r"^(?i)(http|https|ftp|file)://"), url).otherwise(F.concat(F.lit("http://"), url))


def collapsed(parts: Column, keep_first: Column) -> Column:
    """``x/..`` and ``.`` removed; leading ``..`` dropped; the first part stays if ``keep_first``."""
    least = F.when(keep_first, 1).otherwise(0)
    folded = F.aggregate(
        parts,
        strings(),
        lambda a, p: F.when(p == "..", F.when(F.size(a) > least, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    return F.when(F.array_contains(parts, "..") | F.array_contains(parts, "."), folded).otherwise(parts)


def _pieces(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: F.trim(p) != "")


def _tail(parts: Column) -> Column:
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def _is_file(last: Column) -> Column:
    dot = F.instr(last, ".")
    return (dot == 0) | ((dot > 1) & (dot < F.length(last)))


def _filelike(path: Column) -> Column:
    """Whether the last of some path parts names a file."""
    last = F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(""))
    directory = F.coalesce(F.regexp_extract(F.lower(last), r"(\.[^.]*)$", 1).isin(*DIRECTORY_EXTENSIONS), F.lit(False))
    return (F.size(path) > 0) & _is_file(last) & ~directory


def _located(protocol: Column, host: Column, port: Column | None, path: Column, filelike: Column) -> Column:
    """protocol, domain, port, dirpath, filename, filelike from a host[:port] and path parts."""
    default = F.coalesce(*[F.when(protocol == p, F.lit(n)) for p, n in PORTS.items()], F.lit(80))
    given = F.try_to_number(F.when(F.instr(host, ":") > 0, F.regexp_extract(host, r":(\d{1,5})$", 1)), F.lit("99999")).cast("int")
    return named(
        protocol=protocol,
        domain=F.regexp_replace(host, r":\d*$", ""),
        port=F.coalesce(given, port if port is not None else default),
        dirpath=F.transform(F.when(filelike, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path), lambda x: F.trim(x)),
        filename=F.when(filelike, F.trim(F.try_element_at(path, F.lit(-1)))).otherwise(F.lit(DEFAULT_FILE)),
        filelike=filelike,
    )


def _scheme(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(*[F.when(F.instr(low, p) > 0, F.lit(p)) for p in ("http://", "ftp://", "https://", "file://")])


# A URL is taken apart in stages, each a named value of those before it. As Columns the
# stages follow each other on a struct (``parse``, ``resolve``); on a DataFrame each is a
# column of its own (``parsed``, ``resolved``), so that the plan names every value once
# however often it is used.


def _staged_column(given: dict[str, Column], stages: list) -> Column:
    def with_stage(name: str, f, known: list[str]):
        return lambda y: named(**{k: y[k] for k in known}, **{name: f(y)})

    known, at = list(given), F.array(named(**given))
    for name, f in stages[:-1]:
        at = F.transform(at, with_stage(name, f, list(known)))
        known.append(name)
    return F.transform(at, lambda y: stages[-1][1](y))[0]


def _staged_frame(df: DataFrame, given: dict[str, Column], stages, into: str) -> DataFrame:
    """The last stage is a generated column: a filter on it then stays above instead of being moved down with all stages written out in it.

    ``stages``, a function without arguments, gives the stages; their Columns are built once in an application.
    """
    staged = df.withColumns({STAGE + k: c for k, c in given.items()})
    columns = _stage_columns(stages, tuple(given))
    for name, column in columns[:-1]:
        staged = staged.withColumn(STAGE + name, column)
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c != into], F.explode(F.array(columns[-1][1])).alias(into))


STAGE = "_stage_"


@remembered
def _stage_columns(stages, given: tuple[str, ...]) -> list[tuple[str, Column]]:
    known, found = list(given), []
    for name, f in stages():
        found.append((name, f({k: F.col(STAGE + k) for k in known})))
        known.append(name)
    return found


def _parsing(url: str, to: str) -> list:
    """The stages from the URL ``url`` without base to its struct ``to``."""
    return [
        (f"{to}_clean", lambda x: F.regexp_replace(decode_entities(x[url]), "/$", "")),
        (f"{to}_scheme", lambda x: F.coalesce(_scheme(x[f"{to}_clean"]), F.lit("http://"))),
        (f"{to}_raw", lambda x: _pieces(F.regexp_replace(x[f"{to}_clean"], r"(?i)^.*?(https?|ftp|file)://|^//", ""))),
        (f"{to}_parts", lambda x: collapsed(x[f"{to}_raw"], F.lit(True))),
        (f"{to}_path", lambda x: _tail(x[f"{to}_parts"])),
        (f"{to}_file", lambda x: _filelike(x[f"{to}_path"])),
        (to, lambda x: _located(x[f"{to}_scheme"], F.get(x[f"{to}_parts"], 0), None, x[f"{to}_path"], x[f"{to}_file"])),
    ]


def _parsing_urls() -> list:
    return _parsing("url", "b")


def _resolving() -> list:
    """The stages from ``url``, ``typ`` and ``base`` to the resolved struct."""

    def head(x):
        pieces = F.split(x["clean"], "#+")
        anchored = (x["typ"] == "anchor") & (F.instr(x["clean"], "#") > 0)
        return named(
            head=F.when(anchored, F.get(pieces, 0)).otherwise(x["clean"]),
            anchor=F.when(anchored, F.concat(F.lit("#"), F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), "#"))).otherwise(""),
        )

    def schemed(x):
        scheme = _scheme(x["h"])
        absolute = F.coalesce(scheme, F.when(x["h"].rlike(r"^www\d?\."), F.lit("http://")), F.when(x["h"].startswith("//"), F.coalesce(x["b"]["protocol"], F.lit("http://"))))
        rest = F.when(scheme.isNotNull(), F.regexp_replace(x["h"], r"(?i)^.*?(https?|ftp|file)://", "")).otherwise(F.regexp_replace(x["h"], "^//", ""))
        return named(absolute=absolute, rest=rest)

    def raw(x):
        parts = _pieces(F.when(x["alone"], x["s"]["rest"]).otherwise(x["h"]))
        return F.when(x["alone"] | x["h"].startswith("/"), parts).otherwise(F.concat(F.coalesce(x["b"]["dirpath"], strings()), parts))

    def place(x):
        return named(
            protocol=F.when(x["alone"], F.coalesce(x["s"]["absolute"], F.lit("http://"))).otherwise(F.coalesce(x["b"]["protocol"], F.lit("http://"))),
            host=F.when(x["alone"], F.get(x["parts"], 0)).otherwise(x["b"]["domain"]),
            port=F.when(~x["alone"], x["b"]["port"]),
        )

    def located(x):
        default = F.coalesce(*[F.when(x["place"]["protocol"] == p, F.lit(n)) for p, n in PORTS.items()], F.lit(80))
        return _located(x["place"]["protocol"], x["place"]["host"], F.coalesce(x["place"]["port"], default), x["path"], x["file"])

    def final(x):
        rel = ~x["alone"]
        return named(
            full_url=full_url(x["u"]),
            **{c: x["u"][c] for c in ("protocol", "domain", "port", "dirpath", "filename", "filelike")},
            valid_filename=valid_filename(x["u"]["filename"]),
            full_filename=full_filename(x["u"]),
            is_rel=rel,
            is_rel_server=rel & x["h"].startswith("/"),
            anchor=x["head"]["anchor"],
        )

    return [
        *_parsing("base", "b"),
        ("clean", lambda x: F.regexp_replace(decode_entities(x["url"]), "/$", "")),
        ("head", head),
        ("h", lambda x: F.when((x["head"]["head"] == "") & (x["head"]["anchor"] != ""), full_url(x["b"])).otherwise(x["head"]["head"])),
        ("s", schemed),
        ("alone", lambda x: x["s"]["absolute"].isNotNull() | x["b"]["domain"].isNull()),
        ("raw", raw),
        ("parts", lambda x: collapsed(x["raw"], x["alone"])),
        ("path", lambda x: F.when(x["alone"], _tail(x["parts"])).otherwise(x["parts"])),
        ("file", lambda x: _filelike(x["path"])),
        ("place", place),
        ("u", located),
        ("resolved", final),
    ]


def domain_with_port(u: Column) -> Column:
    shown = F.coalesce(*[F.when(u["protocol"] == p, u["port"] != n) for p, n in PORTS.items()], F.lit(True))
    return F.when(shown & (u["protocol"] != "file://"), F.concat(u["domain"], F.lit(":"), u["port"].cast("string"))).otherwise(u["domain"])


def full_url(u: Column) -> Column:
    dirs = F.array_join(F.transform(u["dirpath"], lambda d: F.concat(d, F.lit("/"))), "")
    return valid_url(F.concat(u["protocol"], domain_with_port(u), F.lit("/"), dirs, F.when(u["filelike"], u["filename"]).otherwise("")))


def url_directory(u: Column) -> Column:
    return F.concat(u["protocol"], u["domain"], F.lit("/"), F.array_join(F.transform(u["dirpath"], lambda d: F.concat(d, F.lit("/"))), ""))


def full_filename(u: Column) -> Column:
    """The root-relative local file of a URL."""
    return F.concat_ws("/", F.array(u["domain"]), F.transform(u["dirpath"], valid_filename), F.array(valid_filename(u["filename"])))


def parse(url: Column) -> Column:
    """The struct of a URL that has no base."""
    return _staged_column({"url": url}, _parsing("url", "b"))


def parsed(df: DataFrame, url: Column, into: str) -> DataFrame:
    """``df`` with ``parse(url)`` as the column ``into``, in stages."""
    return _staged_frame(df, {"url": url}, _parsing_urls, into)


def resolve(url: Column, url_type: Column, base: Column) -> Column:
    """The struct of ``url`` found on the page ``base`` (null: none)."""
    return _staged_column({"url": url, "typ": url_type, "base": base}, _resolving())


def resolved(df: DataFrame, url: Column, url_type: Column, base: Column, into: str) -> DataFrame:
    """``df`` with ``resolve(url, url_type, base)`` as the column ``into``, in stages."""
    return _staged_frame(df, {"url": url, "typ": url_type, "base": base}, _resolving, into)


def base_domain(domain: Column) -> Column:
    """The last two labels of a domain with more than one dot."""
    labels = F.split(domain, r"\.")
    return F.when(F.size(labels) > 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(domain)


def base_domain_with_port(u: Column) -> Column:
    shown = domain_with_port(u)
    return F.concat(base_domain(u["domain"]), F.regexp_extract(shown, r"(:\d+)$", 1))


def full_url_sans_port(u: Column) -> Column:
    dirs = F.array_join(F.transform(u["dirpath"], lambda d: F.concat(d, F.lit("/"))), "")
    return F.concat(u["protocol"], u["domain"], F.lit("/"), dirs, F.when(u["filelike"], u["filename"]).otherwise(""))


def relative_url(u: Column, compat: bool = False) -> Column:
    """The URL from its server's root; ``compat`` keeps the second slash before the file name where there are directories."""
    dirs = F.array_join(u["dirpath"], "/")
    file = F.when(u["filelike"], u["filename"]).otherwise("")
    between = F.when(F.size(u["dirpath"]) > 0, F.lit("//" if compat else "/")).otherwise("")
    return F.concat(F.lit("/"), dirs, between, file)


def directory_sans_domain(u: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(u["dirpath"], lambda d: F.concat(d, F.lit("/"))), ""))


def is_cgi(url: Column, url_type: Column) -> Column:
    """Forms and PHP pages with a query."""
    return (url_type == "form") | (F.instr(url, "php?") > 0)


def is_equal(a: Column, b: Column) -> Column:
    return full_url(a) == full_url(b)


def css_child_type(url: Column) -> Column:
    return F.when(F.lower(url).endswith(".css"), "stylesheet").otherwise("generic")


def lower_keys(m: Column) -> Column:
    """A map whose keys differ no more by case; of equal ones the last stays."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def url_hash(full: Column) -> Column:
    return F.md5(full)


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))


def kind(filename: Column, url_type: Column) -> Column:
    """image, stylesheet, document or webpage; a type that says it wins, an unknown extension is a webpage."""
    ext = extension(filename)
    return (
        F.when(url_type.isin("image", "stylesheet", "document", "webpage"), url_type)
        .when(url_type.isin("anchor", "base", "frame", "frameset"), F.lit("webpage"))
        .when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext.isin(*DOCUMENT_EXTENSIONS), F.lit("document"))
        .otherwise(F.lit("webpage"))
    )


def mime_kind(mime: Column, fallback: Column) -> Column:
    m = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    return F.when(F.coalesce(m, F.lit("")) == "", fallback).when(m.startswith("image/"), "image").when(m == "text/css", "stylesheet").when(m.rlike("javascript|ecmascript"), "javascript").when(m.rlike("html"), "webpage").when(m.isin("application/pdf", "application/msword", "application/postscript"), "document").otherwise("file")


def relative_depth(directory: Column, other: Column, mode: int = 0, same: Column | None = None) -> Column:
    """Components of ``directory`` beyond ``other``; -1 where they can't be compared.

    Mode 0 asks that it lies inside ``other``; mode 1 that ``same`` holds (the domains are equal); mode 2 counts from the root of its own server.
    """
    n = lambda d: F.size(F.filter(F.split(d, "/"), lambda p: p != ""))
    if mode == 2:
        return n(F.regexp_replace(directory, "^[a-z]+://", "")) - 1
    return F.when(F.instr(directory, other) > 0 if mode == 0 else same, F.greatest(n(directory) - n(other), F.lit(-1))).otherwise(-1)


def relative_filename(path: Column, start: Column) -> Column:
    """The path of one local file as seen from another, by their common directories."""

    def body(x: Column) -> Column:
        p, s = x["p"], x["s"]
        same = F.aggregate(F.sequence(F.lit(0), F.least(F.size(p), F.size(s)) - 1), F.lit(0), lambda a, i: F.when((a == i) & (F.get(p, i) == F.get(s, i)) & (i < F.size(s) - 1) & (i < F.size(p) - 1), a + 1).otherwise(a))
        return let(same, lambda k: F.concat_ws("/", F.array_repeat(F.lit(".."), F.size(s) - 1 - k), F.slice(p, k + 1, F.size(p) - k)))

    return let(F.struct(F.split(path, "/").alias("p"), F.split(start, "/").alias("s")), body)


def image_signature(content: Column) -> Column:
    """The image type that the first bytes tell."""
    at = lambda a, n: F.decode(F.substring(content, a, n), "ISO-8859-1")
    return F.when(at(1, 6).isin("GIF87a", "GIF89a"), "gif").when(at(7, 4) == "JFIF", "jpeg").when(at(1, 3) == "BM6", "bmp")


def content_length(headers: Column, body: Column) -> Column:
    """The announced length: the first of a comma list, as it stands; the body's own length where none is announced. ``headers``: map of lower-case names."""
    told = F.trim(F.split_part(F.try_element_at(headers, F.lit("content-length")), F.lit(","), F.lit(1)))
    return F.coalesce(told, F.length(F.coalesce(body, F.lit(""))).cast("string"))


def content_type(headers: Column) -> Column:
    """The announced type up to a semicolon; empty where none is announced, and as it stands where nothing is before the semicolon."""
    told = F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit(""))
    return F.coalesce(F.nullif(F.split_part(told, F.lit(";"), F.lit(1)), F.lit("")), told)


def content_encoding(headers: Column) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit("content-encoding")), F.lit("plain"))


def last_modified(headers: Column) -> Column:
    return F.coalesce(F.try_element_at(headers, F.lit("last-modified")), F.lit(""))


def http_date(text: Column) -> Column:
    """``Sun, 06 Nov 1994 08:49:37 GMT`` as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))


def byte_label(n: Column) -> Column:
    return F.when(n >= 1024 * 1024, F.concat(F.round(n / (1024 * 1024), 2).cast("string"), F.lit("M"))).when(n >= 1024, F.concat(F.round(n / 1024, 2).cast("string"), F.lit("K"))).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def mirror_urls(full: Column, mirrors: dict[str, list[str]]) -> Column:
    """array<string>: ``full`` under each mirror of the project whose prefix it has; empty where no prefix fits."""
    found = F.array().cast("array<string>")
    for prefix, others in mirrors.items():
        rest = F.substring(full, len(prefix) + 1, 1 << 30)
        found = F.when(full.startswith(prefix), F.array(*[F.concat(F.lit(m), rest) for m in others])).otherwise(found)
    return found


def pick_mirrors(candidates: Column, n: int, seed: Column) -> Column:
    """``n`` of the mirrors in an order that depends on ``seed`` alone, so that reruns agree."""
    drawn = F.array_sort(F.transform(candidates, lambda m: F.struct(F.md5(F.concat(seed, m)).alias("h"), m.alias("m"))))
    return F.transform(F.slice(drawn, 1, n), lambda x: x["m"])


def eta_label(left: Column, rate: Column) -> Column:
    """The time for ``left`` bytes at ``rate`` bytes a second as h:mm:ss; empty where the rate is not known."""
    t = F.ceil(left / rate).cast("bigint")
    return F.when(rate > 0, F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)).otherwise("")


# The download hosts of one project whose files are on mirrors, and the mirrors
DOWNLOAD_HOSTS = ("downloads.sourceforge.net", "prdownloads.sourceforge.net")
MIRRORS = tuple(f"{m}.dl.sourceforge.net" for m in "umn jaist mesh superb-west superb-east keihanna optusnet kent ufpr ovh switch nchc heanet surfnet easynews belnet puzzle internap".split())


def is_mirror(domain: Column, hosts: tuple[str, ...] | list[str] = DOWNLOAD_HOSTS + MIRRORS) -> Column:
    """Whether a host is one of a project's download hosts or mirrors."""
    return F.lower(domain).isin([h.lower() for h in hosts])


# The escapes that older versions decode in file names
ESCAPES = {"%20": " ", "%7E": "~", "%2B": "+", "%22": '"', "%3C": "<", "%3E": ">", "%23": "#", "%25": "%", "%7B": "{", "%7D": "}", "%7C": "|", "%5C": "\\", "%5E": "^", "%5B": "[", "%5D": "]", "%60": "`"}


def escapes_decoded(name: Column, table: dict[str, str] = ESCAPES) -> Column:
    """The escapes of a table, in either case, decoded in turn; others are kept."""
    return reduce(lambda s, e: F.replace(F.replace(s, F.lit(e[0]), F.lit(e[1])), F.lit(e[0].lower()), F.lit(e[1])), table.items(), name)


def with_base_port(u: Column, base: Column) -> Column:
    """The struct of a URL with the port of its base, as older versions give it to every URL, absolute ones too (bases of files excepted)."""
    return F.when(base["protocol"] != "file://", u.withField("port", base["port"])).otherwise(u)


def reresolved(df: DataFrame, target: Column, url: str = "u") -> DataFrame:
    """``df`` whose URL struct ``url`` follows a redirect (``target``, null: none); the struct before stays as ``<url>_old``."""
    moved = resolved(df, target, F.lit("generic"), F.col(f"{url}.full_url"), "_to")
    old = F.when(target.isNotNull(), F.col(url))
    return moved.withColumns({f"{url}_old": old, url: F.when(target.isNotNull(), F.col("_to")).otherwise(F.col(url)), "reresolved": target.isNotNull()}).drop("_to")
