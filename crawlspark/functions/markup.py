"""Start tags of a page by a tokenizer, where expressions over whole pages would see tags in quotes, comments or raw text.

It takes markup as the HTML standard's tokenizer does: quoted values hold any character, the first of two attributes of one name counts,
comments end at ``-->``, ``--!>`` or the end, the text of script, style, textarea, title and the like holds no tags, and a tag
that the page's end cuts off is none. Every character is passed once or twice, so time is linear in the page. The work is a map over
Arrow batches: pages aren't moved.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

# Elements whose content is text to the tokenizer
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
TAGS = ArrayType(StructType().add("name", StringType()).add("attributes", MapType(StringType(), StringType())))

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*("[^"]*"?|'[^']*'?|[^\t\n\f\r >"'][^\t\n\f\r >]*)?)?""")
_SPACE = re.compile(r"[\t\n\f\r /]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.IGNORECASE) for name in RAW_TEXT}
_LOWER = {c: c + 32 for c in range(65, 91)}


def _attributes(html: str, at: int) -> tuple[dict[str, str], int] | None:
    """The attributes from ``at`` to the ``>`` of a tag and the place after it; None where the page ends within the tag."""
    found: dict[str, str] = {}
    while True:
        at = _SPACE.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(html, at)
        value, at = m[2] or "", m.end()
        if value[:1] in ('"', "'"):
            if len(value) == 1 or value[-1] != value[0]:
                return None
            value = value[1:-1]
        found.setdefault(m[1].translate(_LOWER), value)


def tags_of(html: str) -> list[tuple[str, dict[str, str]]]:
    """(name, attributes) of each start tag in order; names in lower case, values as they stand."""
    found: list[tuple[str, dict[str, str]]] = []
    at = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                at = html.index(">", at + 4) + 1
            elif m := _COMMENT_END.search(html, at + 4):
                at = m.end()
            else:
                break
        elif m := _NAME.match(html, at + 1):
            name = m[0].translate(_LOWER)
            if (read := _attributes(html, m.end())) is None:
                break
            found.append((name, read[0]))
            at = read[1]
            if name in _RAW_END:
                if not (m := _RAW_END[name].search(html, at)):
                    break
                at = m.start()
        elif _NAME.match(html, at + 2) and html[at + 1] == "/":
            if (read := _attributes(html, _NAME.match(html, at + 2).end())) is None:
                break
            at = read[1]
        elif html[at + 1 : at + 2] in ("!", "?", "/") and html[at + 1 : at + 2]:
            if (at := html.find(">", at + 1)) < 0:
                break
        else:
            at += 1
    return found


@F.arrow_udf(TAGS)
def start_tags(html: pa.Array) -> pa.Array:
    """array<struct<name, attributes>> of each page; empty for null."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))]))
    return pa.array([[{"name": n, "attributes": list(a.items())} for n, a in tags_of(h.as_py() or "")] for h in html], kind)


def strict_tags(html: Column, names: list[str]) -> Column:
    """Those start tags of a page whose name is one of ``names``."""
    return F.filter(start_tags(html), lambda t: t["name"].isin(*names))
