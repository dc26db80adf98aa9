"""Crawl options from keywords, an XML document or a JSON project."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, fields, replace

_WORDS = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}


@dataclass(frozen=True)
class CrawlConfig:
    """Options that change results; names and defaults are the crawler's. ``plans.crawl`` acts on every one of them."""

    html: bool = True
    htmlparser: int = 0  # 1: links by the tokenizer of functions.markup
    images: bool = True
    javascript: bool = True
    javaapplet: bool = True
    imagelinks: bool = True
    stylesheetlinks: bool = True
    offset_start: int = 0
    offset_end: int = -1
    fetchlevel: int = 0
    extserverlinks: bool = False
    extpagelinks: bool = True
    depth: int = 10
    extdepth: int = 0
    subdomain: bool = True
    maxextservers: int = 0
    maxextdirs: int = 0
    maxfiles: int = 5000
    maxfilesize: int = 5242880
    timelimit: int = -1
    robots: bool = True
    urlpriority: str = ""
    serverpriority: str = ""
    urlfilter: str = ""
    serverfilter: str = ""
    wordfilter: str = ""
    junkfilter: bool = True
    querylinks: bool = False
    skipruletypes: tuple[str, ...] = ()
    simulate: bool = False
    localise: int = 2
    numparts: int = 4

    @classmethod
    def of(cls, **options: object) -> CrawlConfig:
        """Options with values of any spelling (``yes``, ``0``, ``"3"``); unknown names are refused."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := sorted(set(options) - set(kinds)):
            raise KeyError(f"unknown options: {', '.join(unknown)}")
        return cls(**{k: _coerced(v, kinds[k]) for k, v in options.items()})

    @classmethod
    def from_xml(cls, text: str) -> CrawlConfig:
        """Known options of an XML document: an element's text or its ``value`` attribute."""
        names = {f.name for f in fields(cls)}
        found = {}
        for e in ET.fromstring(text).iter():
            value = e.get("value", (e.text or "").strip())
            if e.tag in names and value != "":
                found[e.tag] = value
        return cls.of(**found)

    @classmethod
    def from_json(cls, text: str) -> CrawlConfig:
        return cls.of(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def browsing(self) -> CrawlConfig:
        """The preset of a user who looks at one page with what it shows."""
        return replace(self, depth=0, fetchlevel=2, skipruletypes=("image", "stylesheet"))

    def simulated(self) -> CrawlConfig:
        """The preset of a run that saves nothing."""
        return replace(self, simulate=True)


def _coerced(value: object, kind: type) -> object:
    if kind is tuple:
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    if kind is bool and isinstance(value, str):
        return _WORDS[value.strip().lower()]
    return kind(value)
