"""Title, body and links of HTML: by built-in expressions, and by the standard parser for badly formed pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
DROPPED = r"(?is)<!--.*?-->|<head(\s[^>]*)?>.*?</head\s*>|<script(\s[^>]*)?>.*?</script\s*>|<style(\s[^>]*)?>.*?</style\s*>"
#: href in double, single or no quotes (groups 1 to 3), and what the link shows.
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""


def decoded(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def plain(html: Column) -> Column:
    """Text outside of tags, white space made one space."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body(html: Column) -> Column:
    return plain(F.regexp_replace(html, DROPPED, " "))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, n (place in the page from 0), href, anchor."""
    groups = {name: F.regexp_extract_all(html, F.lit(LINK), n).alias(name) for n, name in enumerate(("double", "single", "bare", "anchor"), 1)}
    rows = pages.select(url, F.posexplode(F.arrays_zip(*groups.values())).alias("n", "link"))
    href = F.concat_ws("", "link.double", "link.single", "link.bare")  # two of them are empty
    return rows.select(url, "n", href.alias("href"), plain(F.col("link.anchor")).alias("anchor"))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.open = [], [], [], []
        self.href: str | None = None
        self.anchor: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title"):
            self.open.append(tag)
        elif tag == "a":
            self.href, self.anchor = dict(attrs).get("href"), []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.open.remove(tag)
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.anchor).split())))
            self.href = None

    def handle_data(self, data: str) -> None:
        if "title" in self.open:
            self.title.append(data)
        elif not self.open:
            self.text.append(data)
            if self.href is not None:
                self.anchor.append(data)


def read_page(html: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    squeeze = lambda parts: " ".join(" ".join(parts).split())
    return squeeze(reader.title), squeeze(reader.text), reader.links


def parsed(pages: DataFrame) -> DataFrame:
    """url, title, body, links(href, anchor) of pages(url, html), by the standard parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_page(h) for h in batch["html"]]
            yield pd.DataFrame({"url": batch["url"], "title": [f[0] for f in found], "body": [f[1] for f in found], "links": [[{"href": h, "anchor": a} for h, a in f[2]] for f in found]})

    return pages.select("url", "html").mapInPandas(run, "url string, title string, body string, links array<struct<href:string,anchor:string>>")
