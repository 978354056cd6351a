"""Hosts, types, link targets, snapshot keys and relocated paths."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types that are told apart; all else is html.
TYPES = ("html", "pdf", "doc", "docx", "xls", "xlsx")
CONTENT_TYPES = {
    "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "text/html": "html",
}
#: Each stands for a whole label of the host, part of the path or name in the query: /cas is a login page, /case-study is not.
NOISE = r"(?i)(^|[/.?&=_-])(cas|login|logout|redirect|sso|passport)([/.?&=:#;_-]|$)"
LOGIN = r"(?i)(^|[/.?&=_-])(cas|login|redirect)([/.?&=:#;_-]|$)"
ATTACHMENT = r"(?i)(_upload|\.(pdf|docx?|xlsx?)([?#]|$))"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/[^?#]*)", 1)


def type_of(url: Column, content_type: Column | None = None) -> Column:
    """By the path's ending, else by Content-Type, else html."""
    ending = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(ending.isin(*TYPES), ending)
    if content_type is None:
        return F.coalesce(known, F.lit("html"))
    plain = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    served = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))[plain]
    return F.coalesce(known, served, F.lit("html"))


def inside(host_: Column, domain: str) -> Column:
    """The domain itself or one below it."""
    return (F.lower(host_) == domain.lower()) | F.endswith(F.lower(host_), F.lit("." + domain.lower()))


def _joined(b: str | None, h: str | None) -> str | None:
    try:
        return urljoin(b, h) if isinstance(b, str) and isinstance(h, str) else None
    except ValueError:
        return None


def _resolved_all(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_joined(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolved(base: Column, href: Column) -> Column:
    """Absolute form of a link, null if it has none."""
    return F.pandas_udf(_resolved_all, "string")(base, href)


def linked(base: Column, href: Column) -> Column:
    """host/path that a link of the page at `base` leads to, in built-in expressions; null for fragments, mail and scripts.

    Paths are relative to the page's folder; . and .. are followed, and .. stops at the root. Query and fragment go.
    """
    bare = F.regexp_replace(F.trim(href), "[?#].*$", "")
    whole = F.rlike(bare, F.lit("^[A-Za-z]+://"))
    own = F.when(whole, host(bare)).when(F.startswith(bare, F.lit("//")), F.lower(F.regexp_extract(bare, "^//([^/:]+)", 1))).otherwise(host(base))
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")
    full = F.when(whole, path(bare)).when(F.startswith(bare, F.lit("//")), F.regexp_extract(bare, "^//[^/]+(/.*)$", 1)).when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
    parts = F.split(F.regexp_replace(full, "^/", ""), "/")
    steps = F.aggregate(parts, F.array().cast("array<string>"), lambda at, x: F.when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).when(x == ".", at).otherwise(F.concat(at, F.array(x))))
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(steps) > 0)
    no_page = (bare == "") | F.rlike(bare, F.lit("^(?i)(mailto|javascript|tel|data):")) | (own == "")
    return F.when(~no_page, F.concat(own, F.lit("/"), F.array_join(steps, "/"), F.when(ends, "/").otherwise("")))


def snapshot_path(url: Column) -> Column:
    return F.concat(F.lit("snapshots/"), F.md5(url), F.lit(".html.gz"))


def relocated(stored: Column, root: str) -> Column:
    """A stored absolute path of a snapshot or an attachment under another data folder."""
    tail = F.regexp_extract(stored, r"(snapshots|attachments)[/\\].*$", 0)
    return F.when(tail != "", F.concat(F.lit(root.rstrip("/") + "/"), F.replace(tail, F.lit("\\"), F.lit("/")))).otherwise(stored)


def rendered_snapshot(html: Column, url: Column, fetched_at: Column) -> Column:
    """A snapshot with a banner (time and address) above it and site-relative links made absolute."""
    banner = F.concat(F.lit('<div class="snapshot-banner">'), fetched_at, F.lit(" "), url, F.lit("</div>"))
    return F.concat(banner, F.regexp_replace(html, F.lit('(href|src)="/'), F.concat(F.lit('$1="'), origin(url), F.lit("/"))))
