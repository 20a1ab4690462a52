"""URL lists: checks, identity and retrieval."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_valid(url: Column) -> Column:
    """http or https with a host and without user information."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s@]+(?:[/?#]|$)"), F.lit(False)) & ~url.rlike(r"^[^/]*//[^/?#]*@")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def distinct_urls(urls: DataFrame, position: str, url: str = "url") -> DataFrame:
    """Each URL once, at its first position."""
    first = Window.partitionBy(url).orderBy(position)
    return urls.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def parse_url_list(value: str, max_pages: int) -> list[str]:
    """The URLs of a text, one a line: blank lines and repeats go, the limit holds for the rest."""
    found = list(dict.fromkeys(x for x in map(str.strip, value.splitlines()) if x))
    for url in found:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"not an http(s) URL with a host: {url}")
        if parts.username is not None or parts.password is not None:
            raise ValueError("URLs with credentials are not accepted")
    if not found:
        raise ValueError("give at least one URL")
    if len(found) > max_pages:
        raise ValueError(f"at most {max_pages} URLs are accepted")
    return found


def url_request_key(urls: list[str]) -> str:
    return hashlib.sha256(json.dumps(urls, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def request_keys(urls: DataFrame, group: str, position: str, url: str = "url") -> DataFrame:
    """(group, request_key) of ordered URL lists, as ``url_request_key`` gives it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(url).alias("u")))), lambda x: x["u"])
    return urls.groupBy(group).agg(F.substring(F.sha2(F.to_json(ordered), 256), 1, 16).alias("request_key"))


def fetch(urls: list[str], timeout_seconds: float = 20.0, max_page_bytes: int = 5_000_000, progress: Callable[[str], None] | None = None, opener: Callable = urllib.request.urlopen) -> list[tuple[str, str, str]]:
    """(requested, final URL, html) of each page; a page that can't be had is an error."""
    pages = []
    for url in urls:
        if progress:
            progress(f"downloading {url}")
        request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; gridloom)"})
        try:
            with opener(request, timeout=timeout_seconds) as answer:
                final = answer.geturl()
                if urlsplit(final).scheme not in ("http", "https"):
                    raise ValueError("redirected away from http(s)")
                kind = answer.headers.get_content_type()
                if kind not in ("text/html", "application/xhtml+xml"):
                    raise ValueError(f"not an HTML page: {kind}")
                body = answer.read(max_page_bytes + 1)
                if len(body) > max_page_bytes:
                    raise ValueError(f"larger than {max_page_bytes} bytes")
                charset = answer.headers.get_content_charset() or "utf-8"
        except Exception as e:
            raise RuntimeError(f"{url} could not be downloaded: {e}") from e
        try:
            html = body.decode(charset, "replace")
        except LookupError:
            html = body.decode("utf-8", "replace")
        pages.append((url, final, html))
    return pages
