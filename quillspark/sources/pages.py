"""Raw pages to articles: decoding, anchors, article parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded
from .tree import closed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def decode(raw: bytes | None, header: str | None = None) -> str:
    """By the header's charset, else the <meta> of the first 2 KB, else UTF-8; bad bytes are replaced."""
    if raw is None:
        return ""
    m = re.search(r"charset=[\"']?([\w-]+)", header or "", re.I) or re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", raw[:2048], re.I)
    name = m[1].decode() if m and isinstance(m[1], bytes) else m[1] if m else "utf-8"
    try:
        return raw.decode(name, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


class _Walk(HTMLParser):
    """Titles, paragraphs with the classes above them, anchors, images and metadata of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.anchors, self.images, self.blocks, self.meta = [], [], [], {}
        self.texts: list[tuple[int, list[str], str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.meta[(a.get("property") or a.get("name") or "").lower()] = a.get("content") or ""
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])
        if tag in VOID:
            return
        self.open.append((tag, a.get("class") or ""))
        if tag in ("a", "p", "title", "h1", "h2", "small", "span", "dd"):
            self.texts.append((len(self.open), [], tag, a.get("href") or "" if tag == "a" else " ".join(c for _, c in self.open)))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            depth, (t, _) = len(self.open), self.open.pop()
            while self.texts and self.texts[-1][0] >= depth:
                _, parts, kind, more = self.texts.pop()
                text = " ".join("".join(parts).split())
                (self.anchors if kind == "a" else self.blocks).append((more, text) if kind == "a" else (kind, more, text))
            if t == tag:
                break

    def handle_data(self, data):
        if any(t in ("script", "style") for t, _ in self.open):
            return
        for _, parts, _, _ in self.texts:
            parts.append(data)

    @classmethod
    def of(cls, html: str | None) -> _Walk:
        w = cls()
        w.feed(closed(html))
        w.close()
        return w


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, n (from 0), href (resolved against the page's url) and text of every link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, urljoin(u or "", href), text) for p, u, h in zip(b["page_id"], b["url"], b["html"]) for i, (href, text) in enumerate(x for x in _Walk.of(h).anchors if x[0])]
            yield pd.DataFrame(rows, columns=["page_id", "n", "href", "text"])

    bounded(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, n int, href string, text string")


def listing(links: DataFrame, pattern: str, day: str, starts: bool = False) -> DataFrame:
    """Distinct article URLs whose form fits and whose link text holds (or begins with) the day."""
    dated = F.col("text").startswith(day) if starts else F.contains("text", F.lit(day))
    return links.filter(F.col("href").rlike("^" + pattern) & dated).select("href").distinct()


def listing_by_url(links: DataFrame, pattern: str, year: str, month: str) -> DataFrame:
    """Distinct article URLs whose form captures the target year and month."""
    part = lambda i: F.regexp_extract("href", "^" + pattern, i)
    return links.filter((part(1) == year) & (F.lpad(part(2), 2, "0") == month)).select("href").distinct()


def parse(pages: DataFrame, source: str = "web", content: str = "", least: int = 30, drop: tuple[str, ...] = (), fallback: str = "") -> DataFrame:
    """Raw articles: url, source_slug, title_original, text_original, published_date.

    Title: first <h2>, else <h1>, else <title>. Text: paragraphs under the content class, else
    all of more than `least` characters, without those that hold a dropped term. Date: the
    first ISO date of the page, else the fallback. Pages without title or text are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, html in zip(b["url"], b["html"]):
                w = _Walk.of(html)
                title = next((t for kind in ("h2", "h1", "title") for k, _, t in w.blocks if k == kind and t), "")
                ps = [(c, t) for k, c, t in w.blocks if k == "p" and t and not any(d in t for d in drop)]
                inside = [t for c, t in ps if content and content in c.split()]
                text = "\n".join(inside or [t for _, t in ps if len(t) > least])
                if title and text:
                    m = re.search(r"\d{4}-\d{2}-\d{2}", html or "")
                    rows.append((url, source, title, text, m[0] if m else fallback))
            yield pd.DataFrame(rows, columns=["url", "source_slug", "title_original", "text_original", "published_date"])

    bounded(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(run, "url string, source_slug string, title_original string, text_original string, published_date string")


def page_images(pages: DataFrame, most: int = 10, avoid: str = r"logo|icon|sprite|\.gif|\.svg") -> DataFrame:
    """page_id, rank and image address: the preview image first, then images of the page, by attributes alone."""
    meta = F.regexp_extract(F.col("html"), r"""(?i)<meta[^>]+(?:property|name)=["'](?:og|twitter):image["'][^>]+content=["']([^"']+)""", 1)
    images = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)"""), 1)
    found = F.filter(F.concat(F.array(meta), images), lambda x: (x != "") & ~F.lower(x).rlike(avoid))
    return pages.select("page_id", F.posexplode(F.slice(F.array_distinct(found), 1, most)).alias("rank", "src"))


def cache_path(source, day, url):
    """Where a fetched page lies: by source, day and the start of the URL's SHA-256."""
    return F.concat_ws("/", F.lit("cache"), source, day, F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(".html")))
