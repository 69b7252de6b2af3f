"""The four monitored sites: what their listings name, and where their pages keep title, text and date.

Each site is a set of rules over the page tree; a rule that finds what it looks for settles the
field, and the next one is asked otherwise. Addresses, class names and terms are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from ..session import bounded
from .tree import Tree, search

ISO = r"(\d{4}-\d{2}-\d{2})"
SLASHES = re.compile(r"(\d{4})/(\d{1,2})/(\d{1,2})")
NOTICES = ("版权", "责任编辑")


@dataclass(frozen=True)
class Paragraphs:
    """Paragraphs of more than `least` characters inside a container (if one is named) with or without classes.

    settles: the rule is final once any paragraph fits tag and class, whatever the other limits leave.
    """

    inside: tuple[str, str, bool] | None = None
    cls: str = ""
    least: int = -1
    without_class: str = ""
    not_only: str = ""
    bare: bool = False
    avoid: tuple[str, ...] = ()
    settles: bool = False

    def __call__(self, t: Tree) -> str | None:
        top = 0
        if self.inside:
            tag, cls, exact = self.inside
            top = t.first(tag, cls, exact)
            if top < 0:
                return None
        found = list(t.find("p", self.cls, below=top))
        kept = []
        for p in found:
            own = t.classes(p)
            text = t.words(p)
            wanted = not (self.bare and own) and self.without_class not in own and (not own or own != [self.not_only])
            if wanted and len(text) > self.least and not any(a in text for a in self.avoid):
                kept.append(text)
        return "\n".join(kept) if kept or (self.settles and found) else None


def whole(tag: str, cls: str, least: int) -> Callable[[Tree], str | None]:
    """All text of a container, a line for each piece."""

    def rule(t: Tree) -> str | None:
        i = t.first(tag, cls)
        text = t.words(i, "\n") if i >= 0 else ""
        return text if len(text) > least else None

    return rule


def heading(tag: str, inside: str = "", never: str = "", cls: str = "") -> Callable[[Tree], str | None]:
    """Text of the first such element (of the first container of that class)."""

    def rule(t: Tree) -> str | None:
        top = t.first("div", inside, True) if inside else 0
        i = t.first(tag, cls, True, top) if top >= 0 else -1
        text = t.words(i) if i >= 0 else ""
        return text if text and text != never else None

    return rule


def day_of(match: re.Match) -> str:
    return f"{match[1]}-{int(match[2]):02d}-{int(match[3]):02d}"


def _published(t: Tree, html: str) -> str:
    box = t.first("div", "artichle-info")
    inside = search(r"发布[：:]\s*" + ISO, "".join(t.strings(box))) if box >= 0 else ""
    return inside or next((search(ISO, s) for s in t.strings() if re.search(r"发布[：:]\s*" + ISO, s)), "")


def _any_day(t: Tree, html: str) -> str:
    return search(ISO, html)


def _info_day(t: Tree, html: str) -> str:
    box = t.first("div", "pub-info", True)
    found = (re.match(ISO, t.words(i)) for i in t.find("dd", below=box)) if box >= 0 else ()
    return next((m[1] for m in found if m), "") or search(ISO, html)


def _source_day(t: Tree, html: str) -> str:
    found = (SLASHES.search(t.words(i)) for i in t.find("div", "source_time"))
    return next((day_of(m) for m in found if m), "")


def _dated_links(t: Tree, day: str) -> Iterator[str]:
    return (href for href, _, i in t.anchors() if day in "".join(t.strings(i)))


def _timed_links(t: Tree, day: str) -> Iterator[str]:
    """Links right above a title whose time begins with the day."""
    for i in t.find("div", "title", True):
        time, up = t.first("small", "time", below=i), t.parent[i]
        if time >= 0 and t.words(time).startswith(day) and t.tag[up] == "a":
            yield t.attrs[up].get("href", "")


def _month_links(t: Tree, day: str) -> Iterator[str]:
    """Links whose address has the month; a day that one of the four nodes above shows has to be the day."""
    for href, _, i in t.anchors():
        shown = (SLASHES.search(t.words(d)) for up in t.above(i, 4) for d in t.find("div", "source_time", below=up))
        first = next((m for m in shown if m), None)
        if first is None or day_of(first) == day:
            yield href


@dataclass(frozen=True)
class Site:
    slug: str
    address: str  # of an article, from its start; groups are year and month, if any
    links: Callable[[Tree, str], Iterator[str]]
    title: tuple[Callable[[Tree], str | None], ...]
    text: tuple[Callable[[Tree], str | None], ...]
    date: Callable[[Tree, str], str]


SITES = {
    s.slug: s
    for s in (
        Site(
            "pla_daily", r"https?://www\.81\.cn/[^/]+/\d+\.html$", _dated_links, (heading("h2"), heading("h1")),
            (Paragraphs(inside=("ul", "m-t-list", False), cls="ueditor", settles=True), whole("ul", "m-t-list", 50), Paragraphs(least=30, avoid=NOTICES)), _published,
        ),
        Site(
            "mod_china", r"https?://www\.mod\.gov\.cn/gfbw/[^/]+(?:/[^/]+)*/\d+\.html$", _dated_links, (heading("h1"), heading("h2")),
            (Paragraphs(cls="ueditor", least=10, without_class="ueditor-text-tushuo", settles=True), Paragraphs(least=30, avoid=NOTICES)), _any_day,
        ),
        Site(
            "china_mil_online", r"https?://eng\.chinamil\.com\.cn/\S+/\d+\.html$", _timed_links, (heading("h1", inside="article-header"), heading("h1", never="China Military")),
            (Paragraphs(cls="ueditor", least=10, settles=True), Paragraphs(least=40)), _info_day,
        ),
        Site(
            "global_times_mil", r"https?://www\.globaltimes\.cn/page/(\d{4})(\d{2})/\d+\.shtml$", _month_links, (heading("div", cls="article_title"), heading("h1")),
            (Paragraphs(inside=("div", "article_content", True), least=30, not_only="picture"), Paragraphs(least=40, bare=True)), _source_day,
        ),
    )
}


def article(site: Site, html: str | None, day: str) -> tuple[str, str, str] | None:
    """Title, text ('' if no rule finds any) and date (else the day) of a page, or None without a title."""
    t = Tree(html)
    title = next((x for x in (rule(t) for rule in site.title) if x), None)
    if title is None:
        return None
    return title, next((x for x in (rule(t) for rule in site.text) if x is not None), ""), site.date(t, html or "") or day


def listed(site: Site, url: str | None, html: str | None, day: str) -> list[str]:
    """Addresses of the day's articles on a listing, each once, in order."""
    out = {}
    for href in site.links(Tree(html), day):
        full = urljoin(url or "", href)
        m = re.match(site.address, full)
        if m and (not m.groups() or f"{m[1]}-{m[2]}" == day[:7]):
            out[full] = None
    return list(out)


def articles(pages: DataFrame) -> DataFrame:
    """url, source_slug, title_original, text_original, published_date of every page that has a title.

    pages: url, html, source_slug and day (what a page without a date gets). Pages of other
    sources are left out. A null html has no title. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, s, *found) for u, h, s, d in zip(b["url"], b["html"], b["source_slug"], b["day"]) if s in SITES and (found := article(SITES[s], h, d)) is not None]
            yield pd.DataFrame(rows, columns=["url", "source_slug", "title_original", "text_original", "published_date"])

    bounded(pages.sparkSession)
    return pages.select("url", "html", "source_slug", "day").mapInPandas(run, "url string, source_slug string, title_original string, text_original string, published_date string")


def listings(pages: DataFrame) -> DataFrame:
    """source_slug and url of the articles that listings (url, html, source_slug, day) name for their day, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, x) for u, h, s, d in zip(b["url"], b["html"], b["source_slug"], b["day"]) if s in SITES for x in listed(SITES[s], u, h, d)]
            yield pd.DataFrame(rows, columns=["source_slug", "url"])

    bounded(pages.sparkSession)
    return pages.select("url", "html", "source_slug", "day").mapInPandas(run, "source_slug string, url string").distinct()
