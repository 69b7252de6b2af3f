"""String functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# white space as Unicode has it, with the four separators that Java's class leaves out
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_TAGS = r"(?U)^(?:[\s\x1c-\x1f]*(?:【[^】]*】|\[[^\]]*\])[\s\x1c-\x1f]*)+"


def blank_to(x: Column, other: Column | None = None) -> Column:
    """x, or `other` where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other if other is not None else F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), _SPACE, " "))


def content_hash(title: Column, text: Column) -> Column:
    """SHA-256 of the collapsed title and text, one newline between."""
    return F.sha2(F.concat(collapse(title), F.lit("\n"), collapse(text)), 256)


def normal_title(title: Column) -> Column:
    """Without leading bracketed tags, however many."""
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), _TAGS, ""))


def title_hash(title: Column) -> Column:
    """SHA-1 of the normal title; empty for an empty one."""
    t = normal_title(title)
    return F.when(t == "", "").otherwise(F.sha1(t))


def body_hash(body: Column, n: int = 200) -> Column:
    """SHA-1 of the first n characters that are not white space."""
    return F.sha1(F.left(F.regexp_replace(F.coalesce(body, F.lit("")), _SPACE, ""), F.lit(n)))


def url_section(url: Column) -> Column:
    """First folder of the path; empty if the path has none."""
    return F.coalesce(F.regexp_extract(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^/([^/]+)/", 1), F.lit(""))


def url_host(url: Column) -> Column:
    """Host with its port; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, path without trailing slashes, no query or fragment."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(head, path)


def section_priority(url: Column, table: dict[str, int] = C.SECTION_PRIORITY) -> Column:
    """A copy's rank by its URL's section."""
    section = url_section(url)
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(known, section), F.when(section != "", C.OTHER_SECTION).otherwise(C.NO_SECTION))


def excerpt(x: Column, n: int = C.EXCERPT) -> Column:
    """At most n characters, cut at the last blank, with three dots if cut."""
    x = F.coalesce(x, F.lit(""))
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.regexp_replace(F.left(x, F.lit(n)), " [^ ]*$", ""), "[ ,;:]+$", ""), F.lit("...")))


def short_title(english: Column, original: Column, n: int = 110) -> Column:
    """The first title there is, cut at a blank with an ellipsis if longer than n."""
    t = strip(blank_to(english, blank_to(original, F.lit("Untitled"))))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.regexp_replace(F.left(t, F.lit(n)), " [^ ]*$", ""), "[ ,;:]+$", ""), F.lit("…")))


def csv_array(x: Column) -> Column:
    """Non-empty fields of a comma-separated string."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda v: v != "")


def sentences(x: Column) -> Column:
    """Sentences, cut after . ! ? and white space."""
    return F.filter(F.split(F.trim(F.coalesce(x, F.lit(""))), r"(?<=[.!?])\s+"), lambda v: v != "")


def word_count(x: Column) -> Column:
    """Words between white space; none in an empty string."""
    return F.size(F.filter(F.split(collapse(x), " "), lambda v: v != ""))


def tokens(x: Column, stopwords=C.STOPWORDS) -> Column:
    """Lower-case words of three letters or more without punctuation and stop words, in order."""
    stop = F.array(*map(F.lit, stopwords))
    words = F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s\-']", " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def without(words: Column, banned=C.SENSATIONAL) -> Column:
    """The words that are not banned, repeats kept."""
    out = F.array(*map(F.lit, banned))
    return F.filter(words, lambda w: ~F.array_contains(out, w))


def escape_html(x: Column) -> Column:
    """& < > and both quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_html_keeping_emphasis(x: Column) -> Column:
    """Escaped, with <strong> and <em> restored."""
    x = escape_html(x)
    for tag in ("strong", "em"):
        for t in (tag, "/" + tag):
            x = F.replace(x, F.lit(f"&lt;{t}&gt;"), F.lit(f"<{t}>"))
    return x


def strip_tags(x: Column) -> Column:
    """Without markup; the common entities resolved; white space collapsed."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return collapse(x)


def paragraphs(html: Column) -> Column:
    """The stripped contents of <p>, blank lines between."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)<p>(.*?)</p>"), 1)
    return F.array_join(F.filter(F.transform(found, strip_tags), lambda p: p != ""), "\n\n")


def strip_first_prefix(x: Column, prefixes: list[str]) -> Column:
    """Without the first of the prefixes that it begins with."""
    out = None
    for p in prefixes:
        hit = x.startswith(p)
        rest = F.trim(F.substr(x, F.lit(len(p) + 1)))
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return out.otherwise(x) if out is not None else x


def leading_cjk(x: Column, n: int = 2) -> Column:
    """The CJK characters at the start, n at most."""
    return F.left(F.regexp_extract(F.trim(F.coalesce(x, F.lit(""))), "^[一-鿿㐀-䶿]+", 0), F.lit(n))


def capped(x: Column, n: int = 240) -> Column:
    """At most n characters, the last an ellipsis if cut."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 3)), F.lit("…"))).otherwise(x)


def first_line_with(x: Column, pattern: str) -> Column:
    """1-based number of the line on which the pattern first matches; null if nowhere."""
    at = F.regexp_instr(x, F.lit(pattern))
    return F.when(at > 0, F.length(F.regexp_replace(F.left(x, at - 1), "[^\n]", "")) + 1)


def image_extension(mime: Column, url: Column) -> Column:
    """By MIME type, else the URL's own, else .jpg."""
    known = F.create_map(*(F.lit(x) for kv in {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/svg+xml": ".svg"}.items() for x in kv))
    own = F.nullif(F.lower(F.regexp_extract(url, r"(?i)(\.(?:jpg|jpeg|png|webp|gif|svg))$", 1)), F.lit(""))
    return F.coalesce(F.try_element_at(known, mime), own, F.lit(".jpg"))


def prose_gaps(x: Column) -> Column:
    """How often a sentence says 'not ... but'."""
    return F.regexp_count(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"\bnot\b[^.!?]{3,80}?\bbut\b"))
