"""Editions, their media and manifests, and the text recovered from published pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V

# Headings of published editions and the fields under them.
HEADINGS = {
    "opening note": "opening_note",
    "what stood out": "what_stood_out",
    "why it matters": "why_it_matters",
    "routine baseline": "what_was_routine",
    "what was routine": "what_was_routine",
    "what i'm watching next": "what_im_watching_next",
    "what i’m watching next": "what_im_watching_next",
}
# Markup of published editions: a section with its heading, the term, the signal.
SECTION = r'(?s)<div class="mod-heading brand">([^<]+)</div>\s*<div class="section-text">(.*?)</div>\s*</div>'
TERM = r'(?s)<div class="term-word">(.*?)</div>\s*<div class="term-explanation">(.*?)</div>'
SIGNAL = r'(?s)<div class="signal-text">(.*?)</div>'
# Labels of media kinds.
MEDIA_LABELS = {
    "map": "Map",
    "source_image": "Source Image",
    "source image": "Source Image",
    "document_excerpt": "Document Excerpt",
    "document excerpt": "Document Excerpt",
    "chart": "Chart",
}
# MIME types of photographs; status codes and words of errors that no row escapes.
PHOTO_MIME = ("image/jpeg", "image/png", "image/webp")
FATAL_STATUS = (401, 402, 403)
FATAL_WORDS = ("reached your specified api usage limits", "credit balance is too low", "billing", "quota")
# Words of titles that reject an image, unless the text is about such things.
VIOLENT = ("explosion", "blast", "wreck", "wreckage", "fireball", "casualty", "casualties", "destruction", "burning")
MAPS, ABOUT_MAPS = ("map of", "locator map", "diagram", "schematic", "infographic"), ("map of", "geography", "border")
EMBLEMS, ABOUT_EMBLEMS = ("logo", "icon", "emblem", "coat of arms", "crest", "seal of"), ("logo", "emblem", "insignia", "seal of")
WEAPONS = ("missile", "icbm", "warhead", "tank prototype", "fighter jet")
LEAST_SCORE = 6.0


def recent_flagged(df: DataFrame, brief: str, days: int = 7) -> DataFrame:
    """Flagged rows without extraction issues of the brief's day and the `days` days before it, newest and most relevant first."""
    day = F.lit(brief).cast("date")
    dated = df.filter("is_significant AND NOT extraction_issue").filter(D.strict(F.col("published_date")).between(F.date_sub(day, days), day))
    return dated.orderBy(F.desc("published_date"), F.desc("relevance_score"), "id")


def body_fields(pages: DataFrame) -> DataFrame:
    """One row of (key, field, value) for each recovered field of a published edition (key, html): the last section of a field counts."""
    heads = F.regexp_extract_all("html", F.lit(SECTION), 1)
    bodies = F.regexp_extract_all("html", F.lit(SECTION), 2)
    rows = pages.select("key", F.posexplode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("n", "s"))
    rows = rows.select("key", "n", V.lookup(HEADINGS, F.lower(T.strip(F.col("s.h"))), F.lit(None).cast("string")).alias("field"), T.paragraphs(F.col("s.b")).alias("value"))
    one = rows.filter("field IS NOT NULL AND value <> ''").groupBy("key", "field").agg(F.max_by("value", "n").alias("value"))
    found = lambda p, i: F.regexp_extract("html", p, i)
    more = F.array(
        F.struct(F.lit("term_to_know_term").alias("field"), T.strip_tags(found(TERM, 1)).alias("value")),
        F.struct(F.lit("term_to_know_explanation").alias("field"), F.coalesce(F.nullif(T.paragraphs(found(TERM, 2)), F.lit("")), T.strip_tags(found(TERM, 2))).alias("value")),
        F.struct(F.lit("signal").alias("field"), T.strip_tags(found(SIGNAL, 1)).alias("value")),
    )
    return one.unionByName(pages.select("key", F.inline(more)).filter("value <> ''"))


def ticks(editions: DataFrame) -> DataFrame:
    """Date, number, title and counts of editions that have a date and a number, by date."""
    return editions.filter("coalesce(date, '') <> '' AND issue_number IS NOT NULL").select("date", "issue_number", "title", "n_articles", "n_significant").orderBy("date")


def latest(editions: DataFrame, prefixes: list[str], default: str = "Latest edition") -> DataFrame:
    """The newest edition for readers: title without its prefix, trimmed dek."""
    return editions.orderBy(F.desc("date")).limit(1).select("date", T.blank_to(T.strip_first_prefix(F.coalesce("title", F.lit("")), prefixes), F.lit(default)).alias("title"), F.trim(F.coalesce("dek", F.lit(""))).alias("dek"))


def cover_paths(editions: DataFrame, base: str) -> DataFrame:
    """Cover, thumbnail and absolute address by date; all empty without one."""
    named = lambda head, tail: F.when(T.blank_to(F.col("date")) != "", F.concat(F.lit(head), "date", F.lit(tail))).otherwise("")
    return editions.withColumns({"cover_image": named("../covers/", ".png"), "cover_thumb": named("../covers/", "-thumb.png"), "cover_image_url": named(f"{base}/covers/", ".png")})


def media_label(raw: Column) -> Column:
    return V.lookup(MEDIA_LABELS, F.lower(F.trim(F.coalesce(raw, F.lit("")))), "Visual Context")


def split_media(media: Column, cover: Column) -> tuple[Column, Column]:
    """Media items that are not the cover, and the first that is: by path, address or file name."""
    name = lambda x: F.lower(F.element_at(F.split(F.coalesce(x, F.lit("")), "/"), -1))

    def is_cover(m):
        paths = F.array(m["src"], m["image_url"], m["source_url"])
        same = F.exists(paths, lambda p: F.coalesce((p == cover) | (T.canonical_url(p) == T.canonical_url(cover)) & (T.canonical_url(p) != "") | (name(p) == name(cover)), F.lit(False)))
        return F.coalesce((m["type"] == "image") & (F.coalesce(cover, F.lit("")) != "") & same, F.lit(False))

    return F.filter(media, lambda m: ~is_cover(m)), F.get(F.filter(media, is_cover), F.lit(0))


def visual_fields(entries: DataFrame) -> DataFrame:
    """Manifest entries with display fields and their defaults; fields that are not there count as missing."""
    has = lambda c: T.blank_to(F.col(c)) if c in entries.columns else F.lit("")
    defaults = {"treatment": "veil", "mask_focus": "", "subject": "", "alt": "", "credit": "", "source_page": "", "license": "", "license_url": "", "focal": "50% 50%"}
    out = {c: T.blank_to(has(c), F.lit(d)) for c, d in defaults.items()}
    return entries.withColumns(out | {"source_id": T.blank_to(has("source_id"), T.blank_to(has("license"), F.lit("SOURCE")))})


def required_kinds(routes: Column, treatment: Column) -> Column:
    """Derivatives that an entry needs, by its routes and treatment."""
    shown = F.arrays_overlap(routes, F.array(F.lit("home"), F.lit("article")))
    return F.array_compact(F.array(F.when(shown & (treatment == "dither"), "dither-ink").when(shown, "duo-paper"), F.when(F.array_contains(routes, "pw-post"), "duo-navy")))


def derivative_name(entry_id: Column, kind: Column) -> Column:
    """File name of a derivative; an unknown kind is an error."""
    known = F.when(kind.isin("duo-paper", "duo-navy"), ".jpg").when(kind == "dither-ink", ".png")
    return F.when(known.isNotNull(), F.concat(F.coalesce(entry_id, F.lit("")), F.lit("-"), kind, known)).otherwise(F.raise_error(F.concat(F.lit("unknown derivative: "), F.coalesce(kind, F.lit("null")))))


def by_edition(entries: DataFrame, editions: DataFrame, route: str, without: str | None = None) -> DataFrame:
    """For each edition date the first entry for the route that names it, another one than `without`."""
    named = entries.filter(F.array_contains("match.routes", route))
    named = named.filter(F.col("id") != without) if without else named
    first = named.select("id", "n", F.explode("match.editions").alias("date")).groupBy("date").agg(F.min_by("id", "n").alias("entry_id"))
    return editions.join(first, "date")


def previous_image(editions: DataFrame) -> DataFrame:
    """Editions (date, image) with the image of the edition before, null for the first. Editions are one a week, so one task orders them."""
    return editions.withColumn("previous_image", F.lag("image").over(Window.orderBy("date")))


def without_previous(candidates: DataFrame, editions: DataFrame) -> DataFrame:
    """Candidates (date, image) that the edition before theirs did not use."""
    used = previous_image(editions).filter("previous_image IS NOT NULL").select("date", F.col("previous_image").alias("image"))
    return candidates.join(used, ["date", "image"], "left_anti")


def first_acceptable(candidates: DataFrame, key: str, width: int = 800, height: int = 400) -> DataFrame:
    """The first candidate (by url_rank, then rank) of each key that is large enough."""
    large = candidates.filter((F.col("width") >= width) & (F.col("height") >= height))
    return large.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("url_rank", "rank"))).filter("_k = 1").drop("_k")


def photographs(candidates: DataFrame) -> DataFrame:
    """Candidates with an address and the MIME type of a photograph."""
    return candidates.filter(F.col("mime").isin(*PHOTO_MIME) & (T.blank_to(F.col("url")) != ""))


def image_reason(title: Column, about: Column) -> Column:
    """Why an image's title and description reject it for a text (both in lower case); null if nothing does."""
    has = lambda x, words: F.coalesce(x.rlike("|".join(words)), F.lit(False))
    return (
        F.when(has(title, VIOLENT), "sensational")
        .when(has(title, MAPS) & ~has(about, ABOUT_MAPS), "map")
        .when(has(title, EMBLEMS) & ~has(about, ABOUT_EMBLEMS), "emblem")
        .when(has(title, WEAPONS) & ~has(about, WEAPONS), "weapon")
    )


def best_image(scored: DataFrame, least: float = LEAST_SCORE, *key: str) -> DataFrame:
    """The candidate of the greatest score, if it is good enough, of each key, or of all without a key.

    Ties go to the title, then to the least of the other columns in turn, a null before all
    else. A score that is null or no number is never good enough; null keys are one key.
    """
    good = scored.filter((F.col("score") >= least) & ~F.isnan("score"))
    if not key:
        return good.orderBy(F.desc("score"), "title").limit(1)
    # a minimum is merged before rows are exchanged, so a key with very many candidates sends few
    rest = [c for c in scored.columns if c not in {*key, "score", "title"}]
    best = good.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "title", *rest)).alias("best"))
    own = {c: F.col("best")[c] for c in ("title", *rest)} | {c: F.col(c) for c in key} | {"score": -F.col("best.minus")}
    return best.select(*(own[c].alias(c) for c in scored.columns))


def first_query(hits: DataFrame, title: str) -> DataFrame:
    """The first query (n, query, titles) that found the title, else the first of all."""
    return hits.agg(F.coalesce(F.min_by("query", F.when(F.array_contains("titles", title), F.col("n"))), F.min_by("query", "n")).alias("query"))


def fallback(*sources: tuple[str, Column], default: str) -> Column:
    """struct<value, source> of the first source that has a value."""
    out = reduce(lambda a, s: a.when(T.blank_to(s[1]) != "", F.struct(s[1].alias("value"), F.lit(s[0]).alias("source"))), sources, F.when(F.lit(False), F.struct(F.lit("").alias("value"), F.lit("").alias("source"))))
    return out.otherwise(F.struct(F.lit(default).alias("value"), F.lit("default").alias("source")))


def fatal_error(status: Column, message: Column) -> Column:
    """An error of the account, not of the row: by status, or by words of the message; too many requests are not."""
    return F.coalesce(status.isin(*FATAL_STATUS), F.lit(False)) | F.coalesce(F.lower(message).rlike("|".join(FATAL_WORDS)), F.lit(False))


def retry_reason() -> Column:
    """What a row that passed the gate still lacks."""
    lacks = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return F.when(F.col("passed_relevance") & lacks("title_english"), "no translation").when(F.col("passed_relevance") & lacks("summary_english"), "no summary")


def joined_context(*parts: DataFrame) -> DataFrame:
    """One-row contexts side by side; a name that two of them have is an error."""
    names = [c for p in parts for c in p.columns]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"names given twice: {', '.join(twice)}")
    return reduce(lambda a, b: a.join(b.limit(1), F.lit(True)), parts[1:], parts[0].limit(1))


def tally(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def nested_strings(json: Column) -> Column:
    """Every string value of a JSON text, at any depth."""
    return F.regexp_extract_all(json, F.lit(r'(?:[:\[,]\s*)"((?:[^"\\]|\\.)*)"(?!\s*:)'), 1)


def to_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Names of files (name, modified) that the target lacks or has older."""
    return source.join(target.select("name", F.col("modified").alias("_m")), "name", "left").filter("_m IS NULL OR modified > _m").drop("_m")


def messages(template: str, **columns: Column) -> Column:
    """A prompt from a template with {name} fields; nulls are empty."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def write_editions(editions: DataFrame, path: str) -> None:
    """Editions as JSON, a folder for each date."""
    editions.write.mode("overwrite").partitionBy("date").json(path)


def sole_labels(categories: Column) -> Column:
    """Labels of categories, unknown ones as they are."""
    return F.transform(categories, lambda c: V.lookup(C.CATEGORY_LABELS, c, c))
