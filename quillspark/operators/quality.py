"""Lints and data-quality rules; each rule gives rows (level, rule, key, message)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from . import editions as E


def _findings(*checks: Column) -> Column:
    """The messages of checks that fired, as an array."""
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), F.lit(1))


def lint_summary(title: Column, summary: Column) -> Column:
    """Findings on a summary: openers, phrases, crutches, length, a restated headline, a long first sentence."""
    # runs of what stays are put together: replacing all else took eight times as long
    kept = lambda low: F.array_join(F.regexp_extract_all(low, F.lit("[a-z0-9 ]+"), 0), "")
    plain = lambda low: F.filter(F.split(kept(low), " +"), lambda w: w != "")

    def findings(x: Column) -> Column:
        low, head, n_words, n_sentences = x["low"], x["head"], x["n_words"], F.size(x["sentences"])
        opener = reduce(lambda a, o: a.when(low.startswith(o), F.lit(f"banned opener: {o}")), C.BANNED_OPENERS, F.when(F.lit(False), F.lit("")))
        checks = [opener]
        checks += [F.when(F.contains(low, F.lit(p)), F.lit(f"banned phrase: {p}")) for p in C.BANNED_PHRASES]
        checks += [F.when(F.contains(low, F.lit(p)), F.lit(f"crutch construction: {p}")) for p in C.CRUTCHES]
        checks += [
            F.when(n_sentences > C.MAX_SENTENCES, F.format_string("%d sentences (max %d)", n_sentences, F.lit(C.MAX_SENTENCES))),
            F.when(n_words > C.MAX_WORDS, F.format_string("%d words", n_words)),
            F.when((F.size(head) >= 8) & (F.slice(plain(low), F.lit(1), F.greatest(F.size(head), F.lit(1))) == head), F.lit("summary opens by restating the headline")),
            F.when(F.length(F.try_element_at(x["sentences"], F.lit(1))) > C.EXCERPT, F.lit("first sentence exceeds the card excerpt")),
        ]
        return _findings(*checks)

    # a collapsed text has one blank between words
    parts = lambda s: F.struct(F.lower(s).alias("low"), plain(F.lower(F.coalesce(title, F.lit("")))).alias("head"), T.sentences(s).alias("sentences"), F.size(F.split(s, " ")).alias("n_words"))
    return _once(T.collapse(summary), lambda s: F.when(s == "", F.array(F.lit("empty summary"))).otherwise(_once(parts(s), findings)))


def prose_warnings(df: DataFrame, key: str, fields=C.PROSE_FIELDS) -> DataFrame:
    """One row per warning on an edition's prose: dashes, transitions, repeated 'not ... but'."""
    checks = []
    for f in fields:
        x = F.coalesce(F.col(f).cast("string"), F.lit(""))
        checks.append(F.when(x.rlike("—|--"), F.lit(f"{f}: dash")))
        checks += [F.when(F.lower(x).rlike(rf"\b{t}\b"), F.lit(f"{f}: transition {t}")) for t in C.BANNED_TRANSITIONS]
        checks.append(F.when(T.prose_gaps(x) >= 2, F.format_string(f"{f}: %d times not X but Y", T.prose_gaps(x))))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(_findings(*checks)).alias("message")).select(F.lit("warning").alias("level"), F.lit("prose").alias("rule"), "key", "message")


def finding(df: DataFrame, bad: Column, level: str, rule: str, key: str, message: str) -> DataFrame:
    """Rows where the rule is broken; an unknown outcome counts as broken."""
    return df.filter(F.coalesce(bad, F.lit(True))).select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(message).alias("message"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def unrendered(files: DataFrame) -> DataFrame:
    """Files (path, value) with template markers left, and the first line of one."""
    marker = r"\{\{|\}\}|\{%|%\}"
    return files.filter(F.col("value").rlike(marker)).select(F.lit("error").alias("level"), F.lit("template_marker").alias("rule"), F.col("path").alias("key"), F.concat(F.lit("line "), T.first_line_with(F.col("value"), marker).cast("string")).alias("message"))


def record_rules(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Published records (id, date, summary, article_path) against the files (path) that exist."""
    dated = records.filter(~_blank("date"))
    return reduce(DataFrame.unionByName, [
        finding(records.join(paths.select(F.col("path").alias("article_path")), "article_path", "left_anti"), F.lit(True), "error", "missing_page", "id", "article page is missing"),
        finding(dated, D.strict(F.col("date")).isNull(), "error", "bad_date", "id", "date is malformed"),
        finding(records, _blank("date"), "warning", "blank_date", "id", "date is blank"),
        finding(records, _blank("summary"), "error", "blank_summary", "id", "summary is blank"),
        finding(records.groupBy("id").count(), F.col("count") > 1, "error", "duplicate_id", "id", "id is not unique"),
    ])


def missing_fields(fields=C.REQUIRED_FIELDS, numbers: tuple[str, ...] = ()) -> Column:
    """Names of required fields that are missing: null or empty text; a number is missing only if null."""
    return _findings(*(F.when(_blank(f), F.lit(f)) for f in fields), *(F.when(F.col(f).isNull(), F.lit(f)) for f in numbers))


def edition_rules(e: DataFrame) -> DataFrame:
    """Editions (date, week_start, week_ending, file_date, counts, trail, type, number) against their rules."""
    trail = F.coalesce(F.col("source_trail"), F.array().cast(e.schema["source_trail"].dataType))
    flagged = F.coalesce(F.exists(trail, lambda t: F.coalesce(t["is_significant"], F.lit(False))), F.lit(False))
    undated = F.size(F.filter(trail, lambda t: F.coalesce(t["date"], F.lit("")) == ""))
    outside = F.size(F.filter(trail, lambda t: (F.coalesce(t["date"], F.lit("")) != "") & ~t["date"].between(F.col("week_start"), F.col("week_ending"))))
    incomplete = F.exists(trail, lambda t: (F.coalesce(t["title"], F.lit("")) == "") | (F.coalesce(t["url"], F.lit("")) == "") | (F.coalesce(t["source"], F.lit("")) == ""))
    at = Window.orderBy("date")
    ordered = e.withColumn("_before", F.lag("issue_number").over(at)).withColumn("_gap", F.datediff(D.strict(F.col("date")), D.strict(F.lag("date").over(at))))
    missing = e.select("date", F.explode(missing_fields(numbers=("n_articles", "n_significant"))).alias("f")).select(F.lit("error").alias("level"), F.lit("required_field").alias("rule"), F.col("date").alias("key"), F.concat(F.lit("missing: "), F.col("f")).alias("message"))
    return reduce(DataFrame.unionByName, [
        missing,
        finding(e, (F.col("file_date") != F.col("date")) | (F.col("date") != F.col("week_ending")), "error", "edition_date", "date", "file name, date and week ending differ"),
        finding(e, F.datediff(D.strict(F.col("week_ending")), D.strict(F.col("week_start"))) != 6, "error", "week_span", "date", "the week is not 7 days"),
        finding(e, F.col("n_significant") > F.col("n_articles"), "error", "flag_count", "date", "more flagged than articles"),
        finding(e, F.size(trail) > F.col("n_articles"), "error", "trail_size", "date", "trail is longer than the articles"),
        finding(e, incomplete, "error", "trail_entry", "date", "a trail entry lacks title, url or source"),
        finding(e, undated > 0, "warning", "trail_undated", "date", "undated trail entries"),
        finding(e, outside > 0, "warning", "trail_outside", "date", "trail entries outside the week"),
        finding(e, (F.col("n_significant") > 0) & ~flagged, "warning", "trail_flag", "date", "flagged articles but no flagged trail entry"),
        finding(e, ~F.col("edition_type").isin("significant", "routine"), "error", "edition_type", "date", "unknown edition type"),
        finding(e.groupBy("issue_number").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("date")), (F.col("n") > 1) | F.col("issue_number").isNull(), "error", "issue_unique", "date", "issue number missing or repeated"),
        finding(ordered.filter("_before IS NOT NULL"), F.col("issue_number") <= F.col("_before"), "error", "issue_order", "date", "issue numbers fall"),
        finding(ordered.filter("_gap IS NOT NULL"), F.col("_gap") != 7, "warning", "cadence", "date", "editions are not a week apart"),
    ])


def site_rules(files: DataFrame, editions: DataFrame, pages=("index.html", "archive.html", "terms.html", "feed.xml"), prose=C.PROSE_FIELDS) -> DataFrame:
    """A built site (files: path, value) against its editions (date and the prose fields).

    The index has to be there and not blank; articles.json has to be a list; every edition needs
    some prose, a companion text, and a link on each of the pages; the feed has an entry for each.
    Links are joined as rows, so a page of any length is broadcast to no task; a link names a
    file, of 255 characters at most.
    """
    # names between "editions/" and the next ".html"; the look-ahead takes nothing, so names may overlap
    linked = lambda p: files.filter(F.col("path") == p).select(F.explode(F.regexp_extract_all("value", F.lit(r"editions/(?=((?s:.{0,255}?))\.html)"), 1)).alias("_linked"))
    told = lambda rule, key, message: [F.lit("error").alias("level"), F.lit(rule).alias("rule"), key.alias("key"), F.lit(message).alias("message")]
    name = F.concat(F.lit("editions/"), F.col("date"))
    whole = lambda p, ok: files.agg(F.coalesce(F.max(F.when(F.col("path") == p, ok)), F.lit(False)).alias("ok")).filter("NOT ok")
    found = [
        whole("index.html", F.trim("value") != "").select(*told("index", F.lit("index.html"), "the index is missing or empty")),
        whole("articles.json", F.json_array_length("value").isNotNull()).select(*told("articles_json", F.lit("articles.json"), "not a list")),
        editions.filter(reduce(lambda a, f: a & _blank(f), prose, F.lit(True))).select(*told("no_body", F.col("date"), "no prose at all")),
        editions.withColumn("path", F.concat(name, F.lit(".txt"))).join(files.select("path"), "path", "left_anti").select(*told("companion", F.col("date"), "companion text is missing")),
        *(editions.join(linked(p), F.col("date") == F.col("_linked"), "left_anti").select(*told("unlinked", F.concat(F.lit(f"{p}:"), "date"), "the page does not link the edition")) for p in pages),
    ]
    entries = files.agg(F.coalesce(F.max(F.when(F.col("path") == "feed.xml", F.regexp_count("value", F.lit("<entry>")))), F.lit(0)).alias("n"))
    found.append(entries.crossJoin(F.broadcast(editions.agg(F.count(F.lit(1)).alias("m")))).filter("n <> m").select(*told("feed_count", F.lit("feed.xml"), "entries and editions differ")))  # one row each
    return reduce(DataFrame.unionByName, found)


# Markup of editorial images on published pages, and patterns that templates gave up.
ASSET_REF = r"""[^"'()\s]*assets/editorial/[^"'()\s]+"""
ASSET_TAG = r"""<[^>]*data-editorial-id="([^"]+)"[^>]*>"""
ASSET_LABEL = r"""aria-label="[^"]+\""""
RETIRED = ('class="lead-figure"', "hero-figure", "issue-cover-thumb", 'class="cover-figure"', "entry-thumb")


def resolved(path: Column, ref: Column) -> Column:
    """A reference on the page at path as a path from the root; steps above the root end at it."""
    parts = F.split(F.concat(F.regexp_extract(path, "^(?:.*/)?", 0), ref), "/")
    step = lambda at, p: F.when(p.isin("", "."), at).when(p == "..", F.when(F.size(at) > 1, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(F.array().cast("array<string>"))).otherwise(F.array_append(at, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def asset_rules(manifest: DataFrame, site: DataFrame, built: DataFrame, pages: DataFrame) -> DataFrame:
    """Editorial images: manifest entries (id, file, source_page, treatment, match), files (path) of the site and of the built folder, built pages (path, value).

    Derivatives that an entry needs are on both sides and its file is built; what pages refer
    to is there; an element names an entry, links its source, has a label and stands on a page
    that says "not evidence"; an article's page shows one of the entry's URLs; no page has a
    pattern that was given up.
    """
    told = lambda rule, key, message: [F.lit("error").alias("level"), F.lit(rule).alias("rule"), key.alias("key"), F.lit(message).alias("message")]
    routes = F.coalesce(F.col("match.routes"), F.array().cast("array<string>"))
    needed = manifest.select("id", F.explode(E.required_kinds(routes, F.coalesce("treatment", F.lit("")))).alias("kind")).select(F.concat(F.lit("assets/editorial/derivatives/"), E.derivative_name(F.col("id"), F.col("kind"))).alias("path"))
    files = manifest.filter((F.size(routes) > 0) & ~_blank("file")).select(F.concat(F.lit("assets/editorial/"), "file").alias("path"))
    lost = lambda df, there, rule, message: df.distinct().join(there.select("path"), "path", "left_anti").select(*told(rule, F.col("path"), message))
    refs = pages.select(F.col("path").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(ASSET_REF), 0))).alias("ref"))
    refs = refs.withColumn("path", resolved(F.col("page"), F.col("ref"))).join(built.select("path"), "path", "left_anti")
    tags = pages.select("path", "value", F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(ASSET_TAG), 0).alias("tag"), F.regexp_extract_all("value", F.lit(ASSET_TAG), 1).alias("id"))).alias("t"))
    entries = manifest.select(F.col("id").alias("entry"), F.coalesce("source_page", F.lit("")).alias("source_page"), F.coalesce("match.article_urls", F.array().cast("array<string>")).alias("urls"))
    seen = tags.join(entries, F.col("t.id") == F.col("entry"), "left")
    at = F.concat_ws(":", "path", "t.id")
    bad = lambda cond, rule, message: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message")))
    known = F.col("entry").isNotNull()
    found = _findings(
        bad(~known, "asset_unknown", "element is not in the manifest"),
        bad(known & ~F.contains("value", F.col("source_page")), "asset_credit", "no link to the source"),
        bad(known & ~F.col("t.tag").rlike(ASSET_LABEL), "asset_label", "no label"),
        bad(known & ~F.contains(F.lower("value"), F.lit("not evidence")), "asset_context", "the page does not say that it is not evidence"),
        bad(known & F.col("path").startswith("article/") & (F.size("urls") > 0) & ~F.exists("urls", lambda u: F.contains("value", u)), "asset_article", "none of the entry's URLs is on the page"),
    )
    retired = pages.select("path", F.explode(F.array(*map(F.lit, RETIRED))).alias("p"), "value").filter(F.contains("value", F.col("p")))
    return reduce(DataFrame.unionByName, [
        lost(needed, site, "derivative_site", "a derivative is missing on the site's side"),
        lost(needed, built, "derivative_built", "a derivative is missing in the build"),
        lost(files, built, "asset_file", "the image is missing in the build"),
        refs.select(*told("asset_ref", F.concat_ws(":", "page", "ref"), "refers to a missing asset")),
        seen.select(F.explode(found).alias("f"), at.alias("key")).select(F.lit("error").alias("level"), "f.rule", "key", "f.message"),
        retired.select(*told("asset_retired", F.concat_ws(":", "path", "p"), "a pattern that was given up")),
    ])


def pairing(a: DataFrame, b: DataFrame, key: str, rule: str, level: str = "error") -> DataFrame:
    """Keys that only one side has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    one = finding(left.join(right, key, "left_anti"), F.lit(True), level, rule, key, "only on the left")
    return one.unionByName(finding(right.join(left, key, "left_anti"), F.lit(True), level, rule, key, "only on the right"))


def taxonomy(used: DataFrame, slugs=tuple(C.CATEGORY_LABELS)) -> DataFrame:
    """Categories used that the taxonomy lacks."""
    return finding(used.select(F.explode("categories").alias("slug")).distinct(), ~F.col("slug").isin(*slugs), "error", "taxonomy", "slug", "not in the taxonomy")


def blocks(findings: DataFrame) -> bool:
    """Whether an error stops publication."""
    return bool(findings.filter("level = 'error'").limit(1).count())
