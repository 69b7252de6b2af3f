"""Numbers, JSON and constant look-ups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def clamp01(x: Column) -> Column:
    """x held to 0 to 1; null stays null, so a row without a score never looks rejected."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def lookup(table: dict, key: Column, default) -> Column:
    """The value of a constant table, or the default."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(known, key), default if isinstance(default, Column) else F.lit(default))


def category_priority(categories: Column) -> Column:
    """Least priority number among the categories; 99 if there are none."""
    return F.coalesce(F.array_min(F.transform(categories, lambda c: lookup(C.CATEGORY_PRIORITY, c, C.NO_PRIORITY))), F.lit(C.NO_PRIORITY))


def lead_category(categories: Column) -> Column:
    """The category of least priority number, the first of equals; empty if there are none."""
    ranked = F.transform(categories, lambda c, i: F.struct(lookup(C.CATEGORY_PRIORITY, c, C.NO_PRIORITY).alias("p"), i.alias("i"), c.alias("c")))
    return F.coalesce(F.array_min(ranked)["c"], F.lit(""))


def cost(chars: Column, model: str, prices: dict = C.PRICES, ratio: float = C.OUTPUT_RATIO) -> Column:
    """struct<input_tokens, output_tokens, input_usd, output_usd, total_usd>; a model without a price raises KeyError."""
    per_in, per_out = prices[model]
    tokens = chars.cast("double")
    out = tokens * ratio
    a, b = tokens / 1e6 * per_in, out / 1e6 * per_out
    return F.struct(tokens.cast("long").alias("input_tokens"), out.cast("long").alias("output_tokens"), a.alias("input_usd"), b.alias("output_usd"), (a + b).alias("total_usd"))


def reply_json(x: Column, schema: str) -> Column:
    """A model's reply as a struct: without code fences, or from the first brace to the last; raw newlines in strings will do."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    body = F.when(bare.startswith("{"), bare).otherwise(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    return F.from_json(body, schema, {"allowUnquotedControlChars": "true"})


def license_allowed(short: Column, field: Column) -> Column:
    """Denied words win, then an allowed licence must be named; empty is not allowed."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(short, F.lit("")), F.coalesce(field, F.lit(""))))
    deny = "|".join([*(rf"\b{w}\b" for w in C.REJECTED_LICENSE_WORDS), *C.REJECTED_LICENSES])
    allow = "|".join(x.replace(".", r"\.") for x in C.ALLOWED_LICENSES)
    return (F.trim(blob) != "") & ~blob.rlike(deny) & blob.rlike(allow)


def resized(width: Column, height: Column, most: int) -> Column:
    """struct<width, height> after an image wider than `most` shrinks to it in proportion, heights cut to whole pixels."""
    wide = width > most
    return F.struct(F.when(wide, F.lit(most)).otherwise(width).cast("int").alias("width"), F.when(wide, F.floor(height * most / width)).otherwise(height).cast("int").alias("height"))
