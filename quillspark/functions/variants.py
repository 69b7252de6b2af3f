"""Nested values as VARIANT: every string with its path, and checks made from a JSON Schema document."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut

FINDING = "array<struct<path:string,rule:string,message:string>>"
#: What the schema of a variant begins with, and the JSON type that it stands for.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number; null for what is not there."""
    s = F.schema_of_variant(v)
    out = F.when(s.rlike("^(TINYINT|SMALLINT|INT|BIGINT)$"), "integer").when(s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
    for start, name in KINDS.items():
        out = out.when(s.startswith(start), name)
    return out.when(s.isNotNull(), "number")


def step(path: Column, key: Column) -> Column:
    """The path of a field: plain names after a dot, others in quotes."""
    return F.concat(path, F.lit("."), F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(F.concat(F.lit('"'), key, F.lit('"'))))


def strings(rows: DataFrame, key: str, column: str, most: int = 100) -> DataFrame:
    """key, path and value of every string at any depth of a JSON text column.

    One level is opened at a time, all rows at once: what holds more goes to the next level,
    so the work is the size of the values and the rounds are their depth (an error beyond
    `most`). Texts that are null or not JSON have no strings; a key that is null or repeated
    stands for each of its rows; fields of one name each count.
    """
    left = cut(rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).filter("v IS NOT NULL").withColumn("kind", kind(F.col("v"))))
    found = None
    for _ in range(most):
        here = left.filter("kind = 'string'").select("key", "path", F.variant_get("v", "$", "string").alias("value"))
        found = here if found is None else found.unionByName(here)
        left = left.filter("kind IN ('object', 'array')")
        if not left.limit(1).count():
            return found.select(F.col("key").alias(key), "path", "value")
        inner = left.alias("l").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("l.v").outer()).alias("x"))
        path = F.when(F.col("l.kind") == "array", F.concat(F.col("l.path"), F.lit("["), F.col("x.pos").cast("string"), F.lit("]"))).otherwise(step(F.col("l.path"), F.col("x.key")))
        left = inner.select(F.col("l.key").alias("key"), path.alias("path"), F.col("x.value").alias("v"))
        left = cut(left.withColumn("kind", kind(F.col("v"))).filter("kind IN ('object', 'array', 'string')"))
    raise ValueError(f"values nest deeper than {most} levels")


def _one(broken: Column, path: Column, rule: str, message) -> Column:
    message = message if isinstance(message, Column) else F.lit(message)
    return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), message.alias("message")))).otherwise(F.array()).cast(FINDING)


def _field(name: str) -> str:
    return "$[" + json.dumps(name) + "]"


def findings(schema: dict, v: Column, path: Column | None = None) -> Column:
    """Every violation of a JSON Schema document by a variant: path, rule and message.

    Compiled into built-in expressions. Known: type (one or several), enum, const, minimum, maximum,
    minLength, maxLength, pattern, properties, required, additionalProperties (false), items,
    minItems, maxItems; any other rule but title, description, default is an error, so that
    none is silently left out. A value of the wrong type is looked into no further.
    """
    unknown = set(schema) - {"type", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "pattern", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "title", "description", "default"}
    if unknown:
        raise ValueError(f"rules that are not known: {', '.join(sorted(unknown))}")
    path = F.lit("$") if path is None else path
    k = kind(v)
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
    fits = k.isin(*types, *(["integer"] if "number" in types else [])) | ((k == "number") & (number == F.floor(number)) if "integer" in types else F.lit(False))
    is_text, is_number, is_object, is_array = k == "string", k.isin("integer", "number"), k == "object", k == "array"
    parts = []
    for rule in ("enum", "const"):
        if rule in schema:
            allowed = schema[rule] if rule == "enum" else [schema[rule]]
            parts.append(_one(~F.to_json(v).isin(*(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in allowed)), path, rule, F.concat(F.to_json(v), F.lit(" is not allowed"))))
    for rule, broken, word in (("minimum", lambda n: number < n, "below"), ("maximum", lambda n: number > n, "above")):
        if rule in schema:
            parts.append(_one(is_number & broken(schema[rule]), path, rule, F.concat(F.to_json(v), F.lit(f" is {word} {schema[rule]}"))))
    for rule, broken, word in (("minLength", lambda n: F.length(text) < n, "shorter"), ("maxLength", lambda n: F.length(text) > n, "longer")):
        if rule in schema:
            parts.append(_one(is_text & broken(schema[rule]), path, rule, f"is {word} than {schema[rule]} characters"))
    if "pattern" in schema:
        parts.append(_one(is_text & ~text.rlike(schema["pattern"]), path, "pattern", f"does not match {schema['pattern']}"))
    for name in schema.get("required", []):
        parts.append(_one(is_object & F.try_variant_get(v, _field(name), "variant").isNull(), step(path, F.lit(name)), "required", "is missing"))
    for name, inner in schema.get("properties", {}).items():
        child = F.try_variant_get(v, _field(name), "variant")
        parts.append(F.when(is_object & child.isNotNull(), findings(inner, child, step(path, F.lit(name)))).otherwise(F.array().cast(FINDING)))
    if schema.get("additionalProperties") is False:
        more = F.filter(F.json_object_keys(F.when(is_object, F.to_json(v))), lambda x: ~x.isin(*(schema.get("properties") or {"": 0})))
        parts.append(F.coalesce(F.transform(more, lambda x: F.struct(step(path, x).alias("path"), F.lit("additionalProperties").alias("rule"), F.lit("is not a field of this object").alias("message"))).cast(FINDING), F.array().cast(FINDING)))
    if {"items", "minItems", "maxItems"} & set(schema):
        items = F.when(is_array, F.try_variant_get(v, "$", "array<variant>"))
        if "items" in schema:
            at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            parts.append(F.coalesce(F.flatten(F.transform(items, lambda x, i: findings(schema["items"], x, at(i)))), F.array().cast(FINDING)))
        for rule, broken, word in (("minItems", lambda n: F.size(items) < n, "fewer"), ("maxItems", lambda n: F.size(items) > n, "more")):
            if rule in schema:
                parts.append(_one(is_array & broken(schema[rule]), path, rule, f"has {word} than {schema[rule]} items"))
    rest = F.concat(*parts) if parts else F.array().cast(FINDING)
    if not types:
        return rest
    return F.when(fits, rest).otherwise(_one(k.isNotNull(), path, "type", F.concat(F.lit("is "), k, F.lit(f", not {' or '.join(types)}"))))


def check(rows: DataFrame, key: str, column: str, schema: dict) -> DataFrame:
    """key, path, rule and message of every violation in a JSON text column; a text that is null or not JSON is one of its own."""
    v = F.try_parse_json(F.col(column))
    found = F.when(v.isNull(), _one(F.lit(True), F.lit("$"), "json", "is no JSON")).otherwise(findings(schema, v))
    return rows.select(F.col(key).alias(key), F.inline(found))


def _object(required: dict, **more: dict) -> dict:
    return {"type": "object", "properties": {**required, **more}, "required": list(required)}


_TEXT = {"type": "string"}
_EDITION = (
    "title", "dek", "opening_note", "what_stood_out", "why_it_matters", "what_was_routine", "term_to_know_term", "term_to_know_explanation",
    "what_im_watching_next", "edition_type", "linkedin_version",
)
#: What analysis calls answer, and what an edition has to hold.
SCHEMAS = {
    "relevance": _object({"score": {"type": "number", "minimum": 0.0, "maximum": 1.0}, "reasoning": _TEXT}),
    "translation": _object({"title_en": _TEXT, "body_en": _TEXT}),
    "summary": _object({"summary": _TEXT}),
    "edition": _object({name: _TEXT | ({"enum": ["significant", "routine"]} if name == "edition_type" else {}) for name in _EDITION}, signal=_TEXT),
    "categories": _object({"categories": {"type": "array", "items": {"type": "string", "enum": sorted(C.CATEGORY_LABELS)}}, "significance": {"type": "boolean"}, "significance_reason": {"type": ["string", "null"]}}),
}
