import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.functions import variants
from quillspark.plans import files
from quillspark.sources import anchors

DOCS = [
    (1, '{"a": {"b c": ["x", {"d": "y"}, null, 1, true]}, "e.f": "", "g": "z"}'), (2, '"alone"'), (3, '[[[["deep"]]]]'),
    (4, None), (5, "no json"), (6, "{}"), (None, '["n"]'), (1, '["again"]'), (7, '[1, 2.5, false]'),
]


def walk(value, path="$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"')
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_strings_at_any_depth(spark):
    df = spark.createDataFrame([(*d, "x") for d in DOCS], "id long, doc string, path string")
    want = [(i, *x) for i, d in DOCS if d and d != "no json" for x in walk(json.loads(d))]
    assert sorted(map(tuple, variants.strings(df, "id", "doc").collect()), key=repr) == sorted(want, key=repr)
    assert variants.strings(df.limit(0), "id", "doc").count() == 0
    with pytest.raises(ValueError):
        variants.strings(df, "id", "doc", most=2)


SCHEMA = {
    "type": "object", "required": ["score", "tags"], "additionalProperties": False,
    "properties": {
        "score": {"type": "number", "minimum": 0, "maximum": 1}, "n": {"type": "integer"}, "why": {"type": ["string", "null"], "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"},
        "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "enum": ["a", "b"]}}, "in": {"type": "object", "properties": {"k": {"const": 7}}, "required": ["k"]},
    },
}
CASES = [
    ('{"score": 0.5, "tags": ["a"], "n": 3, "why": null, "in": {"k": 7}}', []),
    ('{"score": 1, "tags": ["a", "b"], "n": 3.0, "why": "abc"}', []),
    ('{"score": 2, "tags": []}', [("$.score", "maximum"), ("$.tags", "minItems")]),
    ('{"score": "high", "tags": ["a", "c", 1]}', [("$.score", "type"), ("$.tags", "maxItems"), ("$.tags[1]", "enum"), ("$.tags[2]", "type")]),
    ('{"tags": null, "n": 1.5, "why": "A", "x y": 1}', [("$.score", "required"), ("$.tags", "type"), ("$.n", "type"), ("$.why", "minLength"), ("$.why", "pattern"), ('$."x y"', "additionalProperties")]),
    ('{"score": -1, "tags": ["b"], "in": {}, "why": "abcde"}', [("$.score", "minimum"), ("$.in.k", "required"), ("$.why", "maxLength")]),
    ('{"score": 0, "tags": ["b"], "in": {"k": 8}}', [("$.in.k", "const")]),
    ("[]", [("$", "type")]), ("null", [("$", "type")]), ("nope", [("$", "json")]), (None, [("$", "json")]),
]


def test_schema_documents_become_checks(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "id long, doc string, rule string")
    got = {}
    for r in variants.check(df, "id", "doc", SCHEMA).collect():
        got.setdefault(r["id"], []).append((r["path"], r["rule"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(c[1]) for i, c in enumerate(CASES) if c[1]}
    assert variants.check(df.limit(0), "id", "doc", SCHEMA).count() == 0
    with pytest.raises(ValueError):
        variants.findings({"type": "object", "properties": {"a": {"oneOf": []}}}, F.lit(1))


def test_schemas_of_the_calls(spark):
    good = {"relevance": {"score": 0.6, "reasoning": "r"}, "translation": {"title_en": "t", "body_en": "b"}, "summary": {"summary": "s"}, "categories": {"categories": ["taiwan"], "significance": True, "significance_reason": None}}
    for name, doc in good.items():
        df = spark.createDataFrame([(0, json.dumps(doc)), *((i + 1, json.dumps({k: v for k, v in doc.items() if k != lost})) for i, lost in enumerate(doc))], "id long, doc string")
        assert sorted((r["id"], r["rule"]) for r in variants.check(df, "id", "doc", variants.SCHEMAS[name]).collect()) == [(i + 1, "required") for i in range(len(doc))]
    df = spark.createDataFrame([(0, '{"categories": ["none such"], "significance": "yes", "significance_reason": 1}')], "id long, doc string")
    assert sorted(r["path"] for r in variants.check(df, "id", "doc", variants.SCHEMAS["categories"]).collect()) == ["$.categories[0]", "$.significance", "$.significance_reason"]


def test_anchors_called_laterally(spark):
    anchors.register(spark)
    pages = spark.createDataFrame([(1, "http://h/a/b", "<a href='c'>x <b>y</b>\n z</a><a>no</a><a href=''>no</a><a href='/d'></a>"), (2, None, "<a href='e'>t</a>"), (3, "u", None), (4, "u", "")], "id long, url string, html string")
    got = spark.sql("SELECT id, a.* FROM {p}, LATERAL anchors(html, url, true) a", p=pages).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "http://h/a/c", "x y z"), (1, 1, "http://h/d", ""), (2, 0, "e", "t")]
    assert spark.sql("SELECT a.* FROM {p}, LATERAL anchors(html, url) a", p=pages).columns == ["n", "href"]
    with pytest.raises(Exception, match="has to be a string"):
        spark.sql("SELECT * FROM anchors(1, 'u')")


def test_files_are_whole_whatever_attempts_there_were(spark, tmp_path):
    out = str(tmp_path / "site")
    rows = spark.createDataFrame([(f"articles/{i}.html", f"page {i} ü" * 50, i) for i in range(30)] + [("top.html", None, 0)], "name string, content string, bytes int").repartition(3)
    lost = files.staged(rows, f"file:{out}").collect()  # an attempt whose report never counted
    assert len(lost) == 31 and files.existing(spark, out).count() == 0
    first = {r["name"]: r["sha256"] for r in files.write_files(rows, out, prune="articles").collect()}
    assert len(first) == 31 and not os.path.exists(f"{out}/_attempts")
    assert open(f"{out}/articles/7.html").read() == "page 7 ü" * 50 and open(f"{out}/top.html").read() == ""
    # a move that is done twice, and one whose file is gone
    wrote = files.cut(files.staged(rows.filter("name = 'top.html'"), f"file:{out}"))
    assert files.moved(wrote, f"file:{out}").count() == files.moved(wrote, f"file:{out}").count() == 1
    # fewer rows: orphans of the folder go, files elsewhere stay
    files.write_files(rows.filter("bytes < 10 AND name <> 'top.html'").withColumn("content", F.lit("new")), out, prune="articles")
    assert sorted(r["name"] for r in files.existing(spark, out).collect()) == sorted([*(f"articles/{i}.html" for i in range(10)), "top.html"])
    assert open(f"{out}/articles/7.html").read() == "new"
    for bad in ([("a", "x"), ("a", "y")], [(None, "x")], [("../a", "x")], [("/a", "x")]):
        with pytest.raises(ValueError):
            files.write_files(spark.createDataFrame(bad, "name string, content string"), out)
    assert files.write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path / "none"), prune="").count() == 0
