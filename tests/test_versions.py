import threading

import pytest
from pyspark.sql import functions as F

from quillspark.plans import versions
from quillspark.plans.versions import Conflict, Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_read_by_number(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    assert s.latest() == 0 and s.versions() == [] and not s.has("a")
    assert s.commit({"a": spark.createDataFrame([(1, "x")], "id long, v string"), "b": spark.range(2)}) == 1
    # a table may be made from what it replaces, and others stay
    assert s.commit({"a": s.read("a").withColumn("v", F.upper("v"))}, notes={"why": "upper"}) == 2
    assert s.commit(append={"a": spark.createDataFrame([(2, None)], "id long, v string")}) == 3
    assert rows(s.read("a", 1)) == [(1, "x")] and rows(s.read("a", 2)) == [(1, "X")] and sorted(r[0] for r in s.read("a").collect()) == [1, 2]
    assert rows(s.read("b")) == [(0,), (1,)] and s.entry(2)["notes"] == {"why": "upper"}
    assert s.rollback(1) == 4 and rows(s.read("a")) == [(1, "x")]
    assert s.forget(2) == 0  # version 3 stands on the folders of version 2
    assert s.versions() == [3, 4] and sorted(r[0] for r in s.read("a", 3).collect()) == [1, 2]
    assert s.forget(1) == 2 and rows(s.read("a")) == [(1, "x")]
    with pytest.raises(KeyError):
        s.read("none")


def test_a_commit_that_fails_at_any_step_leaves_no_trace(spark, tmp_path, monkeypatch):
    s = Store(spark, f"{tmp_path}/s")
    s.commit({"articles": spark.createDataFrame([(1,)], "id long"), "links": spark.createDataFrame([(1, 7)], "article_id long, category_id long")})
    good = {"articles": spark.createDataFrame([(1,), (2,)], "id long"), "links": spark.createDataFrame([(2, 7)], "article_id long, category_id long")}
    fails = F.udf(lambda x: 1 / 0, "long")
    steps = [
        dict(tables={"articles": spark.range(1).select(fails("id").alias("id")), "links": good["links"]}),
        dict(tables={"articles": good["articles"], "links": spark.range(1).select(fails("id").alias("article_id"), F.lit(1).cast("long").alias("category_id"))}),
        dict(tables=good, append={"links": spark.range(1).select(fails("id").alias("article_id"), F.lit(1).cast("long").alias("category_id"))}),
        dict(tables=good, append={"articles": spark.range(1).select("id", F.lit(1).alias("more"))}),
        dict(tables=good | {"links": spark.createDataFrame([(9, 7)], "article_id long, category_id long")}, keys=[("links", "article_id", "articles", "id")]),
        dict(tables=good, check=lambda t: 1 / 0),
        dict(tables=good, parent=0),
    ]
    for step in steps:
        with pytest.raises(Exception):
            s.commit(**step)
        assert s.latest() == 1 and rows(s.read("articles")) == [(1,)] and rows(s.read("links")) == [(1, 7)]
    # the file of the version can't be put down
    monkeypatch.setattr(versions.Store, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.commit(good)
    monkeypatch.undo()
    assert s.latest() == 1 and s.forget(5) == 0  # nothing is left over
    assert s.commit(good, keys=[("links", "article_id", "articles", "id")]) == 2 and rows(s.read("links")) == [(2, 7)]


def test_one_of_two_writers_wins(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.commit({"a": spark.range(1)})
    seen, start = [], threading.Barrier(2)

    def write(n):
        start.wait()
        try:
            seen.append(("won", s.commit({"a": spark.range(n)}, parent=1)))
        except Conflict:
            seen.append(("lost", None))

    both = [threading.Thread(target=write, args=(n,)) for n in (3, 4)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(seen, key=str) == [("lost", None), ("won", 2)] and s.read("a").count() in (3, 4)
