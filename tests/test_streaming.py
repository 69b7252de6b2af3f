import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import rollup
from quillspark.plans import versions
from quillspark.plans.versions import Store
from quillspark.streaming import incremental, rolling

SCHEMA = "ord long, url string, source_slug string, title_original string, text_original string, published_date string"
SF = "/root/testdata/sf0.001"


def files(spark, parts):
    """Documents of the smallest tables, many of them under shared URLs, dealt into files."""
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rng = random.Random(parts)
    rows = [{"ord": 0, "url": f"http://x/yw_208727/{i % 150}.html" if i % 9 else None, "source_slug": "s", "title_original": f"T{i}", "text_original": t[:400] if i % 7 else "same body", "published_date": "2026-05-07"} for i, t in docs]
    rows += [dict(r) for r in rows[:40]]
    rng.shuffle(rows)
    for i, r in enumerate(rows):
        r["ord"], r["title_original"] = i, f"T{len(r['text_original'])}"
    return [rows[i::parts] for i in range(parts)]


def plain(parts):
    """A scan: a row stays unless its URL or its hash is that of a row that stayed."""
    urls, hashes, kept = set(), set(), []
    for part in parts:
        for r in sorted(part, key=lambda r: r["ord"]):
            h = (" ".join(r["title_original"].split()), " ".join(r["text_original"].split()))
            if (r["url"] is not None and r["url"] in urls) or h in hashes:
                continue
            urls.add(r["url"])
            hashes.add(h)
            kept.append(r["ord"])
    return sorted(kept)


def put(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{n}").write_text("\n".join(map(json.dumps, rows)))
    (folder / f".{n}").rename(folder / f"{n}.json")


def test_stream_keeps_what_a_scan_keeps(spark, tmp_path, monkeypatch):
    """One file a run, all files in one run, and a run that fails after its commit and before its keys are in place."""
    step = incremental.fresh_only
    parts = files(spark, 3)
    for n, part in enumerate(parts):
        put(tmp_path / "a", n, part)
        if n == 1:
            # the store can't be written: nothing of the batch is seen, and the run after does it all
            with monkeypatch.context() as m, pytest.raises(Exception):
                m.setattr(versions.Store, "_publish", lambda *a: 1 / 0)
                incremental.run(spark, str(tmp_path / "a"), SCHEMA, str(tmp_path / "sa"), str(tmp_path / "ca"), step=step)
            assert Store(spark, str(tmp_path / "sa")).latest() == 1
        store = incremental.run(spark, str(tmp_path / "a"), SCHEMA, str(tmp_path / "sa"), str(tmp_path / "ca"), step=step)
        assert sorted(r["ord"] for r in store.read("articles").collect()) == plain(parts[: n + 1])
    # the same files again bring nothing
    put(tmp_path / "a", 9, parts[0])
    store = incremental.run(spark, str(tmp_path / "a"), SCHEMA, str(tmp_path / "sa"), str(tmp_path / "ca"), step=step)
    assert sorted(r["ord"] for r in store.read("articles").collect()) == plain(parts)


def test_one_run_equals_the_batch(spark, tmp_path):
    (part,) = files(spark, 1)
    put(tmp_path / "b", 0, part)
    store = incremental.run(spark, str(tmp_path / "b"), SCHEMA, str(tmp_path / "sb"), str(tmp_path / "cb"))
    batch = spark.createDataFrame([tuple(r.values()) for r in part], SCHEMA)
    want = incremental.ingest(batch, spark.createDataFrame([], "url string, content_hash string"))
    pick = lambda df: sorted((r["ord"], r["kw_pass"]) for r in df.collect())
    assert pick(store.read("articles")) == pick(want)


def test_rolling_windows_equal_the_whole(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("published_date"), (F.col("event_type") == "error").alias("is_significant"), "event_id")
    odd = spark.createDataFrame([(None, True, 1), ("2024-02-31", True, 2), ("", None, 3)], events.schema)
    events = events.unionByName(odd)
    store = Store(spark, str(tmp_path / "s"))
    for i in range(3):
        part = events.filter(F.col("event_id") % 3 == i)
        assert rolling.update(store, part, i) == i + 1 == rolling.update(store, part, i)  # a second time adds nothing
        so_far, days = events.filter(F.col("event_id") % 3 <= i), store.read("days")
        assert sorted(map(tuple, rolling.window_totals(days).collect())) == sorted(map(tuple, rollup.window_stats(so_far).collect()))
        got = rolling.series(days, 30, 7).orderBy("day").collect()
        whole = [tuple(r) for r in rollup.daily_series(so_far, 36).orderBy("day").collect()]
        assert [tuple(r)[:3] for r in got] == whole[6:]
        assert [(r["window_total"], r["window_flagged"]) for r in got] == [(sum(x[1] for x in whole[j : j + 7]), sum(x[2] for x in whole[j : j + 7])) for j in range(30)]
    # an update reads the table of days and its own batch
    part.write.parquet(str(tmp_path / "new"))
    read = rolling.add(store.read("days"), rolling.day_counts(spark.read.parquet(str(tmp_path / "new")))).inputFiles()
    assert read and all("/new/" in f or f"/{store.entry()['tables']['days']['folders'][0]}/" in f for f in read)
    empty = Store(spark, str(tmp_path / "e"))
    rolling.update(empty, events.limit(0), 0)
    assert rolling.series(empty.read("days")).count() == 0
    assert sorted(tuple(r) for r in rolling.window_totals(empty.read("days")).collect()) == [(7, 0, 0), (30, 0, 0)]
