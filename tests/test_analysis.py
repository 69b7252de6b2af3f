import os
import time
import uuid

from pyspark.sql import functions as F

from quillspark.operators import analysis


def counting(*args, **kwargs):
    """A client of a class that travels to the workers whole."""

    class Counting:
        """Writes down every call; refuses all from a given text on."""

        def __init__(self, folder, bad=(), fatal=(), slow=0.0):
            self.folder, self.bad, self.fatal, self.slow = folder, bad, fatal, slow

        def _call(self, kind, title):
            began = time.time()
            time.sleep(self.slow)
            with open(f"{self.folder}/{kind}-{uuid.uuid4().hex}", "w") as f:
                f.write(f"{title} {began} {time.time()}")
            if (kind, title) in self.bad:
                raise ValueError(f"{kind} failed")
            if (kind, title) in self.fatal:
                raise analysis.Fatal("the key is refused")

        def score(self, title, body):
            self._call("score", title)
            return 0.9, "why"

        def translate(self, title, body):
            self._call("translate", title)
            return title, "text"

        def summarise(self, title, body):
            self._call("summarise", title)
            return "summary"

        def tag(self, title, body):
            self._call("tag", title)
            return ["taiwan", "none such"], True, "because"

    return Counting(*args, **kwargs)


def calls(folder):
    out = []
    for name in os.listdir(folder):
        title, began, ended = open(f"{folder}/{name}").read().rsplit(" ", 2)
        out.append((name.split("-")[0], title, float(began), float(ended)))
    return sorted(out, key=lambda c: c[2])


def rows(spark, n, parts):
    return spark.range(0, n, 1, parts).select("id", F.concat(F.lit("t"), "id").alias("title_original"), F.lit(None).cast("string").alias("text_original"))


def test_a_fatal_error_stops_all_tasks(spark, tmp_path):
    client = counting(tmp_path, fatal={("score", "t3")}, slow=0.05)
    got = {r["id"]: r for r in analysis.analyse(rows(spark, 80, 4), client, at_once=1).collect()}
    made = calls(tmp_path)
    refused = next(end for _, title, _, end in made if title == "t3")
    # one call of each other task may have been under way, and one may have looked at the mark just before
    assert sum(began > refused for _, _, began, _ in made) <= 4 and {k for k, *_ in made} == {"score"}
    tried = {int(t[1:]) for _, t, _, _ in made} - {3}
    assert len(got) == 80 and all((got[i]["relevance_score"] == 0.9) == (i in tried) for i in got)
    assert got[3]["fatal"] and got[3]["error"] == "the key is refused"
    assert all(r["fatal"] and r["error"] == "not tried after a fatal error" for i, r in got.items() if i not in tried | {3})


def test_a_fatal_error_of_a_later_stage_keeps_what_was_paid_for(spark, tmp_path):
    client = counting(tmp_path, fatal={("tag", "t1")}, bad={("translate", "t4"), ("summarise", "t0")})
    got = {r["id"]: r for r in analysis.analyse(rows(spark, 6, 1), client, at_once=2).collect()}
    assert all(r["relevance_score"] == 0.9 for r in got.values())
    assert got[0]["error"] == "summarise failed" and not got[0]["analysed"] and not got[0]["fatal"]
    assert got[1]["fatal"] and not got[1]["analysed"]
    assert got[4]["error"] == "translate failed" and not got[4]["fatal"]
    assert got[5]["error"] == "not tried after a fatal error" and not got[5]["analysed"]
    # both calls of the row were made before the run stopped
    assert {k for k, t, *_ in calls(tmp_path) if t == "t1"} == {"score", "translate", "summarise", "tag"}


def test_calls_run_side_by_side_in_bounds_and_in_order(spark, tmp_path):
    client = counting(tmp_path, bad={("score", "t7")}, slow=0.1)
    df = rows(spark, 24, 1)
    stage = analysis.stage(df, [client.score, client.tag], ("title_original", "text_original"), "score:double;tags:array<string>", lambda s, t: {"score": s[0], "tags": t[0]}, at_once=8)
    got = stage.collect()
    assert [r["id"] for r in got] == list(range(24))
    assert [r["id"] for r in got if r["error"]] == [7] and all(r["score"] == 0.9 and r["tags"] == ["taiwan", "none such"] for r in got if r["id"] != 7)
    made = calls(tmp_path)
    under_way = [sum(b <= began < e for _, _, b, e in made) for _, _, began, _ in made]
    assert len(made) == 48 and 4 <= max(under_way) <= 8
    assert max(e for *_, e in made) - min(b for _, _, b, _ in made) < 0.1 * 48 / 3


def test_empty_table_and_answers_of_another_form(spark, tmp_path):
    assert analysis.analyse(rows(spark, 0, 1), counting(tmp_path)).count() == 0
    odd = analysis.stage(rows(spark, 2, 1), lambda a, b: None, ("title_original", "text_original"), "score:double", lambda r: {"score": r[0]})
    assert all(r["score"] is None and r["error"] and not r["fatal"] for r in odd.collect())
