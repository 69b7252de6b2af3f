"""Staged analysis by pluggable functions: score, gate, translate, then summarise and tag.

A client is any object with score, translate, summarise and tag; the network is its affair.
Each stage is written down before the next, so a row that fails the gate never reaches the
dear stages and no function runs twice.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Any, Protocol

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import bounded, cut, qualified, shared_dir, storage


class Client(Protocol):
    def score(self, title: str, body: str) -> tuple[float, str]: ...
    def translate(self, title: str, body: str) -> tuple[str, str]: ...
    def summarise(self, title: str, body: str) -> str: ...
    def tag(self, title: str, body: str) -> tuple[list[str], bool, str | None]: ...


class Fatal(Exception):
    """An error that no further row can escape, such as a refused key."""


class Stop:
    """A mark in a shared folder that tells all tasks of a run to make no further call."""

    def __init__(self, path: str):
        self.path = path

    @classmethod
    def new(cls, spark: SparkSession) -> Stop:
        return cls(qualified(spark, f"{shared_dir(spark)}/stop-{uuid.uuid4().hex}"))

    def raised(self) -> bool:
        fs, path = storage(self.path)
        return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound

    def put(self, why: str) -> None:
        fs, path = storage(self.path)
        with fs.open_output_stream(path) as out:
            out.write(why.encode())


def in_order(pool: ThreadPoolExecutor, tasks: Iterator[list[Callable[[], Any]]], at_once: int) -> Iterator[list[Any]]:
    """Results of each item's calls, in order of the items; calls of at most `at_once` items are under way."""
    waiting: deque = deque()
    for calls in tasks:
        waiting.append([pool.submit(c) for c in calls])
        if len(waiting) >= at_once:
            yield [f.result() for f in waiting.popleft()]
    while waiting:
        yield [f.result() for f in waiting.popleft()]


def stage(df: DataFrame, calls: Callable[[str, str], Any] | list[Callable[[str, str], Any]], inputs: tuple[str, str], outputs: str, pick: Callable[..., dict], at_once: int = 4, stop: Stop | None = None) -> DataFrame:
    """df with the outputs of row-wise calls, and error and fatal where one failed (outputs null).

    All calls of a row are made side by side, and at most `at_once` are under way in a task;
    rows keep their order. After a fatal error no task makes a further call: those under way
    are waited for, and rows that were not tried say so. A null input is an empty text.
    """
    calls = calls if isinstance(calls, list) else [calls]
    names = [o.split(":")[0].strip() for o in outputs.split(";")]
    stop = stop or Stop.new(df.sparkSession)

    def attempt(call, a, c):
        if stop.raised():
            return None, "not tried after a fatal error", True
        try:
            return call(a, c), None, False
        except Fatal as e:
            stop.put(str(e))
            return None, str(e), True
        except Exception as e:  # noqa: BLE001 a failed row stays pending
            return None, str(e), False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                tasks = ([partial(attempt, call, a or "", c or "") for call in calls] for a, c in zip(b[inputs[0]], b[inputs[1]]))
                rows = []
                for found in in_order(pool, tasks, max(1, at_once // len(calls))):
                    row = dict.fromkeys(names) | {"error": next((e for _, e, _ in found if e), None), "fatal": any(f for _, _, f in found)}
                    if row["error"] is None:
                        try:
                            row |= pick(*(x for x, _, _ in found))
                        except Exception as e:  # noqa: BLE001 an answer of another form
                            row |= {"error": str(e)}
                    rows.append(row)
                yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "error", "fatal"]).astype(object)], axis=1)

    kept = [f for f in df.schema.fields if f.name not in {*names, "error", "fatal"}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(" ".join(o.split(":", 1)) for o in outputs.split(";")), "error string", "fatal boolean"])
    bounded(df.sparkSession)
    return df.select(*(f.name for f in kept)).mapInPandas(run, schema)


def analyse(df: DataFrame, client: Client, threshold: float = C.THRESHOLD, valid=tuple(C.CATEGORY_LABELS), at_once: int = 4) -> DataFrame:
    """id, relevance_score, relevance_reasoning, passed_relevance, and the analysis of rows that passed.

    df: id, title_original, text_original. A row whose score failed stays unscored; one whose
    translation, summary or tags failed, or whose translation or summary is empty, is passed
    but not analysed (analysed is false). Summary and tags are asked for side by side. A fatal
    error stops all stages in all tasks; what was paid for before is kept.
    """
    stop = Stop.new(df.sparkSession)
    clamp = lambda x: min(1.0, max(0.0, float(x)))
    call = partial(stage, at_once=at_once, stop=stop)
    scored = cut(call(df.select("id", "title_original", "text_original"), client.score, ("title_original", "text_original"), "relevance_score:double;relevance_reasoning:string", lambda r: {"relevance_score": clamp(r[0]), "relevance_reasoning": r[1]}))
    scored = scored.withColumn("passed_relevance", F.col("relevance_score") >= threshold)
    chosen = scored.filter("passed_relevance").drop("error", "fatal")
    english = cut(call(chosen, client.translate, ("title_original", "text_original"), "title_english:string;text_english:string", lambda r: {"title_english": r[0], "text_english": r[1]}))
    told = english.filter("error IS NULL AND coalesce(title_english, '') <> '' AND coalesce(text_english, '') <> ''").drop("error", "fatal")
    tagged = lambda s, r: {"summary_english": s, "categories": [c for c in r[0] if c in valid], "is_significant": bool(r[1]), "significance_reasoning": r[2] if r[1] else None}
    done = cut(call(told, [client.summarise, client.tag], ("title_english", "text_english"), "summary_english:string;categories:array<string>;is_significant:boolean;significance_reasoning:string", tagged))
    failed = english.select("id", "error", "fatal").unionByName(done.select("id", "error", "fatal")).filter("error IS NOT NULL").groupBy("id").agg(F.first("error").alias("later_error"), F.max("fatal").alias("later_fatal"))
    done = done.filter("error IS NULL AND trim(coalesce(summary_english, '')) <> ''").select("id", "title_english", "text_english", "summary_english", "categories", "is_significant", "significance_reasoning", F.lit(True).alias("analysed"))
    out = scored.select("id", "relevance_score", "relevance_reasoning", "passed_relevance", "error", "fatal").join(done, "id", "left").join(failed, "id", "left")
    return out.withColumns({"analysed": F.coalesce("analysed", F.lit(False)), "error": F.coalesce("error", "later_error"), "fatal": F.col("fatal") | F.coalesce("later_fatal", F.lit(False))}).drop("later_error", "later_fatal")


def outcome(n_queued: int, n_done: int, n_failed: int, fatal: bool) -> str:
    """How a run ended: idle, aborted, failed, partial or completed."""
    if not n_queued:
        return "idle"
    if fatal:
        return "aborted"
    if n_failed >= n_queued:
        return "failed"
    return "partial" if n_failed else "completed"


def preflight(chars: int, model: str, limit: float = 5.00, confirmed: bool = False, prices: dict = C.PRICES) -> float:
    """Estimated dollars; raises if they reach the limit without being confirmed, or if the model has no price."""
    per_in, per_out = prices[model]
    total = chars / 1e6 * per_in + chars * C.OUTPUT_RATIO / 1e6 * per_out
    if total >= limit and not confirmed:
        raise RuntimeError(f"estimated at ${total:.2f}; confirm to go on")
    return total


