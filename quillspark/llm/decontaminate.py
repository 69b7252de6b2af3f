"""Benchmark decontamination with a generalised suffix automaton of the test items.

Automata are compiled on the driver from the normalised items, each from MAX_WORDS words or
little more, which bounds its size, and broadcast one after another. Every document streams
its words through each: the state holds the longest suffix that occurs in some item, so ten
matched words are a window of an item. Items of fewer words count whole. With several
automata each is a pass over the documents that adds to what the passes before found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import free_names
from .work import Workspace, fill, slices

WINDOW = 10
#: Words of all items after which an automaton is closed; it has two states a word and three edges at most.
MAX_WORDS = 200_000

# bytes that are words after A-Z became a-z; all others become spaces
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """All runs of words of a set of items; a state knows the items in which its last `window` words occur.

    It is built from one dictionary for each state, then kept as flat arrays.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[tuple[int, int]] = []
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, words in items:
            if not words:
                continue
            k = len(self.names)
            self.names.append(name)
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                own.append((last, k))
            if len(words) < window:
                short[last].append((len(words), k))
        n, length, link = len(self.link), self.length, self.link
        by_length = sorted(range(1, n), key=length.__getitem__)
        # the state of each state's last `window` words, and the items in which that run occurs
        at_window = [0] * n
        for s in by_length:
            if length[s] >= window:
                at_window[s] = at_window[link[s]] if length[link[s]] >= window else s
        holds: dict[int, set[int]] = defaultdict(set)
        for state, k in own:
            if at_window[state]:
                holds[at_window[state]].add(k)
        # an occurrence of a longer run is one of the window at its end, so its items are there already
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        whole: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for state, found in short.items():
            for size, k in found:
                s = state
                while link[s] > 0 and length[link[s]] >= size:
                    s = link[s]
                whole[s].append((size, k))
        if whole:  # a state ends with the short items of its suffixes too
            for s in by_length:
                if mine := (*self.short.get(link[s], ()), *whole.get(s, ())):
                    self.short[s] = mine
        self.at_window = np.array(at_window, np.int32)
        heads = sorted(holds)
        self.held = dict(zip(heads, range(len(heads))))
        self.held_at = np.cumsum([0, *(len(holds[s]) for s in heads)])
        self.held_items = np.array([k for s in heads for k in sorted(holds[s])], np.int32)
        self.edges = len(self.ids) + 1  # an edge's number is state * edges + word
        self.edge = np.array([s * self.edges + c for s, move in enumerate(self.next) for c in move], np.int64)
        self.to = np.array([t for move in self.next for t in move.values()], np.int32)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.next = None
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _lists(self):
        """The flat arrays as one dictionary and lists, made once in a worker."""
        if self._open is None:
            self._open = dict(zip(self.edge.tolist(), self.to.tolist())), self.link.tolist(), self.length.tolist(), self.at_window.tolist()
        return self._open

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[last] + 1 == length[q]:
                return q
            return self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words inside windows, joined and in order; items with windows there."""
        edges, (go, link, length, at_window), window, short = self.edges, self._lists(), self.window, self.short
        state = size = 0
        ends: list[tuple[int, int]] = []
        seen: set[int] = set()
        items: set[int] = set()
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = size = 0
                continue
            to = go.get(state * edges + c)
            if to is not None:
                state, size = to, size + 1
            else:
                while to is None and state:
                    state = link[state]
                    to = go.get(state * edges + c)
                size = length[state]
                if to is not None:
                    state, size = to, size + 1
            if size >= window:
                ends.append((i + 1 - window, i + 1))
                seen.add(at_window[state])
            if short and (here := short.get(state)):
                for n, k in here:
                    if n <= size:
                        ends.append((i + 1 - n, i + 1))
                        items.add(k)
        for s in seen:
            h = self.held[s]
            items.update(self.held_items[self.held_at[h] : self.held_at[h + 1]].tolist())
        return _joined(ends), items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = MAX_WORDS) -> Iterator[tuple[SuffixAutomaton, bool]]:
    """Automata over all items, each closed at `most` words, and whether it is the last. item_ids are compared as strings.

    An item of more words is cut into pieces that share all but one word of a window, so each of
    its windows lies in a piece. One automaton at a time is on the driver, with the items of
    the next.
    """
    part, size, ready = [], 0, None
    most = max(most, 2 * window)
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = normal_words(r["text"])
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            if size >= most:
                if ready is not None:
                    yield ready, False
                ready, part, size = SuffixAutomaton(part, window), [], 0
            piece = words[at : at + most]
            part.append((r["item_id"] if r["item_id"] is not None else "", piece))
            size += len(piece)
    if ready is not None:
        yield ready, False
    yield SuffixAutomaton(part, window), True


_SPANS = "array<struct<start:int,end:int>>"


def _search(spark: SparkSession, rows: DataFrame, benchmark: DataFrame, window: int, most: int, named: bool, last_step, schema: str) -> DataFrame:
    """last_step of each batch and its rows' joined spans and item names (if `named`).

    rows: text and any other columns. One automaton takes one pass. With more of them the rows
    are numbered and written once; each pass reads the texts and writes the spans of the rows
    that it hits, and what all passes found is joined to the rows at the end. No worker ever
    holds two automata.
    """
    ws = Workspace(spark)
    row, spans_, items_ = free_names(rows.columns, "row", "spans", "items")
    columns, at = rows.columns, rows.columns.index("text")
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
    parts = automata(benchmark, window, most)
    automaton, last = next(parts)

    def match(a, text):
        found, k = a.match(normal_words(text))
        return found, sorted({a.names[i] for i in k}) if named else []

    if last:
        shared = spark.sparkContext.broadcast(automaton)

        def whole(batches):
            for b in slices(batches, "text", 8 << 20):
                found = [match(shared.value, t) for t in fill(b.column(at)).to_pylist()]
                yield last_step(b, [x for x, _ in found], [k for _, k in found])

        return rows.mapInArrow(whole, schema)

    rows = ws.table("numbered", rows.withColumn(row, F.monotonically_increasing_id()))
    told = f"row long, spans {_SPANS}, items array<string>"
    hits = None
    for turn, (automaton, _) in enumerate(chain([(automaton, last)], parts)):
        shared = spark.sparkContext.broadcast(automaton)

        def one_pass(batches, shared=shared):
            for b in slices(batches, "text", 8 << 20):
                found = [match(shared.value, t) for t in fill(b.column("text")).to_pylist()]
                has = [i for i, (x, _) in enumerate(found) if x]
                spans = pa.array([[{"start": x, "end": y} for x, y in found[i][0]] for i in has], kinds[0])
                yield pa.record_batch([b.column("row").take(pa.array(has, pa.int64())), spans, pa.array([found[i][1] for i in has], kinds[1])], ["row", "spans", "items"])

        now = ws.table(f"hits{turn}", rows.select(F.col(row).alias("row"), "text").mapInArrow(one_pass, told))
        hits = now if hits is None else hits.unionByName(now)
        shared.destroy()
    every = hits.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("spans")).alias(spans_), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items_))

    def joined(batches):
        for b in slices(batches, "text", 8 << 20):
            spans = [_joined([(x["start"], x["end"]) for x in found or []]) for found in b.column(spans_).to_pylist()]
            yield last_step(b.select(columns), spans, [k or [] for k in b.column(items_).to_pylist()])

    return rows.join(every.hint("merge"), row, "left").select(*columns, spans_, items_).mapInArrow(joined, schema)


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start, end in words), items (sorted strings) of every row.

    Null or wordless texts have no words; wordless items have no windows; items that share
    an item_id count once; empty tables give no rows or no hits. Other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def told(b, spans, items):
        n_words = [len(normal_words(t)) for t in b.column("text").to_pylist()]
        n_hit = [sum(e - s for s, e in found) for found in spans]
        spans = pa.array([[{"start": s, "end": e} for s, e in found] for found in spans], kind)
        return pa.record_batch([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "spans", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _search(spark, rows, benchmark, window, most, True, told, f"doc_id long, n_words long, n_hit long, spans {_SPANS}, items array<string>")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, most: int = MAX_WORDS) -> DataFrame:
    """Cut matched spans out of the texts; documents more than `coverage` of whose words are hit go.

    A span runs from its first matched word to the end of its last, so the punctuation
    between goes too. All columns stay; n_chars is set anew; a null text stays null. Rows are
    judged one by one, repeated ones alike; an empty table gives an empty result, an empty
    benchmark changes nothing.
    """
    at = docs.columns.index("text")

    def clean(text, found):
        if not found:
            return text
        raw = text.encode()
        spaced = raw.translate(_TABLE)
        if sum(e - s for s, e in found) > coverage * len(spaced.split()):
            return None
        inside = np.frombuffer(spaced, np.uint8) != 0x20
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out, upto = [], 0
        for s, e in found:
            out.append(raw[upto : begin[s]])
            upto = int(end[e - 1])
        return b"".join([*out, raw[upto:]]).decode()

    def cut(b, spans, _):
        before = b.column(at).to_pylist()
        after = [clean(t, f) for t, f in zip(before, spans)]
        keep = pa.array([y is not None or x is None for x, y in zip(before, after)], pa.bool_())
        return b.set_column(at, b.schema.field(at), pa.array(after, b.schema.field(at).type)).filter(keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = _search(spark, docs, benchmark, window, most, False, cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = find_contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0
), occ AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos, sizes WHERE i + n - 1 <= len(w)) JOIN win USING (n, s)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
