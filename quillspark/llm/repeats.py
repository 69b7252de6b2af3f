"""Substring dedup with repeated-phrase automata.

A window of 20 words is covered by its anchor, the six-word phrase in it whose hash is
least; equal windows have equal anchors, so only phrases that recur can lie in a recurring
passage. Per document the distinct anchors are counted over the corpus. Each recurring phrase
goes, with one place where it stands, to the shards of documents that hold it. A shard
compiles an Aho-Corasick automaton of the texts of its phrases and streams all its documents
through it: the automaton's hits alone tell where the phrases occur. The windows around them
are confirmed by 128-bit hashes of their words and compared with their first occurrence; the
rest is removed.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Powers, Workspace, mix, raw_bytes, slices, span_sums, word_hashes, words_of

WINDOW, PHRASE = 20, 6
LOW = -(1 << 63)
_BYTES, _PHRASES, _FIRST, _SECOND = (Powers(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every run of `width` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


class Words:
    """Words of a slice of documents, with hashes of phrases and windows."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, phrase: int = PHRASE):
        self.body, self.starts = raw_bytes(texts)
        self.begin, self.end, self.first = words_of(self.body, self.starts)
        self.count = np.diff(self.first)
        self.window, self.phrase, self.n = window, phrase, len(self.begin)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = word_hashes(self.body, self.begin, self.end, _BYTES)
        span = window - phrase + 1
        if self.n >= window:
            self.grams = mix(self.spans(self.hash, phrase, _PHRASES))
            self.valid = self.doc[: self.n - window + 1] == self.doc[window - 1 :]
            self.least = _slide(self.grams, span, np.minimum)
        else:
            self.grams = self.least = np.zeros(0, np.uint64)
            self.valid = np.zeros(0, bool)

    @staticmethod
    def spans(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
        sums = span_sums(values, powers)
        _, down = powers.get(len(values) + 1)
        return (sums[width:] - sums[:-width]) * down[: len(values) - width + 1]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every window."""
        return mix(self.spans(self.hash, self.window, _FIRST)), mix(self.spans(mix(self.hash ^ np.uint64(0x5851F42D4C957F2D)), self.window, _SECOND))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each document's words."""
        out = []
        for values, powers in ((self.hash, _FIRST), (mix(self.hash ^ np.uint64(0x5851F42D4C957F2D)), _SECOND)):
            sums = span_sums(values, powers)
            _, down = powers.get(len(values) + 1)
            out.append(mix((sums[self.first[1:]] - sums[self.first[:-1]]) * down[self.first[:-1]]))
        return out[0], out[1]

    def anchors(self) -> np.ndarray:
        """Where a phrase is the least of some window."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        span = self.window - self.phrase + 1
        inside = np.where(self.valid, self.least, np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        most = _slide(np.concatenate([pad, inside, pad]), span, np.maximum)
        return np.flatnonzero((most == self.grams) & (self.grams > 0))

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Windows whose anchor was located."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        known = np.where(hit, self.grams, np.uint64(0xFFFFFFFFFFFFFFFF))
        return np.flatnonzero((_slide(known, self.window - self.phrase + 1, np.minimum) == self.least) & self.valid)


def _anchor_lists(words: Words) -> tuple[pa.ListArray, pa.ListArray]:
    """Hashes of each document's anchors and where in it they stand first; a phrase that recurs inside the document stands twice."""
    at = words.anchors()
    doc, gram = words.doc[at], words.grams[at]
    order = np.lexsort((at, gram, doc))
    doc, gram, at = doc[order], gram[order], at[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1])
    third = np.zeros(len(doc), bool)
    third[1:] = same[1:] & same[:-1]
    doc, gram, at = doc[~third], gram[~third], at[~third]
    ends = pa.array(np.searchsorted(doc, np.arange(len(words.count) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(gram.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array((at - words.first[doc]).astype(np.int32)))


def locate(words: Words, wanted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where phrases begin that recur: one automaton of the shard's phrases, every document streamed through it.

    wanted: for each document, the hashes of its recurring anchors and one place of each in it
    (of a document with the same doc_id, if the hash there is another).
    """
    hit = np.zeros(len(words.grams), bool)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    texts: dict[int, list[str]] = {}

    def text(d):
        if d not in texts:
            texts[d] = words.body[words.starts[d] : words.starts[d + 1]].tobytes().translate(_SPACES).decode().split(" ")
            texts[d] = [w for w in texts[d] if w]
        return texts[d]

    compiled = set()
    for d, (phrases, places) in enumerate(wanted):
        for phrase, k in zip(phrases.tolist(), places.tolist()):
            if phrase in compiled or k + words.phrase > words.count[d] or words.grams[words.first[d] + k].view(np.int64) != phrase:
                continue
            compiled.add(phrase)
            automaton.add_word(" " + " ".join(text(d)[k : k + words.phrase]) + " ")
    if not compiled:
        return hit
    automaton.make_automaton()
    for d in range(len(wanted)):
        if words.count[d] < words.window:
            continue
        line = text(d)
        # the place of the blank after each word
        after = np.cumsum(np.fromiter(map(len, line), np.int64, len(line)) + 1)
        ends = np.fromiter((e for e, _ in automaton.iter(" " + " ".join(line) + " ")), np.int64)
        if len(ends):
            hit[int(words.first[d]) + np.searchsorted(after, ends) - words.phrase + 1] = True
    return hit


_SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


def recurring_anchors(ws: Workspace, docs: DataFrame, window: int, phrase: int) -> tuple[DataFrame, DataFrame]:
    """d, its recurring anchors (phrases) and places of them, and d, seq1 of later documents with the words of an earlier one."""

    def find(batches):
        for b in slices(batches):
            w = Words(b.column("text"), window, phrase)
            one, two = w.whole()
            yield pa.record_batch([b.column("d"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(w.count), *_anchor_lists(w)], ["d", "seq1", "seq2", "n_words", "phrases", "places"])

    table = ws.table("anchors", docs.mapInArrow(find, "d long, seq1 long, seq2 long, n_words long, phrases array<long>, places array<int>"))
    long = table.filter(F.col("n_words") >= window)
    first = ws.table("firsts", long.groupBy("seq1", "seq2", "n_words").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1"))
    # both sides are plain tables, so a text with very many copies can be dealt to several tasks
    copies = ws.table("copies", long.select("d", "seq1", "seq2", "n_words").join(first, ["seq1", "seq2", "n_words"]).filter("d > first").select("d", "seq1").distinct())
    own = table.select("d", "seq1", "phrases", "places").join(copies, ["d", "seq1"], "left_anti").select("d", F.explode(F.arrays_zip("phrases", "places")).alias("p")).select("d", "p.phrases", "p.places").toDF("d", "phrase", "place")
    often = own.groupBy("phrase").count().filter("count > 1").select("phrase")
    found = own.join(often, "phrase").groupBy("d").agg(F.collect_list(F.struct("phrase", "place")).alias("p")).select("d", F.col("p.phrase").alias("phrases"), F.col("p.place").alias("places"))
    return ws.table("recurring", found), copies


def later_windows(ws: Workspace, docs: DataFrame, recurring: DataFrame, window: int, phrase: int) -> DataFrame:
    """d and cuts: of each document, where windows start that begin earlier elsewhere, each with 32 bits of its hash."""

    def find(batches):
        for b in slices(batches):
            w = Words(b.column("text"), window, phrase)
            wanted = [(v.values.to_numpy(), x.values.to_numpy()) for v, x in zip(b.column("phrases"), b.column("places"))]
            at = w.candidates(locate(w, wanted))
            if not len(at):
                continue
            one, two = w.windows()
            one, two = one[at].view(np.int64), two[at].view(np.int64)
            doc = w.doc[at]
            d, start = b.column("d").to_numpy()[doc], at - w.first[doc]
            # of windows that recur inside this slice only the first goes on to be compared
            order = np.lexsort((start, d, two, one))
            again = np.zeros(len(at), bool)
            o1, o2 = one[order], two[order]
            head = np.ones(len(at), bool)
            head[1:] = (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            tie = (d[order] == d[order][lead]) & (start[order] == start[order][lead])
            again[order] = ~tie
            yield pa.record_batch([pa.array(one), pa.array(two), pa.array(d), pa.array(start.astype(np.int32)), pa.array(again)], ["w1", "w2", "d", "start", "again"])

    with_phrases = docs.join(recurring, "d").select("d", "text", "phrases", "places")
    windows = ws.table("windows", with_phrases.mapInArrow(find, "w1 long, w2 long, d long, start int, again boolean"))
    open_ = windows.filter("NOT again").select("w1", "w2", "d", "start")
    first = open_.groupBy("w1", "w2").agg(F.min(F.struct("d", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("w1", "w2", "first")
    later = open_.join(first, ["w1", "w2"]).filter(F.struct("d", "start") > F.col("first"))
    cuts = later.select("d", "start", "w1").unionByName(windows.filter("again").select("d", "start", "w1"))
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("w1").bitwiseAND(F.lit(0xFFFFFFFF)))
    return ws.table("cuts", cuts.groupBy("d").agg(F.collect_list(packed).alias("cuts")))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    Words are runs of characters other than blank and \\x09-\\x0D, unchanged. A word goes if a
    window of `window` words around it also starts earlier: in a smaller doc_id, or earlier in
    the same document. A null text has no words; a null doc_id comes before all others. Rows
    that share a doc_id are equally early, so neither loses what it shares with the other. An
    empty table gives an empty result; other columns are not read.
    """
    ws = Workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select("d", "text")
    recurring, copies = recurring_anchors(ws, texts, window, phrase)
    ws.drop("anchors")
    ws.drop("firsts")
    cuts = later_windows(ws, texts, recurring, window, phrase)
    ws.drop("windows")
    ws.drop("recurring")
    whole = copies.groupBy("d").agg(F.collect_set("seq1").alias("whole"))

    def clean(batches):
        for b in slices(batches):
            w = Words(b.column("text"), window, phrase)
            seq, _ = w.whole()
            hashes = w.windows()[0] if w.n >= window else np.zeros(0, np.uint64)
            texts, cut, whole_ = b.column("text").to_pylist(), b.column("cuts"), b.column("whole")
            removed, kept = np.zeros(len(texts), np.int64), []
            for i, t in enumerate(texts):
                line, n = t.encode().split(), int(w.count[i])
                if whole_[i].is_valid and int(seq[i].view(np.int64)) in whole_[i].as_py():
                    removed[i], line = n, []
                elif cut[i].is_valid and n >= window:
                    packed = cut[i].values.to_numpy()
                    at, check = packed >> 32, packed & 0xFFFFFFFF
                    at, check = at[at <= n - window], check[at <= n - window]
                    at = at[(hashes[int(w.first[i]) + at] & np.uint64(0xFFFFFFFF)).astype(np.int64) == check]
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    removed[i] = n - int(stays.sum())
                    line = [x for x, s in zip(line, stays.tolist()) if s]
                kept.append(b" ".join(line).decode())
            yield pa.record_batch([b.column("doc_id"), pa.array(w.count), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    out = rows.join(cuts, "d", "left").join(whole, "d", "left").select("doc_id", "text", "cuts", "whole")
    return out.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept string")


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows of 20 words."""
    found = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS a, md5(array_to_string(w[i:i + 19], ' ')) AS b
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)
), firsts AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS k FROM win
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM firsts WHERE k > 1) GROUP BY doc_id
), words AS (
  SELECT doc_id, w[j] AS word, j, js IS NOT NULL AND list_contains(js, j) AS out FROM (SELECT doc_id, w, js, unnest(range(1, len(w) + 1)) AS j FROM d LEFT JOIN gone USING (doc_id))
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT out) AS s FROM words GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
