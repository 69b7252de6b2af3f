"""Alignment of two tokenizers over a corpus, by elementary intervals.

Both tokenizers cut the same bytes (a blank, then the text). The union of their token ends cuts
those bytes into elementary intervals; each lies in one A token and one B token, so it is one
overlap, and a link. Where both have an end, a group closes.

Neither tokenizer joins anything across a blank that follows another character, so a text is cut
there into units, and a unit is encoded and aligned once for all its occurrences that a task
sees. How often an id pair is linked is summed over the corpus; a second pass looks the sums up.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, prepare, slices, text_rows

#: Units and links that a worker remembers, and characters that are encoded in one call.
UNITS, LINKS, RUN = 300_000, 4_000_000, 1 << 16
#: Id pairs that are broadcast with their counts, at most (the most frequent); the others are joined.
BROADCAST_PAIRS = 2_000_000

BEFORE = re.compile(r"(?<=\S) ")
#: How byte-level BPE of this kind parts a text before merging (a fixed value of the format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(a_path: str, b_path: str) -> tuple[str, bytes]:
    """Both vocabulary files as they are; the driver reads and broadcasts them (vocabularies are of fixed size)."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


class Tokenizers:
    """A byte-level BPE (a tokenizer file) and a piece BPE with byte fallback (a model)."""

    def __init__(self, a_file: str, b_model: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a_file)
        split, vocabulary = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        letters = byte_letters()
        pieces = {i: bytes(letters[c] for c in p) for p, i in vocabulary.items() if all(c in letters for c in p)}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer") or merged != sorted(merged):
            raise ValueError("the first tokenizer has to be a byte-level BPE without normalizer, without a blank of its own, and with ids in order of merging")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={p: i for i, p in pieces.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece of the second tokenizer runs across a blank")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # each id as it is written inside a group and at the end of its side
        self.written = np.array([f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)], object)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text by A, and of the text by B, or None if the bytes of either differ."""
        a = self.a.encode_ordinary(" " + text)
        # nothing at all is encoded as nothing, but a blank at the end of a text is one
        b = self.b.encode(text, num_threads=1) if text else self.b.encode("x ", num_threads=1)[len(self.b.encode("x", num_threads=1)) :]
        want = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """End, A owner and B owner of every elementary interval, and whether a group closes there."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


def group_parts(tools: Tokenizers, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
    """`a1,` `a2|` `b1;` and so on: what each token writes, group after group. a_group, b_group: the group of each token."""
    in_a, in_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=a_group[-1] + 1))]) for g in (a_group, b_group))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + in_b[a_group]] = a + len(tools.a_bytes) * (np.diff(a_group, append=-1) != 0)
    codes[np.arange(len(b)) + in_a[b_group + 1]] = b + len(tools.b_bytes) * (np.diff(b_group, append=-1) != 0) + 2 * len(tools.a_bytes)
    return tools.written[codes].tolist()


class Memory:
    """Units that a worker has aligned: numbers by unit, links one after another."""

    NAMES = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, tools: Tokenizers, with_texts: bool = True):
        self.tools, self.with_texts = tools, with_texts
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.numbers = np.zeros((0, len(self.NAMES)), np.int64)  # n_a is -1 where bytes differ
        self.texts: list[str] = []
        self.links = np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.of) >= UNITS or len(self.links) >= LINKS

    def index(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts one after another, and where each text's begin (and the last's end)."""
        cut = [t.split(" ") if t else [] for t in texts]
        # a blank after white space cuts nothing
        blank = {u for c in cut for u in c[:-1] if not u or u[-1].isspace()}
        if blank:
            cut = [BEFORE.split(t) if not blank.isdisjoint(c) else c for t, c in zip(texts, cut)]
        flat = [u for c in cut for u in c]
        self._learn([u for u in dict.fromkeys(flat) if u not in self.of])
        at = np.fromiter(map(self.of.__getitem__, flat), np.int64, len(flat))
        return at, np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)

    def sound(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts of which all bytes agree."""
        return sums(self.numbers[:, 0] < 0, at, starts) == 0

    def _learn(self, new: list[str]) -> None:
        runs, size = [], RUN
        for u in new:
            alone = not u or u[-1].isspace()  # what follows would not be cut off
            if alone or size >= RUN:
                runs.append([])
                size = 0
            runs[-1].append(u)
            size += RUN if alone else len(u) + 1
        found = [x for r in runs for x in self._align(r)]
        if found:
            self.numbers = np.concatenate([self.numbers, *(x[0] for x in found)])
            self.links = np.concatenate([self.links, *(x[1] for x in found)])
            for _, _, own, texts in found:
                self.of.update(zip(own, range(len(self.of), len(self.of) + len(own))))
                self.texts += texts

    def _align(self, run: list[str]):
        """Numbers, links, units and group texts of units that are encoded together."""
        ids = self.tools.encode(" ".join(run))
        if ids is None:
            if len(run) > 1:
                return [x for u in run for x in self._align([u])]
            return [(np.array([[-1, 0, 0, 0]], np.int64), np.zeros(0, np.int64), run, [""])]
        a, b = ids
        a_ends, b_ends = np.cumsum(self.tools.a_size[a]), np.cumsum(self.tools.b_size[b])
        ends, a_of, b_of, closes = intervals(a_ends, b_ends)
        unit_ends, shared = np.cumsum([len(u.encode()) + 1 for u in run]), ends[closes]
        unit = lambda x: np.bincount(np.searchsorted(unit_ends, x), minlength=len(run))
        numbers = np.stack([unit(a_ends), unit(b_ends), unit(shared), unit(ends)], 1)
        texts = [""] * len(run)
        if self.with_texts:
            parts = group_parts(self.tools, a, b, np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends))
            cut = np.concatenate([[0], np.cumsum(numbers[:, 0] + numbers[:, 1])]).tolist()
            texts = ["".join(parts[i:j]) for i, j in zip(cut, cut[1:])]
        return [(numbers, a[a_of] * len(self.tools.b_bytes) + b[b_of], run, texts)]


def sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of values[at] between neighbouring starts."""
    upto = np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])
    return upto[starts[1:]] - upto[starts[:-1]]


_made: dict[int, Tokenizers] = {}


def tokenizers(shared: Broadcast) -> Tokenizers:
    """This worker's tokenizers for the broadcast files."""
    key = hash(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizers(*shared.value)
    return _made[key]


def link_counts(spark: SparkSession, docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """pair (A id * size of B + B id) and n, the links of all documents that hold it. There are no more than pairs of ids."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(files)

    def count(batches):
        memory = Memory(tokenizers(shared), with_texts=False)
        seen = np.zeros(0, np.int64)

        def total():
            times = np.repeat(seen, memory.numbers[:, 3])
            order = np.argsort(memory.links, kind="stable")
            pairs = memory.links[order]
            heads = np.flatnonzero(np.diff(pairs, prepend=-1))
            n = np.add.reduceat(times[order], heads) if len(heads) else heads
            return pa.record_batch([pa.array(pairs[heads]), pa.array(n, pa.int64())], ["pair", "n"])

        for b in slices(batches):
            at, starts = memory.index(b.column("text").to_pylist())
            fine = np.repeat(memory.sound(at, starts), np.diff(starts))
            more = np.bincount(at[fine], minlength=len(memory.of))
            more[: len(seen)] += seen
            seen = more
            if memory.full:
                yield total()
                memory.clear()
                seen = seen[:0]
        yield total()

    found = text_rows(docs).select("text").mapInArrow(count, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")


def id_pairs(counts: DataFrame, b_size: int) -> DataFrame:
    """pair, n and best: whether no other A id has more links with its B id."""
    b = F.col("pair") % b_size
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each B id at most
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summaries(spark: SparkSession, docs: DataFrame, files: tuple[str, bytes], most: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A text that is null or empty, or whose bytes either tokenizer doesn't give back, has no
    tokens: zeros and ''. Strings of special tokens are ordinary text. Rows with null or
    repeated doc_id each give a row and each count; an empty table gives an empty result;
    other columns are not read. The `most` commonest id pairs are broadcast at most (taken by
    powers of two of their counts); links of rarer pairs are joined with their counts.
    """
    ws = Workspace(spark)
    b_size = len(Tokenizers(*files).b_bytes)
    pairs = ws.table("pairs", id_pairs(ws.table("counts", link_counts(spark, docs, files)), b_size))
    power = F.floor(F.log2("n")).cast("int")
    floor, kept = 64, 0
    for r in sorted(pairs.groupBy(power.alias("p")).count().collect(), key=lambda r: -r["p"]):  # 63 rows at most
        if kept + r["count"] > most:
            break
        floor, kept = r["p"], kept + r["count"]
    common = pairs.filter(power >= floor).toArrow().sort_by("pair")
    table = [common.column(c).combine_chunks() for c in ("pair", "n", "best")]
    table = [np.concatenate([[-1], x.to_numpy(zero_copy_only=False)]) for x in table]
    known, shared = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(files)

    def score(batches):
        memory, (pair, n, best) = Memory(tokenizers(shared)), known.value
        scored = np.zeros((0, 2), np.int64)
        rare, rare_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for b in slices(batches):
            before, links = len(memory.of), len(memory.links)
            at, starts = memory.index(b.column("text").to_pylist())
            own = memory.links[links:]
            place = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            there = pair[place] == own
            ends = np.concatenate([[0], np.cumsum(memory.numbers[before:, 3])])
            upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]  # noqa: E731, B023
            scored = np.concatenate([scored, np.stack([np.diff(upto(best[place] * there)), np.diff(upto(n[place] * there))], 1)])
            rare_ends = np.concatenate([rare_ends, rare_ends[-1] + upto(~there)[1:]])
            rare = np.concatenate([rare, own[~there]])
            fine = memory.sound(at, starts)
            out = [sums(c, at, starts) * fine for c in (*memory.numbers.T, *scored.T)]
            digests, left = [], []
            bounds = starts.tolist()
            for i, j, ok in zip(bounds, bounds[1:], fine.tolist()):
                units_ = at[i:j].tolist() if ok else []
                digests.append(hashlib.sha256("".join(map(memory.texts.__getitem__, units_))[:-1].encode()).hexdigest() if units_ else "")
                left.append(np.concatenate([rare[rare_ends[u] : rare_ends[u + 1]] for u in units_]) if units_ and len(rare) else rare[:0])
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out), pa.array(digests), pa.array(left, pa.list_(pa.int64()))], [*NAMES, "groups_sha256", "rare"])
            if memory.full:
                memory.clear()
                scored, rare, rare_ends = scored[:0], rare[:0], rare_ends[:1]

    found = text_rows(docs).mapInArrow(score, ", ".join(f"{c} long" for c in NAMES) + ", groups_sha256 string, rare array<long>")
    if kept == pairs.count():
        return found.drop("rare")
    found = ws.table("found", found.withColumn("row", F.monotonically_increasing_id()))
    left = found.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    left = left.join(pairs.hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    found = found.join(left, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select(*NAMES, "groups_sha256")


NAMES = ("doc_id", *Memory.NAMES, "n_best", "count_sum")


def groups(spark: SparkSession, docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """doc_id, n (from 0), end (byte offset after a blank and the text so far), a_ids, b_ids of every group of every row."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(files)

    def run(batches):
        tools = tokenizers(shared)
        for b in slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = tools.encode(text) if text else None
                if ids is None:
                    continue
                a_ends, b_ends = np.cumsum(tools.a_size[ids[0]]), np.cumsum(tools.b_size[ids[1]])
                ends, _, _, closes = intervals(a_ends, b_ends)
                shared_ends = ends[closes]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(e, shared_ends, side="right")]), pa.int32()), pa.array(i, pa.int32())) for e, i in ((a_ends, ids[0]), (b_ends, ids[1]))]
                n = len(shared_ends)
                yield pa.record_batch([pa.array([doc_id] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(shared_ends), *lists], ["doc_id", "n", "end", "a_ids", "b_ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n int, end long, a_ids array<int>, b_ids array<int>")


def products(found: DataFrame) -> DataFrame:
    """doc_id, n, a, b: every A token of a group with every B token of it, as maps between vocabularies count them."""
    return found.select("doc_id", "n", F.explode("a_ids").alias("a"), "b_ids").select("doc_id", "n", "a", F.explode("b_ids").alias("b"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies, aligned."""
    import public_tokenizers

    files = load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return summaries(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), files)
