"""Byte-level BPE: overlapping chunk encoding, and decoding by joining raw bytes.

A long text is cut into overlapping chunks that are pre-tokenised in parallel. The split
pattern looks only ahead, so from any place where two chunks agree on a boundary they agree
until the earlier one ends; that is where they are stitched. Only the boundaries inside the
overlaps are brought together for that; each chunk is then encoded between its two stitches,
again in parallel. A text in which two neighbours agree nowhere (a match longer than the
overlap) is stitched as a whole. A text of one chunk takes one step.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, fill, prepare, slices, text_rows

#: Characters of a chunk, and how far it reaches into the next.
CHUNK, OVERLAP = 32_768, 512
#: Pieces whose ids a worker remembers.
CACHE = 80_000


def load_ranks(path: str) -> bytes:
    """The rank file, as it is; the driver reads it and broadcasts it (a vocabulary is of fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id; ids without a rank have none."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        table[k] = token
    return table


class Encoder(dict):
    """Ids of pieces: looked up, or merged by rank and remembered."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        super().__init__()
        self.ranks = read_ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = tuple(self.merge(piece))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, pieces) -> chain:
        return chain.from_iterable(map(self.__getitem__, pieces))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


_made: dict[tuple[int, str], Encoder] = {}


def encoder(shared: Broadcast, pattern: str) -> Encoder:
    """This worker's encoder for the broadcast ranks."""
    key = (hash(shared.value), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(shared.value, pattern)
    return _made[key]


def stitch(chunks: list[tuple[str, list[int]]], size: int, pattern) -> list[list[str]]:
    """The pieces of each chunk, so that together they are those of the whole text.

    chunks: the text of each (chunk i begins at i * size and reaches into the next) and the
    starts of its matches. From the first true start on, all starts of a chunk are true, but
    where its last match ends is only known in the last chunk.
    """
    body = "".join([c[0][:size] for c in chunks[:-1]] + [chunks[-1][0]])
    n, out, at = len(body), [], 0
    for i, (text, starts) in enumerate(chunks):
        base, end = i * size, min(i * size + len(text), n)
        if at >= end:  # a match from before runs past this chunk
            out.append([])
            continue
        j = bisect_left(starts, at - base)
        if j < len(starts) and starts[j] == at - base:
            true = [base + s for s in starts[j:]]
        else:  # no boundary in common: scan on from the true one
            true = [at + m.start() for m in pattern.finditer(body[at:end])]
        if end == n:
            cut = [*true, n]
        else:
            # up to the first boundary in the overlap that the next chunk has too, or to the last match
            there = {base + size + s for s in chunks[i + 1][1]}
            stop = next((k for k in range(bisect_left(true, base + size), len(true)) if true[k] in there), len(true) - 1)
            cut = true[: stop + 1]
            if len(cut) == 1:  # one match fills the chunk; the whole text tells where it ends
                cut.append(pattern.match(body, at).end())
        out.append([body[a:b] for a, b in zip(cut, cut[1:])])
        at = cut[-1]
    return out


def encode(spark: SparkSession, docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row, as encoding the whole text at once gives them.

    Strings of special tokens are ordinary text. A null or empty text has no ids; rows with
    null or repeated doc_id each give a row; an empty table gives an empty result. Other
    columns are not read. With decoded also what decode() makes of the ids; a text of one chunk
    is then decoded by the worker that encoded it, so that no task needs two workers.
    """
    ws = Workspace(spark)
    shared = spark.sparkContext.broadcast(ranks)
    rows = text_rows(docs)

    def whole(batches):
        enc = encoder(shared, pattern)
        find = enc.pattern.findall
        get = token_bytes(enc.ranks).__getitem__ if decoded else None
        for b in slices(batches):
            ids, ends = [], [0]
            for t in fill(b.column("text")).to_pylist():
                ids.append(np.fromiter(enc.encode(find(t)), np.int32))
                ends.append(ends[-1] + len(ids[-1]))
            out = [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate(ids))]
            back = [pa.array([b"".join(map(get, x.tolist())) for x in ids], pa.binary())] if decoded else []
            yield pa.record_batch([*out, *back], ["doc_id", "ids", *["decoded"] * decoded])

    def chunks(batches):
        for b in slices(batches):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                for c in range(0, -(-len(text) // chunk), 64):
                    bodies = [text[i * chunk : (i + 1) * chunk + overlap] for i in range(c, min(c + 64, -(-len(text) // chunk)))]
                    yield pa.record_batch([pa.array([key] * len(bodies)), pa.array(range(c, c + len(bodies)), pa.int32()), pa.array(bodies)], ["key", "c", "body"])

    def split(batches):
        enc = encoder(shared, pattern)
        for b in slices(batches, "body"):
            found = [enc.starts(t) for t in b.column("body").to_pylist()]
            head = [x[: bisect_left(x, overlap)] for x in found]
            # the last characters of a chunk that goes on may belong to a longer match, such as 'll
            top = [len(t) - 4 * (len(t) == chunk + overlap) for t in b.column("body").to_pylist()]
            tail = [[s - chunk for s in x[bisect_left(x, chunk) : bisect_left(x, end)]] for x, end in zip(found, top)]
            kind = pa.list_(pa.int32())
            yield pa.record_batch([*b.columns, pa.array(found, kind), pa.array(head, kind), pa.array(tail, kind)], [*b.schema.names, "starts", "head", "tail"])

    def between(batches):
        """Ids of each chunk from its stitch with the one before to that with the next."""
        enc = encoder(shared, pattern)
        for b in slices(batches, "body"):
            ids = []
            for body, starts, lo, hi in zip(*(b.column(c).to_pylist() for c in ("body", "starts", "lo", "hi"))):
                hi = len(body) if hi is None else hi
                cut = [*starts[bisect_left(starts, lo) : bisect_left(starts, hi)], hi]
                ids.append(list(enc.encode(body[x:y] for x, y in zip(cut, cut[1:]))))
            yield pa.record_batch([b.column("key"), b.column("c"), pa.array(ids, pa.list_(pa.int32()))], ["key", "c", "ids"])

    def join(batches):
        enc = encoder(shared, pattern)
        for b in batches:
            for r in b.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["c"])
                pieces = stitch([(p["body"], p["starts"]) for p in parts], chunk, enc.pattern)
                ids = [list(enc.encode(p)) for p in pieces]
                yield pa.record_batch([pa.array([r["key"]] * len(ids)), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["key", "c", "ids"])

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>" + ", decoded binary" * decoded)
    long = rows.filter(F.length("text") > chunk).withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    names = ws.table("names", long.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("times")))
    one = long.select("key", "text").dropDuplicates(["key"])
    parts = one.mapInArrow(chunks, "key string, c int, body string").repartition("key", "c")
    parts = ws.table("parts", parts.mapInArrow(split, "key string, c int, body string, starts array<int>, head array<int>, tail array<int>"))
    # the stitch before each chunk: the first boundary that both sides of an overlap have
    ends = parts.select("key", "c", "head", "tail").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "head", "tail"))).alias("p"))
    first = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.element_at("p", F.greatest(i, F.lit(1)))["tail"], x["head"])))
    ends = ws.table("ends", ends.select("key", F.transform("p", first).alias("lo")))
    agreed = F.forall("lo", lambda x: x.isNotNull())
    at = ends.filter(agreed).select("key", "lo", F.posexplode("lo").alias("c", "from")).select("key", "c", F.col("from").alias("lo"), (F.try_element_at("lo", F.col("c") + 2) + chunk).alias("hi"))
    ids = parts.select("key", "c", "body", "starts").join(at, ["key", "c"]).mapInArrow(between, "key string, c int, ids array<int>")
    odd = parts.join(ends.filter(~agreed).select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("c", "body", "starts")).alias("parts"))
    ids = ids.unionByName(odd.mapInArrow(join, "key string, c int, ids array<int>"))
    back = ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("parts")).join(names, "key")
    back = back.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("doc_id", "ids")
    if decoded:
        back = decode(spark, back.select("doc_id", "ids", F.col("ids").alias("kept")), ranks).withColumnRenamed("kept", "ids")
    return short.unionByName(back)


def decode(spark: SparkSession, coded: DataFrame, ranks: bytes) -> DataFrame:
    """The rows of coded with `ids` replaced by `decoded`, the joined bytes of their tokens (null: null)."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(ranks)
    kept = [c for c in coded.columns if c != "ids"]

    def run(batches):
        get = token_bytes(read_ranks(shared.value)).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = [None if x is None else b"".join(map(get, x)) for x in (v.values.to_numpy().tolist() if v.is_valid else None for v in b.column("ids"))]
                yield pa.record_batch([*(b.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "decoded"])

    schema = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in kept)
    return coded.select(*kept, "ids").mapInArrow(run, f"{schema}, decoded binary")


def _digests() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of ids and decoded."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def tokens(spark: SparkSession, docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the digests of digests()."""
    coded = encode(spark, docs, ranks, pattern, decoded=True)
    return coded.select("doc_id", F.col("ids").alias("token_ids"), *_digests())


def digests(spark: SparkSession, docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    coded = encode(spark, docs, ranks, pattern, decoded=True)
    return coded.select("doc_id", *_digests())


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
