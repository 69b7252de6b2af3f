"""Secret scan: fixed patterns, and a guess-cost dynamic programme over credential values.

The programme splits a value into words, dates, repeats, keyboard walks and brute-force
spans so that the sum of their log10 guesses is least. A value that stands in a
credential context and still costs many guesses is a secret; `changeme2020` is not.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from base64 import b64decode
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import fill, prepare, slices, text_rows

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Contexts in which a whole value is judged by its guess cost: those of ASSIGN, further ones, and `Bearer <value>`.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|secret|token|api[_-]?key|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|auth|authorization|credentials?|(?:private|access|signing)[_-]?key|bearer))["']?\x20*[:=]\x20*["']?(?:(?:bearer|basic|digest|token)\x20+)?"""
    r"""|(?<![A-Za-z0-9])bearer\x20+["']?(?=[^\s"']*[0-9]))(?=[^\s"']{6})""",
    re.I | re.A,
)
#: Where a value ends; what closes a clause or bracket around an unquoted one is not of it.
END, CLOSING = re.compile(r"""[\s"']"""), ",;)]}>"
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
CONTEXT_HINTS = ("pwd", "pass", "pin", "auth", "credential", "key", "bearer", "secret", "token")
#: log10 guesses from which a value in a credential context counts as a secret.
LEAST_COST = 12.0

# Common words of passwords, most common first.
WORDS = (
    "password 123456 qwerty admin welcome login letmein monkey dragon master hello freedom shadow sunshine princess "
    "football baseball michael superman batman iloveyou trustno1 starwars whatever changeme default secret test guest "
    "user root example sample placeholder none null true false your here value string token key pass word abc xxx my "
    "the and for this that with from app api dev prod local host server client db database service system config env "
    "summer winter spring autumn january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday love home work name temp demo public private access"
).split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Walks and repeats of more characters than this count only at this length, below it, or whole; values up to it are remembered.
SPAN, REMEMBERED = 64, 100_000
_PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
#: A year, a year and month, or a date with the year first or last; each may be any part of a value.
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)
DATE_SIZES = range(4, 11)


def vocabulary_words(path: str) -> list[str]:
    """The words of WORDS, then those of a rank file (base64 token and rank a line), most frequent first.

    Words are tokens of three or more letters a-z, A-Z lower-cased, with or without a blank before.
    """
    with open(path, "rb") as f:
        tokens = (b64decode(line.split()[0]).strip() for line in f if line.strip())
        words = [t.decode().lower() for t in tokens if len(t) >= 3 and t.isascii() and t.isalpha()]
    return list(dict.fromkeys([*WORDS, *words]))


def _brute(c: str) -> float:
    # mixed case makes 52 letters: the doubling of both cases is laid on the upper one
    return 1.0 if c.isdigit() else math.log10(104) if "A" <= c <= "Z" else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def _walks(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q) and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


class Guesser:
    """Guess costs of values by a ranked list of words; remembers the costs of short values."""

    def __init__(self, words=WORDS):
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)
        self.known: dict[str, float] = {}

    def cost(self, value: str) -> float:
        if (got := self.known.get(value)) is None:
            got = self.least(value)
            if len(value) <= SPAN:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[value] = got
        return got

    def spans(self, value: str):
        """(start, end, log10 guesses) of every span that may be part of a segmentation, by start.

        Every single character, word, date, and every part of a keyboard walk (three keys or
        more) or of a repeated block of one to three characters (twice or more), up to SPAN
        characters long or running to its end.
        """
        if value.isupper():  # of one case: as many as in lower case
            value = value.lower()
        low, n = value.lower(), len(value)
        if len(low) != n:  # a letter whose lower case is longer
            low = value
        walk = [1] * (n + 1)
        for i in range(n - 2, -1, -1):
            if _walks(low[i], low[i + 1]):
                walk[i] = walk[i + 1] + 1
        same = {k: [0] * (n + 1) for k in (1, 2, 3)}
        for k, run in same.items():
            for i in range(n - k - 1, -1, -1):
                run[i] = run[i + 1] + 1 if low[i] == low[i + k] else 0
        for i in range(n):
            yield i, i + 1, _brute(value[i])
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if (rank := self.rank.get(low[i:j])) is not None:
                    yield i, j, rank + (0.3 if value[i:j] != low[i:j] else 0.0) + 0.3
            if value[i] in "0123":
                for j in range(i + DATE_SIZES.start, min(n, i + DATE_SIZES.stop - 1) + 1):
                    if DATE.fullmatch(value, i, j):
                        yield i, j, math.log10(365 * 119) if j - i > 4 else math.log10(119)
            for k, run in same.items():
                whole = run[i] + k
                if whole >= 2 * k:
                    block = sum(map(_brute, value[i : i + k]))
                    for size in {*range(2 * k, min(whole, SPAN) + 1), whole}:
                        yield i, i + size, block + math.log10(size / k)
            if walk[i] >= 3:
                for size in {*range(3, min(walk[i], SPAN) + 1), walk[i]}:
                    yield i, i + size, math.log10(47) + 0.6 * (size - 1)

    def least(self, value: str) -> float:
        """Least log10 guesses over all segmentations into spans; time is linear in the length."""
        best = [0.0] + [math.inf] * len(value)
        for i, j, cost in self.spans(value):  # by start: best[i] is final
            if best[i] + cost < best[j]:
                best[j] = best[i] + cost
        return best[len(value)]


_COMMON = Guesser()


def guess_cost(value: str) -> float:
    """Least log10 guesses by the words of WORDS alone."""
    return _COMMON.cost(value)


def find_spans(text: str, least: float = LEAST_COST, guesser: Guesser = _COMMON) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, cost) of all secrets in a text, by start, then kind as listed."""
    low, found = text.lower(), []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), 0, guesser.cost(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, None) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, None) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        base = sorted(x[:2] for x in found)
        reach, upto = list(accumulate((x[1] for x in base), max)), 0
        for m in CONTEXT.finditer(text):
            if (a := m.end()) < upto:  # inside the value before
                continue
            b = upto = e.start() if (e := END.search(text, a)) else len(text)
            if text[a - 1] not in "\"'":
                b = a + len(text[a:b].rstrip(CLOSING))
            within = bisect_right(base, (a, len(text)))
            # a base span that ends before the value does leaves its rest in the text
            if not (within and reach[within - 1] >= b) and (cost := guesser.cost(text[a:b])) >= least:
                found.append((a, b, 3, cost))
    return [(a, b, KINDS[k], c) for a, b, k, c in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


SPANS = "array<struct<kind:string,start:int,end:int,cost:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))


def scan(spark: SparkSession, docs: DataFrame, least: float = LEAST_COST, words=WORDS) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, guess cost) of every row.

    Kinds assign, access and hex are the fixed patterns; guess holds whole values of credential
    contexts whose guess cost by the ranked `words` is at least `least`, where no base span
    covers them. A null text is empty, without spans; rows with null or repeated doc_id each give a
    row; an empty table gives an empty result. Other columns are not read.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(tuple(words))  # a vocabulary is of fixed size

    def run(batches):
        guesser = Guesser(shared.value)
        for b in slices(batches, most=8 << 20):
            spans = [[{"kind": k, "start": s, "end": e, "cost": c} for s, e, k, c in find_spans(t, least, guesser)] for t in fill(b.column("text")).to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(spans, _TYPE)], ["doc_id", "spans"])

    return text_rows(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[SECRET]", least: float = LEAST_COST, words=WORDS) -> DataFrame:
    """The rows with every secret span of `text` replaced by a mark, and n_chars set anew.

    All columns of docs stay, in their order; a null text stays null. Overlapping spans are
    joined before they are replaced. Each row is judged for itself, repeated ones alike; an
    empty table gives an empty result.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(tuple(words))
    at, counted = docs.columns.index("text"), "n_chars" in docs.columns

    def cut(text, guesser):
        if text is None or not (spans := find_spans(text, least, guesser)):
            return text
        out, upto = [], 0
        for a, b, *_ in spans:
            if a >= upto:
                out += [text[upto:a], mark]
            upto = max(upto, b)
        return "".join([*out, text[upto:]])

    def run(batches):
        guesser = Guesser(shared.value)
        for b in slices(batches, most=8 << 20):
            yield b.set_column(at, b.schema.field(at), pa.array([cut(t, guesser) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if counted else out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    import public_tokenizers

    words = vocabulary_words(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=words)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(written(F.filter("spans", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
