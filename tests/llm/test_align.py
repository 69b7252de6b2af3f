import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import align

FILES = align.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = align.byte_letters()


def spans(text):
    """(start, end, id) of both sides by the libraries on the whole text, or None."""
    if not text:
        return None
    want, sides = (" " + text).encode(), []
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    for side in (a, b):
        if b"".join(x for _, x in side) != want:
            return None
        at, out = 0, []
        for i, x in side:
            out.append((at, at + len(x), i))
            at += len(x)
        sides.append(out)
    return sides


def brute(rows):
    """Every pair of tokens is compared."""
    links, groups, counts = [], [], Counter()
    for _, text in rows:
        s = spans(text)
        a, b = s or ([], [])
        own = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(own)
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        part = lambda side, lo, hi: ",".join(str(x[2]) for x in side if lo < x[1] <= hi)
        groups.append([f"{part(a, lo, hi)}|{part(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)])
        links.append((len(a), len(b), own))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (doc_id, _), (n_a, n_b, own), g in zip(rows, links, groups):
        out.append((doc_id, n_a, n_b, len(g), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(8)
    parts = ["word", "the", " ", "  ", "\n", " \n ", "\t", "don't", "naïve", "中文字", "é", "1234", "!?", "▁", "<|endoftext|>", "\x00", "\x1c", "　", " ", "😀", "x" * 40, "<0x41>", "</s>", "ﬁ"]
    rows = [(i, " ".join(rng.choices(parts[:2] + parts[7:10] + parts[11:13], k=rng.randint(1, 30)))) for i in range(40)]
    rows += [(100 + i, "".join(rng.choices(parts, k=rng.randint(1, 25)))) for i in range(160)]
    clean = [p for p in parts if p != "▁"]
    rows += [(300 + i, "".join(rng.choices(clean, k=rng.randint(1, 25)))) for i in range(160)]
    return [*rows, (500, None), (501, ""), (502, " "), (503, "  "), (504, "a "), (505, " a"), (506, "a\n b"), (507, "a \n"), (1, "again the word"), (None, "the word"), (None, None)]


def test_against_every_pair_of_tokens(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pair int").repartition(3)
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 200 and sum(r[1] == 0 for r in want) > 20
    for most in (2_000_000, 60, 0):  # all pairs broadcast, some, none
        got = sorted((tuple(r) for r in align.summaries(spark, df, FILES, most).collect()), key=repr)
        assert got == want, most


def test_small_memory(spark, monkeypatch):
    rows = texts()
    tools, seen = align.Tokenizers(*FILES), []
    memory = align.Memory(tools)
    for run in (3, 1 << 16):
        monkeypatch.setattr(align, "RUN", run)
        memory.clear()
        at, starts = memory.index([t for _, t in rows])
        seen.append(["".join(memory.texts[u] for u in at[i:j]) for i, j in zip(starts, starts[1:])])
    assert seen[0] == seen[1]


def test_groups_and_products(spark):
    df = spark.createDataFrame([(1, "tokenization matters"), (2, None), (3, "▁")], "doc_id long, text string")
    found = align.groups(spark, df, FILES)
    rows = sorted(found.collect())
    a, b = spans("tokenization matters")
    assert [i for r in rows for i in r["a_ids"]] == [x[2] for x in a] and [i for r in rows for i in r["b_ids"]] == [x[2] for x in b]
    assert [r["end"] for r in rows] == sorted({x[1] for x in a} & {x[1] for x in b}) and {r["doc_id"] for r in rows} == {1}
    assert align.products(found).count() == sum(len(r["a_ids"]) * len(r["b_ids"]) for r in rows)


def test_empty_table(spark):
    assert align.summaries(spark, spark.createDataFrame([], "doc_id long, text string"), FILES).count() == 0


def test_query_against_every_pair(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in align.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    counts, own = Counter(), {}
    for doc_id, text in rows:
        s = spans(text)
        a, b = s or ([], [])
        i = j = 0
        pairs = []
        while i < len(a) and j < len(b):  # overlaps in order
            pairs.append((a[i][2], b[j][2]))
            end_a, end_b = a[i][1], b[j][1]
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        own[doc_id] = (len(a), len(b), pairs)
        counts.update(pairs)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    for doc_id, (n_a, n_b, pairs) in own.items():
        r = got[doc_id]
        assert (r["n_a"], r["n_b"], r["n_links"]) == (n_a, n_b, len(pairs))
        assert r["n_best"] == sum(counts[p] == most[p[1]] for p in pairs) and r["count_sum"] == sum(counts[p] for p in pairs)
