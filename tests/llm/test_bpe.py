import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from quillspark.llm.bpe import Encoder, decode, digests, encode, load_ranks, stitch

RANKS = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENC = Encoder(RANKS, public_tokenizers.PATTERN)
WHOLE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})


def test_stitching_gives_the_pieces_of_the_whole_text():
    rng = random.Random(3)
    parts = ["a", "b", "é", " ", "  ", "\n", "\n\n", "12", "'s", "!!", "word", "\t", "''", "x" * 30, " " * 25, "中文"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(30, 120)))
        size, over = rng.choice([(16, 4), (20, 12), (8, 2)])
        n = max(1, -(-len(text) // size))
        chunks = [text[i * size : (i + 1) * size + over] for i in range(n)]
        got = [p for c in stitch([(c, ENC.starts(c)) for c in chunks], size, ENC.pattern) for p in c]
        assert got == regex.findall(public_tokenizers.PATTERN, text), text


def test_encoding_matches_the_library_and_decodes(spark):
    texts = [None, "", "hello world's  end\n\nx", "é中 " * 400, "a" * 5000, "<|endoftext|> 1234", "word " * 900 + "\n\n" + " " * 700 + "end", " 　 x"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(6, texts[6], "y"), (None, "null id " * 300, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = encode(spark, docs, RANKS, public_tokenizers.PATTERN, chunk=512, overlap=32)
    got = sorted(((r[0] if r[0] is not None else -1), tuple(r[1])) for r in coded.collect())
    want = sorted(((i if i is not None else -1), tuple(WHOLE.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert got == want
    back = {r["doc_id"]: bytes(r["decoded"]) for r in decode(spark, coded, RANKS).collect()}
    assert back[3] == texts[3].encode() and back[0] == b"" and back[4] == texts[4].encode()


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = digests(spark, docs, RANKS, public_tokenizers.PATTERN).first()
    ids = WHOLE.encode_ordinary("some words")
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(b"some words").hexdigest() and row["n_tokens"] == len(ids)
    assert digests(spark, docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_small_chunks_of_all_kinds_of_text(spark):
    """Stitches in the overlap, stitches of the whole text, and contractions that a chunk's end cuts."""
    rng = random.Random(14)
    parts = ["a", "b", "é", " ", "  ", "\n", "\n\n", "12", "'s", "'ll", "we've", "!!", "word", "\t", "''", "x" * 30, " " * 25, "中文", "😀"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(5, 90)))) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, tuple(WHOLE.encode_ordinary(t))) for i, t in rows]
    for chunk, overlap in ((24, 12), (40, 20), (16, 6)):
        assert sorted((r[0], tuple(r[1])) for r in encode(spark, df, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()) == want, chunk


def test_a_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choices(["word", "zwölf", "中文", "can't", "1234", "x" * 50, "\n\n"], k=250_000))
    df = spark.createDataFrame([(1, text), (2, "y" * 40_000 + " " * 40_000 + text[:70_000])], "doc_id long, text string")
    got = {r[0]: r[1] for r in encode(spark, df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1] == WHOLE.encode_ordinary(text) and got[2] == WHOLE.encode_ordinary("y" * 40_000 + " " * 40_000 + text[:70_000])


def test_query_against_the_library(spark):
    from quillspark.llm.bpe import op6_bpe_round_trip

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = WHOLE.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_a_task_of_the_round_trip_has_one_worker(spark):
    """No Python step reads another one's rows in the same task, in the query and in the pipeline."""
    from corpus_pipeline import tokens_stage
    from quillspark.llm.bpe import op6_bpe_round_trip

    folder = "/root/testdata/sf0.001"
    for df in (op6_bpe_round_trip(spark, folder), tokens_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)):
        open_, most, seen = [df._jdf.queryExecution().sparkPlan()], 0, 0  # before exchanges
        while open_:
            node = open_.pop()
            below = [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "MapInArrow":
                seen += 1
                while below and below[0].nodeName() in ("Project", "Filter"):
                    below = [below[0].children().apply(0)]
                most += below[0].nodeName() in ("MapInArrow", "Union")
            open_ += below
        assert seen >= 2 and not most


def test_decoded_ids_of_short_and_long_texts(spark):
    texts = [None, "", "hello world's  end\n\nx", "é中 " * 400, "a" * 5000, "word " * 900 + "\n\n" + " " * 700 + "end", "word " * 900]
    rows = [*enumerate(texts), (6, texts[6]), (None, "null id " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = encode(spark, docs, RANKS, public_tokenizers.PATTERN, chunk=512, overlap=32, decoded=True)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["decoded"]), tuple(r["ids"])) for r in coded.collect())
    assert got == sorted((-1 if i is None else i, (t or "").encode(), tuple(WHOLE.encode_ordinary(t or ""))) for i, t in rows)
