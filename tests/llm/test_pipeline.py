import hashlib
import random
import sys
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from quillspark.llm.bpe import Encoder, load_ranks


def tables(spark, path):
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("", "n", "r", "th", "lor", "vem", "dis")]
    bench = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(5)]
    docs = []
    for i in range(300):
        words = rng.choices(vocab, k=rng.randint(60, 150))
        if i % 10 == 3:
            words[20:20] = bench[i % 5][1].split()
        if i % 10 == 7:
            words[5:5] = ["token", "=", '"0123456789abcdef0123456789ab"']
        text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)) + "."
        if i % 6 == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
    docs += [(1000 + i, docs[i * 4][1], "en", "s0", docs[i * 4][4]) for i in range(20)]
    for i in range(12):  # near copies: one word of about a hundred is another
        words = docs[i * 10 + 1][1].split()
        words[len(words) // 2] = "changed"
        docs.append((3000 + i, " ".join(words), "en", "s0", 0))
    docs += [(2000, None, "en", "s0", 0), (2001, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 5 else 1, 0) for i in range(0, 300) if i % 7 < 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, bench


def shingles(text):
    """Runs of five words, A-Z in lower case."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(x, y):
    return not (x or y) or len(x & y) >= 0.8 * len(x | y)


def test_every_stage_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    docs, bench = tables(spark, path)
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = now.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{path}/stage{i}")
        now = spark.read.parquet(f"{path}/stage{i}")
        kept.append({r["doc_id"]: r for r in now.collect()})

    # quality: shouting goes, all else stays (texts without words may go either way)
    assert {i for i in kept[0] if i < 2000} == {d[0] for d in docs if d[0] < 2000 and (d[0] % 6 != 5 if d[0] < 1000 else (d[0] - 1000) * 4 % 6 != 5)}
    # near-duplicates: the smallest doc_id that links reach
    sets = {i: shingles(r["text"]) for i, r in kept[0].items()}
    root = {i: i for i in sets}
    ids, changed = sorted(sets), True
    linked = [(a, b) for a in ids for b in ids if a < b and similar(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert set(kept[1]) == set(root.values()) and not any(1000 <= i < 2000 or i >= 3000 for i in kept[1])
    assert sum(similar(sets[a], sets[b]) and kept[0][a]["text"] != kept[0][b]["text"] for a, b in linked) >= 8
    # decontamination: the item's words are gone, the others' texts are as they were
    for i, r in kept[2].items():
        words = " ".join((r["text"] or "").lower().replace(".", " ").split())
        assert not any(t in words for _, t in bench)
        if i % 10 != 3:
            assert r["text"] == kept[1][i]["text"]
    assert set(kept[2]) == set(kept[1])
    # secrets
    for i, r in kept[3].items():
        assert "0123456789abcdef" not in (r["text"] or "") and ("[SECRET]" in (r["text"] or "")) == ("0123456789abcdef" in (kept[2][i]["text"] or ""))
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    # tokens
    enc = Encoder(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    for i, r in kept[4].items():
        text = kept[3][i]["text"] or ""
        want = whole.encode_ordinary(text)
        assert list(r["token_ids"]) == want and r["n_tokens"] == len(want)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()) == sorted(kept[4])


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, names that the stages use themselves, and empty tables."""
    path = str(tmp_path)
    tables(spark, path)
    plain = "some words of a plain text that is long enough to be kept here, with token = 0123456789abcdef0123456789ab inside"
    rows = [(1, plain), (1, plain), (1, "another text under the same id, which says other things"), (None, plain), (None, None), (2, None), (3, ""), (4, "x" * 50_000 + " " + plain), (5, "word " * 20_000)]
    names = ["kind", "row", "spans", "items", "body", "c", "key", "KEPT_ID", "score", "starts", "node", "ids", "root", "tie"]
    kinds = ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, None, None, None, *[n if i else None for n in names]) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = k == len(corpus_pipeline.STAGES) - 1
        out = stage(spark, docs, path)
        got = out.collect()
        assert last or out.columns == docs.columns
        assert len(got) == (len(rows) if k in (3, 4) else len(got)) and len(got) <= len(rows)
        if not last:
            assert all(r[n] == (n if r["doc_id"] else None) for r in got for n in names)
        assert stage(spark, docs.limit(0), path).count() == 0
    near = corpus_pipeline.STAGES[1][1](spark, docs, path).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in near) == [(0, ""), (0, "some wo"), (1, "another"), (1, "some wo"), (2, ""), (5, "word wo")]  # 4 is near 1
    secret = corpus_pipeline.STAGES[3][1](spark, docs, path).collect()
    assert sum("[SECRET]" in (r["text"] or "") for r in secret) == 4 and sum(r["text"] is None for r in secret) == 2
