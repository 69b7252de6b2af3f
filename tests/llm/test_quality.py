import random

from quillspark.llm.quality import estimate_prior, keep_good, learnable, op10_quality_classifier, score, train


def is_good(i):
    return i * 7 % 19 > 4


def corpus():
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        good = is_good(i)
        words = rng.choices(vocab, k=rng.randint(20, 120))
        if good:
            text = ". ".join(" ".join(words[j : j + 8]).capitalize() for j in range(0, len(words), 8)) + "."
        else:
            text = rng.choice([" ".join(w + "&&&" for w in words), " ".join([words[0]] * 80), " ".join(w.upper() + "!!" for w in words)])
        docs.append((i, text, i))
        if i % 2:
            labels.append((i, 1 if good else 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (2000, None, 1), (2001, "", 1), (None, docs[1][1], 1)], "doc_id long, text string, kind int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = train(spark, df, learnable(lab, 5, 0))
    got = {r["doc_id"]: r["score"] for r in score(spark, df, model).collect()}
    wrong = [i for i, _, _ in docs if (got[i] >= 0.3) != is_good(i)]
    assert len(wrong) <= 9
    assert 0 <= got[2000] == got[2001] <= 1 and got[None] == got[1]
    kept = keep_good(spark, df, model)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id < 2000").collect()) == [i for i, _, _ in docs if got[i] >= 0.3]
    assert score(spark, df.limit(0), model).count() == 0


def test_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert score(spark, df, train(spark, df, none)).first()["score"] == 0.5
    one = spark.createDataFrame([(1, 1), (1, None), (2, 0)], "doc_id long, quality int")
    assert abs(score(spark, df, train(spark, df, one)).first()["score"] - 0.5) < 1e-9


def test_prior_and_fit_without_negative_labels(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, kind int")
    true = sum(is_good(i) for i, _, _ in docs) / len(docs)
    # only some of the good are labelled, none of the bad: the labels' own share would be 1
    biased = spark.createDataFrame([(i, q) for i, q in labels if q and i % 4 == 1], "doc_id long, quality int")
    model = train(spark, df, biased)
    unlabelled = [i for i, _, _ in docs if not (is_good(i) and i % 4 == 1)]
    assert abs(model.prior - sum(map(is_good, unlabelled)) / len(unlabelled)) < 0.12 and true < 1
    got = {r["doc_id"]: r["score"] for r in score(spark, df, model).collect()}
    assert sum((got[i] >= 0.3) != is_good(i) for i, _, _ in docs) <= 18


def test_prior_of_known_mixtures():
    import numpy as np

    rng = np.random.default_rng(4)
    draw = lambda n, good: rng.normal(size=(n, 3)) + (np.array([2.5, 0, 0]) if good else 0)
    for true in (0.2, 0.5, 0.8):
        n = int(4000 * true)
        got = estimate_prior(draw(3000, True), np.concatenate([draw(n, True), draw(4000 - n, False)]))
        assert abs(got - true) < 0.06, (true, got)


def test_query_columns_and_held_out_accuracy(spark):
    import zlib

    rows = {r["doc_id"]: r for r in op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality IS NOT NULL").collect()
    out = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(rows[r["doc_id"]]["held_out"] for r in out) and all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert sum(rows[r["doc_id"]]["predicted"] == r["quality"] for r in out) >= 0.95 * len(out) > 0


def plain_features(text):
    """The features of one text, by loops and sets."""
    import math

    raw = (text or "").encode()
    n, space = len(raw), b" \t\n\x0b\x0c\r"
    words = bytes(0x20 if b in space else b for b in raw).split(b" ")
    words = [w for w in words if w]
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda k, of: k / max(of, 1)
    count = lambda members: share(sum(b in members for b in raw), n)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    letter = lambda b: 0x61 <= b | 0x20 <= 0x7A or b >= 0x80
    return [
        math.log1p(len(words)), math.log1p(n), share(sum(map(len, words)), len(words)), count(range(0x41, 0x5B)), count(range(0x30, 0x3A)), count(b"!"), count(b"#$%&*@^~<>{}\\=+"), count(b"|"), count(b"."), count(b","),
        count(b"\n"), count(range(0x80, 0x100)), share(sum(x == y for x, y in zip(words, words[1:])), len(words)), share(len(set(words)), len(words)), (len(set(threes)) / len(threes) if threes else 1.0) * (n > 0),
        share(sum(0x41 <= w[0] <= 0x5A for w in words), len(words)), share(sum(len(w) == 1 for w in words), len(words)), share(len(lines) - len(set(lines)), len(lines)), math.log1p(len(lines)), share(sum(not letter(w[-1]) and w[-1] not in b".," for w in words), len(words)),
    ]


def test_query_against_a_plain_fit(spark):
    """Every score of the query is that of a model fitted on features that plain loops took from the same rows."""
    import math
    import zlib

    import numpy as np

    from quillspark.llm.quality import fit_nnpu

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    x = {i: np.array(plain_features(t)) for i, t in docs.items()}
    order = lambda a: a[np.lexsort(a.T)]
    p = order(np.stack([x[i] for i, q in labels.items() if q == 1 and i in x]))
    u = order(np.stack([x[i] for i in docs if i not in labels]))
    model = fit_nnpu(p, u, estimate_prior(p, u))
    rows = op10_quality_classifier(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        z = (x[r["doc_id"]] - model.mean) / model.scale
        want = 1 / (1 + math.exp(-float(model.logit(x[r["doc_id"]][None])[0])))
        assert abs(r["score"] - want) < 1e-6 and np.isfinite(z).all()


def test_repeated_ids_and_named_columns(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, kind int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    # an id that stands many times is learnt from once, by the text of the least hash
    more = df.unionByName(df.filter("doc_id = 1")).unionByName(df.filter("doc_id = 1")).repartition(3)
    one, many = train(spark, df, lab), train(spark, more, lab)
    assert one.prior == many.prior and (one.weights == many.weights).all()
    got = score(spark, df.limit(3), one, "kind").collect()
    assert all(r["kind"] == r["doc_id"] for r in got) and score(spark, df, one, "kind", "score").columns == ["doc_id", "score", "kind"]
