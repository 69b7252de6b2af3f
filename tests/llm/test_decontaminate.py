import random

from quillspark.llm.decontaminate import SuffixAutomaton, automata, decontaminate, find_contamination, normal_words


def brute(words, items, window):
    hit, names = set(), set()
    for name, w in items:
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(name)
    return len(hit), sorted(names)


def test_automaton_against_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        vocab = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        items = [(f"i{k}", rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 5, 9]))) for k in range(rng.randint(1, 6))]
        a = SuffixAutomaton(items, 4)
        for _ in range(6):
            words = rng.choices([*vocab, b"z"], k=rng.randint(0, 25))
            spans, found = a.match(words)
            assert (sum(e - s for s, e in spans), sorted(a.names[i] for i in found)) == brute(words, items, 4)


def test_operator_and_cut(spark):
    items = [(1, "One two THREE four five six seven eight nine ten eleven"), (2, "short item"), (3, "!!"), (4, None), (10, "one two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = "Start: one, two three-four five six seven eight nine ten; eleven end"
    docs = [(1, text, 3), (2, None, 3), (3, "", 3), (None, "a short  item here", 3), (4, "clean words only", 3), (5, "one two three four five six seven eight nine ten", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in find_contamination(spark, df, bench).collect()}
    assert got == {1: (13, 11, ["1", "10"]), 2: (0, 0, []), 3: (0, 0, []), None: (4, 2, ["2"]), 4: (3, 0, []), 5: (10, 10, ["1", "10"])}
    left = {r["doc_id"]: r["text"] for r in decontaminate(spark, df, bench, coverage=0.9).collect()}
    assert left == {1: "Start:  end", 2: None, 3: "", None: "a  here", 4: "clean words only"}
    assert find_contamination(spark, df.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in find_contamination(spark, df, bench.limit(0)).collect()} == {0}
    assert normal_words("A_b é9") == [b"a", b"b", "é9".encode()]


def test_several_automata_give_what_one_gives(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [(f"i{k:02}", " ".join(rng.choices(vocab, k=rng.choice([0, 3, 12, 14])))) for k in range(24)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [" ".join(rng.choices(vocab, k=15) + rng.choice(items)[1].split() + rng.choice(items)[1].split() + rng.choices(vocab, k=rng.randint(0, 9))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, None, 7, "y")], "doc_id long, text string, __spans int, items string")
    sizes = [(len(a.names), last) for a, last in automata(bench, 10, 60)]
    assert len(sizes) >= 3 and [x for _, x in sizes] == [False] * (len(sizes) - 1) + [True] and sum(n for n, _ in sizes) == sum(bool(t) for _, t in items)
    one, many = (sorted(map(str, find_contamination(spark, docs, bench, most=m).collect())) for m in (10**6, 60))
    assert one == many and any("n_hit=0" not in x for x in one)
    one, many = (sorted(map(str, decontaminate(spark, docs, bench, most=m).collect())) for m in (10**6, 60))
    assert one == many


def test_an_automaton_is_of_bounded_size():
    import pickle

    rng = random.Random(9)
    items = [(str(k), [b"w%d" % rng.randrange(3000) for _ in range(50)]) for k in range(100)]
    a = SuffixAutomaton(items)
    assert len(a.link) <= 2 * 5000 and len(a.edge) <= 3 * 5000
    assert len(pickle.dumps(a)) < 100 * 5000


def test_items_longer_than_an_automaton(spark):
    """An item of many words is cut; no window of it is lost, nor made up."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(40)}" for _ in range(150)]
    items = [("long", " ".join(words)), ("short", "w1 w2"), (None, " ".join(words[40:60]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    made = [a for a, _ in automata(bench, 10, 30)]
    assert len(made) >= 5 and max(len(a.link) for a in made) <= 2 * 60 + 2
    texts = [" ".join(["x"] * (i % 3) + words[i : i + 10 + i % 4]) for i in range(0, 140, 7)] + [" ".join(words), "w1 w2 x w2 w1", "", " ".join(words[5:14])]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumnRenamed("row", "doc_id")
    known = [("long", items[0][1].split()), ("short", ["w1", "w2"]), ("", items[2][1].split())]
    for r in find_contamination(spark, docs, bench, most=30).collect():
        assert (r["n_hit"], r["items"]) == brute(texts[r["doc_id"]].split(), known, 10), texts[r["doc_id"]]


def test_several_passes_write_spans_only(spark, monkeypatch):
    """Texts are written once, whatever the number of automata; each pass writes rows that it hits."""
    from quillspark.llm import decontaminate as d

    written = {}

    class Seen(d.Workspace):
        def table(self, name, df):
            out = super().table(name, df)
            written[name] = (out.columns, out.count())
            return out

    monkeypatch.setattr(d, "Workspace", Seen)
    words = [f"w{i}" for i in range(90)]
    bench = spark.createDataFrame([(k, " ".join(words[k * 30 : k * 30 + 30])) for k in range(3)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i * 3 : i * 3 + 12]), i) for i in range(26)] + [(99, "clean", 0)], "doc_id long, text string, row int")
    found = {r["doc_id"]: r["n_hit"] for r in find_contamination(spark, docs, bench, most=20).collect()}
    assert found[0] == 12 and found[99] == 0
    assert written["numbered"][1] == 27 and all(c == ["row", "spans", "items"] and n < 27 for k, (c, n) in written.items() if k.startswith("hits")) and len(written) >= 4
