import hashlib
import itertools
import math
import random
import re

from quillspark.llm.secrets import Guesser, find_spans, guess_cost, op5_secret_scan, redact, scan, vocabulary_words


def base(text):
    out = []
    t = text or ""
    for k, (name, p, ok) in enumerate([
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if ok(m)]
    return [x[2] for x in sorted(out)]


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "api_key", "apikey", "ſecret", " = ", ": ", "=", '"', "'", "abc", "deadbeef" * 3, "0123456789abcdef" * 2, "AKIA", "ABCDEFGH12345678", "é中", " ", "\n", "x", "Token", "hunter2", "9", "pwd"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(400)] + [(900, None), (901, ""), (None, "password=abcdef1"), (902, 'pwd = "x9K#2mQv81ZtP"'), (903, "pwd: changeme2020")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]] for r in scan(spark, df).collect()}
    for i, t in rows:
        assert [x for x in got[i] if not x.startswith("guess")] == base(t), t
    assert got[902] == ["guess:7:20"] and got[903] == []
    assert scan(spark, df.limit(0)).count() == 0


def test_guess_costs():
    assert guess_cost("password1") < guess_cost("qwertyuiop1") < guess_cost("x9K#2mQv81Zt")
    assert guess_cost("aaaaaaaaaaaaaaaa") < 4 and guess_cost("2024-05-17") < 5.5 and guess_cost("") == 0
    assert guess_cost("abcabcabcabc") < guess_cost("abcdzfkqmvbx")


def test_guess_cost_is_least_over_all_segmentations():
    """Every cut of short values, each part priced by itself."""
    from quillspark.llm import secrets as S

    def part(v, low):
        found = [sum(map(S._brute, v))]  # brute force, a character at a time
        if low in S.Guesser().rank and len(v) >= 3:
            found.append(S.Guesser().rank[low] + 0.3 + 0.3 * (v != low))
        if re.fullmatch(r"(19|20)\d\d", v):
            found.append(math.log10(119))
        if re.fullmatch(r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])([-/.]?(0[1-9]|[12]\d|3[01]))?|(0[1-9]|[12]\d|3[01])[-/.]?(0[1-9]|1[0-2])[-/.]?(19|20)\d\d", v):
            found.append(math.log10(365 * 119))
        for k in (1, 2, 3):
            if len(v) >= 2 * k and all(low[i] == low[i - k] for i in range(k, len(v))):
                found.append(sum(map(S._brute, v[:k])) + math.log10(len(v) / k))
        if len(v) >= 3 and all(S._walks(x, y) for x, y in zip(low, low[1:])):
            found.append(math.log10(47) + 0.6 * (len(v) - 1))
        return min(found)

    def brute(v):
        n = len(v)
        return min(sum(part(v[a:b], v[a:b].lower()) for a, b in zip((0, *cut), (*cut, n))) for r in range(n) for cut in itertools.combinations(range(1, n), r))

    rng = random.Random(5)
    bits = ["asdf", "qwe", "hello", "Pass", "2019", "12", "aa", "abab", "x", "Z", "#", "1", "dfg", "0520", "lo", "key"]
    values = ["asdfghello", "aaab", "20190512", "1231234"] + ["".join(rng.choices(bits, k=4))[:11] for _ in range(60)]
    for v in values:
        if not v.isupper():
            assert abs(guess_cost(v) - brute(v)) < 1e-9, v
    assert guess_cost("asdfghello") < 5.5


def test_long_values_take_linear_time():
    assert guess_cost("a" * 50_000) < 8 and guess_cost("qwer" * 10_000) > 100
    g = Guesser()
    g.cost("x9" * 200)
    assert not g.known


def test_words_of_a_vocabulary():
    import public_tokenizers

    words = vocabulary_words(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert len(words) > 10_000 and words[0] == "password" and len(set(words)) == len(words)
    assert Guesser(words).cost("investigationmeeting") < guess_cost("investigationmeeting") / 2


def test_query_columns(spark):
    rows = op5_secret_scan(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("guess")] == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdef12 z", 5), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in redact(spark, df).collect())
    assert got == [(1, "a [SECRET] z", 12), (2, None, None), (3, "plain", 5)]
    assert not find_spans(got[0][1])


def test_whole_values_of_every_context():
    cases = [
        ('password = "', "$9xK!2mQv#81ZtP&wL", '"'), ("password: ", "Xk9#2mQv81ZtPqR7vb", ""), ("token=", "%9aKx#2mQv81ZtPqR", " and"),
        ('api-key: "', "x9K2mQv81ZtPqR7v", '"'), ("Authorization: Bearer ", "x9K2mQv81ZtPqR7v", ""), ("use Bearer ", "x9K2mQv81ZtPqR7v", "\n"),
        ('secret: "', "x9K2mQ#v81ZtP!77kLp", '"'), ("(db_password=", "x9K2mQ#v81ZtP!77kLp", "), ok"), ("private-key: ", "x9K2mQ#v81ZtP!77kLp", ","),
        ("pwd: ", "xKqZ2mQv", ""), ("pass: token: ", "Xk9#2mQv81ZtPqR7vb", ""),
    ]
    for before, value, after in cases:
        text = "a " + before + value + after
        at = len(before) + 2
        assert any(k == "guess" and (a, b) == (at, at + len(value)) for a, b, k, _ in find_spans(text)), text
    for text in ("password: changeme!2020!", "the bearer representatives came", "pwd = QWERTYUIOP", "token=#"):
        assert not any(k == "guess" for _, _, k, _ in find_spans(text)), text
    assert not any(k == "guess" for _, _, k, _ in find_spans('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'))


def test_redaction_leaves_no_rest_of_a_value(spark):
    df = spark.createDataFrame([(1, 'a secret: "x9K2mQ#v81ZtP!77kLp" z')], "doc_id long, text string")
    assert [r["text"] for r in redact(spark, df).collect()] == ['a [SECRET]" z']


def test_time_is_linear_in_nested_contexts():
    assert len(find_spans("pwd=" * 20_000 + "x9K2mQ#v81ZtP!77kLp")) == 1
