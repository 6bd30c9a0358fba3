import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from partloom.llm import queries, repeats


def brute(texts, least):
    """Per text: (bytes, removed, runs, sha256 of the rest)."""
    raw = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - least + 1):
            if c[b[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        rest = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((len(b), len(b) - len(rest), int((np.diff(gone.astype(np.int8)) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], 200), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_repeated_passages(spark, sf).collect()}
    assert got == want


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, base = line(60), line(150)
    texts = [f"{line(rng.randint(3, 40))} {common} {line(rng.randint(3, 40))}" for _ in range(60)]
    for _ in range(40):
        w = base.split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    cut = rng.randint(0, 20)
    texts += [common[cut : cut + n] for n in (180, 190, 199, 200, 201)]
    texts += ["aaaa" * 120, "ab" * 300, line(50), line(50) * 2, None, "", "x", line(120), texts[0], texts[70], texts[70]]
    return texts


@pytest.mark.parametrize("hot", [512, 3])
def test_planted_and_hot(spark, hot):
    texts = corpus(hot)
    df = spark.createDataFrame([(i // 2 if i > 100 else None, i, t, "k") for i, t in enumerate(texts)], "doc_id long, n int, text string, kid string")
    got = repeats.remove(df, 200, hot, keep=["n"]).collect()
    assert {r.n: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == dict(enumerate(brute(texts, 200)))


def test_edges(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    texts = [long, long[1000:1500] + "!", "tail", long[250_000:250_300]]
    monkeypatch.setattr(repeats, "CHUNK", 1 << 16)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_removed, [tuple(s) for s in r.spans]) for r in repeats.remove(df).collect()}
    assert got == {0: (800, [(1000, 1500), (250_000, 250_300)]), 1: (500, [(0, 500)]), 2: (0, []), 3: (300, [(0, 300)])}
    assert repeats.remove(df.limit(0)).collect() == []
    same = spark.createDataFrame([(7, "y" * 250, 3, "a")] * 2 + [(8, "z" * 150, 3, "a")], "doc_id long, text string, n_chars int, row string")
    assert sorted(tuple(r) for r in repeats.trim(same).collect()) == [(7, "", 0, "a")] * 2 + [(8, "z" * 150, 150, "a")]
    assert repeats.trim(same).columns == same.columns


def test_frequent_anchors_and_rows_alike(spark, monkeypatch):
    """One passage in many texts, one anchor with many segments, and rows that repeat id and text, ids null too."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, gram = line(70), "0123456789 all rights reserved !!"
    texts = [f"{line(20)} {common} {line(20)}" for _ in range(150)]
    texts += [f"{line(12)} {gram} {line(12)}" for _ in range(200)]
    texts += [texts[3]] * 60 + [None] * 80 + ["short"] * 30
    ids = [i if i < 350 else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, n int, text string")
    want = dict(enumerate(brute(texts, 200)))
    for salts in (1, 64):
        monkeypatch.setattr(repeats, "SALTS", salts)
        got = repeats.remove(df, keep=["n"]).collect()
        assert {r.n: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == want


def test_other_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "q" * 450), (2, "tail")], "doc_id long, text string").selectExpr("*", "map('k', doc_id) AS `row`", "1 AS `a.b`", "2 AS kid", "3 AS cuts", "4 AS `c``0`", "9 AS n_chars")
    got = repeats.trim(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "" and rows[2].text == "tail" and rows[2]["row"] == {"k": 2} and rows[1]["a.b"] == 1 and rows[1].n_chars == 0 and rows[2]["c`0"] == 4


def test_strings_of_equal_polynomial_hash(spark):
    """Two strings that the hash of textvec cannot tell apart, found by lattice reduction: nothing repeats, nothing goes."""
    from partloom.llm.textvec import prefix, span

    start = ("0123456789" * 20)[:178]
    pair = [start + "k" * 22, start + "kmikmhhinnlnlnlkkhokoi"]
    hashes = [span(prefix(np.frombuffer(t.encode(), np.uint8)), np.array([0]), np.array([200]))[0] for t in pair]
    assert hashes[0] == hashes[1]
    for texts in (pair, [*pair, pair[0]], [t + f" {i}" for i, t in enumerate(pair * 3)]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for hot in (256, 1):
            got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove(df, 200, hot).collect()}
            assert got == dict(enumerate(brute(texts, 200)))
