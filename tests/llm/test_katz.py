import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import katz, queries

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


class Brute:
    """Katz over plain dictionaries."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), defaultdict(Counter)
        for t in texts:
            for v, w in zip(["begin", *t], t):
                self.c[w] += 1
                self.pairs[v][w] += 1
        self.total = sum(self.c.values())
        seen = lambda counts: [sum(1 for n in counts if n == r) for r in range(1, katz.LOW + 2)]
        self.d1 = katz.discounts(seen(self.c.values()))
        self.d2 = katz.discounts(seen([n for x in self.pairs.values() for n in x.values()]))
        self.whole, self.uni = self._share(self.c, self.d1)
        self.unknown = 1 - sum(self.uni.values()) if self.c else 1.0
        self.models = {}
        for v, x in self.pairs.items():
            _, share = self._share(x, self.d2)
            self.models[v] = share, (1 - sum(share.values())) / (1 - sum(self.uni[w] for w in x))

    @staticmethod
    def _share(counts, d):
        held = {w: n * (d[n] if n <= katz.LOW else 1.0) for w, n in counts.items()}
        total = sum(counts.values())
        total += sum(held.values()) >= total * (1 - 1e-12)
        return total, {w: x / total for w, x in held.items()}

    def p(self, w, v):
        share, weight = self.models.get(v, ({}, 1.0))
        return share[w] if w in share else weight * self.uni.get(w, self.unknown)

    def score(self, t):
        return sum(math.log10(self.p(w, v)) for v, w in zip(["begin", *t], t))

    def base(self, t):
        return sum(math.log10((self.c[w] + 1) / (self.total + len(self.c) + 1)) for w in t)


def check(rows, got):
    """rows: (id, held, text); ids may repeat."""
    model = Brute([tokens(t) for _, h, t in rows if not h])
    want = sorted(((i is not None, i or 0), h, len(t := tokens(x)), sum(w in model.c for w in t), model.total, model.base(t), model.score(t)) for i, h, x in rows)
    got = sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)
    return model


def test_whole_table(spark, sf):
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 == 2, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op12_katz_scoring(spark, sf)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    thin = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    model = check(rows, [tuple(r) for r in katz.perplexities(thin, F.col("held")).collect()])  # pairs; the query's triples: test_katz_orders.py
    held = [tokens(t) for _, h, t in rows if h]
    assert sum(map(model.score, held)) > sum(map(model.base, held))


def test_probabilities_sum_to_one(spark, sf):
    model = Brute([tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()])
    for v in ["begin", *list(model.pairs)[:200], b"never"]:
        total = sum(model.p(w, v) for w in model.c) + model.p(b"unheard of", v)
        assert total == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_cut_texts_hot_pairs_and_small_parts(spark, monkeypatch, seed):
    """Blocks of a few tokens, texts cut within, one context with a third of all pairs, many parts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["İ", "é", "the"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) if rng.random() < 0.6 else "the" for _ in range(rng.choice([0, 1, 3, 40, 700]))]
        rows.append((i // 2, rng.random() < 0.3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(None, False, "The END"), (5, True, None), (6, False, ""), (7, False, " \x0b "), (8, True, "x" * 5000), (8, False, "  " * 3000 + "w1")]
    monkeypatch.setattr(katz, "PART", 50)
    df = spark.createDataFrame(rows, "doc_id long, held boolean, text string").selectExpr("*", "1 AS row", "2 AS part", "3 AS id", "4 AS score")
    check(rows, [tuple(r) for r in katz.perplexities(df, F.col("held")).collect()])


def test_cutting_texts_changes_nothing():
    """The batch function alone, with small blocks: a token is counted once, and knows the word before it."""
    import pyarrow as pa

    texts = ["a b c d e f g", "", "  ", "hello " * 50, "q" * 300 + " z", None]
    cols = {"held": [False] * len(texts), "ids": list(range(len(texts)))}
    pairs = {}
    for block, cut in ((1 << 20, 1 << 22), (7, 8)):
        old = katz.BLOCK, katz.CUT
        katz.BLOCK, katz.CUT = block, cut
        try:
            found = Counter()
            batch = pa.RecordBatch.from_arrays([pa.array(cols["ids"]), pa.array(cols["held"]), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["id", "held", "text"])
            for b in katz.token_blocks([batch], 0):
                for i in range(b.num_rows):
                    words = b["words"][i].as_py()
                    local, doc, own, held, starts, opens = katz._layout(b, i)
                    before = [None, *local[:-1].tolist()]
                    for k, s in enumerate(starts[:-1].tolist()):
                        if opens[k] and s < len(before):
                            before[s] = None
                    ids = b["ids"][i].as_py()
                    for x, p, d, o in zip(local.tolist(), before, doc.tolist(), own.tolist()):
                        if o:
                            found[(b["row"][i].as_py() + d, ids[d], None if p is None else words[p], words[x])] += 1
            pairs[block] = found
        finally:
            katz.BLOCK, katz.CUT = old
    assert pairs[7] == pairs[1 << 20]
    assert sum(pairs[7].values()) == sum(len(tokens(t)) for t in texts)


def test_no_training_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in katz.perplexities(df, F.lit(True)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == got[1].train_tokens == 0 and got[1].score == got[1].base_score == 0
    assert katz.perplexities(df.limit(0), F.lit(False)).collect() == []


def test_discounts():
    d = katz.discounts([1000, 400, 220, 140, 100, 70])
    assert (0 < d[1:]).all() and (d[1:] < 1).all() and d[0] == 1
    assert katz.discounts([0] * 6).tolist() == [1, *((r - 0.5) / r for r in range(1, 6))]


def test_packing_of_numbers():
    for x in ([], [0, 255], [256], [1 << 20], [1 << 40]):
        assert katz.unpack(katz.pack(np.array(x, np.int64))).tolist() == katz.unpack(katz.pack(np.array(x, np.int64), True)).tolist() == x
