"""The recursion of op12 over contexts of two words, against plain dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partloom.llm import katz, queries

from .test_katz import Brute, tokens


class Recursive(Brute):
    """Katz of any order; a context that was never seen gives way to one that is a word shorter."""

    def __init__(self, texts, order):
        super().__init__(texts)
        self.order, self.levels = order, []
        for k in range(2, order + 1):
            grams = defaultdict(Counter)
            for t in texts:
                whole = ["begin", *t]
                for i in range(k - 1, len(whole)):
                    grams[tuple(whole[i - k + 1 : i])][whole[i]] += 1
            d = katz.discounts([sum(1 for x in grams.values() for n in x.values() if n == r) for r in range(1, katz.LOW + 2)])
            level = {}
            for context, x in grams.items():
                _, share = self._share(x, d)
                level[context] = share, (1 - sum(share.values())) / (1 - sum(self.at(w, context[1:]) for w in x))
            self.levels.append(level)

    def at(self, w, context):
        if not context:
            return self.uni.get(w, self.unknown)
        share, weight = self.levels[len(context) - 1].get(context, ({}, 1.0))
        return share[w] if w in share else weight * self.at(w, context[1:])

    def score(self, t):
        whole = ["begin", *t]
        return sum(math.log10(self.at(whole[i], tuple(whole[max(0, i - self.order + 1) : i]))) for i in range(1, len(whole)))


def check(rows, got, order):
    model = Recursive([tokens(t) for _, h, t in rows if not h], order)
    want = sorted(((i is not None, i or 0), h, len(t := tokens(x)), sum(w in model.c for w in t), model.total, model.base(t), model.score(t)) for i, h, x in rows)
    got = sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)
    return model


def test_query_asks_the_two_words_before(spark, sf):
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 == 2, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = check(rows, [tuple(r) for r in queries.op12_katz_scoring(spark, sf).collect()], 3)
    two = Brute([tokens(t) for _, h, t in rows if not h])
    t = next(tokens(t) for _, h, t in rows if not h and t and len(t.split()) > 20)
    assert model.score(t) > two.score(t)  # of a learned text triples know more
    assert Recursive([tokens(t) for _, h, t in rows[:40] if not h], 2).score(t) == pytest.approx(Brute([tokens(t) for _, h, t in rows[:40] if not h]).score(t))


def test_triples_sum_to_one(spark, sf):
    model = Recursive([tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()], 3)
    for context in [*list(model.levels[1])[:100], (b"never", b"the"), ("begin", b"never")]:
        assert sum(model.at(w, context) for w in model.c) + model.at(b"unheard of", context) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("part", [50, 500, 1 << 21])
@pytest.mark.parametrize("order", [2, 3])
def test_words_and_contexts_of_several_parts(spark, monkeypatch, part, order):
    """With small parts most words are dealt by what follows them, and "the the" is dealt itself."""
    rng = random.Random(part)
    vocabulary = [f"w{i}" for i in range(60)] + ["İ", "é", "the"]
    rows = [(i // 2, rng.random() < 0.3, " ".join(rng.choice(vocabulary) if rng.random() < 0.5 else "the" for _ in range(rng.choice([0, 1, 2, 3, 40, 700])))) for i in range(80)]
    rows += [(None, False, "The END"), (5, True, None), (6, True, "unheard the of the"), (7, False, " \x0b "), (8, True, "x y z x y z")]
    monkeypatch.setattr(katz, "PART", part)
    df = spark.createDataFrame(rows, "doc_id long, held boolean, text string")
    check(rows, [tuple(r) for r in katz.perplexities(df, F.col("held"), order=order).collect()], order)


def test_no_training_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert {(r.id, r.n_tokens, r.n_known, r.score) for r in katz.perplexities(df, F.lit(True), order=3).collect()} == {(1, 4, 0, 0.0), (2, 1, 0, 0.0)}
    assert katz.perplexities(df.limit(0), F.lit(False), order=3).collect() == []
    with pytest.raises(ValueError):
        katz.perplexities(df, F.lit(True), order=4)


def test_cut_texts_keep_both_words_before(monkeypatch):
    """Triples are the same however texts are cut; a piece of white space alone has none."""
    texts = ["a b c d e f g", "", "  ", "hello " * 50, "q" * 300 + " z", "x" + " " * 40 + "y z", " " * 40 + "y z", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["id", "held", "text"])
    found = []
    for block, cut in ((1 << 20, 1 << 22), (7, 8), (1, 1)):
        monkeypatch.setattr(katz, "BLOCK", block)
        monkeypatch.setattr(katz, "CUT", cut)
        seen, number = Counter(), {}
        for b in katz.token_blocks([batch], 0):
            words = b["words"][0].as_py()
            ranks = [number.setdefault(w, len(number) + 1) for w in words]
            ranks = pa.array([[katz.bundle(katz.pack(np.arange(len(ranks)), True), katz.pack(np.array(ranks, np.int64)))]], pa.list_(pa.binary()))
            b = pa.RecordBatch.from_arrays([*b.columns, ranks], names=[*b.schema.names, "ranks"])
            u, v, w, n, docs, doc, times = katz._block_grams(b, 0, 3)
            ids = b["ids"][0].as_py()
            name = {-1: None, 0: "begin"} | {k: x for x, k in number.items()}
            for k, d, x in zip(np.repeat(np.arange(len(v)), docs).tolist(), doc.tolist(), times.tolist()):
                seen[(ids[d], name[int(u[k])], name[int(v[k])], name[int(w[k])])] += x
            assert n.tolist() == np.add.reduceat(times, np.append(0, np.cumsum(docs)[:-1])).tolist() if len(n) else True
        found.append(seen)
    assert found[0] == found[1] == found[2]
    assert found[0][(0, b"e", b"f", b"g")] == 1 and found[0][(0, "begin", b"a", b"b")] == 1 and found[0][(5, "begin", b"x", b"y")] == 1
    assert sum(found[0].values()) == sum(len(tokens(t)) for t in texts)
