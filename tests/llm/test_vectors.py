import math
import random
from fractions import Fraction
from itertools import combinations

import duckdb
import numpy as np
import pytest

from partloom.llm import ann, queries, topk


def rows_of(df, names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("embeddings", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert set(want.columns) <= set(got.columns)
    assert rows_of(got, want.columns) == sorted(want.fetchall())


def brute_top(vectors, asked, k):
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    out = []
    for q in asked:
        if q in ok:
            best = sorted((-int(ok[q] @ x), i) for i, x in ok.items() if i != q and len(x) == len(ok[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


BAD = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0]), (905, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]


def test_top_ties_and_edges(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(3)]) for i in range(300)] + [(400, [1e5, -1e5, 1e5]), *BAD]
    df = spark.createDataFrame([(i, v, 5, 5) for i, v in vectors], "vec_id long, embedding array<double>, id int, v int")
    asked = [0, 3, 7, 400, 900, 902, 905]
    got = topk.search(df, df.where(df.vec_id.isin(asked)), k=5, block_rows=3)
    assert rows_of(got, ["query_id", "rank", "id", "score"]) == brute_top(vectors, asked, 5)
    few = df.where("vec_id < 3")
    assert rows_of(topk.search(few, few, k=5), ["query_id", "rank", "id", "score"]) == brute_top(vectors[:3], [0, 1, 2], 5)
    assert topk.search(df.limit(0), df, k=5).collect() == [] and topk.search(df, df.limit(0), k=5).collect() == []


def test_blocks_of_queries_are_full(spark, monkeypatch):
    rng, sizes = np.random.default_rng(8), []
    vectors = [(int(i), rng.normal(size=4).tolist()) for i in rng.permutation(5000)[:1000]]
    find = topk._kth
    monkeypatch.setattr(topk, "_kth", lambda of, block, *rest: (sizes.append(len(block["ids"])), find(of, block, *rest)))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    got = topk.search(df, df, k=2, block_rows=300)
    assert sizes == [300, 300, 300, 100]
    assert rows_of(got, ["query_id", "rank", "id", "score"]) == brute_top(vectors, [i for i, _ in vectors], 2)


def brute_links(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    n, low = {i: 0 for i, _ in vectors}, {i: i for i, _ in vectors}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.95]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted((i, n[i], low[i], low[i] == i) for i in n)


def test_groups_copies_and_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vectors = [(i, (base[i % 40] + rng.normal(size=16) * (0.08 if i % 3 else 0.3)).tolist()) for i in range(400)]
    vectors += [(500 + i, base[0].tolist()) for i in range(50)] + [(600, [0.0] * 16), *[b for b in BAD if b[0] is not None]]
    df = spark.createDataFrame([(i, v, 5, True) for i, v in vectors], "vec_id long, embedding array<double>, id int, kept boolean")
    names = ["id", "n_links", "component_id", "kept"]
    got = rows_of(ann.near_duplicates(df, block=64), names)
    assert got == brute_links(vectors)
    null = ann.near_duplicates(spark.createDataFrame([(None, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, null.collect()), key=str) == [(1, 0, 1, True), (None, 0, None, False)]
    assert ann.near_duplicates(df.limit(0)).collect() == []


def test_recall(spark):
    """At least 0.9 is asked for; measured over the pairs of a table with groups of near copies."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    x = np.concatenate([base, base[rng.integers(0, 200, 1500)] + rng.normal(size=(1500, 64)) * rng.uniform(0.1, 0.4, (1500, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum() - len(x)
    got = sum(r.n_links for r in ann.near_duplicates(df).collect())
    assert 0.99 * true <= got <= true


def exact_top(vectors, asked, k, factor=256):
    """By Python's integers; scores that no long holds are the nearest long."""
    whole = {i: [max(-(2**62), min(2**62, math.floor(factor * c) if abs(factor * c) < 2**62 else (2**62 if c > 0 else -(2**62)))) for c in v] for i, v in vectors}
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for q in asked:
        best = sorted((-dot(whole[q], x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_with_outliers(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(200)]
    vectors += [(300, [1e8, 0.1, -1.0, 2.0]), (301, [-1e8, 1e8, 1.0, 1.0]), (302, [1e300, -1e300, 0.0, 1.0]), (303, [1e15, 1e-300, -1e15, 3.0]), (304, [0.0] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = [0, 1, 2, 3, 300, 301, 302, 303, 304]
    got = topk.search(df, df.where(df.vec_id.isin(asked)), k=4, block_rows=4)
    assert rows_of(got, ["query_id", "rank", "id", "score"]) == exact_top(vectors, asked, 4)


def exact_links(vectors, least=Fraction(95, 100)):
    """Cosine of at least ``least`` by fractions: products and squares, no roots."""
    v = {i: [Fraction(c) for c in x] for i, x in vectors if any(x)}
    n = {i: 0 for i, _ in vectors}
    for a, b in combinations(sorted(v), 2):
        dot = sum(x * y for x, y in zip(v[a], v[b], strict=True))
        if dot > 0 and dot * dot >= least**2 * sum(x * x for x in v[a]) * sum(x * x for x in v[b]):
            n[a] += 1
            n[b] += 1
    return n


def test_links_of_tiny_and_huge_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0]), (5, [1e300, 1e299]), (6, [-1e300, 0.0]), (7, [1e-310, 2e-310]), (8, [1.0, 2.0]), (9, [0.0, 0.0]), (10, [1e-320, 1e300]), (11, [0.0, 5e-324])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {r.id: r.n_links for r in ann.near_duplicates(df).collect()} == exact_links(vectors)


def test_recall_at_a_thousand_lists(spark):
    """Over 64 dimensions and 1024 lists, as a table of a million rows has: the share of true pairs that are probed and pass."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(8000, 64))
    x = ann.unit(np.concatenate([base, base[rng.integers(0, 2000, 4000)] + rng.normal(size=(4000, 64)) * rng.uniform(0.1, 0.4, (4000, 1))]))
    sample = spark.createDataFrame([(i * 7919 % 12007, i, v.tolist()) for i, v in enumerate(x)], "h bigint, id bigint, v array<double>")
    model = ann.train(sample, 64, 1024)
    assert model["coarse"].shape == (1024, 64) and (ann.train(sample.repartition(5), 64, 1024)["coarse"] == model["coarse"]).all()  # whatever the tasks
    radius = math.sqrt(0.1)
    own, codes, miss, rows, lists = ann.index(model, x, radius, 3.0)
    probed = np.zeros((len(x), 1024), bool)
    probed[rows, lists] = True
    found = true = 0
    for c in range(1024):
        mine, asking = np.flatnonzero(own == c), np.flatnonzero(probed[:, c])
        if len(mine) and len(asking):
            a, b = ann.match(model, c, x[asking], x[asking], codes[mine], miss[mine], x[mine], radius, 0.95)
            found += int((asking[a] != mine[b]).sum())
    for i in range(0, len(x), 1000):
        true += int((x[i : i + 1000] @ x.T >= 0.95).sum())
    assert found >= 0.99 * (true - len(x))
