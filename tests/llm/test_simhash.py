import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from partloom.llm import queries, simhash


def brute_fp(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fp = {d: brute_fp(t) for d, t in rows}
    low = {d: d for d in fp}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {d: (f"{fp[d]:016x}", root(d)) for d in fp}


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, sf).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [4096, 20])
def test_chains_and_hot_keys(spark, hot):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    rng.shuffle(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    from partloom.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(df, 4, hot)).collect()}
    low = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(fps)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(low))


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one  TWO"), (6, "É é"), (7, "é é"), (8, long), (9, long + " tail"), (9, long), (None, "One two")]
    df = spark.createDataFrame([(a, b, 7, 7) for a, b in rows], "doc_id long, text string, fp int, node int")
    got = [(r.doc_id, r.component_id) for r in simhash.group(df).collect()]
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 8), (9, 8), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.group(df.limit(0)).collect() == []
    kept = [r.doc_id for r in simhash.keep_first(df).collect()]
    assert sorted(kept, key=str) == [1, 4, 6, 7, 8, None]
    odd = spark.createDataFrame([(8, long), (9, long), (9, "quite another text of some words"), (9, "quite another text of some words")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(odd).collect())) == [(8, long), (9, "quite another text of some words")]
    assert simhash.keep_first(df).columns == df.columns
    strange = df.selectExpr("*", "map(doc_id, text) AS `key`", "1 AS `a.b`", "2 AS `row`", "3 AS `others`", "4 AS `c``0`").where("doc_id is not null")
    kept = simhash.keep_first(strange)
    assert kept.columns == strange.columns
    assert all(r.key == {r.doc_id: r.text} and r["a.b"] == 1 and r.row == 2 and r.others == 3 and r["c`0"] == 4 for r in kept.collect())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_larger_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_other_distances(spark, bits):
    from partloom.llm.components import components

    rng = random.Random(bits)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), n)) for f in fps for n in (1, 2, 3, 4)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r.node: r.component for r in components(simhash.links(df, bits)).collect()}
    low = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(fps)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= bits and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(low))


def test_tally_of_shared_postings_bounds_the_bits():
    """Shared positional bytes are counted a pair; near pairs always reach the minimum, and not all that do are near."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 4000, np.uint64)
    b = a.copy()
    for _ in range(6):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    shared = simhash.tally(a, b)
    assert shared.tolist() == [sum(x == y for x, y in zip(int(p).to_bytes(8), int(q).to_bytes(8))) for p, q in zip(a, b)]
    differ = np.bitwise_count(a ^ b)
    for bits in (1, 2, 3, 4):
        assert (shared[differ <= bits] >= 8 - bits).all() and ((shared >= 8 - bits) & (differ > bits)).any()
        assert (simhash.near(a, b, bits) == (differ <= bits)).all()
