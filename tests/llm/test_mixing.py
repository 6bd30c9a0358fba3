import math
import random
import re
from collections import Counter, defaultdict

import pytest

from partloom.llm import mixing, queries


def want_targets(size_of, most=3.0):
    """Share by weight, cap, reshare the excess, until none is above."""
    order = sorted((s for s in size_of if s is not None)) + [None] * (None in size_of)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(size_of.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * size_of[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * size_of[s]
            left -= target[s]
            free.remove(s)
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = defaultdict(int)
    for r in docs:
        size[r.source] += words(r.text)
    target = want_targets(size)
    source = {r.doc_id: r.source for r in docs}
    rows = queries.op4_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = defaultdict(int)
    for r in docs:
        largest[r.source] = max(largest[r.source], words(r.text))
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = queries.op4_mixing(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_tree_keeps_words_and_is_unbiased(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 17 as int)) AS text", "if(id % 3 = 0, 'b', if(id % 7 = 0, null, 'a')) AS source")
    rows = mixing.copies(df, group_rows=64).collect()
    assert len(rows) == 6000
    per = defaultdict(int)
    for r in rows:
        per[(r.source_size, r.target)] += r.copies * r.size
    for (_, target), got in per.items():
        assert abs(got - target) <= 17


def test_rounding_is_near_and_fair():
    rng = random.Random(1)
    size = sorted((int(math.exp(rng.gauss(5.6, 1.0))) for _ in range(50)), reverse=True)
    taken = [0.0] * 50
    for _ in range(2000):
        x = [0.4] * 50
        mixing.pivot(size, x, [rng.getrandbits(64) for _ in size], True)
        assert set(x) <= {0.0, 1.0}
        assert abs(sum(a * b for a, b in zip(size, x, strict=True)) / sum(size) - 0.4) < 0.01
        taken = [a + b for a, b in zip(taken, x, strict=True)]
    assert all(abs(t / 2000 - 0.4) < 0.06 for t in taken)


def test_edges(spark):
    rows = [(1, None, "b"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "z " * 5, "a"), (4, "w " * 20_000, "c"), (5, "one", "a")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, h int")
    got = mixing.copies(df).collect()
    assert len(got) == len(rows)
    assert {r.source_size for r in got} == {0, 6, 4, 20_000}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({k: sum(r.copies for r in got if r.id == k) for k in {r.id for r in got}})
    assert mixing.copies(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


def test_same_text_in_two_sources_and_odd_columns(spark):
    df = spark.range(200).selectExpr("id AS doc_id", "concat('same words ', id % 7) AS text", "explode(array('a', 'b')) AS source")
    df = df.selectExpr("*", "map('k', doc_id) AS `__own`", "array(source) AS `__key`", "doc_id AS `a.b`", "source AS copies", "1 AS n", "2 AS `row`", "3 AS `tick``s`")
    rows = mixing.copies(df).collect()
    got = mixing.mix(df)
    assert got.columns == df.columns
    mixed = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in mixed) == +Counter({k: n for k, n in total(rows, df.collect()).items()})
    per = Counter(r.source for r in mixed)
    assert abs(per["a"] - 400 / 3) <= 1 and abs(per["b"] - 800 / 3) <= 1
    assert all(r["__own"] == {"k": r.doc_id} and r["__key"] == [r.source] and r["a.b"] == r.doc_id and r.copies == r.source and r["tick`s"] == 3 for r in mixed)


def total(rows, docs):
    out = Counter()
    for r in rows:
        out[(r.id, r.key, r.source)] += r.copies
    by_id = defaultdict(set)
    for d in docs:
        by_id[(d.doc_id, d.source)].add(d.text)
    assert all(len(v) == 1 for v in by_id.values())
    return Counter({(i, next(iter(by_id[(i, s)])), s): n for (i, _, s), n in out.items()})


def test_a_third_of_all_rows_alike(spark):
    """Rows without id and text, alike in all or differing in another column, share their unit's copies evenly."""
    df = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, null, repeat('w ', cast(id % 11 AS int))) AS text", "if(id % 2 = 0, 's', 't') AS source", "if(id % 3 = 0, id % 5, 0) AS more")
    rows = mixing.copies(df, group_rows=64).collect()
    assert len(rows) == 9000
    mixed = mixing.mix(df, group_rows=64).collect()
    assert len(mixed) == sum(r.copies for r in rows)
    empty = Counter((r.source, r.more) for r in mixed if r.doc_id is None)
    alike = [r.copies for r in rows if r.id is None and r.source == "s"]
    assert max(alike) - min(alike) <= 1 and sum(n for (s, _), n in empty.items() if s == "s") == sum(alike)
    again = mixing.mix(df.repartition(13), group_rows=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixed))
