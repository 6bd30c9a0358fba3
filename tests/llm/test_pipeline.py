import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402
from partloom.llm import langid, mixing, queries  # noqa: E402
from partloom.llm.common import save  # noqa: E402

from .test_packing import library_ids  # noqa: E402
from .test_repeats import brute as removed  # noqa: E402
from .test_simhash import brute as grouped  # noqa: E402


def test_every_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(save(stage(spark, kept[-1], sf), name))
    raw, known, single, trimmed, mixed, packed = (d.collect() for d in kept)
    assert all(d.columns == names for d in kept[:-1])

    rejected = {r.doc_id for r in langid.predict(docs, langid.learned(docs), keep=["doc_id"]).where("rejected").collect()}
    assert {r.doc_id for r in known} == {r.doc_id for r in raw} - rejected and len(rejected) <= 2

    group = grouped([(r.doc_id, r.text) for r in known])
    assert sorted(single) == sorted(r for r in known if group[r.doc_id][1] == r.doc_id)

    want = dict(zip([r.doc_id for r in single], removed([r.text for r in single], 200), strict=True))
    text = {r.doc_id: r.text for r in single}
    assert len(trimmed) == len(single)
    for r in trimmed:
        total, gone, _, _ = want[r.doc_id]
        assert r.n_chars == len(r.text) <= len(text[r.doc_id])
        assert 0 <= total - gone - len(r.text.encode()) <= 6 * want[r.doc_id][2]
        assert gone or r.text == text[r.doc_id]

    copies = {r.id: r.copies for r in mixing.copies(kept[3]).collect()}
    assert Counter(r.doc_id for r in mixed) == +Counter(copies)
    assert set(mixed) <= set(trimmed)

    once = {r.doc_id: r.text for r in mixed}
    ids = dict(zip(once, library_ids(list(once.values())), strict=True))
    pieces = Counter((r.doc_id, r.piece) for r in packed)
    assert pieces == Counter({(d, p): copies[d] for d in once for p in range(max(1, -(-len(ids[d]) // 1024)))})
    assert sum(r.length for r in packed) == sum(len(ids[r.doc_id]) for r in mixed)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == queries.op6_best_fit_packing(spark, sf).columns and out.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)


def test_odd_rows_and_columns_end_to_end(spark, sf, tmp_path):
    """Null ids, null and empty texts, repeated rows, helper names, dotted names and a map column go through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (5_000_001, "", "en", "src0", 0), (5_000_002, None, "en", "src1", 0), (None, docs.first().text, "en", "src2", 7), (5_000_003, "кириллица " * 40, None, None, 400)], docs.schema)
    few = docs.limit(60).unionByName(odd)
    wide = few.selectExpr("*", "map('id', doc_id) AS `row`", "1 AS `a.b`", "source AS `__own`", "2 AS component_id", "3 AS copies", "4 AS `key`", "5 AS id", "6 AS salt")
    for rows in (wide, wide.limit(0)):
        now = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = save(stage(spark, now, sf), name)
            if k < 4:
                assert now.columns == wide.columns
        got = now.collect()
        assert bool(got) == (rows is wide)
    assert "кириллица" not in " ".join(r.text or "" for r in corpus_pipeline.language_id(spark, wide, sf).collect())


def test_tables_of_the_stages_are_gone(spark, sf):
    import os

    from partloom.storage import scratch

    where = scratch(spark).removeprefix("file://") + "/partloom"
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert len(set(os.listdir(where)) - before) == 1
