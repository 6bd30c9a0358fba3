import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partloom.llm import packing, queries

pytest.importorskip("public_tokenizers")


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, ids_by_doc, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_by_doc)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        ids, at = ids_by_doc[d], 0
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            assert p.start == at and 1 <= p.length <= capacity
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.piece == 0 or p.length == capacity
            at += p.length
        assert at == len(ids)
        assert len(pieces) == 1 or len(ids) > capacity
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq)


def test_whole_table_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in docs], library_ids([r.text for r in docs]), strict=True))
    rows = queries.op6_best_fit_packing(spark, sf).collect()
    used = check(rows, ids)
    assert used <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_edges(spark):
    texts = [None, "", "a", " \n\t ", "<|endoftext|> x", "x" * 30_000, "wörter ñ 漢字 😀 " * 800, "a", "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    check(packing.pack(df, queries.tokenizer()).collect(), dict(enumerate(library_ids(texts))))
    got = packing.pack(df, queries.tokenizer(), with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(df.limit(0), queries.tokenizer()).collect() == []
    twice = packing.pack(df.unionAll(df).withColumn("doc_id", df.doc_id * 0), queries.tokenizer()).collect()
    assert sum(r.length for r in twice) == 2 * sum(map(len, library_ids(texts)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_a_packing_and_not_worse_than_first_fit(sizes):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    p = packing.plan(histogram, 20)
    bins = defaultdict(list)
    for s, n in histogram.items():
        for r in range(n):
            i = np.searchsorted(p["key"], (s << 48) + r, "right") - 1
            assert p["key"][i] >> 48 == s
            bins[int(p["seq"][i] + r - p["rank"][i])].append((int(p["at"][i]), s))
    for b in bins.values():
        at = 0
        for o, s in sorted(b):
            assert o == at
            at += s
        assert at <= 20
    first_fit: list[int] = []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, x in enumerate(first_fit) if x + s <= 20), None)
        if i is None:
            first_fit.append(s)
        else:
            first_fit[i] += s
    assert len(bins) <= len(first_fit)


def exact(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_reduction_never_loses_the_optimum(sizes):
    count = np.bincount(np.array(sizes, int), minlength=13)
    fixed = packing.reduce_histogram(count, 12)
    rest = [s for s in range(12, 0, -1) for _ in range(count[s])]
    assert sum(m for m, _ in fixed) + exact(rest, 12) == exact(sorted(sizes, reverse=True), 12)


def test_added_tokens_as_the_library_matches_them_by_default(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "  <|endoftext|>  \n", "<|endoftext|", "wörter<|endoftext|>ñ 漢字 " * 900, "plain words", None]
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    assert ids[0].tolist() == [64, 220, 50256, 275, 2]
    check(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer()).collect(), ids)


def test_settings_of_the_file():
    import json

    with open(queries.tokenizer()) as f:
        plain = json.load(f)
    assert packing.pattern_of(plain) == packing.PATTERN
    split = {"type": "Split", "pattern": {"Regex": "[a-z]+"}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    assert packing.pattern_of({**plain, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}}) == "[a-z]+"
    for odd in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**plain["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**plain["model"], "unk_token": "?"}}, {"added_tokens": [{**plain["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError):
            packing.pattern_of({**plain, **odd})


def test_runs_of_millions(spark):
    """No text ends the query: long runs of white space and of anything else have the library's ids, beside good rows."""
    from tokenizers import Tokenizer

    library, n = Tokenizer.from_file(queries.tokenizer()), 2_000_000
    texts = ["a" + " " * n + "b", "\n" * n, "a" + " \n\t\u00a0\u2003" * (n // 5) + "<|endoftext|>x", "x" * n, "\U0001f600" * (n // 4), "good", " " * n + "\n?", "\u3000" * 5000 + "'s" + "\x85" * 4096 + "7" + "\x1c" * 9000 + " " * 4095 + "."]
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    check(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer()).collect(), ids)
