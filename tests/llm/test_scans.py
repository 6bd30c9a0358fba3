import re
import zlib

import numpy as np
import pytest

from partloom.llm import langid, licenses, quality, queries

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_quality_on_held_out_labels(spark, sf):
    big = sf.replace("0.001", "0.1")
    rows = queries.op3_quality_classifier(spark, big).collect()
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert auc(np.array([r.score for r in held]), np.array([label[r.doc_id] for r in held])) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (None, "a b"), (3, "!!")], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS y")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1), (1, 0)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_language_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.1")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op5_language_id(spark, big).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.001


def test_language_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learned(docs)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 345 !?"), (4, "Привет мир, как дела сегодня"), (5, docs.first().text * 30), (5, "x")], "doc_id long, text string").selectExpr("*", "'a' AS lang_pred", "5 AS score", "'q' AS lang")
    got = {r.doc_id: r for r in langid.predict(rows, model, keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].rejected and got[4].lang_pred in model["languages"]
    assert langid.predict(rows.limit(0), model).collect() == []
    none = langid.learned(rows.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in langid.predict(rows, none).collect()} == {"und"}
    assert langid.keep_known(docs.withColumn("score", docs.doc_id)).columns == [*docs.columns, "score"]


REJECT = [
    "Привет мир, как дела сегодня и всегда " * 3, "你好世界，今天天气很好" * 3, "qzxv wkjq zzxq vvkw jqxz pfqz " * 4, "12 345 kg 77 x 9 mm 3 ft " * 12,
    "def f(x):\n    return np.zeros((len(x), 3)) if x else None\n" * 5, '<div class="a"><span id=b>{{x}}</span></div>' * 8, "asdf " * 80, "aaaaaaaaaaaa" * 20,
]


def test_language_rejects_what_no_language_is_near(spark, sf):
    """Junk of other scripts, code, keys and numbers goes; of the table's own texts at most one in a thousand."""
    big = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    model = langid.learned(docs)
    rows = spark.createDataFrame(list(enumerate(REJECT)), "doc_id long, text string")
    assert all(r.rejected and r.lang_pred != "und" for r in langid.predict(rows, model).collect())
    short = spark.createDataFrame([(i, " ".join((t or "").split()[:n])) for i, t in enumerate(r.text for r in docs.limit(60).collect()) for n in (2, 5, 20)], "doc_id long, text string")
    kept = [r.rejected for r in langid.predict(short, model).collect()]
    assert sum(kept) <= 0.03 * len(kept)


def test_language_scores_again_in_plain_python(spark, sf):
    """Cosines of a text's n-grams to each centroid, one text at a time."""
    import math

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learned(docs)
    bits = 64 - int(len(model["idf"])).bit_length() + 1
    got = {r.doc_id: r for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    for r in docs.limit(40).collect():
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in r.text.encode())
        x = [0.0] * len(model["idf"])
        for n in (2, 3):
            for i in range(len(b) - n + 1):
                if b[i : i + n].strip():
                    x[((int.from_bytes(b[i : i + n], "big") + (n << 32)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> bits] += 1
        x = [math.sqrt(c) * w for c, w in zip(x, model["idf"].tolist(), strict=True)]
        norm = math.sqrt(sum(c * c for c in x))
        sims = [sum(a * c for a, c in zip(x, row, strict=True)) / norm for row in model["centroids"].tolist()]
        best = max(range(len(sims)), key=lambda k: sims[k])
        assert got[r.doc_id].score == pytest.approx(sims[best], abs=1e-4)
        assert got[r.doc_id].lang_pred == model["languages"][model["of"][best]]


def test_language_learns_every_language_and_keeps_any_column(spark):
    import random

    rng = random.Random(3)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(60)] for k in range(300)}
    rows = [(i, " ".join(rng.choices(words[f"l{i % 300}"], k=60)), f"l{i % 300}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs)
    assert len(model["languages"]) == 300
    right = [r.lang_pred == r.lang for r in langid.predict(docs, model, keep=["lang"]).collect()]
    assert np.mean(right) > 0.95
    odd = docs.limit(900).selectExpr("*", "map('a', doc_id) AS `__lang`", "lang AS `row`", "1 AS `a.b`", "2 AS score", "true AS rejected")
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns
    assert all(r["__lang"] == {"a": r.doc_id} and r.row == r.lang and r["a.b"] == 1 and r.score == 2 and r.rejected for r in kept.collect())


def test_quality_scores_again_in_plain_python(spark, sf):
    import math

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = quality.fit(docs, labels)
    got = {r.id: r.score for r in quality.score(docs, weights).collect()}
    mask, base, inverse = (1 << 64) - 1, 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def mixed(x):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & mask
        return x ^ x >> 29

    bits = int(len(weights) - 1).bit_length() - 1
    for r in docs.limit(25).collect():
        raw = r.text.encode()
        h = [mixed(sum((raw[i] + 1) * pow(base, i - m.start(), 1 << 64) for i in range(m.start(), m.end())) & mask) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", raw)]
        f = h + [mixed(((1 if a == b else a * 3 + b) + 0x51ED27) & mask) for a, b in zip(h, h[1:], strict=False)] + [mixed(int(math.log2(len(h) + 1)) + 0xABCD)]
        dot = sum(float(weights[x >> 64 - bits]) for x in f) * quality.SCALE / len(f) + float(weights[-1])
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, dot)))), abs=1e-5)
    assert inverse * base & mask == 1


def brute_scan(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_license_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_edges(spark):
    texts = [None, "", "under the MIT", "license", "UNDER  the\nMIT-license. under the mit licenses", "cc by nc " * 20_000, "é under the mit license é", "CC by nc by nc cc-BY-NC", "Licensed under the GNU General Public License, version 3.", "apache license, version 2.0"]
    df = spark.createDataFrame([(i, t, 3, "l") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string")
    got = {r.id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        at = [p.word for p in got[i].base_places]
        assert (got[i].n_words, len(at), min(at, default=None), max(at, default=None), got[i].base_labels) == brute_scan(t)
    assert got[8].labels == "gpl-3" and got[8].score == 1
    assert got[0].labels == "" and got[0].score == 0
    assert licenses.scan(df.limit(0)).collect() == []


MIT_TEXT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
GPL_TEXT = "Licensed under the GNU General Public License, version 3"


def brute_templates(text):
    """Labels and best score by trying every template at every word."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = {x for x in brute_scan(text)[4].split(",") if x}, 0.0
    for label, t in licenses.TEMPLATES:
        ws = t.replace("[", "").replace("]", "").split()
        before, key = len(t.split("[")[0].split()), t.split("[")[1].split("]")[0].split()
        for d in range(-before, len(w)):
            if w[d + before : d + before + len(key)] == key:
                share = sum(0 <= d + k < len(w) and w[d + k] == x for k, x in enumerate(ws)) / len(ws)
                best = max(best, share)
                labels |= {label} if share >= licenses.LEAST_SHARE else set()
    return ",".join(sorted(labels)), 1.0 if brute_scan(text)[4] else best


def test_license_several_notices_in_one_text(spark):
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.replace("[", "").replace("]", "").split()})
    plain = [t.replace("[", "").replace("]", "") for _, t in licenses.TEMPLATES]
    texts = [f"{MIT_TEXT}. {GPL_TEXT}.", f"{GPL_TEXT}. {MIT_TEXT}.", " ".join(words[::-1]) + " # " + GPL_TEXT, (" ".join(words[::-1]) + " ") * 2000 + MIT_TEXT, "\n".join(plain), "\n".join(plain[::-1]), "Licensed under", "the GNU general public license version 2", "is hereby granted " * 40, MIT_TEXT[:45], "x " + MIT_TEXT[:70], *[GPL_TEXT] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got[0][0] == got[1][0] == "gpl-3,mit"
    for i, t in enumerate(texts):
        labels, score = brute_templates(t)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), i


def test_license_work_follows_the_postings_met():
    """Hundreds of templates that a text does not meet add no alignments; the rarest key word is looked up first."""
    text = (GPL_TEXT + " common words " * 50).encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    met = []
    for more in ([], [("x", f"common words [of licence{i} and nothing{i}] else") for i in range(600)]):
        index = licenses.Index(licenses.PHRASES, licenses.TEMPLATES + more)
        index.weigh(np.array([1.0 if x in ("common", "words", "of", "and", "license", "the") else 9.0 for x in index.words]))
        h, row, _, _ = licenses.words_of(raw, off)
        t, s = index.alignments(index.find(h), row)
        met.append([(index.entries[x][0], int(y)) for x, y in zip(t, s)])
        for x in range(len(index.entries)):
            k = index.place[x] >= 0
            weights = [9.0 if index.words[y] not in ("common", "words", "of", "and", "license", "the") else 1.0 for y in index.word[x][k]]
            assert weights == sorted(weights, reverse=True)
    assert met[0] == met[1] == [("gpl-3", 0)]


@pytest.mark.parametrize("text, label", [("// SPDX-License-Identifier: MIT", "mit"), ("BSD 3-Clause License", "bsd-3"), ("Mozilla Public License Version 2.0", "mpl-2"), ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2")])
def test_license_short_notices(text, label):
    data = text.encode()
    index = licenses.Index(licenses.PHRASES, licenses.TEMPLATES)
    index.weigh(np.ones(len(index.words)))
    h, row, _, _ = licenses.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    words = licenses.RUN.findall(data.lower())
    found = {(index.entries[t][0], index.verify(t, s, words)) for t, s in zip(*(x.tolist() for x in index.alignments(index.find(h), row)))}
    assert (label, 1.0) in found


def test_license_words_are_verified():
    """A place whose words are not the key phrase's, though their hashes say so, is no match."""
    index = licenses.Index(licenses.PHRASES, licenses.TEMPLATES)
    index.weigh(np.ones(len(index.words)))
    assert index.verify(0, 0, b"under the mit licence".split()) is None and index.verify(0, 0, b"under the mit license".split()) == 1
