import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from partloom.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: b if b is not None and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def result(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def made(seed, n, letters="abé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(6, longest))): rng.choice([5, 6, 25, 30, 130, 700, 4000]) for _ in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_composition_accepts_each_near_pair_once(seed):
    words = sorted(made(seed, 300)) if seed else ["", "a", "aa", "aaa", "ab", "b", "ba", "bab"]
    got = sorted(tuple(sorted(p)) for p in spelling.Acceptor(words).one_edit())
    assert got == [(i, j) for i, j in combinations(range(len(words)), 2) if one_edit(words[i], words[j])]


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("lay", "play", "stay") for b in ("", "er", "ers", "ing"))
    a = spelling.Acceptor(words)
    live, todo = set(), [0]
    while todo:
        q = todo.pop()
        if q not in live:
            live.add(q)
            todo += [t for _, t, _ in a.arcs[q]]
    rights = {}

    def right(q):
        rights.setdefault(q, frozenset({""} if a.final[q] else set()) | {c + y for c, t, _ in a.arcs[q] for y in right(t)})
        return rights[q]

    right(0)
    assert len({rights[q] for q in live}) == len(live)


@pytest.mark.parametrize("most", [1, 7, 4096])
def test_large_states_are_cut_and_nothing_is_lost(spark, most):
    words = made(9, 400) | {"zzzzzz" + w: n for w, n in made(3, 200, "ab", 8).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(spelling.variants(df, most=most)) == brute(words)


def test_chain_of_forms(spark):
    words = {"a" * 6 + "b" * k: 5 ** (8 - k) * 5 for k in range(8)} | {"x" * 3000: 5, "x" * 2999 + "y": 40}
    got = {r[0]: r for r in result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert all(got["a" * 6 + "b" * k][2] == "a" * 6 for k in range(8)) and got["x" * 3000][1] == "x" * 2999 + "y"


def test_nulls_repeats_letters_and_other_columns(spark):
    rng = random.Random(1)
    rows = []
    for d in range(400):
        rows.append((d, " ".join(rng.choice(["Straße", "STRASSE", "ÀÉÎÕÜß", "àéîõüß", "kitten", "kittens", "mitten", "Kitte1n", "naïve×s", "colour_colors"]) for _ in range(30))))
    rows += [(None, "kitten mitten kitten")] * 7 + [(3, None), (4, ""), rows[5], rows[5], (9, "q" * 200_000)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS id", "4 AS form")
    words = brute_words(rows)
    assert {r.word: r.n for r in spelling.words(df).collect()} == words and any(len(w) == 6 for w in words)
    assert result(spelling.variants(spelling.words(df))) == brute(words)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op13_spelling_variants(spark, sf)) == brute(brute_words(rows))


def test_empty_table(spark):
    assert result(spelling.variants(spelling.words(spark.createDataFrame([], "doc_id long, text string")))) == []
