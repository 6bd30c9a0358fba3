import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from partloom.llm import bwt


def brute(segments, least):
    c = Counter(s[i : i + least] for s in segments for i in range(len(s) - least + 1))
    return [[c[s[i : i + least]] > 1 for i in range(len(s) - least + 1)] for s in segments]


def same(segments, least):
    assert [x.tolist() for x in bwt.repeated(segments, least)] == brute(segments, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), max_size=8), st.integers(1, 12))
def test_small_alphabets(segments, least):
    same(segments, least)


def test_suffix_order():
    rng = random.Random(3)
    sym = np.array([rng.choice([0, 1, 2, 2, 3]) for _ in range(500)] + [0], np.uint16)
    text = [(s, i) if s == 0 else (s, 0) for i, s in enumerate(sym.tolist())]

    def suffix(i):
        out = []
        for x in text[i:]:
            out.append(x)
            if x[0] == 0:
                break
        return out

    assert bwt.suffix_array(sym)[0].tolist() == sorted(range(len(sym)), key=suffix)


def test_long_repeats():
    rng = random.Random(4)
    common = bytes(rng.randrange(256) for _ in range(260))
    parts = [bytes(rng.randrange(97, 100) for _ in range(90)) + common[rng.randrange(40) : 260 - rng.randrange(40)] + bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(60)]
    same([*parts, b"a" * 400, b"ab" * 180, parts[0], b"", b"x"], 200)
