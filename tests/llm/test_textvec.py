import random

import numpy as np
import pytest

from partloom.llm import langid, licenses, quality, textvec


def bytes_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_long_texts_in_chunks_give_the_same(monkeypatch, chunk):
    rng = random.Random(chunk)
    text = " ".join("".join(rng.choice("abcXYZ.,!\u00e9") for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(300))
    data, off = bytes_of([text])
    whole = [quality.features(data, off, 18), licenses.words_of(data, off), langid.counts(data, off, 8192)]
    for module in (textvec, langid):
        monkeypatch.setattr(module, "CHUNK", chunk)
    parts = [quality.features(data, off, 18), licenses.words_of(data, off), langid.counts(data, off, 8192)]
    for a, b in zip(whole[:2], parts[:2], strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert (whole[2] == parts[2]).all()


def test_hashes_depend_on_the_word_alone():
    texts = ["one two", "two  three two", "", "xone", "two"]
    h, row = textvec.tokens(*bytes_of(texts), licenses.WORDS)
    words = [w for t in texts for w in t.split()]
    assert row.tolist() == [0, 0, 1, 1, 1, 3, 4]
    assert len(set(h.tolist())) == len(set(words))
    assert {w: x for w, x in zip(words, h.tolist(), strict=True)} == {w: h.tolist()[words.index(w)] for w in words}
