"""License scans over a positional rare-token index.

The index maps words to postings (template, position). Words are weighed by their inverse document frequency over the
whole corpus, and a template is posted under the words of its mandatory key phrase, from the highest IDF on. A text's
words are looked up in the first of these postings: each occurrence of a template's rarest key word gives an alignment
(template, text position minus template position). The postings of the next rarer words are intersected with that by
relative position, word by word, until the whole key phrase stands, so work follows the postings that a text meets and
not the number of templates, and no place of a key phrase is missed. What is left is verified on the text's own words,
as the index compares hashes, and scored by the share of the template's words that stand in place. The frequencies
decide what a look-up costs, not what it finds.

Defined cases: null text is empty, without words or labels and with score 0; labels are distinct and sorted;
repeated rows are scanned alike; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_bytes, tune
from .textvec import lookup, prefix, span, tokens

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Words of public licence notices (label, notice); brackets hold the mandatory key phrase.
TEMPLATES = [
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released [under the mit license]"),
    ("apache-2", "licensed under the [apache license version 2] 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the [apache license version 2] 0"),
    ("gpl-3", "licensed under the [gnu general public license version 3]"),
    ("gpl-2", "licensed under the [gnu general public license version 2]"),
    ("gpl", "you can redistribute it and or modify it [under the terms of the gnu general public license] as published by the free software foundation"),
    ("lgpl", "licensed under the [gnu lesser general public license]"),
    ("agpl", "licensed under the [gnu affero general public license]"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by", "licensed under a [creative commons attribution 4 0 international license]"),
    ("cc0", "[cc0 1 0 universal] public domain dedication"),
    ("mit", "[the above copyright notice and this permission notice shall be included in all copies] or substantial portions of the software"),
    ("mpl-2", "[mozilla public license version 2 0]"),
    ("bsd-3", "[bsd 3 clause license]"),
    ("bsd-2", "[bsd 2 clause license]"),
    ("bsd-3", "[neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote] products derived from this software without specific prior written permission"),
    ("mit", "[spdx license identifier mit]"),
    ("apache-2", "[spdx license identifier apache 2 0]"),
    ("gpl-3", "[spdx license identifier gpl 3 0]"),
    ("gpl-2", "[spdx license identifier gpl 2 0]"),
    ("lgpl", "[spdx license identifier lgpl]"),
    ("agpl", "[spdx license identifier agpl]"),
    ("mpl-2", "[spdx license identifier mpl 2 0]"),
    ("bsd-3", "[spdx license identifier bsd 3 clause]"),
    ("bsd-2", "[spdx license identifier bsd 2 clause]"),
    ("isc", "[spdx license identifier isc]"),
    ("cc0", "[spdx license identifier cc0 1 0]"),
    ("cc-by", "[spdx license identifier cc by 4 0]"),
    ("cc-by-sa", "[spdx license identifier cc by sa 4 0]"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
]

WORDS = lookup([(0x30, 0x39, 1), (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xFF, 1)])
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LEAST_SHARE = 0.6


def words_of(data: np.ndarray, off: np.ndarray):
    """(hash, row, number in the row) of each lower-cased word, and the words of each row."""
    h, row = tokens(data, off, WORDS, lower=True)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    return h, row, np.arange(len(row)) - first[row] if len(row) else row, n


class Index:
    """Words of base phrases and templates as numbers, and postings by words of the key phrases."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        #: (label, words, words before the key phrase, words in it, whether it is a base phrase)
        self.entries = [(label, p.split(), 0, len(p.split()), True) for p, label in phrases.items()]
        for label, t in templates:
            before, key, _ = re.split(r"[\[\]]", t)
            self.entries.append((label, t.replace("[", "").replace("]", "").split(), len(before.split()), len(key.split()), False))
        self.words = sorted({w for _, ws, *_ in self.entries for w in ws})
        raw = [w.encode() for w in self.words]
        off = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        self.hash = span(prefix(np.frombuffer(b"".join(raw), np.uint8)), off[:-1], off[1:])
        self.order = np.argsort(self.hash)
        self.sorted = self.hash[self.order]
        self.small = np.zeros(1 << 16, bool)
        self.small[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True

    def weigh(self, idf: np.ndarray) -> Index:
        """Build the postings. ``place[t, k]`` and ``word[t, k]``: the k-th rarest word of template t's key phrase and
        where it stands in the template; ``first``: by word, where its run of postings (``posted``) begins."""
        number = {w: i for i, w in enumerate(self.words)}
        most = max((key for *_, key, _ in self.entries), default=0)
        self.place, self.word = np.full((len(self.entries), most), -1), np.full((len(self.entries), most), -1)
        for t, (_, ws, before, key, _) in enumerate(self.entries):
            rare = sorted(range(before, before + key), key=lambda q: (-idf[number[ws[q]]], q))
            self.place[t, :key], self.word[t, :key] = rare, [number[ws[q]] for q in rare]
        self.posted = np.argsort(self.word[:, 0], kind="stable") if most else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.word[self.posted, 0] if most else self.posted, np.arange(len(self.words) + 1))
        self.raw = [[w.encode() for w in ws] for _, ws, *_ in self.entries]
        return self

    def alignments(self, w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, place of its first word) wherever a key phrase's words stand, by their hashes, in one row."""
        at = np.flatnonzero(w >= 0)
        n = (self.first[1:] - self.first[:-1])[w[at]]
        at, n = at[n > 0], n[n > 0]
        t = self.posted[np.repeat(self.first[w[at]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        home = np.repeat(at, n)  # where the rarest word stands
        s = home - self.place[t, 0]
        for k in range(1, self.place.shape[1]):
            q = s + self.place[t, k]
            inside = np.clip(q, 0, len(w) - 1)
            ok = (self.word[t, k] < 0) | ((q == inside) & (w[inside] == self.word[t, k]) & (row[inside] == row[home]))
            t, s, home = t[ok], s[ok], home[ok]
        return t, s

    def verify(self, t: int, s: int, words: list[bytes]) -> float | None:
        """The share of template ``t``'s words that stand in place from word ``s`` on, if its key phrase does."""
        _, _, before, key, _ = self.entries[t]
        want = self.raw[t]
        if words[s + before : s + before + key] != want[before : before + key]:
            return None
        return sum(0 <= s + k < len(words) and words[s + k] == x for k, x in enumerate(want)) / len(want)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, -1 for words of no template."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.small[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == h[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out


def frequencies(docs: DataFrame, index: Index, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each template word, and all documents: corpus-wide counts of a fixed set of words."""

    @lean
    def run(batches):
        df, rows = np.zeros(len(index.words), np.int64), 0
        for b in batches:
            data, off = text_bytes(b.column(0))
            rows += b.num_rows
            for i, j in slices(off):
                h, row, _, _ = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                w = index.find(h)
                has = w >= 0
                df += np.bincount(np.unique(row[has] * len(df) + w[has]) % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), len(df)), pa.int32()), pa.array(np.append(df[df > 0], rows), pa.int64())], names=["w", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "w int, n bigint").groupBy("w").agg(F.sum("n")).collect()
    df = np.zeros(len(index.words) + 1, np.int64)
    for w, n in got:
        df[w] = n
    return df[:-1], int(df[-1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, n_words, base_places: array of (label, word), base_labels, labels, score) of every row."""
    tune(docs.sparkSession)
    index = Index(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    df, rows = frequencies(docs, index, text_col)
    idf = np.log((1 + rows) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(index.weigh(idf))  # the templates, whatever the corpus

    @lean
    def run(batches):
        index = shared.value
        for b in batches:
            data, off = text_bytes(b.column(1))
            for i, j in slices(off):
                h, row, at, n = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                w = index.find(h)
                t, s = index.alignments(w, row)
                home = s + index.place[t, 0]
                met = defaultdict(list)
                for r, x, start in zip(row[home].tolist(), t.tolist(), (s - home + at[home]).tolist(), strict=True):
                    met[r].append((x, start))
                out = []
                for r in range(j - i):
                    found, labels, best = [], set(), 0.0
                    if r in met:
                        own = RUN.findall(data[off[i + r] : off[i + r + 1]].tobytes().lower())
                        for x, start in met[r]:
                            share, (label, *_, base) = index.verify(x, start, own), index.entries[x]
                            if share is None:
                                continue
                            if base:
                                found.append((start, label))
                            else:
                                best = max(best, share)
                                labels |= {label} if share >= LEAST_SHARE else set()
                    base = {x for _, x in found}
                    out.append((int(n[r]), [{"label": x, "word": p} for p, x in sorted(found)], ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best))
                c = list(zip(*out, strict=True))
                kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(c[0], pa.int64()), pa.array(c[1], kind), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.float64())], names=["id", "n_words", "base_places", "base_labels", "labels", "score"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, base_places array<struct<label:string,word:bigint>>, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
