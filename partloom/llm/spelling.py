"""Spelling variants of a corpus' own vocabulary by finite-state composition.

The vocabulary's minimised acceptor is composed with a transducer that makes exactly one edit, and with the acceptor
again; what the composed machine accepts are the pairs of words one edit apart. Before the edit both acceptors are in
one state, since they have read the same, so the machine branches there into the transducer's arcs (replace, delete,
and insert, which is a delete read the other way) and afterwards follows the symbols that both states have. A pair
has one accepted path: the edit is where the words first differ.

The machine is cut at its first states. A state that is reached by one beginning of words and has at most ``most``
words is a partition: a task builds the acceptor of these words alone and enumerates all pairs whose edit comes later.
A state with more words is too large for that, however much of the vocabulary begins alike; for it the edit arcs of
that very position are enumerated by a shuffle on what both words read (the word, and the word without the symbol),
where at most one word a letter of the alphabet and one more meet, and the states one symbol further on are looked at
in turn. So no partition is large, no word is left out, and no pairs are formed but near ones.

Words carry only their number of near words and the best of them; pairs are never written.

Defined cases: null texts have no words; rows of a null id lose no letter; repeated rows count again; empty tables,
and tables without any word often enough, give no rows; other columns do not matter. Upper case beyond A-Z is kept,
as the contract says. Words of any length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, named, npcol, runs, save, tune

LETTERS = "A-Za-zÀ-ÿ"


def words(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters in lower case, at least ``least`` code points long and ``often`` times in the corpus.
    In a document whose crc32 with the run is a multiple of ``every``, the run loses one letter first."""
    tune(docs.sparkSession)
    thin = docs.select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").cast("binary").alias("text"))

    @lean
    def run(batches):
        find = re.compile(f"[{LETTERS}]{{{least},}}")
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                text = text.lower().decode()
                found = Counter(find.findall(text) if len(text) < 1 << 20 else (m.group() for m in find.finditer(text)))
                start = zlib.crc32(f"{key}:".encode()) if key is not None else None
                for w, n in found.items():
                    if start is not None:
                        h = zlib.crc32(w.encode(), start)
                        if h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                    total[w] += n
                if len(total) > 1 << 19:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return thin.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


class Acceptor:
    """The minimised deterministic acceptor of sorted, distinct words. ``arcs[q]`` is (symbol, state, place) in order:
    adding places along a word's arcs gives the word's index."""

    def __init__(self, sorted_words):
        self.arcs: list = [[]]
        self.final = [False]
        self.size = [0]
        known: dict = {}
        path, last = [0], ""

        def settle(depth):
            """Complete the states below ``depth`` on the last word's path, and use an equal one where there is one."""
            while len(path) > depth + 1:
                q = path.pop()
                self._place(q)
                key = (self.final[q], tuple((c, t) for c, t, _ in self.arcs[q]))
                same = known.setdefault(key, q)
                if same != q:
                    self.arcs[path[-1]][-1] = (self.arcs[path[-1]][-1][0], same, 0)

        for w in sorted_words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            settle(same)
            for c in w[same:]:
                self.arcs.append([])
                self.final.append(False)
                self.size.append(0)
                self.arcs[path[-1]].append((c, len(self.arcs) - 1, 0))
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = w
        settle(0)
        self._place(0)
        self.step = [{c: (t, place) for c, t, place in out} for out in self.arcs]

    def _place(self, q):
        at = int(self.final[q])
        for i, (c, t, _) in enumerate(self.arcs[q]):
            self.arcs[q][i] = (c, t, at)
            at += self.size[t]
        self.size[q] = at

    def _rest(self, a, i, b, j, barred=None):
        """Index pairs of words that go on alike from states a and b; the first symbol is not ``barred``."""
        todo = [(a, i, b, j, barred)]
        while todo:
            a, i, b, j, barred = todo.pop()
            if self.final[a] and self.final[b]:
                yield i, j
            other = self.step[b]
            for c, t, place in self.arcs[a]:
                if c in other and c != barred:
                    u, there = other[c]
                    todo.append((t, i + place, u, j + there, None))

    def one_edit(self):
        """(i, j) once for each two words that one edit turns into each other: this acceptor, the transducer, this acceptor."""
        todo = [(0, 0)]
        while todo:
            q, at = todo.pop()
            out = self.arcs[q]
            for k, (c, a, place) in enumerate(out):
                todo.append((a, at + place))
                for _, b, there in out[k + 1 :]:
                    yield from self._rest(a, at + place, b, at + there)
                yield from self._rest(a, at + place, q, at, c)


_FOUND = "word string, n_near bigint, best struct<less: bigint, word: string>"


def _inside(partitions: DataFrame) -> DataFrame:
    """(start, skip, word, n): near words whose edit comes after the first ``skip`` symbols, the same in all words of a start."""
    dealt = partitions.repartition("start").sortWithinPartitions("start", "word")

    @lean
    def run(batches):
        for t in runs(batches, ["start"]):
            starts = npcol(t, "start")
            edges = [0, *(np.flatnonzero(starts[1:] != starts[:-1]) + 1).tolist(), len(starts)]
            out, whole, n = [], t.column("word").to_pylist(), t.column("n").to_pylist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                skip = len(starts[lo])
                near, best = [0] * (hi - lo), [-1] * (hi - lo)
                for pair in Acceptor([w[skip:] for w in whole[lo:hi]]).one_edit():
                    for i, j in (pair, pair[::-1]):
                        near[i] += 1
                        if best[i] < 0 or (n[lo + j], -j) > (n[lo + best[i]], -best[i]):
                            best[i] = j
                out += [{"word": whole[lo + i], "n_near": k, "best": {"less": -n[lo + best[i]], "word": whole[lo + best[i]]}} for i, k in enumerate(near) if k]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))]))

    return dealt.mapInArrow(run, _FOUND)


def _at(active: DataFrame, k: int) -> DataFrame:
    """Near words whose first difference is symbol ``k`` (from 0), among words that are alike before it."""
    symbol = F.substring("word", k + 1, 1)
    without = F.concat(F.substring("word", 1, k), F.expr(f"substring(word, {k + 2})"))
    reads = F.array(F.col("word"), F.when(F.length("word") > k, without))
    rows = active.select(F.explode(reads).alias("reads"), F.struct("word", "n", symbol.alias("symbol")).alias("m")).where("reads IS NOT NULL")
    met = rows.groupBy("reads").agg(F.collect_list("m").alias("ms")).where(F.size("ms") > 1)
    each = met.select("ms", F.explode("ms").alias("m"))
    others = each.select(F.col("m.word").alias("word"), F.filter("ms", lambda x: x["symbol"] != F.col("m.symbol")).alias("near"))
    best = F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("less"), x["word"].alias("word"))))
    return others.where(F.size("near") > 0).select("word", F.size("near").cast("bigint").alias("n_near"), best.alias("best"))


def near(vocabulary: DataFrame, most: int = 4096) -> DataFrame:
    """(word, n) -> (word, n_near, best) of every word that has near words; best: of most occurrences, then the first."""
    active, k, found, inside = vocabulary, 0, [], []
    while True:
        found.append(save(_at(active, k), "edits"))
        longer = active.where(F.length("word") > k).withColumn("start", F.substring("word", 1, k + 1))
        sizes = save(longer.groupBy("start").agg(F.count(F.lit(1)).alias("words")), "states")
        large = sizes.where(F.col("words") > most)
        inside.append(longer.join(sizes.where(F.col("words") <= most), "start").select("start", "word", "n"))
        if large.isEmpty():
            break
        active, k = save(longer.join(large, "start").select("word", "n"), "active"), k + 1
    parts = inside[0]
    for x in inside[1:]:
        parts = parts.unionAll(x)
    both = _inside(parts)
    for x in found:
        both = both.unionAll(x)
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): follow the links to the last word. Each round doubles what a link spans."""
    now = save(links, "links")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = save(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        discard(now)
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now
        now._partloom_path = further._partloom_path


def variants(vocabulary: DataFrame, times: int = 5, most: int = 4096) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n: a word's form is its best near word if that occurs ``times``
    as often; forms grow in number, so they never lead back."""
    vocabulary = save(vocabulary, "vocabulary")
    joined = vocabulary.join(near(vocabulary, most), "word", "left")
    form = F.when(-F.col("best.less") >= F.lit(times) * F.col("n"), F.col("best"))
    formed = save(joined.withColumn("form", form).select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("form.word").alias("form"), (-F.col("form.less")).alias("form_n")), "formed")
    root = roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
