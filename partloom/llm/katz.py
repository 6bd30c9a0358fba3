"""A Katz backoff language model of word pairs or triples, learned and applied as Spark jobs.

P(w | u v) is the discounted share of the triple (u, v, w) among those of the context (u, v) where the triple was seen,
and the backoff weight of (u, v) times P(w | v) where it was not; P(w | v) backs off to P(w) in the same way; P(w) is
the discounted share of w, and what is left over for all unknown words together. Counts up to ``LOW`` are discounted
by Good and Turing's estimate, of pairs and of triples apart, as Katz does it; the weight of each context is what its
discounts free over what its unseen words hold, so P(. | u v) sums to one over all words and the unknown one. A context
that was never seen gives way to the shorter one. The first token has the beginning as its only context, the second
the beginning and the first. With order two, P(w | v) is the answer.

1. Texts become blocks of tokens: words by their place in a list of the block's own words.
2. Blocks deal their words to buckets by their bytes. Words are counted over all training documents and ranked by count, so that a word is a number and its count
   follows from how many words have which count, of which there are at most the square root of twice the tokens.
3. Each block learns the ranks of its words from the buckets, which look their ranked words up.
4. Each block deals its distinct triples, with the documents that have them, to parts by the middle word v: a part
   has all triples and pairs that P(. | v) and P(. | u v) need. A v with more than two parts' share of the tokens is
   dealt by (v, w): counts are still whole in one part, sums over w are not.
5. Parts count. How many pairs and triples occur once, twice, ... is summed up, and so are the sums of each dealt v (at
   most one for two parts, on the driver). What parts hold of a context (u, v) of a dealt v goes to one part by (u, v), which
   sums it and sends each part that asked the total and the weight.
6. Parts answer the blocks with sums a document. So tokens never move as single rows, and no task holds more of the
   model than a part.

Words are told apart by their bytes and pairs and triples by ranks; nothing rests on hashes. A long text is cut between
words into several blocks, with the last two words of one as context of the next.

Defined cases: null texts are empty and have the end token alone; rows of a null id are learned from; repeated rows
count and are scored again each; without training documents every token has probability one; where no word, pair or
triple occurs once, Good and Turing's estimate does not hold, and fewer counts, or all by an absolute part of half a
count, are discounted; a context whose counts are all above ``LOW`` has one added to its total, as there is nothing to
back off with otherwise; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import batch, discard, lean, named, npcol, release, runs, save, text_bytes, tune, width

#: Counts above this are not discounted.
LOW = 5
#: Tokens a block and a part; bytes of a long text that are split into words at once.
BLOCK, PART, CUT = 1 << 20, 1 << 20, 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, first bytes first, so that they compress well;
    of ``rising`` ones the differences. The first byte says how many bytes, and whether they are differences."""
    x = np.diff(x, prepend=0) if rising else x
    most = int(x.max()) if len(x) else 0
    each = max(1, (most.bit_length() + 7) // 8)
    return bytes([each + 16 * rising]) + x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :each].T.tobytes()


def unpack(x: bytes) -> np.ndarray:
    each = x[0] & 15
    flat = np.frombuffer(x, np.uint8, offset=1).reshape(each, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :each] = flat.T
    out = out.view("<i8").ravel()
    return np.cumsum(out) if x[0] & 16 else out


def pack_doubles(x: np.ndarray) -> bytes:
    """unpack() gives their bits as whole numbers."""
    return bytes([8]) + np.ascontiguousarray(x, "<f8").view(np.uint8).reshape(-1, 8).T.tobytes()


def bundle(*columns: bytes) -> bytes:
    """Packed columns as one compressed value."""
    flat = b"".join(len(x).to_bytes(4, "little") + x for x in columns)
    return len(flat).to_bytes(8, "little") + pa.compress(flat, "zstd", asbytes=True)


def unbundle(x: bytes) -> list[np.ndarray]:
    flat = pa.decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(flat):
        end = at + 4 + int.from_bytes(flat[at : at + 4], "little")
        out.append(unpack(flat[at + 4 : end]))
        at = end
    return out


def discounts(seen: list[int]) -> np.ndarray:
    """Factors of the counts 0 to LOW, given how many things were seen 1, 2, ..., LOW + 1 times."""
    out = np.ones(LOW + 1)
    for k in range(min(LOW, len(seen) - 1), 0, -1):
        if not all(seen[: k + 1]):
            continue
        shared = (k + 1) * seen[k] / seen[0]
        r = np.arange(1, k + 1)
        d = ((r + 1) * np.array(seen[1 : k + 1]) / (r * np.array(seen[:k])) - shared) / (1 - shared) if shared != 1 else np.zeros(k)
        if (d > 0).all() and (d < 1).all():
            out[1 : k + 1] = d
            return out
    r = np.arange(1, LOW + 1)
    out[1:] = (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """Counts and probabilities of words by rank, from how many words have each count. Rank 0 is every unknown word."""

    counts: np.ndarray  # falling
    last: np.ndarray  # the last rank of each count
    beginnings: int  # documents

    def __post_init__(self):
        words = np.diff(self.last, prepend=0)
        self.total, self.size = int((self.counts * words).sum()), int(words.sum())
        seen = dict(zip(self.counts.tolist(), words.tolist(), strict=True))
        d = discounts([seen.get(r, 0) for r in range(1, LOW + 2)])
        mass = self.counts * np.where(self.counts <= LOW, d[np.minimum(self.counts, LOW)], 1.0)
        whole = self.total + (float((mass * words).sum()) >= self.total * (1 - 1e-12)) if self.total else 1
        self.share = np.append(mass / whole, 0.0)
        self.unknown = 1 - float((self.share[:-1] * words).sum())

    def count(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank > 0, np.append(self.counts, 0)[np.searchsorted(self.last, rank)], 0)

    def context(self, rank: np.ndarray) -> np.ndarray:
        """How often something follows; 0 is the beginning of a document, -1 an unknown word."""
        return np.where(rank == 0, self.beginnings, self.count(rank))

    def p(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank > 0, self.share[np.searchsorted(self.last, rank)], self.unknown)


def token_blocks(batches, base: int):
    """Batches of (id, held, text) -> blocks, with numbers from ``base``."""
    row, made, ids, held, starts, opens, tokens, schema = 0, 0, [], [], [0], [], [], None

    def out():
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        local = coded.indices.to_numpy()
        often = np.argsort(-np.bincount(local, minlength=len(coded.dictionary)), kind="stable")  # frequent words get small numbers
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        return batch(schema, [[base + made], [base + row - len(ids)], [ids], [bytes(held)], [pack(np.array(starts), True)], [bytes(opens)], [pack(place[local])], pa.ListArray.from_arrays(pa.array([0, len(often)], pa.int32()), coded.dictionary.take(pa.array(often)))])

    for b in batches:
        schema = schema or pa.schema([("block", pa.int64()), ("row", pa.int64()), ("ids", pa.list_(b.schema.field(0).type)), *((c, pa.binary()) for c in ("held", "starts", "opens", "tokens")), ("words", pa.list_(pa.binary()))])
        for i, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text, at, before = (text or b"").lower(), 0, []
            row += 1
            while at is not None:
                cut = _SPACE.search(text, at + CUT) if len(text) > at + CUT else None
                words = text[at : cut.start() if cut else None].split()
                at = cut.start() if cut else None
                opens.append((1, 0, 2)[len(before)])
                tokens += before
                tokens += words
                if at is None:
                    tokens.append(b"")
                ids.append(i)
                held.append(h)
                starts.append(len(tokens))
                if len(tokens) >= BLOCK or at is not None:
                    before = [*before, *words[-2:]][-2:]
                    yield out()
                    made += 1
                    ids, held, starts, opens, tokens = [], [], [0], [], []
    if ids:
        yield out()


def blocks(docs: DataFrame) -> DataFrame:
    """(id, held, text) -> blocks of about BLOCK tokens. A block has documents ``row``, ``row`` + 1, ...; ``starts`` of
    each among the tokens; ``opens`` is 1 where it has the document's beginning, 0 where its first token, the first of the
    document, is context, and 2 where its first two tokens are."""
    kind = docs.schema["id"].dataType.simpleString()

    @lean
    def run(batches):
        from pyspark import TaskContext

        yield from token_blocks(batches, TaskContext.get().partitionId() << 33)

    return docs.select("id", "held", "text").mapInArrow(run, f"block bigint, row bigint, ids array<{kind}>, held binary, starts binary, opens binary, tokens binary, words array<binary>")


def _layout(t, i: int):
    """(local word of each token, its document in the block, whether it is a token of its own, held and opening documents)."""
    starts, opens = unpack(t["starts"][i].as_py()), np.frombuffer(t["opens"][i].as_py(), np.uint8)
    held, local = np.frombuffer(t["held"][i].as_py(), np.uint8), unpack(t["tokens"][i].as_py())
    doc = np.repeat(np.arange(len(opens)), np.diff(starts))
    own = np.ones(len(local), bool)
    own[starts[:-1][opens != 1]] = False
    own[starts[:-1][opens == 2] + 1] = False
    return local, doc, own, held, starts, opens


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _runs(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cuts(part: np.ndarray):
    """Each part and the places that have it, in order."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    first = _runs(part[order])
    return [(int(part[c[0]]), c) for c in np.split(order, first[1:])] if len(order) else []


def _buckets(data: np.ndarray, off: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each word, by its bytes."""
    at = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    sums = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * _mix((at & 63) * 2 + 1)))
    return (_mix(sums[off[1:]] - sums[off[:-1]]) % np.uint64(buckets)).astype(np.int64)


def _dealt(made: DataFrame, buckets: int) -> DataFrame:
    """Blocks -> (bucket, block, places, words): what a block has of a bucket's words: their places in its list, how often
    training documents have them, their lengths; and their bytes."""

    @lean
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, (local, doc, own, held, *_) = b["words"][i].values, _layout(b, i)
                n, out = np.bincount(local[own & (held[doc] == 0)], minlength=len(words)), []
                for bucket, c in _cuts(_buckets(*text_bytes(words), buckets)):
                    data, off = text_bytes(words.take(pa.array(c)))
                    out.append((bucket, b["block"][i].as_py(), bundle(pack(c, True), pack(n[c]), pack(np.diff(off))), bundle(b"\x01" + data.tobytes())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "places", "words"])

    return made.select("block", "held", "starts", "opens", "tokens", "words").mapInArrow(run, "bucket bigint, block bigint, places binary, words binary")


def _spelled(places: list[bytes], words: list[bytes]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(all words of some rows of _dealt, the places of each row, counts of all)."""
    at, n, sizes = zip(*map(unbundle, places), strict=True)
    data = np.concatenate([unbundle(x)[0].astype(np.uint8) for x in words])
    off = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)]), list(at), np.concatenate(n)


def counts(dealt: DataFrame, buckets: int) -> DataFrame:
    """Dealt words -> (bucket, word, n) over the training documents."""

    @lean
    def run(batches):
        for t in runs(batches, ["bucket"]):
            bucket = npcol(t, "bucket")
            for a in np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist():
                rows = t.slice(a, int((bucket == bucket[a]).sum()))
                words, _, n = _spelled(rows["places"].to_pylist(), rows["words"].to_pylist())
                coded = words.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), n, minlength=len(coded.dictionary)).astype(np.int64)
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), bucket[a])), coded.dictionary.take(pa.array(seen)).cast(pa.binary()), pa.array(n[seen])], names=["bucket", "word", "n"])

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "bucket bigint, word binary, n bigint")


def _ranks(dealt: DataFrame, ranked: DataFrame, buckets: int) -> DataFrame:
    """Dealt words and (bucket, word, rank) -> (block, ranks): places and ranks of a block's words, in pieces."""

    @lean
    def run(batches):
        for t in runs(batches, ["bucket"]):
            known = t.filter(pc.is_null(t["block"]))
            rows = t.filter(pc.is_valid(t["block"]))
            if not rows.num_rows:
                continue
            words, places, _ = _spelled(rows["places"].to_pylist(), rows["words"].to_pylist())
            at = pc.fill_null(pc.index_in(words, known["word"].cast(pa.large_binary()).combine_chunks()), -1).to_numpy()
            rank = np.append(known["rank"].to_numpy(), 0)[at].astype(np.int64)
            out = []
            for c, x in zip(places, np.split(rank, np.cumsum([len(c) for c in places])[:-1]), strict=True):
                out.append(bundle(pack(c[x > 0], True), pack(x[x > 0])))
            yield pa.RecordBatch.from_arrays([rows["block"].combine_chunks(), pa.array(out, pa.binary())], names=["block", "ranks"])

    none = F.lit(None)
    both = ranked.select("bucket", none.cast("bigint").alias("block"), "word", "rank", none.cast("binary").alias("places"), none.cast("binary").alias("words"))
    both = both.unionAll(dealt.select("bucket", "block", none.cast("binary").alias("word"), none.cast("bigint").alias("rank"), "places", "words"))
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block")).mapInArrow(run, "block bigint, ranks binary")


def _part(v: np.ndarray, w: np.ndarray, large: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair: by its context, or by both words where the context is large."""
    return (_mix(np.where(large, _mix(v) + _mix(w + 1), v)) % np.uint64(parts)).astype(np.int64)


@dataclass
class Model:
    """What every task may hold of the model; the counts are in the table of what blocks ask."""

    order: int
    unigrams: Unigrams
    parts: int
    most: float  # tokens; words with more are dealt by what follows them
    pairs: np.ndarray | None = None  # factors of the counts of pairs
    triples: np.ndarray | None = None
    dealt: dict[int, tuple[float, float]] | None = None  # context -> its total, its backoff weight

    def hot(self, v: np.ndarray) -> np.ndarray:
        """Which contexts are dealt by what follows them. Ranks follow counts, so these are the first ones."""
        u = self.unigrams
        few = np.flatnonzero(u.counts <= self.most)[:1]
        last = (u.last[few[0] - 1] if few[0] else 0) if len(few) else u.size
        return (v <= last) & (v > 0) | (v == 0) & (u.beginnings > self.most)


def _words(t, i: int):
    """(rank of each word of a block, 0 for unknown ones; what _layout gives)."""
    local, *rest = _layout(t, i)
    rank = np.zeros(int(local.max()) + 1 if len(local) else 1, np.int64)
    for x in t["ranks"][i].as_py() or []:
        places, ranks = unbundle(x)
        rank[places] = ranks
    return rank, local, *rest


def _before(x: np.ndarray, starts: np.ndarray, opens: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(word before the word before, word before) of each token; ``begin`` stands before the first."""
    u, v = np.full(len(x), begin), np.full(len(x), begin)
    v[1:], u[2:] = x[:-1], x[:-2]
    first, some = starts[:-1], np.diff(starts) > 0  # of a long text of white space a piece may be empty
    v[first[some & (opens == 1)]] = begin
    second = first[some & (opens != 2)] + 1
    u[second[second < len(x)]] = begin
    u[v == begin] = begin
    return u, v


def _block_grams(t, i: int, order: int):
    """Distinct triples (u, v, w) of a block by rank, in order of v, u and w, with v known or the beginning; how often
    training documents have each; how many documents have it, which, and how often. -1 is an unknown u, 0 the beginning
    and, as w, every unknown word. With order two, u is 0."""
    rank, local, doc, own, held, starts, opens = _words(t, i)
    ranks = np.sort(rank[rank > 0])
    table = np.concatenate([[-1, 0], ranks])
    x = np.where(rank > 0, np.searchsorted(ranks, rank) + 2, 0)[local]
    u, v = _before(x, starts, opens, 1)
    if order == 2:
        u[:] = 1
    use = own & (v > 0)
    u, v, w, doc = u[use], v[use], x[use], doc[use]
    bits = len(table).bit_length()
    if bits < 22:
        key = (v << bits | u) << bits | w
        by = np.argsort(key)
        key = key[by]
        first = _runs(key)
        key = key[first]
        v, u, w = key >> 2 * bits, key >> bits & ((1 << bits) - 1), key & ((1 << bits) - 1)
    else:
        by = np.lexsort((w, u, v))
        u, v, w = u[by], v[by], w[by]
        first = _runs(v, u, w)
        u, v, w = u[first], v[first], w[first]
    doc = doc[by]
    gram = np.zeros(len(doc), np.int64)
    gram[first[1:]] = 1
    each = np.sort(np.cumsum(gram) << 32 | doc)
    single = _runs(each)
    times, gram, doc = np.diff(np.append(single, len(each))), each[single] >> 32, each[single] & 0xFFFFFFFF
    n = np.bincount(gram, times * (held[doc] == 0), minlength=len(first)).astype(np.int64)
    return table[u], table[v], np.maximum(table[w], 0), n, np.bincount(gram, minlength=len(first)), doc, times


def _inner(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the members of the groups at ``places``, where group i has those from ``ends[i]`` to ``ends[i + 1]``."""
    start, own = ends[places], ends[places + 1] - ends[places]
    if len(own) and own.max() == 1:
        return start
    return np.repeat(start - np.cumsum(own) + own, own) + np.arange(int(own.sum()))


def _asks(coded: DataFrame, model: Model) -> DataFrame:
    """Coded blocks -> (part, row, grams, docs): what a block has of a part's triples."""

    @lean
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                u, v, w, n, docs, doc, times = _block_grams(b, i, model.order)
                out, ends = [], np.append(0, np.cumsum(docs))
                for p, c in _cuts(_part(v, w, model.hot(v), model.parts)):
                    inner = _inner(c, ends)
                    out.append((p, bundle(pack(v[c], True), *map(pack, (u[c] + 1, w[c], n[c]))), bundle(*map(pack, (docs[c], doc[inner], times[inner])))))
                if out:
                    part, grams, who = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([b["row"][i].as_py()] * len(out)), pa.array(grams, pa.binary()), pa.array(who, pa.binary())], names=["part", "row", "grams", "docs"])

    return coded.select("row", "held", "starts", "opens", "tokens", "ranks").mapInArrow(run, "part bigint, row bigint, grams binary, docs binary")


def _by_part(batches):
    """Batches sorted by their first column, part -> (part, its rows as dictionaries)."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["part"] != now:
                if rows:
                    yield now, rows
                now, rows = r["part"], []
            rows.append(r)
    if rows:
        yield now, rows


class _Counts:
    """Pairs, contexts and triples of a part, each in order, with counts. Keys are v << 32 | w, v << 32 | u + 1 and
    place of the context << 32 | w."""

    def __init__(self, grams: list[bytes]):
        v, u, w, n = (np.concatenate(x) for x in zip(*map(unbundle, grams), strict=True))
        v <<= 32
        self.contexts, at = np.unique(v | u, return_inverse=True)
        self.triples, self.triple = np.unique(at << 32 | w, return_inverse=True)  # the second: of each asked row
        v |= w
        del u, w, at
        self.pairs, pair = np.unique(v, return_inverse=True)
        self.n2 = np.bincount(pair, n, minlength=len(self.pairs)).astype(np.int64)
        self.n3 = np.bincount(self.triple, n, minlength=len(self.triples)).astype(np.int64)
        self.pair = np.empty(len(self.triples), np.int64)
        self.pair[self.triple] = pair
        self.context = self.triples >> 32
        self.v = self.contexts >> 32


def _classes(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """For each group: how many counts are 1, 2, ..., LOW, and the sum of those above; rows are groups."""
    k = np.minimum(n, LOW + 1) - 1
    return np.bincount(at * (LOW + 1) + k, np.where(n > LOW, n, 1), minlength=size * (LOW + 1)).astype(np.int64).reshape(size, LOW + 1)


def _mass(classes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The discounted counts of each row of _classes."""
    return classes @ np.append(np.arange(1, LOW + 1) * factors[1:], 1.0)


def _count(asked: DataFrame, model: Model) -> DataFrame:
    """Asks -> rows of three kinds. key -1: ``nums`` has how many pairs and triples were seen 1, 2, ..., LOW + 1 times. key
    from 0: a dealt context, with the classes of its counts and what P gives its seen words, as far as a part has them.
    key null: ``sums`` has contexts of two words that end with a dealt one, from part ``origin`` for ``part``: keys, and
    classes of the counts of their triples and of the pairs in these."""
    names = ["key", "nums", "p", "part", "origin", "sums"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64(), pa.int64(), pa.binary()]

    @lean
    def run(batches):
        for now, rows in _by_part(batches):
            c = _Counts([r["grams"] for r in rows])
            del rows
            triples = c.n3[c.v[c.context] > 0] if model.order > 2 else c.n3[:0]
            seen = [np.bincount(n[n <= LOW + 1], minlength=LOW + 2)[1:] for n in (c.n2, triples)]
            out = [(-1, np.concatenate(seen).tolist(), 0.0, None, None, None)]
            use = np.flatnonzero(model.hot(c.pairs >> 32) & (c.n2 > 0))
            v, at = np.unique(c.pairs[use] >> 32, return_inverse=True)
            p = np.bincount(at, model.unigrams.p(c.pairs[use] & 0xFFFFFFFF), minlength=len(v))
            out += [(*x, None, None, None) for x in zip(v.tolist(), _classes(at, c.n2[use], len(v)).tolist(), p.tolist(), strict=True)]
            if model.order > 2:
                hot = np.flatnonzero(model.hot(c.v) & (c.v > 0))
                place = np.zeros(len(c.v), np.int64)
                place[hot] = np.arange(1, len(hot) + 1)
                use = np.flatnonzero((place[c.context] > 0) & (c.n3 > 0))
                at = place[c.context[use]] - 1
                sums = np.hstack([_classes(at, n[use], len(hot)) for n in (c.n3, c.n2[c.pair])])
                key = c.contexts[hot]
                for part, x in _cuts(_part(key >> 32, key & 0xFFFFFFFF, np.ones(len(key), bool), model.parts)):
                    out.append((None, None, None, part, now, bundle(pack(key[x], True), pack(sums[x].T.ravel()))))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    grams = asked.select("part", "row", "grams").repartition(model.parts, "part").sortWithinPartitions("part", "row")
    return grams.mapInArrow(run, "key bigint, nums array<bigint>, p double, part bigint, origin bigint, sums binary")


def _held(n: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return n * np.where(n <= LOW, factors[np.minimum(n, LOW)], 1.0)


def _weights(total: np.ndarray, mass: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals of contexts (one more where nothing was discounted) and backoff weights; ``seen``: what P gives the seen words."""
    total = total + (mass >= total * (1 - 1e-12))
    return total, (1 - mass / total) / np.maximum(1 - seen, 1e-300)


def _learn(counted: DataFrame, model: Model) -> None:
    """Factors, and the sums of contexts that several parts share."""
    sums = counted.where("key IS NOT NULL")
    nums = sums.select("key", F.posexplode("nums").alias("at", "n")).groupBy("key", "at").agg(F.sum("n").alias("n")).collect()
    p = {r.key: r.p for r in sums.groupBy("key").agg(F.sum("p").alias("p")).collect()}
    of: dict[int, list[int]] = {k: [0] * (2 * (LOW + 1)) for k in (-1, *p)}
    for r in nums:
        of[r.key][r.at] = r.n
    model.pairs, model.triples = discounts(of[-1][: LOW + 1]), discounts(of[-1][LOW + 1 :])
    v = np.array(sorted(k for k in p if k >= 0), np.int64)
    classes = np.array([of[k][: LOW + 1] for k in v.tolist()], np.int64).reshape(-1, LOW + 1)
    total, weight = _weights(model.unigrams.context(v).astype(float), _mass(classes, model.pairs), np.array([p[k] for k in v.tolist()]))
    model.dealt = dict(zip(v.tolist(), zip(total.tolist(), weight.tolist(), strict=True), strict=True))


def _shared(counted: DataFrame, model: Model) -> DataFrame:
    """Counts -> (part, sums): totals and backoff weights of the contexts that several parts share, for each that asked."""

    @lean
    def run(batches):
        for _, rows in _by_part(batches):
            keys, classes = zip(*(unbundle(r["sums"]) for r in rows), strict=True)
            classes = np.concatenate([x.reshape(2 * (LOW + 1), -1) for x in classes], axis=1)
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            classes = np.stack([np.bincount(at, x, minlength=len(key)) for x in classes], 1)
            triples, pairs = classes[:, : LOW + 1], classes[:, LOW + 1 :]
            v, which = np.unique(key >> 32, return_inverse=True)
            whole = np.array([model.dealt[k][0] for k in v.tolist()])[which]
            n = triples @ np.append(np.arange(1, LOW + 1), 1)
            total, weight = _weights(n, _mass(triples, model.triples), _mass(pairs, model.pairs) / whole)
            out = [bundle(pack(key[x], True), pack_doubles(total[x]), pack_doubles(weight[x])) for x in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([r["origin"] for r in rows]), pa.array(out, pa.binary())], names=["part", "sums"])

    contexts = counted.where("part IS NOT NULL").select("part", "origin", "sums")
    return contexts.repartition(model.parts, "part").sortWithinPartitions("part", "origin").mapInArrow(run, "part bigint, sums binary")


def _coded(made: DataFrame, ranks: DataFrame) -> DataFrame:
    """Blocks with the ranks of their words instead of the words."""
    return made.drop("words").join(ranks.groupBy("block").agg(F.collect_list("ranks").alias("ranks")), "block", "left")


def fit(docs: DataFrame, order: int) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """(id, held, text) -> the model of the documents not held; what needs no context of all documents; asks; counts."""
    spark = docs.sparkSession
    made = save(blocks(docs), "blocks", "zstd")
    buckets = width(spark)
    dealt = save(_dealt(made, buckets), "dealt")
    ranked = save(numbered(counts(dealt, buckets), F.desc("n"), "word", name="rank"), "words")
    of = ranked.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    ends = ranked.where(F.length("word") == 0).select("n").first()
    unigrams = Unigrams(np.array([r.n for r in of], np.int64), np.cumsum(np.array([r.words for r in of], np.int64)), ends.n if ends else 0)
    release(spark)
    coded = save(_coded(made, _ranks(dealt, ranked, buckets)), "coded", "zstd")
    discard(made, dealt, ranked)
    release(spark)
    parts = max(width(spark), -(-unigrams.total // PART))
    model = Model(order, unigrams, parts, 2 * unigrams.total / parts)
    plain = save(_plain(coded, unigrams), "plain")
    asked = save(_asks(coded, model), "asked")
    discard(coded)
    del coded
    release(spark)
    counted = save(_count(asked, model), "counted")
    release(spark)
    _learn(counted, model)
    return model, plain, asked, counted


def _log_p(c: _Counts, model: Model, shared: list[bytes]) -> np.ndarray:
    """log10 P of each triple of a part; ``shared`` has the totals and weights of contexts that others have part of."""
    u = model.unigrams
    v, p = c.pairs >> 32, u.p(c.pairs & 0xFFFFFFFF)
    first = _runs(v)
    alone = v[first]
    held = _held(c.n2, model.pairs)
    total, weight = _weights(u.context(alone).astype(float), *(np.add.reduceat(x, first) for x in (held, p * (c.n2 > 0))))
    for k in np.flatnonzero(model.hot(alone)):
        total[k], weight[k] = model.dealt[int(alone[k])]
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
    share = held / total[at]
    log = np.log10(np.where(c.n2 > 0, share, weight[at] * p))[c.pair]
    if model.order == 2:
        return log
    held, seen = _held(c.n3, model.triples), c.n3 > 0
    sums = (np.bincount(c.context, x, minlength=len(c.contexts)) for x in (c.n3, held, share[c.pair] * seen))
    total, weight = _weights(*sums)
    if shared:
        key, wholes, weights = (np.concatenate(x) for x in zip(*map(unbundle, shared), strict=True))
        place = np.searchsorted(c.contexts, key)
        total[place], weight[place] = wholes.view(float), weights.view(float)
    longer = (c.v > 0)[c.context]
    with np.errstate(divide="ignore"):
        return np.where(longer, np.where(seen, np.log10(held / total[c.context]), np.log10(weight)[c.context] + log), log)


def _plain(coded: DataFrame, u: Unigrams) -> DataFrame:
    """Coded blocks -> what needs no context: counts, the base score, and tokens after an unknown word."""
    kind = coded.schema["ids"].dataType.elementType.simpleString()

    @lean
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rank, local, doc, own, held, starts, opens = _words(b, i)
                after = np.zeros(len(local), bool)  # an unknown word
                after[1:] = rank[local[:-1]] == 0
                after[starts[:-1][(opens == 1) & (np.diff(starts) > 0)]] = False
                after &= own
                c = u.count(rank)
                total = lambda x, where: np.bincount(doc[where], x[local[where]], minlength=len(held)).astype(float)  # noqa: E731, B023
                n, known, base = (total(x, own) for x in (np.ones(len(c)), c > 0, np.log10((c + 1) / (u.total + u.size + 1))))
                yield pa.RecordBatch.from_arrays([pa.array(b["row"][i].as_py() + np.arange(len(held))), b["ids"][i].values, pa.array(held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total(np.log10(u.p(rank)), after))], names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return coded.select("row", "ids", "held", "starts", "opens", "tokens", "ranks").mapInArrow(run, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def _by_document(log: np.ndarray, docs: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Sums a document, with the documents that have some."""
    total = np.bincount(doc, np.repeat(log, docs) * times)
    hit = np.flatnonzero(np.bincount(doc))
    return bundle(pack(hit, True), pack_doubles(total[hit]))


def _answers(asked: DataFrame, shared: DataFrame, model: Model) -> DataFrame:
    """Asks and what parts share -> (row, sums) of blocks."""

    @lean
    def run(batches):
        for _, rows in _by_part(batches):
            sums, rows = [r["grams"] for r in rows if r["row"] is None], [r for r in rows if r["row"] is not None]
            c = _Counts([r.pop("grams") for r in rows])
            log, triple, at, out = _log_p(c, model, sums), c.triple, 0, []
            del c
            for r in rows:
                docs, doc, times = unbundle(r["docs"])
                total = np.bincount(doc, np.repeat(log[triple[at : at + len(docs)]], docs) * times)
                at += len(docs)
                hit = np.flatnonzero(np.bincount(doc))
                out.append(bundle(pack(hit, True), pack_doubles(total[hit])))
            yield pa.RecordBatch.from_arrays([pa.array([r["row"] for r in rows]), pa.array(out, pa.binary())], names=["row", "sums"])

    none = F.lit(None)
    both = asked.unionAll(shared.select("part", none.cast("bigint").alias("row"), F.col("sums").alias("grams"), none.cast("binary").alias("docs")))
    return both.repartition(model.parts, "part").sortWithinPartitions("part", F.asc_nulls_first("row")).mapInArrow(run, "row bigint, sums binary")


def score(model: Model, plain: DataFrame, answers: DataFrame) -> DataFrame:
    """Counts and answers (row, sums) -> id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""

    @lean
    def add(batches):
        """The parts' answers to one block, summed a document."""
        now, held = None, np.zeros(0)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(now + np.arange(len(held))), pa.array(held)], names=["row", "score"])

        for b in batches:
            for row, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row != now:
                    if now is not None:
                        yield out()
                    now, held = row, np.zeros(0)
                docs, sums = unbundle(sums)
                held = np.append(held, np.zeros(max(0, int(docs[-1]) + 1 - len(held))))
                held[docs] += sums.view(float)
        if now is not None:
            yield out()

    answers = answers.repartition("row").sortWithinPartitions("row").mapInArrow(add, "row bigint, score double")
    empty = [F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in plain.columns[1:-1]]
    rows = plain.unionAll(answers.select("row", *empty, "score")).groupBy("row")
    out = rows.agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(model.unigrams.total).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexities(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Learn from the rows where ``held`` (a column) is not true, and score all rows. The result is a written table."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    tune(spark)
    thin = docs.select(named(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), named(text_col).cast("string").cast("binary").alias("text"))
    model, plain, asked, counted = fit(thin, order)
    shared = save(_shared(counted, model), "shared")
    discard(counted)
    release(spark)
    answers = _answers(asked, shared, model)
    out = save(score(model, plain, answers), "scores")
    discard(plain, asked, shared)
    return out
