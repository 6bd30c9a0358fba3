"""Best-fit packing with Martello-Toth dominance reduction.

Items are the token counts of document pieces, integers from 1 to the sequence length, so a whole corpus is
one histogram of at most ``capacity`` counts. The plan is made on that histogram: whole runs of equal items are
fixed or placed at once, and what comes out is a table of slots, each a range of ranks within one size. The
driver's work does not grow with the corpus; documents are ranked within their size by a two-level count.

Defined cases: null or empty text is a document of the end token alone; runs of millions of one kind of character
are taken whole; repeated rows are packed as often as
they come; null ids are kept; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, save, tune

#: The word pattern and the printable stand-ins for bytes of this family of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that pattern means it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

LONG = 4096
LONG_SPACE = re.compile(f"[{SPACE}]{{{LONG},}}")

_encoders: dict[int, object] = {}


def pattern_of(model: dict) -> str:
    """The word pattern that the file's settings stand for; raises on settings that encoder() does not follow."""
    steps = model["pre_tokenizer"] or {}
    steps = steps["pretokenizers"] if steps.get("type") == "Sequence" else [steps]
    level = steps[-1]
    split = steps[:-1]
    known = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and len(split) == (0 if level.get("use_regex", True) else 1)
    known &= all(s.get("type") == "Split" and s.get("behavior") == "Isolated" and not s.get("invert") and "Regex" in s.get("pattern", {}) for s in split)
    bpe, added = model["model"], model.get("added_tokens", [])
    known &= bpe.get("type") == "BPE" and not model.get("normalizer") and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    known &= not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not known:
        raise ValueError("not a plain byte-level BPE vocabulary")
    return split[0]["pattern"]["Regex"] if split else PATTERN


class Encoder:
    """A fast encoder for a byte-level BPE vocabulary file, giving the ids its own library gives (tests compare).

    The file's added tokens are matched in texts, as that library does by default. Its merges must be in the order of
    their ids, which is how this encoder ranks them. The word pattern looks back over a whole run of white space, and
    its engine gives up on very long ones; so a run of over LONG characters is taken out first. The pattern makes one
    word of it, without its last character where something else than an added token follows."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        shown = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        model = json.loads(vocabulary)
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        pattern, at = pattern_of(model), [model["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        if any(a >= b for a, b in zip(at, at[1:], strict=False)):
            raise ValueError("merges are not in the order of their ids")
        self.added = tuple(special)
        self.words = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}) if pattern == PATTERN else None

    def ids(self, text: str) -> np.ndarray:
        out, at = [], 0
        for run in LONG_SPACE.finditer(text) if self.whole else ():
            end = run.end() - (run.end() < len(text) and not text.startswith(self.added, run.end()))
            out += [self._words(text[at : run.start()]), self.whole.encode_to_numpy(text[run.start() : end], disallowed_special=())]
            at = end
        return np.concatenate([*out, self._words(text[at:])])

    def _words(self, text: str) -> np.ndarray:
        return self.words.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def encoder(vocabulary: bytes) -> Encoder:
    key = zlib.crc32(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def ids_of(enc: Encoder, text: str | None, end_id: int) -> np.ndarray:
    ids = enc.ids(text) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(end_id)).astype("<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def reduce_histogram(count: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Fix every bin that provably dominates all others holding its largest item; shrinks ``count`` in place.

    For an item j with room r left: {j} if nothing fits; {j, k} if k fills r exactly, or if at most one more item
    fits (k the largest that fits), or if at most two more fit and no pair that fits outweighs k.
    """
    fixed: list[tuple[int, list[int]]] = []
    for j in range(capacity, 0, -1):
        while count[j]:
            rest = count.copy()
            rest[j] -= 1
            room = capacity - j
            sizes = np.flatnonzero(rest[: room + 1])
            if not len(sizes):
                fixed.append((int(count[j]), [j]))
                count[j] = 0
                break
            k = int(sizes[-1])
            small: list[int] = []
            for s in sizes:
                small += [int(s)] * int(min(rest[s], 3 - len(small)))
                if len(small) == 3:
                    break
            two, three = sum(small[:2]) if len(small) > 1 else room + 1, sum(small) if len(small) > 2 else room + 1
            ok = k == room or two > room
            if not ok and three > room:
                best, hi = 0, len(sizes) - 1
                for lo in range(len(sizes)):
                    while hi >= 0 and sizes[lo] + sizes[hi] > room:
                        hi -= 1
                    a, b = lo, hi
                    while b >= 0 and (a == b and rest[sizes[a]] < 2):
                        b -= 1
                    if b >= 0:
                        best = max(best, int(sizes[a] + sizes[b]))
                ok = best <= k
            if not ok:
                break
            m = int(count[j] // 2) if k == j else int(min(count[j], count[k]))
            fixed.append((m, [j, k]))
            count[j] -= m
            count[k] -= m
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over a histogram: bins of equal content are one (how many, items) group."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            fits = [r for r, g in open_.items() if r >= s and g]
            if fits:
                r = min(fits)
                m, items = open_[r].pop()
            else:
                r, m, items = capacity, max(1, left // (capacity // s)), []
            each = r // s
            full = min(m, left // each)
            if full:
                open_.setdefault(r - each * s, []).append((full, items + [s] * each))
                left -= full * each
                if m > full and fits:
                    open_.setdefault(r, []).append((m - full, items))
            else:
                open_.setdefault(r - left * s, []).append((1, items + [s] * left))
                if m > 1:
                    open_.setdefault(r, []).append((m - 1, items))
                left = 0
        for r in [r for r, g in open_.items() if not g]:
            del open_[r]
    return [g for r in sorted(open_) for g in open_[r]]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots, sorted by size and first rank: items of that size from that rank on go to consecutive sequences."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        count[s] = n
    groups = reduce_histogram(count, capacity) + best_fit(count, capacity)
    rank = np.zeros(capacity + 1, np.int64)
    slots, seq = [], 0
    for m, items in groups:
        at = 0
        for s in items:
            slots.append((s, int(rank[s]), seq, at))
            rank[s] += m
            at += s
        seq += m
    slots.sort()
    out = np.array(slots, np.int64).reshape(-1, 4)
    return {"key": (out[:, 0] << 48) + out[:, 1], "rank": out[:, 1], "seq": out[:, 2], "at": out[:, 3], "sequences": np.array([seq])}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids``, little-endian unsigned 32-bit, if ``with_ids``)."""
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed file, whatever the corpus
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    @lean
    def pieces(batches):
        enc, part = encoder(vocabulary.value), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            rows = []
            for i in range(b.num_rows):
                t = ids_of(enc, texts[i].as_py(), end_id)
                for p, (s, n) in enumerate(cuts(len(t), capacity)):
                    raw = t[s : s + n].tobytes()
                    r = seen.get(n, 0)
                    seen[n] = r + 1
                    rows.append((i, p, s, n, zlib.crc32(raw), part, r, raw if with_ids else None))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 8
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "local", *["ids"] * with_ids]
            types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = [ids.take(pa.array(c[0], pa.int64())), *(pa.array(x, t) for x, t in zip(c[1:], types[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint" + ", ids binary" * with_ids
    cut = save(thin.mapInArrow(pieces, schema), "pieces")
    each = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = each.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))

    @lean
    def place(batches):
        s = slots.value
        for b in batches:
            n, r = (b.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(s["key"], (n << 48) + r, "right") - 1
            keep = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(s["seq"][at] + r - s["rank"][at]), pa.array(s["at"][at])], names=[*keep, "sequence_id", "offset"])

    placed = cut.join(before, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("before") + F.col("local")).alias("rank"))
    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + ", sequence_id bigint, offset bigint"
    return placed.mapInArrow(place, schema).withColumnRenamed("id", id_col)
