"""SimHash near-duplicate groups over a byte-position inverted index with count filtering.

Fingerprints that differ in at most ``bits`` of 64 bits agree in at least 8 - bits of their 8 bytes, so a pair
shares that many postings (position, byte). Postings of one byte grow as 1/256 of the corpus, and pairs of one posting
with its square; so pairs are drawn from the intersections of the postings of every 8 - bits positions (70 for four
bits), where a pair meets if it can reach the minimum at all. For each pair that meets, its shared postings are
tallied; pairs below the minimum go, and the others are verified on the bits. A list of an intersection holds a
fingerprint in 2**32 by chance, so lists stay short in a corpus of billions.

A list that many distinct fingerprints share is cut into blocks, and every pair of blocks is one group of
rows; within a group a search over the not yet linked fingerprints gives a spanning forest, never all pairs. Which
lists to cut is told by the fingerprints of one hash in sixteen; uncut and cut lists give the same links.

Defined cases: null and empty texts have the fingerprint zero and link like any other; exact copies share a
fingerprint and are linked once; rows with a null id keep their fingerprint, link nothing and have a null
component; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, named, npcol, runs, save, tune
from .components import components


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of all words if there are fewer."""
    w = text.lower().split()  # bytes: A-Z, and the white space x20, x09-x0D
    if not w:
        return np.zeros(0, np.uint64)
    h, line = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - words + 1]
    return np.fromiter((h(line[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(h: np.ndarray) -> int:
    """Bit set if set in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big") if len(h) else 0


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): fp as a signed 64-bit integer, key a hash of the text."""
    tune(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))

    @lean
    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t or b"", words, seed)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "key", "fp"])

    return thin.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, key bigint, fp bigint")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many postings (position, byte) each pair shares: of eight, those where the bytes are equal."""
    return ((a ^ b).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that share at least the 8 - bits postings that ``bits`` differing bits must leave, then verified bit by bit."""
    out = tally(a, b) >= 8 - bits
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= bits
    return out


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of links connect, each between a found and a newly found fingerprint."""
    left, right = [], []
    todo = np.arange(len(fp))
    while len(todo) > 1:
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop()
            hit = near(np.full(len(todo), fp[at]), fp[todo], bits)
            found = todo[hit]
            left.append(np.full(len(found), at))
            right.append(found)
            front += found.tolist()
            todo = todo[~hit]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(left).astype(np.int64), cat(right).astype(np.int64)


def links(distinct: DataFrame, bits: int = 4, hot: int = 4096) -> DataFrame:
    """``distinct`` (fp, node) -> links (u, v) whose chains join all fingerprints within ``bits`` (one to four)."""
    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(255)
    keys = []
    for i, positions in enumerate(combinations(range(8), 8 - bits)):
        key = F.lit(i).cast("bigint")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    post = lambda df: df.select("fp", "node", F.explode(F.array(*keys)).alias("k"))
    posted = post(distinct)
    some = post(distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(16)) == 0)).groupBy("k").agg((F.count(F.lit(1)) * 16).alias("n"))
    many = save(some.where(F.col("n") > hot).select("k", F.ceil(F.col("n") / hot).cast("int").alias("blocks")), "hot")
    cold = posted.join(many, "k", "left_anti").select("k", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "node")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    split = posted.join(many, "k").withColumn("b", block).select("k", "b", "fp", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    split = split.select("k", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "fp", "node")
    groups = cold.unionAll(split).repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "node")

    @lean
    def run(batches):
        for t in runs(batches, ["k", "x", "y"]):
            fp, node = npcol(t, "fp").astype(np.int64).view(np.uint64), npcol(t, "node")
            key = np.rec.fromarrays([npcol(t, c) for c in ("k", "x", "y")])
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(fp)))
            us, vs = [], []
            run_of = np.repeat(np.arange(len(first)), size)
            few = size <= 32
            small = few[run_of]
            for d in range(1, int(size[few].max()) if few.any() else 1):
                i = np.flatnonzero(small[:-d] & (run_of[:-d] == run_of[d:])) if d < len(fp) else np.zeros(0, np.int64)
                if not len(i):
                    break
                i = i[near(fp[i], fp[i + d], bits)]
                us.append(node[i])
                vs.append(node[i + d])
            for g in np.flatnonzero(~few):
                s = slice(first[g], first[g] + size[g])
                a, b = forest(fp[s], bits)
                us.append(node[s][a])
                vs.append(node[s][b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    kind = distinct.schema["node"].dataType.simpleString()
    return groups.mapInArrow(run, f"u {kind}, v {kind}")


def group(docs: DataFrame, bits: int = 4, words: int = 4, seed: int = 42, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, component_id) of every row; ids are integers."""
    marked = save(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    distinct = save(marked.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "distinct")
    joined = components(links(distinct, bits, hot))
    named = distinct.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = marked.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), "key", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id; of rows that repeat an id, the first by the hash of its text and
    its other columns as JSON. Rows without an id stay. Other columns may have any name and type."""
    found = group(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), bits, id_col="id", text_col="text")
    kept = found.where("id = component_id").select("id", "key").distinct()
    whole = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    others = F.struct(F.lit(0).alias("c"), *[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    keyed = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("key"), whole.alias("row"), F.to_json(others, {"ignoreNullFields": "false"}).alias("others"))
    first = keyed.join(kept, ["id", "key"]).groupBy("id").agg(F.min_by("row", F.struct("key", "others")).alias("row"))
    rows = first.select("row").unionAll(keyed.where("id IS NULL").select("row"))
    return rows.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
