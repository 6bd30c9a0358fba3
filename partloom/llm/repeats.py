"""Removal of repeated passages: every byte covered by a string of ``least`` bytes that also starts elsewhere.

Every string of ``least`` bytes has an anchor: the least hash among its ``gram``-byte grams, the first if tied.
Equal strings have equal anchors at equal places, so a text's strings fall into segments, one for each anchor,
and only segments with equal anchors can share a string. Anchors are one to some ninety bytes.

Segments are counted by (anchor, bytes). One that occurs twice is repeated as a whole. Of the others, those whose
anchor has other segments too are compared: their bytes are joined, the Burrows-Wheeler transform is made, and
intervals are expanded by backward extension, common prefixes in increasing order, up to ``least``. Where very
many different segments share an anchor, they are cut into shorter segments keyed by the longer core that their
strings have in common, and counted again; the last cut is single strings, for which counting is exact. So no
group grows beyond ``hot`` segments, and none is dropped. Segments are told apart by the hash of their
anchor and a keyed BLAKE2 digest of their bytes, whose key each run draws anew, so that texts cannot be made to
collide; anchors and cores by hashes that only say what to compare; what goes through the transform is compared byte
for byte. Results do not depend on the key. Frequent
anchors and segments are dealt to many tasks; rows alike in id and text give their examples once.

Defined cases: null text is empty; texts below ``least`` bytes lose nothing; repeated rows, with equal or null
ids too, are other places to each other; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import repeated
from .common import discard, lean, named, release, runs, save, slices, text_bytes, tune
from .textvec import mixed, prefix, span

GRAM = 32
CHUNK = 1 << 19
#: Bytes of whole groups that are compared at once; small enough to stay in a core's cache.
BATCH = 256 << 10
#: Lengths of the ranges of starts that hot segments are cut into, one after the other; the last is single strings.
CUTS = (32, 8, 1)
#: Keys that are dealt to several tasks, and to how many; a key that is not among so many has few of all rows.
HOT_KEYS, SALTS = 1024, 64


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each ``w`` consecutive hashes (by their upper 40 bits), the first if tied."""
    n = len(h)
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """Keyed BLAKE2 of each byte range: nobody can make two of equal digest without the run's own random key."""
    raw = data.tobytes()
    return np.frombuffer(b"".join([hashlib.blake2b(raw[x:y], digest_size=8, key=key).digest() for x, y in zip(start.tolist(), end.tolist(), strict=True)]), "<u8")


def segments(data: np.ndarray, off: np.ndarray, least: int, key: bytes) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, anchor hash, segment digest) of all segments of the rows."""
    w = least - GRAM + 1
    if len(data) < least:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    pre = prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    h = span(pre, at, at + GRAM)
    anchor = window_argmin(h, w)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = row[: len(anchor)] == row[least - 1 :]
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (row[1 : len(anchor)] != row[: len(anchor) - 1])
    first = np.flatnonzero(edge & ok)
    bounds = np.flatnonzero(np.append(edge | ~ok, True))
    n = bounds[np.searchsorted(bounds, first, "right")] - first
    a = anchor[first]
    s = digests(data, first, first + n + least - 1, key) + mixed((a - first).astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64))
    return row[first], first - off[row[first]], n, h[a], s


def _occurrences(docs: DataFrame, least: int, key: bytes) -> DataFrame:
    @lean
    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(2))
            for i, j in slices(off):
                own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                for c in range(0, max(1, len(own) - least + 1), CHUNK) if j == i + 1 else (0,):
                    part = own[c : c + CHUNK + least - 1] if j == i + 1 else own
                    r, lo, n, a, s = segments(part, np.array([0, len(part)]) if j == i + 1 else o, least, key)
                    take = pa.array(r + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(lo + c), pa.array(n), pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(np.ones(len(r), np.int64))], names=["kid", "th", "lo", "n", "a", "s", "c"])

    return docs.select("kid", "th", "text").mapInArrow(run, "kid bigint, th bigint, lo bigint, n bigint, a bigint, s bigint, c bigint")


def _hot(rows: DataFrame, by: list[str]) -> DataFrame:
    """At most ``HOT_KEYS`` keys that a sixteenth of ``rows`` shows to be frequent. It only tells how to deal rows."""
    seen = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 16")
    return save(seen.orderBy(F.desc("n"), *by).limit(HOT_KEYS).select(*by, F.lit(SALTS).alias("salts")), "hot")


def _sixteenth(*by: str):
    return F.pmod(F.xxhash64(*by), F.lit(16)) == 0


def _split_join(many: DataFrame, few: DataFrame, by: list[str], hot: DataFrame, salt, how: str = "inner") -> DataFrame:
    """Join on ``by``, where rows of ``many`` with a hot key are dealt to ``SALTS`` tasks, and ``few`` to each."""
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    many = many.join(hot, by, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(salt, F.lit(SALTS)).cast("int")).otherwise(0)).drop("salts")
    few = few.join(hot, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return many.join(few, [*by, "salt"], how).drop("salt")


def _count(rows: DataFrame) -> DataFrame:
    """(a, s, c, kinds): occurrences of each segment, and how many its anchor has; those alone in both are left out."""
    each = rows.groupBy("a", "s").agg(F.sum("c").alias("c"))
    kinds = each.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    hot = _hot(rows.where(_sixteenth("s")).select("a", "s").distinct(), ["a"])
    both = _split_join(each, kinds, ["a"], hot, F.col("s"), "left")
    return both.where("c > 1 OR kinds > 1").select("a", "s", "c", F.coalesce("kinds", F.lit(1)).cast("bigint").alias("kinds"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose segment occurs again, or whose anchor has other segments: with both counts, their own as ``one``."""
    counts = save(_count(rows), "counts")
    release(rows.sparkSession)  # what the counts were dealt by, before all rows are dealt again
    hot = _hot(rows.where(_sixteenth("kid", "th", "lo")), ["a", "s"])
    return _split_join(rows.withColumnRenamed("c", "one"), counts, ["a", "s"], hot, F.xxhash64("kid", "th", "lo"))


def _whole(shared: DataFrame, least: int) -> DataFrame:
    """Byte ranges of the segments that occur more than once."""
    return shared.where("one = 1 AND c > 1").select("kid", "th", "lo", (F.col("lo") + F.col("n") + (least - 1)).alias("hi"))


def _examples(shared: DataFrame) -> DataFrame:
    """One row of each segment whose anchor has other segments."""
    rest = [c for c in shared.columns if c not in ("a", "s", "c", "kinds", "one")]
    many = shared.where("kinds > 1")
    again = many.where("c > 1").groupBy("a", "s", "c", "kinds").agg(*(F.first(c).alias(c) for c in rest))
    return many.where("c = 1").select("a", "s", "c", "kinds", *rest).unionAll(again)


def _compare(rows: DataFrame, least: int) -> DataFrame:
    """Byte ranges of the strings of single segments (c = 1) that other segments of their anchor hold too."""
    dealt = rows.repartition("a").sortWithinPartitions("a", "s")

    @lean
    def run(batches):
        def flush(held):
            t = pa.concat_tables(held)
            kid, th, lo, c = (t.column(x).to_numpy() for x in ("kid", "th", "lo", "c"))
            out = []
            for k, hit in enumerate(repeated(t.column("bytes").to_pylist(), least)):
                if c[k] == 1 and hit.any():
                    step = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    out += [(kid[k], th[k], lo[k] + x, lo[k] + y + least - 1) for x, y in zip(step[::2], step[1::2], strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in cols], names=["kid", "th", "lo", "hi"])

        held, size = [], 0
        for t in runs(batches, ["a"]):
            held.append(t)
            size += t.nbytes
            if size > BATCH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "kid bigint, th bigint, lo bigint, hi bigint")


def _bytes(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` segments with their bytes."""
    if not docs.groupBy("kid", "th").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["kid", "th"])  # one of the rows alike gives an example
    lists = wanted.groupBy("kid", "th").agg(F.collect_list(F.struct("lo", "n", "a", "s", "c", "kinds")).alias("w"))
    joined = docs.select("kid", "th", "text").join(lists, ["kid", "th"])

    @lean
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                w, text = b.column(3)[i].values, b.column(2)[i].as_py()
                lo, n = w.field("lo").to_numpy(), w.field("n").to_numpy()
                got = [text[x : x + y + least - 1] for x, y in zip(lo.tolist(), n.tolist(), strict=True)]
                same = pa.array(np.zeros(len(got), np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(same), b.column(1).slice(i, 1).take(same), *(w.field(x) for x in ("lo", "n", "a", "s", "c", "kinds")), pa.array(got, pa.binary())], names=["kid", "th", "lo", "n", "a", "s", "c", "kinds", "bytes"])

    return joined.mapInArrow(run, "kid bigint, th bigint, lo bigint, n bigint, a bigint, s bigint, c bigint, kinds bigint, bytes binary")


def _cut(rows: DataFrame, length: int, least: int, secret: bytes) -> DataFrame:
    """Segments cut at multiples of ``length`` starts before the anchor, keyed by the core their strings share."""

    @lean
    def run(batches):
        for b in batches:
            kid, th, lo, n, a, c = (b.column(x).to_numpy() for x in ("kid", "th", "lo", "n", "a", "c"))
            data, off = text_bytes(b.column("bytes"))
            if not len(n):
                continue
            pre = prefix(data)
            if "place" in b.schema.names:
                place = b.column("place").to_numpy()
            else:  # of the anchor in the first string
                at = off[:-1][:, None] + np.arange(least - GRAM + 1)
                place = (span(pre, at, at + GRAM) >> np.uint64(24)).argmin(axis=1)
            # a string starting at x lies d = place - x before the anchor; the strings of a block of d share a core
            top, low = place // length, (place - (n - 1)) // length
            m = top - low + 1
            k = np.repeat(np.arange(len(n)), m)
            block = np.repeat(top, m) - (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m))
            x0 = np.maximum(place[k] - (block * length + length - 1), 0)
            x1 = np.minimum(place[k] - block * length, n[k] - 1)
            begin = off[:-1][k]
            core = span(pre, begin + place[k] - block * length, begin + place[k] - (block * length + length - 1) + least)
            key = mixed(a[k].view(np.uint64) + mixed(block.astype(np.uint64) + np.uint64(length << 40))) + core
            s = digests(data, begin + x0, begin + x1 + least, secret) + mixed((x1 - x0).astype(np.uint64) + (place[k] - x0).astype(np.uint64) * np.uint64(1 << 32))
            got = [data[p:q].tobytes() for p, q in zip((begin + x0).tolist(), (begin + x1 + least).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kid[k]), pa.array(th[k]), pa.array(lo[k] + x0), pa.array(x1 - x0 + 1), pa.array(key.view(np.int64)), pa.array(s.view(np.int64)), pa.array(c[k]), pa.array(place[k] - x0), pa.array(got, pa.binary())], names=["kid", "th", "lo", "n", "a", "s", "c", "place", "bytes"])

    return rows.mapInArrow(run, "kid bigint, th bigint, lo bigint, n bigint, a bigint, s bigint, c bigint, place bigint, bytes binary")


def ranges(docs: DataFrame, least: int = 200, hot: int = 256) -> DataFrame:
    """``docs`` (kid, th, text as bytes) -> the byte ranges (kid, th, lo, hi) to remove; ranges may overlap."""
    spark = docs.sparkSession
    key = secrets.token_bytes(16)
    rows = save(_occurrences(docs, least, key), "occurrences")
    counted = save(_shared(rows), "segments")
    discard(rows)
    release(spark)
    out = [_whole(counted, least)]
    shared = save(_bytes(docs, _examples(counted), least), "bytes")
    release(spark)
    for length in (*CUTS, 0):
        out.append(save(_compare(shared.where(F.col("kinds") <= hot), least), "compared"))
        large = shared.where(F.col("kinds") > hot)
        if not length or large.isEmpty():
            break
        cut = save(_cut(large, length, least, key), "cut")  # read several times to count it
        counted = save(_shared(cut), "segments")
        discard(shared, cut)
        out.append(_whole(counted, least))
        shared = save(_examples(counted), "examples")
    discard(shared)
    release(spark)
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


def remove(docs: DataFrame, least: int = 200, hot: int = 256, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Columns ``keep`` of every row, with n_bytes, n_removed, spans (start, end) of the removed runs, kept_sha256,
    and the remaining text ``kept`` if ``with_text`` (characters that a cut halves are left out)."""
    tune(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    text = F.coalesce(named(text_col).cast("binary"), F.lit(b""))
    keyed = docs.select(F.xxhash64(named(id_col)).alias("kid"), F.xxhash64(text).alias("th"), text.alias("text"), F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"))
    found = ranges(keyed.select("kid", "th", "text"), least, hot)
    lists = found.groupBy("kid", "th").agg(F.collect_set(F.shiftleft("lo", 32) + F.col("hi")).alias("cuts"))
    joined = keyed.join(lists, ["kid", "th"], "left").select("row", "text", "cuts")

    @lean
    def run(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data, cuts = b.column(1)[i].as_py(), b.column(2)[i]
                spans: list[tuple[int, int]] = []
                if cuts.is_valid:
                    packed = np.sort(cuts.values.to_numpy())
                    lo, hi = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
                    new = np.append(True, lo[1:] > hi[:-1])
                    spans = list(zip(lo[new].tolist(), hi[np.append(new[1:], True)].tolist(), strict=True))
                at, parts = 0, []
                for x, y in spans:
                    parts.append(data[at:x])
                    at = y
                left = b"".join([*parts, data[at:]])
                rows.append((len(data), len(data) - len(left), [{"start": x, "end": y} for x, y in spans], hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            c = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
            names = ["n_bytes", "n_removed", "spans", "kept_sha256", "kept"][: 4 + with_text]
            cols = [pa.array(x, t) for x, t in zip(c, kinds, strict=True)][: len(names)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *names])

    own = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [("row", own), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", span), ("kept_sha256", T.StringType()), ("kept", T.StringType())]
    out = joined.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in kinds[: 5 + with_text]]))
    return out.select(*(F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(keep)), *[c for c in out.columns if c != "row" and c not in keep])


def trim(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows with what is left of their text, and its length in ``chars_col`` if there is such a column."""
    renamed = docs.toDF(*(f"c_{i}" for i in range(len(docs.columns))))
    name = dict(zip(docs.columns, renamed.columns, strict=True))
    out = remove(renamed, least, id_col=name[id_col], text_col=name[text_col], keep=[c for c in renamed.columns if c != name[text_col]], with_text=True)
    cols = {c: F.col(name[c]) for c in docs.columns if c != text_col} | {text_col: F.col("kept")}
    if chars_col in cols:
        cols[chars_col] = F.length("kept").cast(docs.schema[chars_col].dataType)
    return out.select(*(cols[c].alias(c) for c in docs.columns))
