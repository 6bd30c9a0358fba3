"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte bigrams and trigrams of its lower-cased letters (square root of the
count, times the inverse document frequency, scaled to length one). Each language has several centroids, found
by spherical k-means on a bounded sample of labelled rows; a text gets the language of the centroid with the
highest cosine. It is rejected if it is too far from it for its length: short texts have few n-grams in common with
any centroid, so held-out labelled rows tell, for each length, the cosine that all but one in a hundred reach, and a
text with less than half of that is rejected.

Bounds: ``fit_docs`` documents a language (the smallest hashes of their ids and texts); every language is learned, so
the model grows with the number of languages, some 100 kB each.

Defined cases: null text or text without a letter is ``und`` with score 0 and rejected; texts in an unknown
script get the nearest language, a score near 0, and are rejected; repeated rows are scored alike; without any
labelled row every text is ``und``; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_crc, discard, lean, named, runs, save, slices, text_bytes, tune
from .textvec import CHUNK, LOWER, lookup

UNDETERMINED = "und"
CLASSES = 48
#: Letters keep their byte; everything else below 0x80 is a gap.
LETTERS = np.where(lookup([(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xFF, 1)]) == 1, LOWER, 32).astype(np.uint64)


def counts(data: np.ndarray, off: np.ndarray, features: int) -> np.ndarray:
    """(rows, features) counts of hashed bigrams and trigrams."""
    if len(data) > CHUNK and len(off) == 2:  # a long text, chunk by chunk
        return sum(_counts(data[i : i + CHUNK + 2], np.array([0, min(CHUNK + 2, len(data) - i)]), features, CHUNK) for i in range(0, len(data), CHUNK))
    return _counts(data, off, features, len(data))


def _counts(data: np.ndarray, off: np.ndarray, features: int, starts: int) -> np.ndarray:
    """Counts of the n-grams that begin in the first ``starts`` bytes."""
    rows, shift = len(off) - 1, np.uint64(64 - int(features).bit_length() + 1)
    if not len(data):
        return np.zeros((rows, features), np.float32)
    b = LETTERS[data]
    row = np.repeat(np.arange(rows), np.diff(off))
    out = np.zeros(rows * features, np.int64)
    for n in (2, 3):
        m = min(len(b) - n + 1, starts)
        if m <= 0:
            continue
        code = b[:m].copy()
        for k in range(1, n):
            code = (code << np.uint64(8)) | b[k : m + k]
        gaps = int("20" * n, 16)
        ok = (row[:m] == row[n - 1 : m + n - 1]) & (code != gaps)
        f = ((code[ok] + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        out += np.bincount(row[:m][ok] * features + f.astype(np.int64), minlength=rows * features)
    return out.reshape(rows, features).astype(np.float32)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(count) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    picked = [x.mean(0)]
    sims = x @ picked[0]
    for _ in range(min(k, len(x)) - 1):
        picked.append(x[int(np.argmin(sims))])
        sims = np.maximum(sims, x @ picked[-1])
    c = np.stack(picked)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _class(grams: np.ndarray) -> np.ndarray:
    """Length class of a text: the whole part of the binary logarithm of its n-grams."""
    return np.minimum(np.log2(grams + 1).astype(np.int64), CLASSES - 1)


def bounds(grams: np.ndarray, cosine: np.ndarray, share: float = 0.01) -> np.ndarray:
    """For each length class, half of the cosine that all but ``share`` of known texts of that length reach. A class
    never asks for more than a longer one with rows; one without rows asks for what the next shorter one does."""
    out, of = np.full(CLASSES, np.nan), _class(grams)
    for k in np.unique(of):
        out[k] = np.quantile(cosine[of == k], share) / 2
    low = np.inf
    for k in range(CLASSES - 1, -1, -1):
        low = out[k] = min(low, out[k]) if not np.isnan(out[k]) else np.nan
        low = np.inf if np.isnan(low) else low
    seen = 0.0
    for k in range(CLASSES):
        seen = out[k] = seen if np.isnan(out[k]) else out[k]
    return out


def fit(docs: DataFrame, lang_col: str, text_col: str, key, features: int = 8192, centroids: int = 3, fit_docs: int = 400) -> dict:
    """The model of labelled ``docs``; ``key`` is a column whose hash picks the sample.

    Each language is clustered in a task of its own, on at most ``fit_docs`` rows, of which every fourth is held out
    and tells what cosine texts of a known language and its length have."""
    tune(docs.sparkSession)
    lang, text = named(lang_col), named(text_col)
    labelled = docs.where(lang.isNotNull() & text.rlike("\\p{L}")).select(lang.alias("lang"), F.pmod(F.xxhash64(key, text), F.lit(1 << 30)).alias("h"), text.alias("text"))
    per = save(labelled.groupBy("lang").count().select("lang", (F.least(F.lit(1.0), 1.3 * fit_docs / F.col("count")) * (1 << 30)).alias("most")), "languages")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    picked = labelled.join(per, "lang").where("h < most").select("lang", "text", nth.alias("nth")).where(F.col("nth") <= fit_docs)

    @lean
    def counted(batches):
        for b in batches:
            data, off = text_bytes(b.column(1))
            for i, j in slices(off, rows=256):
                c = counts(data[off[i] : off[j]], off[i : j + 1] - off[i], features)
                r, f = np.nonzero(c)
                cut = np.searchsorted(r, np.arange(j - i + 1))
                v = c[r, f].astype("<f4")
                rows = [(f[a:e].astype("<u4").tobytes(), v[a:e].tobytes()) for a, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *(pa.array([x[k] for x in rows], pa.binary()) for k in (0, 1))], names=["lang", "nth", "f", "v"])

    sample = save(picked.mapInArrow(counted, "lang string, nth int, f binary, v binary"), "sample")

    @lean
    def held_by(batches):
        df, rows = np.zeros(features, np.int64), 0
        for b in batches:
            for f in b.column(0).to_pylist():
                df[np.frombuffer(f, "<u4")] += 1
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), features), pa.int32()), pa.array(np.append(df[df > 0], rows), pa.int64())], names=["f", "n"])

    df = np.zeros(features + 1)
    for f, n in sample.select("f").mapInArrow(held_by, "f int, n bigint").groupBy("f").agg(F.sum("n")).collect():  # a row a feature
        df[f] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    @lean
    def clustered(batches):
        for t in runs(batches, ["lang"]):
            of = t.column("lang").to_pylist()
            cut = [0, *[i for i in range(1, len(of)) if of[i] != of[i - 1]], len(of)]
            for a, e in zip(cut[:-1], cut[1:], strict=True):
                x = np.zeros((e - a, features), np.float32)
                for r, (f, v) in enumerate(zip(t.column("f")[a:e].to_pylist(), t.column("v")[a:e].to_pylist(), strict=True)):
                    x[r, np.frombuffer(f, "<u4")] = np.frombuffer(v, "<f4")
                grams, x = x.sum(1), vectors(x, idf)
                out = np.arange(len(x)) % 4 == 3
                c = cluster(x[~out], centroids).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([of[a]], pa.string()), pa.array([c.tobytes()], pa.binary()), pa.array([grams[out].astype("<f8").tobytes()], pa.binary()), pa.array([(x[out] @ c.T).max(1, initial=0).astype("<f8").tobytes()], pa.binary())], names=["lang", "c", "grams", "cosine"])

    told = sorted(sample.repartition("lang").sortWithinPartitions("lang", "nth").mapInArrow(clustered, "lang string, c binary, grams binary, cosine binary").collect())  # a row a language
    discard(per, sample)
    if not told:
        return {"languages": []}
    each = [np.frombuffer(r.c, "<f4").reshape(-1, features) for r in told]
    grams, cosine = (np.frombuffer(b"".join(r[k] for r in told), "<f8") for k in ("grams", "cosine"))
    return {"languages": [r.lang for r in told], "idf": idf, "centroids": np.concatenate(each), "of": np.repeat(np.arange(len(each)), [len(c) for c in each]), "least": bounds(grams, cosine)}


def _predicted(docs: DataFrame, model: dict, text_col: str, keep: list[str]) -> DataFrame:
    """(row, lang, score, rejected): ``row`` a struct of the columns ``keep``, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some centroids a language

    @lean
    def run(batches):
        m = shared.value
        for b in batches:
            data, off = text_bytes(b.column(1))
            has = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            lang, score, no = np.full(len(has), UNDETERMINED, object), np.zeros(len(has)), np.ones(len(has), bool)
            for i, j in slices(off, rows=256) if m["languages"] else ():
                c = counts(data[off[i] : off[j]], off[i : j + 1] - off[i], len(m["idf"]))
                sim = vectors(c, m["idf"]) @ m["centroids"].T
                best = np.argmax(sim, axis=1)
                top = np.clip(sim[np.arange(j - i), best], 0, 1)
                lang[i:j], score[i:j], no[i:j] = np.array(m["languages"], object)[m["of"][best]], top, top < m["least"][_class(c.sum(1))]
            lang[~has], score[~has], no[~has] = UNDETERMINED, 0.0, True
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(no)], names=["row", "lang", "score", "rejected"])

    row = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    schema = T.StructType([T.StructField("row", row), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    letter = F.coalesce(named(text_col).rlike("\\p{L}"), F.lit(False))
    whole = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(None).alias("c"))
    return docs.select(whole.alias("row"), named(text_col).alias("text"), letter.alias("letter")).mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``keep`` of every row, with predicted language, cosine, and whether it is rejected; these three take the
    place of columns of their names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    told = _predicted(docs, model, text_col, keep)
    return told.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(o) for c, o in zip(("lang", "score", "rejected"), out, strict=True)])


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> dict:
    """A model of the rows of the learning fold: crc32 of the id modulo 3 is not 1."""
    return fit(docs.where(by_crc(docs, id_col, 3) != 1), lang_col, text_col, F.col(id_col), **options)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are not rejected, with their columns."""
    told = _predicted(docs, learned(docs, id_col, text_col, lang_col), text_col, docs.columns).where("NOT rejected")
    return told.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
