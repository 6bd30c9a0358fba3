"""Embedding near-duplicates by product quantisation with coarse inverted lists.

Equal vectors are one vector with a multiplicity. Vectors of length one belong to the list of their nearest
coarse centroid, and are coded by the nearest codeword of their residual in each subspace; the length of what a
code misses is kept. A vector probes the lists that a vector within the linking distance r may belong to: for a
list c beside its own list o, the difference of squared distances to c and o moves by at most 2 r |c - o| over
that distance, and by ``spread`` / sqrt(dimensions) of that in nearly all directions. Distances to the codes of a
list come from tables of the query's subspaces; whatever may lie within r, given what its code misses, is
reranked by the exact cosine in doubles.

Large lists are cut into blocks, and blocks of a list meet blocks of the vectors that probe it, so that no task
holds more than two blocks of a list, however many copies of a vector there are.

Bounds: there are as many lists as the square root of the number of distinct vectors, so lists and probes grow
alike; centroids are fitted by Spark on ``fit_rows`` vectors (least hashes), or on ``fit_per_list`` for each list where
that is more, codewords on ``fit_rows`` of them by the driver. Driver and tasks hold the centroids, a square root of the
rows, and the driver no other vectors than these. Every vector is indexed.
Recall is measured in the tests and, with ``spread`` 3, has been 1; a ``spread`` of sqrt(dimensions) and more probes
all lists that a neighbour can be in, which is exact.

Lengths are taken after each vector is scaled by a power of two, so tiny and huge components count as they are. Rows
find their distinct vector again by a join on the vector, where equal vectors that make up much of the table are split
by Spark's skew join.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
id, link with nothing; vectors of different lengths are never linked; rows that repeat an id are other vectors;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, runs, save, tune
from .components import components
from .vectors import usable


CELLS = 1 << 22  # entries of the distance matrices that are held at once


def level(v: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two, exactly, so that their largest components lie between a half and one."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = level(v)
    return v / np.sqrt((v * v).sum(1))[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of ``c`` for each of ``x``, some rows at a time."""
    step, c2 = max(1, CELLS // len(c)), (c**2).sum(1)
    return np.concatenate([np.argmin(c2 - 2 * x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)])


def _means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length one of an Arrow column of arrays."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))


def _centroids(sample: DataFrame, dim: int, lists: int, rounds: int) -> np.ndarray:
    """k-means of the sample (h, id, v) by Spark, from the ``lists`` vectors of least h. Vectors are summed as whole numbers
    of 2^-36, which have no order, so that a task that runs again changes nothing."""
    c = _vectors(sample.orderBy("h", "id").limit(lists).select("v").toArrow().column(0).combine_chunks(), dim)
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(c)

        @lean
        def sums(batches, shared=shared):
            for b in batches:
                if b.num_rows:
                    x = _vectors(b.column(0), dim)
                    met, own = np.unique(nearest(x, shared.value), return_inverse=True)
                    total = np.zeros((len(met), dim + 1), np.int64)  # how many vectors, and their sum
                    np.add.at(total, own, np.concatenate([np.ones((len(x), 1)), np.rint(np.ldexp(x, 36))], axis=1).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * (dim + 1), pa.int32()), pa.array(total.ravel()))], names=["c", "total"])

        each = sample.select("v").mapInArrow(sums, "c int, total array<bigint>").select("c", F.posexplode("total").alias("i", "x"))
        got = each.groupBy("c", "i").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros((len(c), dim + 1))
        total[got.column("c").to_numpy(), got.column("i").to_numpy()] = got.column("x").to_numpy()
        c = np.where(total[:, :1] > 0, np.ldexp(total[:, 1:], -36) / np.maximum(total[:, :1], 1), c)
        shared.destroy()
    return c


def train(sample: DataFrame, dim: int, lists: int, fit_rows: int = 20_000, subspaces: int = 8, words: int = 64, rounds: int = 5, seed: int = 0) -> dict:
    """Coarse centroids of the sample (h, id, v), and for each subspace codewords of the residuals. Tasks assign and sum
    the vectors; the driver gets the centroids, and of the residuals about ``fit_rows``, of the least h."""
    coarse = _centroids(sample, dim, lists, rounds)
    shared = sample.sparkSession.sparkContext.broadcast(coarse)
    n, most = sample.agg(F.count(F.lit(1)), F.max("h")).first()
    some = sample if n <= fit_rows else sample.where(F.col("h") < int((most + 1) * 0.9 * fit_rows / n))

    @lean
    def rests(batches):
        for b in batches:
            x = _vectors(b.column(2), dim)
            rest = x - shared.value[nearest(x, shared.value)] if len(x) else x
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in rest], pa.binary())], names=["h", "id", "rest"])

    got = sorted(zip(*(c.to_pylist() for c in some.select("h", "id", "v").mapInArrow(rests, "h bigint, id bigint, rest binary").toArrow().columns), strict=True))
    shared.destroy()
    rest = np.frombuffer(b"".join(r for _, _, r in got)).reshape(-1, dim)
    edges, rng = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int), np.random.default_rng(seed)
    return {"coarse": coarse, "edges": edges, "words": [_means(rest[:, a:b], words, 8, rng) for a, b in zip(edges[:-1], edges[1:], strict=True)]}


def index(model: dict, x: np.ndarray, radius: float, spread: float):
    """(list, codes, what the code misses, probes as pairs of row and list) of vectors of length one."""
    c = model["coarse"]
    c2, own, rows, lists = (c**2).sum(1), np.zeros(len(x), np.int64), [], []
    step = max(1, CELLS // len(c))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d2 = 1 + c2 - 2 * part @ c.T
        own[i : i + step] = o = np.argmin(d2, axis=1)
        apart = np.sqrt(np.maximum(c2[o][:, None] + c2 - 2 * c[o] @ c.T, 0))
        reach = 2 * radius * min(1.0, spread / np.sqrt(x.shape[1])) * apart
        r, k = np.nonzero(d2 - d2[np.arange(len(part)), o][:, None] <= reach + 1e-9)
        rows.append(r + i)
        lists.append(k)
    rest = x - c[own]
    codes, miss = np.zeros((len(x), len(model["words"])), np.uint8), np.zeros(len(x))
    for s, w in enumerate(model["words"]):
        part = rest[:, model["edges"][s] : model["edges"][s + 1]]
        codes[:, s] = np.argmin((w**2).sum(1) - 2 * part @ w.T, axis=1)
        miss += ((part - w[codes[:, s]]) ** 2).sum(1)
    return own, codes, np.sqrt(miss), np.concatenate(rows), np.concatenate(lists)


def tables(model: dict, q: np.ndarray, c: int) -> np.ndarray:
    """(queries, subspaces, words) squared distances of the queries' residuals of list ``c`` to the codewords."""
    rest = q - model["coarse"][c]
    out = np.zeros((len(q), len(model["words"]), max(len(w) for w in model["words"])))
    for s, w in enumerate(model["words"]):
        part = rest[:, model["edges"][s] : model["edges"][s + 1]]
        out[:, s, : len(w)] = np.maximum((part**2).sum(1)[:, None] + (w**2).sum(1) - 2 * part @ w.T, 0)
    return out


def match(model: dict, c: int, q: np.ndarray, qv: np.ndarray, codes: np.ndarray, miss: np.ndarray, v: np.ndarray, radius: float, least: float):
    """Pairs (query, item) of one list with exact cosine of at least ``least``. q: queries of length one; qv, v: scaled."""
    table = tables(model, q, c)
    a, b = [], []
    qn, vn = np.sqrt((qv * qv).sum(1)), np.sqrt((v * v).sum(1))
    for i in range(0, len(q), 256):
        t = table[i : i + 256]
        d2 = np.zeros((len(t), len(codes)))
        for s in range(t.shape[1]):
            d2 += t[:, s][:, codes[:, s]]
        r, k = np.nonzero(d2 <= (radius + miss + 1e-7)[None, :] ** 2)
        for j in range(0, len(r), 50_000):
            x, y = r[j : j + 50_000] + i, k[j : j + 50_000]
            ok = np.einsum("ij,ij->i", qv[x], v[y]) / (qn[x] * vn[y]) >= least
            a.append(x[ok])
            b.append(y[ok])
    z = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (z, z)


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids -> each id of them with the least id that the pairs connect it to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = 20_000, fit_per_list: int = 20, spread: float = 3.0, block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; ids are integers."""
    spark = vectors.sparkSession
    tune(spark)
    wide = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    size = np.float32 if wide else np.float64
    good = usable(vector_col) & F.exists(vector_col, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = save(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.when(good, F.col(vector_col) if wide else F.col(vector_col).cast("array<double>")).alias("v")), "vectors")
    distinct = save(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct")
    radius, found = float(np.sqrt(max(0.0, 2 - 2 * least))), []
    for dim, n in sorted(map(tuple, distinct.groupBy(F.size("v").alias("d")).count().collect())):
        of = distinct.where(F.size("v") == dim)
        lists = max(1, int(np.sqrt(n)))
        most = max(fit_rows, fit_per_list * lists)
        part = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
        picked = of.where(part < int(0.9 * most / n * (1 << 30))) if n > most else of
        sample = save(picked.select(part.cast("bigint").alias("h"), "id", "v"), "sample")
        found.append(_links(of, train(sample, dim, lists, fit_rows), dim, size, radius, least, spread, block))
        discard(sample)
    if found:
        both = found[0]
        for f in found[1:]:
            both = both.unionAll(f)
        both = save(both, "links")
        links = both.where("root IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
        named = components(both.where("root IS NOT NULL").select(F.col("id").alias("u"), F.col("root").alias("v")))
        own = distinct.join(links, "id", "left").join(named.withColumnRenamed("node", "id"), "id", "left").select("v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        out = rows.join(own, "v", "left")
    else:
        out = rows.withColumns({"n_links": F.lit(0), "component_id": F.col("id")})
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).cast("bigint")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links(distinct: DataFrame, model: dict, dim: int, size, radius: float, least: float, spread: float, block: int) -> DataFrame:
    """(id, n, null): other vectors that a block links ``id`` with; (id, null, root): ids that a block connects."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)  # a square root of the rows, and some codewords

    @lean
    def assign(batches):
        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            v = v if size is np.float32 else level(v)
            own, codes, miss, r, c = index(shared.value, unit(v.astype(np.float64)), radius, spread)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(v) + 1)), pa.int32()), pa.array(c, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tobytes() for x in v.astype(size)], pa.binary()), pa.array(own, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(miss), lists], names=["id", "copies", "x", "c", "codes", "miss", "probes"])

    held = save(distinct.select("v", "id", "copies").mapInArrow(assign, "id bigint, copies bigint, x binary, c int, codes binary, miss double, probes array<int>"), "indexed")
    asked = held.select("id", "x", F.explode("probes").alias("c"))
    items = held.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("ib"))
    sizes = F.broadcast(save(items.join(asked.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qb")), "c"), "sizes"))  # a row a list
    h = F.xxhash64("id", F.lit(11))
    one = held.join(sizes, "c").select("c", F.pmod(h, "ib").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(0).alias("kind"), "id", "copies", "x", "codes", "miss")
    two = asked.join(sizes, "c").select("c", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("i"), F.pmod(h, "qb").cast("int").alias("q"), F.lit(1).alias("kind"), "id", F.lit(0).cast("bigint").alias("copies"), "x", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("miss"))
    dealt = one.unionAll(two).repartition("c", "i", "q").sortWithinPartitions("c", "i", "q", "kind", "id")

    @lean
    def compare(batches):
        for t in runs(batches, ["c", "i", "q"]):
            c, i, q, kind, ids, copies, miss = (t.column(x).to_numpy() for x in ("c", "i", "q", "kind", "id", "copies", "miss"))
            vec = np.frombuffer(b"".join(t.column("x").to_pylist()), size).reshape(-1, dim).astype(np.float64)
            codes = t.column("codes").to_pylist()
            cut = np.flatnonzero((np.diff(c) != 0) | (np.diff(i) != 0) | (np.diff(q) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(c)], strict=True):
                m = a + int(np.searchsorted(kind[a:b], 1))
                if m == a or m == b:
                    continue
                code = np.frombuffer(b"".join(codes[a:m]), np.uint8).reshape(m - a, -1)
                asking, asked_of = level(vec[m:b]), level(vec[a:m])
                x, y = match(shared.value, int(c[a]), unit(asking), asking, code, miss[a:m], asked_of, radius, least)
                other = ids[m:b][x] != ids[a:m][y]
                x, y = x[other], y[other]
                if not len(x):
                    continue
                n = np.bincount(x, weights=copies[a:m][y]).astype(np.int64)
                who = np.flatnonzero(n)
                node, root = _joined(ids[m:b][x], ids[a:m][y])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[m:b][who], node])), pa.array([*n[who].tolist(), *[None] * len(node)], pa.int64()), pa.array([*[None] * len(who), *root.tolist()], pa.int64())], names=["id", "n", "root"])

    return dealt.mapInArrow(compare, "id bigint, n bigint, root bigint")
