"""Approximate nearest neighbours by cross-polytope hashing with several probes a table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from margrave.llm.common import materialize
from margrave.llm.textops import lean, trimmed

#: Tables; rounds of sign flips and Hadamard transform that make a pseudo-rotation.
TABLES, ROUNDS = 16, 3
#: Vectors, and queries, of a bucket that one task compares; larger buckets are dealt out by salts.
BLOCK = 8192
#: Products this close to the worst one kept are computed again, each in the same order of additions.
SLACK = 1e-9
#: Queries whose true neighbours are looked up to set the probes, and the share of these that the probes must reach.
PILOT, RECALL = 64, 0.95
#: A query's row in a bucket costs as much as so many products.
ROW_COST = 500


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast orthonormal Walsh-Hadamard transform of each row; row lengths are powers of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([table, function, 91]))
    for _ in range(ROUNDS):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def codes(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """The probes best codes of each row in a table, best first: nearest signed axes under each function, joined by the sum of coordinates. No function: one code for all."""
    if not functions:
        return np.zeros((len(x), 1), np.int64)
    best, total = None, None
    for f in range(functions):
        z = rotated(x, table, f)
        both = np.concatenate([z, -z], 1)
        take = min(probes, both.shape[1])
        top = np.argpartition(-both, take - 1, axis=1)[:, :take] if take < both.shape[1] else np.tile(np.arange(both.shape[1]), (len(x), 1))
        value = np.take_along_axis(both, top, 1)
        if best is None:
            best, total = top.astype(np.int64), value
        else:
            by = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, by, 1), np.take_along_axis(value, by, 1)
            # the i-th best with the j-th best can be among the probes best only if i * j <= probes
            i, j = np.nonzero(np.arange(1, best.shape[1] + 1)[:, None] * np.arange(1, take + 1) <= probes)
            best, total = best[:, i] * both.shape[1] + top[:, j], total[:, i] + value[:, j]
        order = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        best, total = np.take_along_axis(best, order, 1), np.take_along_axis(total, order, 1)
    return best


def tuning(n: int, axes: int = 256) -> tuple[int, int]:
    """(functions at most, probes at least) for n vectors and so many axes to a function, which are 2 * width.

    One function keeps buckets small up to 4096 * axes vectors; beyond that two may cost less. The fewer the vectors,
    the farther a query's 20th neighbour and the more probes it takes to meet it: of 256 axes 33 at 500 vectors, 9 at
    10,000, 5 at 50,000, 4 at least, of more axes the same share; all of them up to 64 vectors. How many probes the
    data need beyond that is measured, see needed."""
    n = max(n, 1)
    probes = max(4, math.ceil(16 - 1.7 * math.log2(n / 500)), math.ceil(64 * 256 / n))
    return 2 if n > 4096 * axes else 1, max(probes, math.ceil(probes * axes / 256))


def needed(q: np.ndarray, x: np.ndarray, of: np.ndarray, tables: int, functions: int, recall: float = RECALL) -> int:
    """Probes by which the share `recall` of the pairs (q[of[i]], x[i]), filled up to the width, meet in a table; one or two functions."""
    if not len(x):
        return 1
    place = np.full(len(x), np.iinfo(np.int64).max)
    for t in range(tables):
        code, sides = codes(x, t, functions, 1)[:, 0], []
        for f in range(functions):
            z = rotated(q, t, f)
            sides.append(np.concatenate([z, -z], 1))
        axes = sides[0].shape[1]
        behind = np.sort(sides[-1], axis=1)
        for i, (c, k) in enumerate(zip(code.tolist(), of.tolist(), strict=True)):
            if functions == 1:
                ahead = axes - np.searchsorted(behind[k], sides[0][k, c], "right")
            else:
                total = sides[0][k, c // axes] + sides[1][k, c % axes]
                ahead = (axes - np.searchsorted(behind[k], total - sides[0][k], "right")).sum()
            place[i] = min(place[i], ahead)
    return int(np.sort(place)[math.ceil(recall * len(place)) - 1]) + 1


def cost(n: int, axes: int, tables: int, functions: int, probes: int) -> float:
    """A query's products and rows, these at ROW_COST, if buckets are alike."""
    bucket = n / axes**functions
    return tables * probes * (bucket + ROW_COST * math.ceil(bucket / BLOCK))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, product) of the k best of x for each q, ties to the smaller id, its own id left out."""
    rows, cols, scores = [], [], []
    again = len(ids) - len(np.unique(ids))  # rows whose id another row has: that many more rows surely hold k ids
    step = max(1, (1 << 21) // max(1, len(x)))
    for lo in range(0, len(q), step):
        g = q[lo : lo + step] @ x.T
        g[q_ids[lo : lo + step, None] == ids[None, :]] = -np.inf
        least = np.partition(g, -k - again, axis=1)[:, -k - again] if len(x) > k + again else np.full(len(g), -np.inf)
        r, c = np.nonzero((g >= least[:, None] - SLACK) & np.isfinite(g))
        s = np.concatenate([np.zeros(0), *[(q[lo + r[i : i + 50_000]] * x[c[i : i + 50_000]]).sum(1) for i in range(0, len(r), 50_000)]])
        by = np.lexsort((ids[c], -s, r))
        r, c, s = r[by], c[by], s[by]
        if again:
            best = np.sort(np.unique(r * len(x) + np.unique(ids[c], return_inverse=True)[1], return_index=True)[1])
            r, c, s = r[best], c[best], s[best]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[keep] + lo)
        cols.append(c[keep])
        scores.append(s[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _pilot(data: DataFrame, asked: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PILOT of the queries, by hash of their ids, their exact k nearest vectors, and the query of each of these. Every task passes on k vectors a query."""
    some = asked.orderBy(F.xxhash64(F.lit(6), "id"), "id").limit(PILOT).toArrow()
    if not some.num_rows:
        return np.zeros((0, d)), np.zeros((0, d)), np.zeros(0, np.int64)
    q_ids, q = some["id"].to_numpy(), _matrix(some["v"].combine_chunks() if some["v"].num_chunks != 1 else some["v"].chunk(0), d)
    given = data.sparkSession.sparkContext.broadcast((q_ids, q))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = given.value
        best, found = np.full((len(q), 0), 0.0), np.zeros((len(q), 0, d))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = _matrix(part["v"], d)
                g = q @ x.T
                g[q_ids[:, None] == part["id"].to_numpy()[None, :]] = -np.inf
                both = np.concatenate([best, g], 1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                old, fresh = np.minimum(top, max(best.shape[1] - 1, 0)), np.maximum(top - best.shape[1], 0)
                found = np.where((top < best.shape[1])[:, :, None], np.take_along_axis(found, old[:, :, None], 1), x[fresh]) if best.shape[1] else x[fresh]
                best = np.take_along_axis(both, top, 1)
        r, c = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(best[r, c]), pa.array(list(found[r, c]), pa.list_(pa.float64()))], ["q", "s", "v"])

    order = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc()))
    near = data.mapInArrow(lean(closest), "q int, s double, v array<double>").withColumn("rank", order).where(F.col("rank") <= k).select("q", "v").toArrow()
    if not near.num_rows:
        return q, np.zeros((0, d)), np.zeros(0, np.int64)
    return q, _matrix(near["v"].combine_chunks() if near["v"].num_chunks != 1 else near["v"].chunk(0), d), near["q"].to_numpy()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int | None = None, functions: int | None = None) -> DataFrame:
    """The k vectors with the largest inner product found for each query: query_id, rank (from 1), vec_id, score.

    Inner products become cosines by one more coordinate: vectors are divided by the largest norm and filled up
    to length 1, queries get 0 there. Both are turned by fast Hadamard pseudo-rotations, several tables of them; a
    vector goes to the bucket of its nearest signed axis in each table, a query to those of its `probes` nearest.
    Unless given, the probes are as many as reach RECALL of the exact k nearest of PILOT queries, which one pass over
    the vectors finds, and no fewer than in tuning; the driver holds PILOT * k vectors for that. Where two functions
    are possible, the cheaper number is taken, each at the probes it needs. A query that would have to visit as many
    buckets as there are vectors is compared with all of them instead.
    Buckets rank their vectors exactly, in double precision on the original vectors; each query's best are merged.

    A bucket of more than BLOCK vectors or queries is dealt out by salts: every part of its vectors meets every part of
    its queries in a task of its own.
    Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, as
    a query or a candidate, nor do null ids. Shorter vectors count as filled with zeros. Rows of one id and equal
    vectors count once. Extra columns are ignored. Fewer candidates than k: all that are found."""

    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == dict(queries.dtypes)[vec_col] == "array<float>" else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
        ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
        return v.where(F.col("id").isNotNull() & ok)

    data, asked = clean(vectors), clean(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    stats = data.agg(F.count("*").alias("n"), F.max(square).alias("m"), F.max(F.size("v")).alias("d")).first()
    n, d, longest = stats["n"], max(stats["d"] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1), math.sqrt(stats["m"] or 1.0)
    width = 1 << max(1, int(d).bit_length())
    axes = 2 * width

    def filled(x: np.ndarray, is_query: bool) -> np.ndarray:
        z = np.zeros((len(x), width))
        if is_query:
            z[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            z[:, :d] = x / longest
            z[:, d] = np.sqrt(np.maximum(0, 1 - (z * z).sum(1)))
        return z

    most, least = tuning(n, axes)
    own = probes is None
    if own and tables * least < n:
        q, x, of = _pilot(data, asked, k, d)
        q, x = filled(q, True), filled(x, False)
        choices = [(f, max(least, needed(q, x, of, tables, f))) for f in ([functions] if functions else range(1, most + 1))]
        functions, probes = min(choices, key=lambda c: cost(n, axes, tables, *c))
    functions = functions or most
    probes = min(probes or least, axes**functions)
    if own and tables * probes >= n:
        tables, functions, probes = 1, 0, 1

    def hashed(m: int, is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                step = max(1, min(1024, (1 << 16) // m))
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    x = _matrix(part["v"], d)
                    z = filled(x, is_query)
                    for t in range(tables):
                        c = codes(z, t, functions, m)
                        row = pa.array(np.repeat(np.arange(len(x)), c.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), t, np.int32)), pa.array(c.reshape(-1)), part["id"].take(row), part["v"].take(row)], ["t", "code", "id", "v"]
                        )

        return run

    schema = f"t int, code long, id long, v {kind}"
    placed = data.mapInArrow(lean(hashed(1, False)), schema)
    probed = asked.mapInArrow(lean(hashed(probes, True)), schema)
    sizes = placed.select("t", "code", F.lit(1).alias("v"), F.lit(0).alias("q")).unionByName(probed.select("t", "code", F.lit(0).alias("v"), F.lit(1).alias("q"))).groupBy("t", "code").agg(F.sum("v").alias("v"), F.sum("q").alias("q"))
    tiles = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int").alias(f"{n}_parts")
    large = materialize(sizes.where((F.col("v") > 0) & (F.col("q") > 0) & ((F.col("v") > BLOCK) | (F.col("q") > BLOCK))).select("t", "code", tiles("v"), tiles("q")), "large-buckets")
    large = F.broadcast(large) if large.count() <= 1_000_000 else large  # tables * (n + probes * queries) / BLOCK rows at most
    v_parts, q_parts, salt = F.coalesce("v_parts", F.lit(1)), F.coalesce("q_parts", F.lit(1)), lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = placed.join(large, ["t", "code"], "left").select("t", "code", salt(v_parts).alias("part"), every(q_parts).alias("ask"), F.lit(False).alias("query"), "id", "v")
    probed = probed.join(large, ["t", "code"], "left").select("t", "code", every(v_parts).alias("part"), salt(q_parts).alias("ask"), F.lit(True).alias("query"), "id", "v")

    def rank(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["query"].to_numpy(zero_copy_only=False)
        ids, x = t["id"].to_numpy(), _matrix(t["v"].combine_chunks() if t["v"].num_chunks != 1 else t["v"].chunk(0), d)
        q_ids, q, v_ids, v = ids[asks], x[asks], ids[~asks], x[~asks]
        if len(q) and len(v):
            r, c, s = _best(q, q_ids, v, v_ids, k)
        else:
            r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": q_ids[r], "vec_id": v_ids[c], "score": s})

    met = placed.unionByName(probed).groupBy("t", "code", "part", "ask").applyInArrow(trimmed(rank), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
