"""Centroid clustering of integer vectors: rotated leading coordinates rule centroids out, survivors are verified in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components of a vector, centroids, rounds, and the seed in the order that picks the first centroids.
DIM, K, ROUNDS, SEED = 64, 40, 5, 2
#: Units of a component, and the largest magnitude in them: squared distances then fit 64 bits.
UNITS, LARGEST = 256, 1 << 27
#: Rotated coordinates that are stored; the rest of a vector is stored as one norm.
LEADING = 16
#: Pairs of a vector and a centroid that are verified at once.
_PAIRS = 1 << 16


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows of ``vectors`` (vec_id, embedding) with DIM components, none null or non-finite, as integers floor(UNITS * x).

    Integers beyond LARGEST are taken as LARGEST. Null and shorter or longer vectors are left out.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = (F.size(x) == DIM) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * UNITS, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel(), kind), rows.shape[1]).cast(pa.list_(kind))


def _elements(name: str) -> list:
    """The sum of each component of an array column."""
    return [F.sum(F.get(name, F.lit(j))).alias(f"s{j}") for j in range(DIM)]


def rotation(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the mean of ``kept`` and the LEADING axes of largest variance, one a column.

    A task sends its moments, DIM rows; the driver gets DIM rows of sums. They only steer the filter.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(DIM), np.zeros((DIM, DIM))
        for b in batches:
            x = _matrix(b.column("v"), DIM).astype(np.float64)
            n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            yield pa.record_batch([pa.array(range(DIM), pa.int32()), pa.array([n] * DIM, pa.int64()), pa.array(first), _lists(second, pa.float64())], ["i", "n", "first", "second"])

    got = kept.select("v").mapInArrow(moments, "i int, n long, first double, second array<double>").groupBy("i").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), *_elements("second")).orderBy("i").collect()
    if not got:
        return np.zeros(DIM), np.eye(DIM)[:, :LEADING]
    n, mean = got[0]["n"], np.array([r["first"] for r in got]) / got[0]["n"]
    spread = np.array([[r[f"s{j}"] for j in range(DIM)] for r in got]) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1][:, :LEADING].copy()


def rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading rotated coordinates, norm of the rest) of the rows of ``v``."""
    x = v.astype(np.float64) - mean
    lead = x @ axes
    return lead, np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0))


def with_rotation(kept: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``kept`` plus lead, the leading rotated coordinates, and rest, the norm of what they leave."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead, rest = rotated(_matrix(b.column("v"), DIM), mean, axes)
            yield pa.record_batch([*b.columns, _lists(lead, pa.float64()), pa.array(rest)], [*b.schema.names, "lead", "rest"])

    return kept.mapInArrow(rotate, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, v array<int>, lead array<double>, rest double")


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, centroids verified) of each row; ties go to the smaller number.

    A rotation keeps distances, and the rests of two vectors are at least as far apart as their norms, so
    |lead - c_lead|^2 + (rest - c_rest)^2 is a lower bound. The integer distance to the centroid with the least
    bound is an upper one; whoever's bound is not above it, with room for rounding, is verified in integers.
    """
    own, other = (lead * lead).sum(1)[:, None], (c_lead * c_lead).sum(1)[None, :]
    bound = own + other - 2 * lead @ c_lead.T + (rest[:, None] - c_rest[None, :]) ** 2
    bound -= 1e-9 * (own + other + rest[:, None] ** 2 + c_rest[None, :] ** 2) + 1e-3
    v = v.astype(np.int64)
    best = bound.argmin(1)
    most = ((v - centroids[best]) ** 2).sum(1)
    maybe = bound <= most[:, None]
    rows, which = np.nonzero(maybe)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    for i in range(0, len(rows), _PAIRS):
        r, w = rows[i : i + _PAIRS], which[i : i + _PAIRS]
        exact[r, w] = ((v[r] - centroids[w]) ** 2).sum(1)
    found = exact.argmin(1)
    return found.astype(np.int32), exact[np.arange(len(v)), found], maybe.sum(1).astype(np.int32)


def _batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> Iterator[tuple]:
    for b in batches:
        if b.num_rows:
            v = _matrix(b.column("v"), DIM)
            yield (b, v, *nearest(v, _matrix(b.column("lead"), LEADING), b.column("rest").to_numpy(), centroids, c_lead, c_rest))


def moved(store: DataFrame, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> np.ndarray:
    """``centroids`` after a round: the floor of the mean of each one's vectors. A task sends a row a centroid, and so does the last stage."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, v, found, _, _ in _batches(batches, centroids, c_lead, c_rest):
            order = np.argsort(found, kind="stable")
            which, start = np.unique(found[order], return_index=True)
            n[which] += np.diff([*start, len(order)])
            total[which] += np.add.reduceat(v[order].astype(np.int64), start)
        has = np.flatnonzero(n)
        if len(has):
            yield pa.record_batch([pa.array(has, pa.int32()), pa.array(n[has]), _lists(total[has], pa.int64())], ["cluster", "n", "total"])

    out = centroids.copy()
    for r in store.select("v", "lead", "rest").mapInArrow(sums, "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *_elements("total")).collect():
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(DIM)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, n_verified), centroids): the nearest of ``k`` centroids for each kept vector after ``rounds`` of moving them.

    Centroids start as the vectors with the smallest sha256 of ``seed:vec_id``; a null id counts as empty text,
    and of repeated ids the smaller vector comes first. Fewer vectors than ``k`` make fewer centroids; the empty
    table has none and gives no rows. n_verified is how many centroids the filter left to integers. The driver
    holds ``k`` centroids and a rotation; vectors stay in one stored table, which each round reads once.
    """
    kept = kept_vectors(vectors)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, DIM)
    mean, axes = rotation(kept)
    store = stored(with_rotation(kept, mean, axes))
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(store, centroids, *rotated(centroids, mean, axes))
    c_lead, c_rest = rotated(centroids, mean, axes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, found, distance, tested in _batches(batches, centroids, c_lead, c_rest):
            yield pa.record_batch([b.column("vec_id"), pa.array(found), pa.array(distance), pa.array(tested)], ["vec_id", "cluster", "distance", "n_verified"])

    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, n_verified int"
    return store.mapInArrow(assign, schema), centroids


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_verified), a row a kept vector.

    Inertias are sums of distances, null should they pass 64 bits. What is joined to all rows is a row a centroid.
    """
    placed, centroids = cluster(vectors, k, rounds, seed)
    placed = stored(placed)
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    sums = {r["cluster"]: int(r["d"]) for r in sums.collect()}
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    fits = lambda n: n if n < 1 << 63 else None
    about = placed.sparkSession.createDataFrame([(i, fits(sums[i]), fits(sum(sums.values())), t) for i, t in enumerate(texts) if i in sums], "c_ int, cluster_inertia long, inertia long, t_ string")
    about = about.select("c_", "cluster_inertia", "inertia", F.sha2(F.col("t_"), 256).alias("centroid_sha256"))
    return placed.join(F.broadcast(about), F.col("cluster") == F.col("c_")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_verified")


def sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The rows of ``clusters`` but n_verified in DuckDB's SQL, by comparing every vector with every centroid."""
    parts = [
        f"kept as materialized (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor({UNITS} * x::double)) as v from embeddings"
        f" where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {DIM})",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from (select sha256('{seed}:' || coalesce(vec_id::varchar, '')) as h, v from kept order by h, v limit {k}))",
    ]
    for i in range(rounds + 1):
        pairs = f"select r, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept, c{i}"
        parts.append(f"a{i} as materialized (select r, (min((d, c)))[2]::integer as c, (min((d, c)))[1] as d from (select r, c, d from ({pairs})) group by r)")
        if i < rounds:
            sums = f"select c, j, sum(x)::hugeint as s, count(*)::hugeint as n from (select c, unnest(v)::bigint as x, unnest(range({DIM})) as j from a{i} join kept using (r)) group by c, j"
            means = f"select c, list(((s - ((s % n) + n) % n) // n)::double order by j) as v from ({sums}) group by c"
            parts.append(f"c{i + 1} as materialized (select c, coalesce(m.v, o.v) as v from c{i} o left join ({means}) m using (c))")
    hashes = f"select c, sha256(array_to_string(list_transform(v, lambda x: x::bigint), ',')) as h from c{rounds}"
    return f"with {', '.join(parts)} select vec_id, c as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256 from a{rounds} join kept using (r) join ({hashes}) using (c)"
