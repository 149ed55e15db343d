"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; a hash is
the signed axis that lies nearest to the rotated vector. A table joins `HASHES`
hashes. A vector is at home in one bucket of each table and is copied to the buckets
that differ in one hash by its next nearest axes (multiprobe). In a bucket each home
vector meets every vector there, in tiles of bounded size; cosines are computed in
double precision, and only pairs that reach the threshold count.

A pair can meet more than once; it counts at the first place where it meets (lowest
table, then the bucket of the smaller key), which both vectors' bucket lists tell.
So tasks emit sums of links for each vector and spanning edges, never the pairs.
Equal vectors are one vector with a weight."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Forest, arrow_map, connected_components, cut, rows, table
from lexloom.llm.tiles import groups, tiled

THRESHOLD = 0.98
TABLES = 4
HASHES = 2
PROBES = 2
TILE = 512
SEED = 20240229


@lru_cache(8)
def _signs(size: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, hashes, 3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1], n // (2 * h), 2, h) if x.shape[-1] == n else x
        a, b = x[..., 0, :], x[..., 1, :]
        x = np.stack((a + b, a - b), axis=-2).reshape(*x.shape[:-3], n)
        h *= 2
    return x / np.sqrt(n)


def buckets(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """int64 (rows, tables, 1 + probes): the home bucket of each table, then the probed ones."""
    n, d = vectors.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors
    signs = _signs(size, tables, hashes)
    out = np.empty((n, tables, 1 + probes), np.int64)
    each = -(-probes // hashes)  # next nearest axes of each hash
    line = np.arange(n)[:, None]
    for t in range(tables):
        axes, gaps = [], []
        for k in range(hashes):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t, k, r])
            order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, : each + 1]
            near = np.take_along_axis(x, order, 1)
            axes.append(order * 2 + (near < 0))
            gaps.append(np.abs(near[:, :1]) - np.abs(near[:, 1:]))
        width = 2 * size
        code = np.zeros(n, np.int64)
        for a in axes:
            code = code * width + a[:, 0]
        out[:, t, 0] = code
        changed, cost = [], []
        for k, a in enumerate(axes):
            place = width ** (hashes - 1 - k)
            for j in range(1, a.shape[1]):
                changed.append(code + (a[:, j] - a[:, 0]) * place)
                cost.append(gaps[k][:, j - 1])
        best = np.argsort(np.array(cost).T, axis=1, kind="stable")[:, :probes]
        out[:, t, 1:] = np.array(changed).T[line, best]
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(x: np.ndarray) -> bytes:
    """Components as 32-bit floats where that loses nothing; the first byte says which."""
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    return b"\x04" + narrow.tobytes() if (narrow == x).all() else b"\x08" + x.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[0] == 4 else np.float64, offset=1).astype(np.float64)


def _size_of(data: bytes) -> int:
    return (len(data) - 1) // data[0]


def usable(values: list | None) -> bool:
    """Whether a vector can link: not null or zero, all components finite."""
    if not values or any(v is None for v in values):
        return False
    x = np.array(values, np.float64)
    return bool(np.isfinite(x).all() and x.any())


def _hashed(tables: int, hashes: int, probes: int):
    """Each vector with its buckets in all tables (`places`, in the narrowest integers that hold them) and its components packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[int]] = defaultdict(list)
            vectors = rows(batch, "vector")
            for i, v in enumerate(vectors):
                by_size[len(v)].append(i)
            for size, index in by_size.items():
                for at in range(0, len(index), 1024):
                    part = index[at : at + 1024]
                    raw = np.array([vectors[i] for i in part], np.float64)
                    places = buckets(units(raw), tables, hashes, probes).astype(_place_type(size, hashes))
                    own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(part)) for c in ("key", "weight", "label")]
                    made = [[x.tobytes() for x in places], [_packed(x) for x in raw]]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.binary()) for x in made)], ["key_id", "weight", "label", "places", "vector"])

    return run


def _spread(tables: int, hashes: int, probes: int):
    """A row for each bucket of each hashed vector; the low bits of a bucket name its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table_no = tables * (1 + probes), np.repeat(np.arange(tables), 1 + probes)
        for batch in batches:
            found = np.empty((batch.num_rows, places), np.int64)
            by_size: dict[int, list[int]] = defaultdict(list)
            for i, v in enumerate(rows(batch, "vector")):
                by_size[_size_of(v)].append(i)
            labels, held = rows(batch, "label"), rows(batch, "places")
            for size, index in by_size.items():
                flat = np.frombuffer(b"".join(held[i] for i in index), _place_type(size, hashes)).reshape(len(index), places).astype(np.int64)
                salt = np.array([hash((labels[i], size)) for i in index], np.int64)
                with np.errstate(over="ignore"):
                    bucket = (flat * np.int64(64) + table_no) * np.int64(-7046029254386353131) ^ salt[:, None] * np.int64(-4417276706812531889)
                found[index] = (bucket & ~np.int64(63)) | table_no
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                line = pa.array(np.repeat(np.arange(part.num_rows), places))
                home = pa.array(np.tile(np.arange(places) % (1 + probes) == 0, part.num_rows))
                copies = part.take(line)
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 1024].ravel()), home, *copies.columns], ["bucket", "home", *copies.schema.names])

    return run


def _place_type(size: int, hashes: int) -> type:
    """The narrowest unsigned integers for the buckets of vectors of `size` components."""
    most = (2 * max(2, 1 << (size - 1).bit_length())) ** hashes
    return np.uint16 if most <= 1 << 16 else np.uint32 if most <= 1 << 32 else np.int64


def _compare(threshold: float, tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sums, edges = Forest(), defaultdict(int), []

        def first_meeting(p: np.ndarray, q: np.ndarray, table_no: int, kp: np.ndarray, kq: np.ndarray) -> np.ndarray:
            """p: places (tables, 1 + probes) of the home side, q of the other: whether this bucket is where the pair counts."""
            hp, hq = p[:, :, 0], q[:, :, 0]
            p_at_q = (q == hp[:, :, None]).any(axis=2)  # they meet at p's home
            q_at_p = (p == hq[:, :, None]).any(axis=2)
            either = p_at_q | q_at_p
            new = ~either[:, :table_no].any(axis=1)
            # both homes differ and each probes the other's: it counts at the smaller key's home
            twice = p_at_q[:, table_no] & q_at_p[:, table_no]
            return new & (~twice | (kp < kq))

        def work(t: pa.Table) -> None:
            kind = t.column("kind").to_numpy()
            key = t.column("key_id").to_numpy()
            weight = t.column("weight").to_numpy()
            label = t.column("label").to_numpy()
            table_no = int(t.column("bucket")[0].as_py()) & 63
            vectors = [_unpacked(v) for v in t.column("vector").to_pylist()]
            places = t.column("places").to_pylist()
            # vectors of other labels or sizes can only share a bucket by a clash of its hash
            parts = defaultdict(list)
            for i, v in enumerate(vectors):
                parts[label[i], len(v)].append(i)
            for (_, size), index in parts.items():
                unit = units(np.stack([vectors[i] for i in index]))
                own_places = np.frombuffer(b"".join(places[i] for i in index), _place_type(size, hashes)).reshape(len(index), tables, 1 + probes)
                meet(unit, own_places, table_no, kind[index], key[index], weight[index])

        def meet(unit: np.ndarray, places: np.ndarray, table_no: int, kind: np.ndarray, key: np.ndarray, weight: np.ndarray) -> None:
            own, others = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
            for i in range(0, len(own), 512):
                for j in range(0, len(others), 2048):
                    a, b = own[i : i + 512], others[j : j + 2048]
                    x, y = np.nonzero(unit[a] @ unit[b].T >= threshold - 1e-9)
                    x, y = a[x], b[y]
                    ok = key[x] != key[y]
                    x, y = x[ok], y[ok]
                    # exact: the same sum for either order of a pair, whatever else stands in the tile
                    ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    x, y = x[ok], y[ok]
                    ok = first_meeting(places[x], places[y], table_no, key[x], key[y])
                    x, y = x[ok], y[ok]
                    # two at home here meet in both orders; one order counts
                    both = places[x, table_no, 0] == places[y, table_no, 0]
                    ok = ~both | (key[x] < key[y])
                    x, y = x[ok], y[ok]
                    for k, w in zip(np.concatenate((key[x], key[y])).tolist(), np.concatenate((weight[y], weight[x])).tolist()):
                        sums[k] += w
                    for k, m in zip(key[x].tolist(), key[y].tolist()):
                        if forest.join(k, m):
                            edges.append((k, m))

        def flush() -> pa.RecordBatch:
            a = [*sums.keys(), *(e[0] for e in edges)]
            b = [*[None] * len(sums), *(e[1] for e in edges)]
            n = [*sums.values(), *[0] * len(edges)]
            sums.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for _ in groups(batches, work):
            if sums or edges:
                yield flush()

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null (all rows, if `label_col` is
    None) and their cosine is `threshold` or more; vectors that are null, zero or
    hold null or non-finite components, and vectors of different sizes, link with
    nothing. n_links counts rows, repeated ones too. Rows with a null id link like
    others; a component without ids has the id null and keeps nothing. An empty table
    gives no rows. Only the named columns are read, so others may have any names."""
    if not 1 <= tables <= 64:
        raise ValueError("one to 64 tables")
    base = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        (F.col(label_col) if label_col else F.lit(0)).cast("bigint").alias("label"),
    )
    good = (
        F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False))
        & F.coalesce(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
        & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    )
    plain = F.transform("vector", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))  # one zero, for hashing
    base = base.select("id", F.when(good, F.col("label")).alias("label"), F.when(good, plain).alias("vector"))
    marked = base.withColumn("mark", F.when(F.col("vector").isNotNull(), F.sha2(F.concat_ws(",", F.col("label"), F.col("vector").cast("array<string>")), 256)))
    distinct = marked.where("mark is not null").groupBy("mark").agg(
        F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    # numbered as they lie in the checkpoint, so that no two vectors share a key
    distinct = cut(cut(distinct).withColumn("key", F.monotonically_increasing_id()))
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "key_id bigint, weight bigint, label bigint, places binary, vector binary"
    hashed = cut(distinct.select("key", "weight", "label", "vector").mapInArrow(_hashed(tables, hashes, probes), schema))
    spread = hashed.mapInArrow(_spread(tables, hashes, probes), f"bucket bigint, home boolean, {schema}")
    found = cut(tiled(spread, TILE, "key_id", parts).mapInArrow(_compare(threshold, tables, hashes, probes), "a bigint, b bigint, n bigint"))
    sums = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    known = distinct.select("mark", "key", "weight", "low").join(roots, "key", "left").join(sums, "key", "left")
    known = cut(known.select("mark", "low", F.coalesce("root", "key").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    lows = cut(known.groupBy("root").agg(F.min("low").alias("component_id")))
    labels = known.join(lows, "root").select("mark", "n_links", "component_id")
    out = marked.select("id", "mark").where("mark is not null").join(labels, "mark").select("id", "n_links", "component_id")
    alone = marked.where("mark is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `embeddings`; nulls, repeats and empty tables as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """DuckDB SQL for `op8_embedding_dedup`: every pair of a label, and what links reach."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
k AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c(r, x) AS (SELECT r, r FROM v UNION SELECT c.r, k.b FROM c JOIN k ON k.a = c.x),
m AS (SELECT c.r, min(v.vec_id) AS low FROM c JOIN v ON v.r = c.x GROUP BY c.r),
n AS (SELECT a AS r, count(*) AS n FROM k GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, low AS component_id, vec_id = low AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)"""
