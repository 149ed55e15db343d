"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from lexloom.functions.memo import portions
from lexloom.plans.cluster import cut, remove, shared_dir

__all__ = ["cut", "portions", "remove", "shared_dir"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Byte table: ASCII upper case to lower, every ASCII byte that is not a letter or digit to a space.
WORD_TABLE = bytes(
    (c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII bytes of a UTF-8 text."""
    return data.translate(WORD_TABLE).split() if data else []


def words_column(text: Column) -> Column:
    """The same words as `words_of`, as a native array column; null is empty."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, changed where `df` has columns of these names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def named(*names: str) -> list[Column]:
    """Columns by their whole names, dots and backticks in them too."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def rows(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def schema_of(more: str, **first: DataType) -> StructType:
    """A schema of fields `first`, whose types may hold names that DDL can't, and of the DDL `more`."""
    from pyspark.sql.types import StructField, _parse_datatype_string

    return StructType([*(StructField(n, t) for n, t in first.items()), *_parse_datatype_string(more).fields])


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]], schema: str | StructType, text: str | None = None
) -> DataFrame:
    """`df` with `fn` applied to each Arrow batch; it returns one column of values per field of `schema`.

    With `text`, the name of a binary column, batches are cut into `portions` first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema_of(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, text) if text else (batch,):
                if part.num_rows:
                    got = fn(part)
                    yield pa.RecordBatch.from_arrays(
                        [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in target],
                        schema=target,
                    )

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for the nodes of the undirected `edges` (a, b: bigint) that can reach a smaller one; root is the smallest.

    Nodes that are missing from the result are their own roots.

    Alternates large-star and small-star steps until the edges stay the same.
    Only joins and partially aggregated minima are used, so a hub's edges can be
    split over tasks, and nothing is collected. Each round is checkpointed."""
    pairs = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    state = mark(pairs)
    for _ in range(limit):
        if not state[0]:
            break
        both = pairs.union(pairs.select("v", "u"))
        # minima are checkpointed so that both sides of a join are plain exchanges, which AQE can split at a hub
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        pairs = cut(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        before, state = state, mark(pairs)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


class Forest:
    """Union-find over integers; `join` says whether an edge connected two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True
