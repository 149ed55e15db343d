"""All-against-all work inside buckets, cut into tiles of bounded size.

Every row names a bucket and says whether it is at home there. Within a bucket
each home row meets every row. A bucket with more than `tile` home rows, or more than
`WIDE` times as many rows in all, is cut into strips and columns, each by its own
count: home rows are dealt over the strips and copied to the columns, all rows are
dealt over the columns and copied to the strips. So no task holds an unbounded bucket,
no row is left out, and what the tiles emit is up to the caller (spanning edges and
sums, never all pairs). A large bucket without home rows has no work and is dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import cut

#: Hot buckets are joined by broadcast up to this many, by shuffle beyond.
MOST_HOT = 100_000
#: Rows in a column, as a multiple of the home rows in a strip.
WIDE = 4


def tiled(rows: DataFrame, tile: int, salt: str, parts: int) -> DataFrame:
    """`rows` (bucket bigint, home boolean, ...) with key bigint and kind (1 strip, 2 column, 3 both), ready for `groups`.

    Rows are counted by bucket first, with map-side partial sums, from the columns
    `bucket` and `home` alone."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("bigint")).alias("h"))
    large = counts.where((F.col("h") > tile) | (F.col("n") > tile * WIDE))
    hot = cut(large.select("bucket", F.ceil(F.col("h") / tile).cast("int").alias("strips"), F.ceil(F.col("n") / (tile * WIDE)).cast("int").alias("columns")))
    n_hot = hot.count()
    if not n_hot:
        keyed = rows.withColumns({"key": F.col("bucket"), "kind": F.when(F.col("home"), 3).otherwise(2)})
    else:
        near = F.broadcast(hot) if n_hot <= MOST_HOT else hot
        lot = lambda n: F.pmod(F.xxhash64(salt), n).cast("int")
        span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        column = F.transform(span("strips"), lambda i: F.struct(i.alias("s"), lot(F.col("columns")).alias("t"), F.lit(2).alias("kind")))
        strip = F.transform(span("columns"), lambda i: F.struct(lot(F.col("strips")).alias("s"), i.alias("t"), F.lit(1).alias("kind")))
        cells = F.when(F.col("home"), F.concat(strip, column)).otherwise(column)
        one = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("t"), F.when(F.col("home"), 3).otherwise(2).alias("kind")))
        whole = F.col("strips").isNull()
        keyed = rows.join(near, "bucket", "left").withColumn("x", F.explode(F.when(whole, one).otherwise(cells)))
        key = F.when(whole, F.col("bucket")).otherwise(F.xxhash64("bucket", "x.s", "x.t"))
        keyed = keyed.withColumns({"key": key, "kind": F.col("x.kind")}).drop("x", "strips", "columns")
    return keyed.drop("home").repartition(parts, "key", "bucket").sortWithinPartitions("key", "bucket")


def groups(
    batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], None], block: int = 1 << 17
) -> Iterator[int]:
    """Call `work` on each tile (equal key and bucket) that has a home row and another row; yields now and then.

    Tiles come sorted; one that spans batches is put together first."""
    held: list[pa.RecordBatch] = []
    n_held = 0

    def run(t: pa.Table, last: bool) -> pa.Table | None:
        t = t.combine_chunks()
        key = t.column("key").to_numpy()
        bucket = t.column("bucket").to_numpy()
        kind = t.column("kind").to_numpy()
        at = np.flatnonzero((key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        starts = np.concatenate(([0], at, [len(key)]))
        if not last:
            starts = starts[:-1]
        if len(starts) > 1:
            sizes = np.diff(starts)
            homes = np.add.reduceat((kind[: starts[-1]] & 1).astype(np.int64), starts[:-1])
            for i in np.flatnonzero((sizes > 1) & (homes > 0)):
                work(t.slice(starts[i], sizes[i]))
        return t.slice(starts[-1]) if not last else None

    for batch in batches:
        held.append(batch)
        n_held += batch.num_rows
        if n_held >= block:
            rest = run(pa.Table.from_batches(held), False)
            held, n_held = rest.to_batches(), 0  # the block counts new rows, so a long tile isn't joined again and again
            yield 1
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            run(t, True)
    yield 1
