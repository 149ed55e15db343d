"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits. Two that differ in at most three bits differ in at most
one bit of one of the two 32-bit halves. Each half is covered by the code
`Hamming[31,26] x {0,1}`, whose 2^27 words (the anchors) have covering radius 1.
A fingerprint is at home at its nearest anchor and is copied to every anchor within
covering radius plus threshold, 1 + 1 = 2 bits, of the half: so wherever x is at
home, each y that agrees with it up to one bit of that half is present, and every
link is found. At an anchor the whole fingerprints are compared.

Only distinct fingerprints take part, tiles bound the work of one task
(`lexloom.llm.tiles`), and tasks emit spanning edges instead of pairs; components
come from a distributed star algorithm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Forest, arrow_map, connected_components, cut, fresh, named, rows, table

SEED = 42
THRESHOLD = 3
TILE = 1024
_CHUNK = 1 << 15


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash over word shingles of a UTF-8 text; 0 without words (also for null)."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + _CHUNK]], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp bigint, and the bigint columns `also`) of every row of `docs`, repeated rows included."""

    def run(batch: pa.RecordBatch) -> dict:
        more = {c: batch.column(batch.schema.get_field_index(c)) for c in also}
        return {"id": batch.column(0), "fp": [fingerprint(x, width) for x in rows(batch, "data")]} | more

    thin = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("data"), *also)
    return arrow_map(thin, run, ", ".join(["id bigint", "fp bigint", *(f"{c} bigint" for c in also)]))


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray]:
    """Per byte and value of a half the syndrome; per syndrome the 17 masks from a half to the anchors near it (home first)."""
    position = np.arange(1, 33)
    position[31] = 0  # the free bit
    syndromes = np.zeros((4, 256), np.uint8)
    for byte in range(4):
        for value in range(256):
            s = 0
            for bit in range(8):
                if value >> bit & 1:
                    s ^= int(position[byte * 8 + bit])
            syndromes[byte, value] = s
    bit = lambda p: 1 << (p - 1)
    masks = np.full((32, 17), -1, np.int64)
    masks[0, :2] = 0, 1 << 31
    for s in range(1, 32):
        pairs = [bit(i) | bit(i ^ s) for i in range(1, 32) if i < (i ^ s)]
        masks[s] = [bit(s), bit(s) | 1 << 31, *pairs]
    return syndromes, masks


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For int64 fingerprints: row index, bucket (half and anchor), whether the row is at home there."""
    syndromes, masks = _code()
    out = []
    u = fp.view(np.uint64)
    for part in range(2):
        half = ((u >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = np.zeros(len(half), np.uint8)
        for byte in range(4):
            s ^= syndromes[byte, (half >> (8 * byte)) & 255]
        m = masks[s]
        ok = m >= 0
        index = np.broadcast_to(np.arange(len(half))[:, None], m.shape)[ok]
        bucket = ((half[:, None] ^ m) | (part << 32))[ok]
        home = np.zeros(m.shape, bool)
        home[:, 0] = True
        out.append((index, bucket, home[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(prints: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Spanning edges (a, b) of the graph over distinct fingerprints `prints` (fp) that differ in `threshold` (at most 3) bits or fewer."""
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors cover thresholds from 0 to 3")
    from lexloom.llm.tiles import groups, tiled

    def spread(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy()
        index, bucket, home = anchors(fp)
        return {"fp": fp[index], "bucket": bucket, "home": home}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, found = Forest(), []

        def work(t: pa.Table) -> None:
            fp, kind = t.column("fp").to_numpy(), t.column("kind").to_numpy()
            own, others = fp[kind & 1 > 0], fp[kind & 2 > 0]
            for i in range(0, len(own), 256):
                for j in range(0, len(others), 4096):
                    x, y = own[i : i + 256], others[j : j + 4096]
                    d = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64))
                    p, q = np.nonzero((d <= threshold) & (d > 0))
                    for a, b in zip(x[p].tolist(), y[q].tolist()):
                        if forest.join(a, b):
                            found.append((a, b))

        def flush() -> pa.RecordBatch:
            a, b = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for _ in groups(batches, work):
            if found:
                yield flush()

    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = arrow_map(prints.select("fp"), spread, "fp bigint, bucket bigint, home boolean")
    return tiled(near, tile, "fp", parts).mapInArrow(compare, "a bigint, b bigint")


def rooted(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root): for each distinct fingerprint of `prints` the smallest one that links of `threshold` bits or fewer reach."""
    distinct = cut(prints.select("fp").distinct())
    roots = connected_components(links(distinct, threshold)).withColumnRenamed("node", "fp")
    return cut(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = 3
) -> DataFrame:
    """(id, fingerprint string, component_id) of every row of `docs`.

    component_id is the smallest id reachable over links of `threshold` bits or
    fewer. Null and blank texts have fingerprint zero and are linked like any
    other. Repeated rows stay, one result row each; rows with null ids are labelled
    by the ids of their component, null if it has none. An empty table gives no
    rows. Only the two named columns are read."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    roots = rooted(prints, threshold)
    low = prints.groupBy("fp").agg(F.min("id").alias("low"))
    held = cut(roots.join(low, "fp"))
    lows = cut(held.groupBy("root").agg(F.min("low").alias("component_id")))
    labels = held.join(lows, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = 3) -> DataFrame:
    """`docs` with one row of each near-duplicate group.

    The row with the smallest id stays, a null id coming last; of rows that share it the
    one with the smallest fingerprint, then that with the smallest hash over all columns.
    So rows are told apart by what they hold: a row that shares the id of another but not
    its text is decided by its own group, and rows that are equal in every column count as
    one. Null and blank texts are one group. Columns keep their names and order, whatever
    these are; an empty table stays empty."""
    hashable = [F.to_json(F.struct(*named(c))) if "map<" in kind or "variant" in kind else named(c)[0] for c, kind in docs.dtypes]
    keys = dict(zip(fresh(docs, "row_key", "row_key2"), (F.xxhash64(*hashable), F.xxhash64(F.lit(1), *hashable))))
    keyed = docs.withColumns(keys)
    prints = cut(fingerprints(keyed, id_col, text_col, width, tuple(keys)))
    roots = rooted(prints, threshold)
    # the first row of each fingerprint, then of each group: minima, with partial sums where the rows are
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "fp", *keys)
    firsts = cut(roots.join(prints.groupBy("fp").agg(F.min(rank).alias("first")), "fp"))
    winners = cut(firsts.groupBy("root").agg(F.min("first").alias("win")).select("root", *(F.col(f"win.{k}").alias(f"{k}_win") for k in keys)))
    labels = cut(roots.join(winners, "root").drop("root"))
    own = F.lit(True)
    for k in keys:
        own = own & (F.col(k) == F.col(f"{k}_win"))
    judged = prints.join(labels, "fp").select(*keys, own.alias("own"))
    counted = cut(judged.groupBy(*keys).agg(F.first("own").alias("own"), F.count(F.lit(1)).alias("n")))
    gone, again = counted.where("not own").select(*keys), counted.where("own and n > 1").select(*keys)
    kept = keyed.join(gone, [*keys], "left_anti")
    if not again.isEmpty():
        once = kept.join(again, [*keys], "left_anti").select(*named(*keyed.columns))
        kept = once.unionByName(kept.join(again, [*keys], "left_semi").select(*named(*keyed.columns)).dropDuplicates([*keys]))
    return kept.select(*named(*docs.columns))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `documents`: 3-word shingles, links of 3 bits or fewer.

    Nulls, blank texts, repeated ids and an empty table as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
