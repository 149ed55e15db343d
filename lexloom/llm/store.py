"""Content-addressed store of token ids.

A document's ids (with the end id) are cut into chunks where a rolling hash over the
last `SPAN` ids has `BITS` zero bits, so equal passages give equal chunks wherever
they stand. A store is a folder of Parquet tables (zstd):

    chunks/     hash, n_ids, payload (unsigned 16- or 32-bit little-endian)          each distinct chunk once
    recipes/    doc_id, start, n_tokens, hashes, sizes, root, part                   range-partitioned, ascending doc_id
    manifest/   part, first_doc, last_doc, start, documents, ids, root               a row a recipe part

A document's root is the Merkle root over its chunk hashes, a part's that over its
documents' roots, and the manifest's last row (part null) has the root over the parts.
Readers check each chunk against its hash and each recipe against its root, and
`verify` recomputes the parts from the recipes: a lost, moved or altered chunk, recipe
or part is an error that names the part."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.bpe import Layout, Pieces, byte_chars, default_path
from lexloom.llm.common import arrow_map, cut, portions, remove, rows, shared_dir, table

END_ID = 1
SPAN = 16
BITS = 9
LEAST, MOST = 128, 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(SPAN)]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash over the last `SPAN` ids lets a chunk end.

    Several documents may stand in `ids` one after the other: a chunk has at least LEAST
    ids, more than SPAN, so no mark that counts depends on the document before."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    h, reach = mixed, 1
    while reach < SPAN:  # windows of 2, 4, 8 ... ids from two of half the length
        wider = h.copy()
        wider[reach:] += h[:-reach] * _POWERS[reach]
        h, reach = wider, 2 * reach
    return np.flatnonzero((h >> np.uint64(64 - BITS)) == 0) + 1


def ends_of(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of `n` ids with marks at `places`; each has LEAST to MOST ids, but for the last."""
    out, last = [], 0
    for m in [*places, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            out.append(m)
            last = m
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of one document's `ids`."""
    return ends_of(marks(ids).tolist(), len(ids))


def digest(payload: bytes, wide: bool = False) -> bytes:
    """Hash of bytes; ids of 32 bits are told apart from those of 16."""
    return hashlib.blake2b(payload, digest_size=16, person=b"wide" if wide else b"").digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; no leaves: the hash of nothing."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: Chunk hashes that a task remembers, so that a chunk leaves it once; what it forgets is dropped when chunks are gathered.
SEEN = 200_000


class _Encoder:
    """The tokenizers library, asked once for each word that the memo doesn't hold.

    Where a file's normalizers and pattern are those of a `Layout`, a text's ids are the
    ids of its words one after the other, and the library's model gets the words; with
    any other file the library gets whole texts."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        try:
            layout = Layout(json.loads(spec))
        except ValueError:
            self.pieces = None
            return
        tokenize, chars = self.library.model.tokenize, byte_chars()

        def word(w: str) -> tuple[int, ...]:
            plain = w if w.isascii() and w.isprintable() else "".join(map(chars.__getitem__, w.encode()))
            return tuple(t.id for t in tokenize(plain))

        self.pieces = Pieces(layout, word)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a binary array of texts, and the places where texts start and the last ends."""
        if self.pieces is not None:
            return self.pieces.encode_all(texts)
        found = [self.library.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        return np.fromiter((i for x in found for i in x), np.uint32, int(ends[-1])), ends


_encoders: dict[int, _Encoder] = {}


def _encoder(key: int, spec: str) -> _Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(spec)
    return _encoders[key]


_STAGED = "doc_id bigint, n_tokens bigint, hashes array<binary>, sizes array<int>, root binary, hash binary, payload binary"


def write(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID
) -> None:
    """Encode `docs` and write a store to `path`, a folder of a shared file system.

    Null and empty texts give the end id alone. Documents stand in ascending order
    of their ids; rows with a null id come first, and rows that share an id stand
    together in an order that the hash of their chunks decides. Only the two named
    columns are read, so other columns may have any names. The text is read and encoded
    once; what the tasks cut goes to a staging table from which the chunks are gathered
    by hash and the recipes by id. An empty table gives a store without documents."""
    spark = docs.sparkSession
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = f.read()
    key, shared = zlib.crc32(spec.encode()), spark.sparkContext.broadcast(spec)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        seen: set[bytes] = set()
        names = [f.split()[0] for f in _STAGED.split(", ")]
        for part in (p for batch in batches for p in portions(batch, "data")):
            found, ends = encoder.encode(part.column(1))
            n = part.num_rows
            ids = np.insert(found, ends[1:], end_id).astype(np.uint32, copy=False)
            ends = ends + np.arange(n + 1)
            places = marks(ids)
            inside = np.searchsorted(places, ends, "right")
            data, over = ids.astype("<u2").tobytes(), np.concatenate(([0], np.cumsum(ids >> 16 > 0)))
            hashes, sizes, roots, new, payloads = [], [], [], [], []
            bounds = ends.tolist()
            for d in range(n):
                at = bounds[d]
                own, last = [], at
                stops = ends_of((places[inside[d] : inside[d + 1]] - at).tolist(), bounds[d + 1] - at)
                for stop in stops:
                    stop += at
                    wide = bool(over[stop] > over[last])
                    raw = ids[last:stop].tobytes() if wide else data[2 * last : 2 * stop]
                    h = digest(raw, wide)
                    own.append(h)
                    if h not in seen:  # once a task; once in all after the gathering
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        new.append((h, stop - last))
                        payloads.append(raw)
                    last = stop
                hashes.append(own)
                sizes.append(np.diff([0, *stops]).astype(np.int32))
                roots.append(merkle(own))
            m = len(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([part.column(0), pa.nulls(m, pa.int64())]), pa.array([*np.diff(ends).tolist(), *(k for _, k in new)], pa.int64()),
                    pa.array([*hashes, *[None] * m], pa.list_(pa.binary())), pa.array([*sizes, *[None] * m], pa.list_(pa.int32())),
                    pa.array([*roots, *[None] * m], pa.binary()), pa.array([*[None] * n, *(h for h, _ in new)], pa.binary()), pa.array([*[None] * n, *payloads], pa.binary()),
                ],
                names,
            )

    thin = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("data"))
    staged = thin.mapInArrow(stage, _STAGED).withColumn("kind", F.col("hash").isNotNull().cast("int"))
    staging = shared_dir(spark)
    staged.write.option("compression", "zstd").partitionBy("kind").parquet(staging)
    try:
        held = spark.read.schema(staged.schema).parquet(staging)
        _write_chunks(held.where("kind = 1").select("hash", F.col("n_tokens").alias("n_ids"), "payload"), f"{path}/chunks")
        _write_recipes(held.where("kind = 0").select("doc_id", "n_tokens", "hashes", "sizes", "root"), path)
    finally:
        remove(spark, staging)


def _write_chunks(chunks: DataFrame, path: str) -> None:
    """Each hash once: equal ones come together by a shuffle, to which every task sends a hash about once."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for h in rows(batch, "hash"):
                keep.append(h != last)
                last = h
            yield batch.filter(pa.array(keep, pa.bool_()))

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, "hash").sortWithinPartitions("hash")
    dealt.mapInArrow(once, chunks.schema).write.option("compression", "zstd").parquet(path)


_RECIPES = "doc_id bigint, start bigint, n_tokens bigint, hashes array<binary>, sizes array<int>, root binary, part int"
_MANIFEST = "part int, first_doc bigint, last_doc bigint, start bigint, documents bigint, ids bigint, root binary"


def _write_recipes(recipes: DataFrame, path: str) -> None:
    """Recipes by range of doc_id, with running starts: one sum a part comes to the driver."""
    spark = recipes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("n_tokens")]
    ranged = cut(recipes.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a part
    base, total = {}, 0
    for p in sorted(sums):
        base[p], total = total, total + sums[p]
    names = [f.split()[0] for f in _RECIPES.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows:
                column = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
                at = base[column["part"][0].as_py()] if at is None else at
                sizes = column["n_tokens"].to_numpy()
                column["start"] = pa.array(at + np.cumsum(sizes) - sizes)
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([column[name] for name in names], names)

    ranged.mapInArrow(place, _RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    found = sorted(_parts(spark, path).collect(), key=lambda r: r["part"])  # one row a part
    documents, ids = (sum(r[k] for r in found) for k in ("documents", "ids"))
    whole = (None, None, None, 0, documents, ids, merkle([bytes(r["root"]) for r in found]))
    spark.createDataFrame([*map(tuple, found), whole], _MANIFEST).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/manifest")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows of the parts, from the recipes as they lie there."""
    names = [f.split()[0] for f in _MANIFEST.split(", ")]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, roots = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if part is not None:
                        out[-1][-1] = merkle(roots)
                    part, roots = r["part"], []
                    out.append([part, r["doc_id"], None, r["start"], 0, 0, None])
                row = out[-1]
                # a gap or an overlap between documents shows in the sum of ids
                row[2], row[4], row[5] = r["doc_id"], row[4] + 1, row[5] + r["n_tokens"]
                roots.append(digest(b"%d " % (r["start"] - row[3]) + r["root"]))
        if out:
            out[-1][-1] = merkle(roots)
            columns = zip(*out)
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = spark.read.schema(_RECIPES).parquet(f"{path}/recipes").select("part", "start", "doc_id", "n_tokens", "root")
    return narrow.repartition(n, "part").sortWithinPartitions("part", "start").mapInArrow(summary, _MANIFEST)


class StoreError(ValueError):
    """A store is not what its manifest says."""


def verify(spark: SparkSession, path: str) -> None:
    """Hold the recipes of a store against its manifest; a `StoreError` names the parts that differ. A part's rows meet in one task."""
    listed = {r["part"]: tuple(r) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()}  # one row a part
    found = {r["part"]: tuple(r) for r in _parts(spark, path).collect()}
    whole = listed.pop(None, None)
    wrong = sorted(p for p in listed.keys() | found.keys() if listed.get(p) != found.get(p))
    if wrong:
        raise StoreError(f"recipe parts {wrong} differ from the manifest")
    roots = [bytes(listed[p][-1]) for p in sorted(listed)]
    if whole is None or bytes(whole[-1]) != merkle(roots) or whole[4:6] != tuple(sum(r[k] for r in listed.values()) for k in (4, 5)):
        raise StoreError("the manifest's parts differ from its root")
    at = 0
    for p in sorted(listed):
        if listed[p][3] != at:
            raise StoreError(f"part {p} doesn't start where the part before it ends")
        at += listed[p][5]


def _ids(payload: bytes, n: int) -> bytes:
    return np.frombuffer(payload, "<u2").astype("<u4").tobytes() if len(payload) == 2 * n else payload


@lru_cache(1)
def _shift_tables() -> list[np.ndarray]:
    """Per k the tables that move a CRC-32 over 2^k zero bytes, by the four bytes of its value."""

    def spread(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for value in range(256):
                r = 0
                for bit in range(8):
                    if value >> bit & 1:
                        r ^= columns[byte * 8 + bit]
                out[byte, value] = r
        return out

    def step(columns: list[int], x: int) -> int:
        r = 0
        for bit in range(32):
            if x >> bit & 1:
                r ^= columns[bit]
        return r

    one = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        one = [step(one, x) for x in one]
    tables = []
    for _ in range(40):
        tables.append(spread(one))
        one = [step(one, x) for x in one]
    return tables


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a piece's CRC-32 adds to that of the whole when `after` bytes follow it; the whole's is the XOR of these."""
    crc = crc.astype(np.uint32)
    for k, t in enumerate(_shift_tables()):
        on = (after >> k) & 1 > 0
        if on.any():
            c = crc[on]
            crc[on] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return crc


_CHUNKS = "hash binary, n_ids bigint, payload binary"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(hash, n_ids, crc, intact) of every chunk of a store, from its payload, where it lies."""

    def check(batch: pa.RecordBatch) -> dict:
        crc, intact = [], []
        for h, n, p in zip(*(rows(batch, c) for c in ("hash", "n_ids", "payload"))):
            crc.append(zlib.crc32(_ids(p, n)))
            intact.append(len(p) in (2 * n, 4 * n) and digest(p, len(p) != 2 * n) == h)
        return {"hash": batch.column(0), "n_ids": batch.column(1), "crc": crc, "intact": intact}

    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    return arrow_map(chunks, check, "hash binary, n_ids bigint, crc bigint, intact boolean")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and intact, from recipes and chunks, after `verify`.

    The CRC-32 of a document is put together from those of its chunks, so payloads
    are read where they lie and only digests are shuffled. `intact`: each chunk is there
    and has its hash and size, the sizes add up and the Merkle root is the recipe's."""
    verify(spark, path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk of a document: which, how many bytes follow it, whether the recipe holds together."""
        for batch in batches:
            start, hash_, n_ids, after, sound = [], [], [], [], []
            for at, n, hashes, sizes, root in zip(*(rows(batch, c) for c in ("start", "n_tokens", "hashes", "sizes", "root"))):
                ok = len(hashes) == len(sizes) and sum(sizes) == n and merkle(hashes) == root
                start += [at] * len(hashes)
                hash_ += hashes
                n_ids += (sizes + [0] * len(hashes))[: len(hashes)]
                after += (4 * (n - np.cumsum((sizes + [0] * len(hashes))[: len(hashes)]))).tolist()
                sound += [ok] * len(hashes)
            columns = [pa.array(start, pa.int64()), pa.array(hash_, pa.binary()), pa.array(n_ids, pa.int64()), pa.array(after, pa.int64()), pa.array(sound, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["start", "hash", "n_ids", "after", "sound"])

    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    narrow = recipes.select("start", "n_tokens", "hashes", "sizes", "root")
    each = narrow.mapInArrow(pieces, "start bigint, hash binary, n_ids bigint, after bigint, sound boolean")
    # both sides are plain exchanges, which AQE can split at a chunk that very many documents share
    found = each.join(cut(read_chunks(spark, path)), ["hash", "n_ids"], "left")

    def move(batch: pa.RecordBatch) -> dict:
        column = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
        crc = shifted(column["crc"].fill_null(0).to_numpy(), column["after"].to_numpy()).astype(np.int64)
        return column | {"crc": crc}

    moved = arrow_map(
        found.select("start", "crc", "after", (F.coalesce("intact", F.lit(False)) & F.col("sound")).alias("whole")), move, "start bigint, crc bigint, whole boolean"
    )
    sums = moved.groupBy("start").agg(F.bit_xor("crc").alias("ids_crc32"), F.min("whole").alias("intact"))
    return recipes.select("doc_id", "start", "n_tokens").join(sums, "start").select("doc_id", "start", "n_tokens", "ids_crc32", "intact")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids, put together from its chunks: doc_id, start, ids array<int>, after `verify`.

    A chunk that is missing or altered fails the job."""
    verify(spark, path)
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", F.posexplode(F.arrays_zip("hashes", "sizes")).alias("seq", "x"))
    parts = parts.select("doc_id", "start", "seq", F.col("x.hashes").alias("hash"), F.col("x.sizes").cast("bigint").alias("n_ids"))
    pieces = parts.join(chunks, ["hash", "n_ids"], "left").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "hash", "n_ids", "payload"))).alias("pieces")
    )

    def build(batch: pa.RecordBatch) -> dict:
        ids = []
        for pieces_ in rows(batch, "pieces"):
            if any(p["payload"] is None or digest(p["payload"], len(p["payload"]) != 2 * p["n_ids"]) != p["hash"] for p in pieces_):
                raise StoreError("a chunk of the store is missing or altered")
            ids.append(np.frombuffer(b"".join(_ids(p["payload"], p["n_ids"]) for p in pieces_), "<u4").astype(np.int32))
        return {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "start": batch.column(batch.schema.get_field_index("start")), "ids": ids}

    return arrow_map(pieces, build, "doc_id bigint, start bigint, ids array<int>")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` through the store and back: doc_id, start, n_tokens, ids_crc32, intact; the store's folder is removed.

    Null and empty texts have the end id alone, repeated ids a row each; an empty table gives no rows."""
    path = shared_dir(spark)
    try:
        write(table(spark, sf_dir, "documents"), path)
        return cut(read_digests(spark, path))
    finally:
        remove(spark, path)
