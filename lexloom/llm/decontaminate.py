"""Benchmark decontamination with a broadcast hash set of n-gram windows.

Benchmark words get integer ids; a document word outside that vocabulary is 0 and
breaks every window. Windows are hashed by a polynomial over the ids, looked up in
a sorted array, and each hit is verified word for word. An index is a handful of
arrays: a window costs about 30 bytes, wherever it comes from.

A broadcast index holds at most `block_bytes` of benchmark text. A larger benchmark is
cut into blocks by a hash, and the documents are scanned once for each block; between
two blocks what was found is written down, so that one block at a time is held by the
driver, the executors and the Python workers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, WORD_TABLE, arrow_map, cut, named, rows, schema_of, table, words_of

WINDOW = 10
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text of a binary array, as `words_of` takes them; null has none."""
    whole = pc.fill_null(texts, b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset :][: len(whole) + 1]
    data = whole.buffers()[2]
    low = (data.to_pybytes() if data is not None else b"").translate(WORD_TABLE)  # a byte for a byte, so offsets stay
    plain = pa.Array.from_buffers(pa.string(), len(whole), [None, pa.py_buffer(offsets.copy()), pa.py_buffer(low)])
    split = pc.ascii_split_whitespace(plain)
    words = split.flatten().cast(pa.binary())
    ends = (split.offsets.to_numpy() - split.offsets[0].as_py()).astype(np.int32)
    full = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty strings
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(kept[ends]), words.filter(full))


class Index:
    """Windows of benchmark items, found in documents by hash and verified exactly."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        lists = word_lists(pa.array([text for _, text in items], pa.binary()))
        coded = lists.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        self.words = coded.indices.to_numpy().astype(np.int32) + 1
        ends = lists.offsets.to_numpy()
        sizes = np.diff(ends)
        #: By length of window: sorted hashes; where each window stands in `words`; bounds of its owners; owners.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.minimum(sizes, window)
        for n in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == n)
            counts = sizes[own] - n + 1
            item = np.repeat(own, counts)
            at = np.repeat(ends[own] - (np.cumsum(counts) - counts), counts) + np.arange(len(item))
            self.windows[n] = self._grouped(n, item, at)

    def _grouped(self, n: int, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Equal windows put together; different windows of one hash stay apart."""
        h = self.rolled(self.words, at, n)
        order = np.lexsort([item, *(self.words[at + k] for k in reversed(range(n))), h])
        h, item, at = h[order], item[order], at[order]
        new = np.ones(len(h), bool)
        if len(h) > 1:
            new[1:] = h[1:] != h[:-1]
            for k in range(n):
                new[1:] |= self.words[at[1:] + k] != self.words[at[:-1] + k]
        first = np.flatnonzero(new)
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]  # an item that holds a window twice owns it once
        bounds = np.append(np.concatenate(([0], np.cumsum(once)))[first], once.sum())
        return h[first], at[first], bounds, item[once]

    @staticmethod
    def rolled(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _BASE + words[at + k].astype(np.uint64)
        return h

    def find(self, texts: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str | None]]]:
        """For each text of a binary array its number of words, the merged word spans [start, end) that windows hit, and their items."""
        lists = word_lists(texts)
        ends = lists.offsets.to_numpy().astype(np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        owners: list[set] = [set() for _ in range(len(texts))]
        ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        last = np.repeat(ends[1:], np.diff(ends))  # where the text of each word ends
        for n, (hashes, places, bounds, items) in self.windows.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero((known[n:] - known[:-n] == n) & (np.arange(len(ids) - n + 1) + n <= last[: len(ids) - n + 1]))
            h = self.rolled(ids, at, n)
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for shift in range(int((right - left).max(initial=0))):  # more than one round only where hashes clash
                some = left + shift < right
                start, entry = at[some], left[some] + shift
                same = np.ones(len(start), bool)
                for k in range(n):
                    same &= ids[start + k] == self.words[places[entry] + k]
                start, entry = start[same], entry[same]
                doc = np.searchsorted(ends, start, "right") - 1
                for d, a in zip(doc.tolist(), (start - ends[doc]).tolist()):
                    spans[d].append((a, a + n))
                # each pair of text and window once
                for d, e in np.unique(np.stack((doc, entry), axis=1), axis=0).tolist() if len(doc) else ():
                    owners[d].update(self.names[i] for i in items[bounds[e] : bounds[e + 1]].tolist())
        return np.diff(ends).tolist(), [merged(x) if x else x for x in spans], owners


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 + int(size * 2 // block_bytes) if size > block_bytes // 2 else 1
    return [benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep_text: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of `docs`: id, n_words, spans (merged word spans that are hit), items (ids as strings), and the text if asked for.

    Null and blank texts have no words and no hits; repeated rows are scanned
    each. Items with null text or no words have no windows; an item with fewer
    words than `window` is one window; an item with a null id marks its words but
    is not listed; of items that share an id each text counts. With an empty benchmark
    nothing is hit; an empty table of documents gives no rows. Only the named columns are
    read, so others may have any names."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = items.where(F.col("text").isNotNull())
    blocks = _blocks(items, block_bytes)
    context = docs.sparkSession.sparkContext
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    kind = out.schema["id"].dataType
    carried = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"
    for k, block in enumerate(blocks):
        if k:
            out = cut(out)  # what ran so far is written down, and its index can go
            shared.destroy()
        pairs = [(r[0], bytes(r[1])) for r in block.select("item", F.col("text").cast("binary")).distinct().toLocalIterator()]
        shared = context.broadcast(Index(pairs, window))
        first, last = k == 0, k == len(blocks) - 1
        whole = keep_text or not last

        def run(batch: pa.RecordBatch, shared=shared, first=first, whole=whole) -> dict:
            data = batch.column(batch.schema.get_field_index("data"))
            n_words, spans, owners = shared.value.find(data)
            if not first:
                for i, (before, named) in enumerate(zip(rows(batch, "spans"), rows(batch, "items"))):
                    spans[i] = merged(spans[i] + [(s["start"], s["stop"]) for s in before])
                    owners[i] |= set(named)
            got = {
                "id": batch.column(0), "n_words": n_words, "spans": [[{"start": a, "stop": b} for a, b in x] for x in spans],
                "items": [sorted(x for x in own if x is not None) for own in owners],
            }
            return got | ({"data": data} if whole else {})

        out = arrow_map(out, run, schema_of(("data binary, " if whole else "") + carried, id=kind), "data")
    out = out.withColumnRenamed("id", id_col)
    return out.withColumn("data", F.col("data").cast("string")).withColumnRenamed("data", text_col) if keep_text else out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """`text` without the words of `spans` (word numbers) and what stands between them."""
    if text is None or not spans:
        return text
    data = text.encode()
    low, places, at = data.translate(WORD_TABLE), [], 0
    for w in low.split():
        at = low.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, end = [], 0
    for a, b in spans:
        out.append(data[end : places[a][0]])
        end = places[b - 1][1]
    return b"".join([*out, data[end:]]).decode()


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that contain a benchmark window; one narrow pass over whole rows, no shuffle.

    Rows of null or blank text stay. `options` as for `scan`."""
    return _filtered(docs, benchmark, id_col, text_col, **options)


def _filtered(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    # The whole row rides along as the id, so that no join is needed to get it back.
    packed = docs.select(F.struct(*named(*docs.columns)).alias("row"), F.col(text_col).alias("body"))
    found = scan(packed, benchmark, "row", "body", **options)
    return found.where(F.size("spans") == 0).select("row.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of `scan` for every row of `documents` against all of `benchmark`; nulls, repeats and empty tables as there."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for `op9_decontaminate`: a join of every window of every item with every place of every document."""
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least({WINDOW}, len(ws)) AS n FROM (SELECT item_id, {words} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(ws[i + 1:i + n], ' ') AS key FROM (SELECT *, unnest(range(0, len(ws) - n + 1)) AS i FROM b)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
p AS (SELECT r, i, n, array_to_string(ws[i + 1:i + n], ' ') AS key FROM (SELECT r, ws, n, unnest(range(0, greatest(len(ws) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM win))),
h AS MATERIALIZED (SELECT r, i, n, item FROM p JOIN win USING (n, key)),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
o AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN o USING (r)"""


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The rows of `op9_decontaminate`, from every window of every item at every place; for tests."""
    out = []
    lists = [(str(i), words_of(t.encode() if t else b"")) for i, t in items]
    for doc, text in docs:
        words = words_of(text.encode() if text else b"")
        hit, owners = set(), set()
        for item, ws in lists:
            n = min(window, len(ws))
            for k in range(len(ws) - n + 1) if n else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == ws[k : k + n]:
                        hit.update(range(at, at + n))
                        owners.add(item)
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(owners), digest, bool(hit)))
    return out
