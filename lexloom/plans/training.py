"""Training on counted words: what grows with the corpus stays on the cluster, what is a vocabulary comes to the driver.

Word-level training takes a top-k. Unigram keeps words and their lattices in a
checkpointed table; a round of training sends out the pieces' scores and brings back one
whole number a piece. Merges for BPE and WordPiece are found one after the other by
nature: words of up to `DRIVER_SYMBOLS` characters in all are merged on the driver, more
on the cluster, a job a merge, with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import trainers, unigram
from lexloom.operators.models import BPE, Model
from lexloom.plans.cluster import cut

#: Characters of distinct words that the driver takes for merging; one costs about 100 bytes there.
DRIVER_SYMBOLS = 20_000_000
#: Merges on the cluster between two checkpoints of the words.
SETTLED = 50


def model(counted: DataFrame, trainer: object, driver_symbols: int = DRIVER_SYMBOLS) -> Model:
    """The model that `trainer` makes of (word, n)."""
    if isinstance(trainer, trainers.WordLevelTrainer):  # all but the first vocab_size words stay on the cluster
        top = counted.where(F.col("n") >= trainer.min_frequency).orderBy(F.desc("n"), "word").limit(trainer.vocab_size)
        return trainer.train({r["word"]: r["n"] for r in top.collect()})
    words = cut(counted.where("word <> ''").select("word", F.col("n").cast("bigint").alias("n")))
    if isinstance(trainer, trainers.UnigramTrainer):
        return trainer.train_on(Words(words))
    size = words.agg(F.sum(F.length("word"))).first()[0] or 0
    if size <= driver_symbols or not isinstance(trainer, trainers.BpeTrainer):  # a trainer of one's own takes all counts
        return trainer.train({r["word"]: r["n"] for r in words.toLocalIterator()})
    return trainer.finished(*merged(words, trainer))


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


class Words:
    """A corpus of distinct words (word, n) on the cluster, as `UnigramTrainer.train_on` takes it."""

    def __init__(self, words: DataFrame) -> None:
        self.words = words
        self.spark = words.sparkSession

    def chars(self) -> dict[str, int]:
        """At most a row for each code point."""
        each = self.words.select(F.explode(_chars(F.col("word"))).alias("c"), "n")
        return {r["c"]: r["n"] for r in each.groupBy("c").agg(F.sum("n").alias("n")).collect()}

    def substrings(self, most: int, limit: int) -> list[tuple[str, int]]:
        """As `unigram.Local.substrings`: a count by substring with the least and the largest character that follows; `limit` rows come back."""
        chars = self.words.select(_chars(F.col("word")).alias("cs"))
        n = F.size("cs")

        def from_place(a: Column) -> Column:
            ends = F.when(a + 1 <= n - 1, F.sequence(a + 2, F.least(a + most, n))).otherwise(F.array().cast("array<int>"))
            return F.transform(ends, lambda b: F.struct(F.array_join(F.slice("cs", a + 1, b - a), "").alias("piece"), F.coalesce(F.get("cs", b), F.lit("\0")).alias("next")))

        each = chars.where(n > 1).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), from_place))).alias("x"))
        found = each.select("x.*").where(~F.contains("piece", F.lit("\0"))).groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("low"), F.max("next").alias("high"))
        weight = (F.col("n") * F.length("piece")).alias("w")
        top = found.where("low <> high").select("piece", weight).orderBy(F.desc("w"), F.desc("piece")).limit(limit)
        return [(r["piece"], r["w"]) for r in top.collect()]

    def prepare(self, pieces: list[str], most: int) -> None:
        shared = self.spark.sparkContext.broadcast(pa.array(pieces, pa.string()))

        def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    texts = part.column(0).to_numpy(zero_copy_only=False)
                    lists = [pa.array(list(x), pa.list_(pa.int32())) for x in unigram.arcs_of(texts, shared.value, most)]
                    size = pa.array([len(t) for t in texts], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(1), size, *lists], ["n", "size", "starts", "ends", "pieces"])

        schema = "n bigint, size int, starts array<int>, ends array<int>, pieces array<int>"
        self.lattices = cut(self.words.select("word", "n").mapInArrow(arcs, schema))
        numbered = self.spark.createDataFrame(list(zip(pieces, range(1, len(pieces) + 1))), "word string, n bigint")
        self.own = cut(numbered.mapInArrow(arcs, schema))
        self.n_pieces = len(pieces)

    def _sums(self, work, scores: np.ndarray) -> np.ndarray:
        """Whole numbers by piece, from `work` on each batch of lattices: partial sums where the lattices are, a row a piece in the end."""
        shared = self.spark.sparkContext.broadcast(scores)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(shared.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    work(out, unigram.Lattices.from_arrow(batch), batch.column(0).to_numpy(), shared.value)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], ["piece", "n"])

        found = self.lattices.mapInArrow(run, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
        out = np.zeros(len(scores), np.int64)
        for r in found.collect():
            out[r["piece"]] = r["n"]
        shared.destroy()
        return out

    def expected(self, scores: np.ndarray) -> np.ndarray:
        def work(out: np.ndarray, own: unigram.Lattices, weights: np.ndarray, scores: np.ndarray) -> None:
            out += own.expected(scores, weights.astype(np.float64))

        return self._sums(work, scores)

    def frequencies(self, scores: np.ndarray) -> np.ndarray:
        def work(out: np.ndarray, own: unigram.Lattices, weights: np.ndarray, scores: np.ndarray) -> None:
            _, text, piece = own.best(scores)
            np.add.at(out, piece, weights[text])

        return self._sums(work, scores)

    def total(self) -> float:
        return float(self.words.agg(F.sum("n")).first()[0] or 0)

    def judged(self, scores: np.ndarray, freq: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
        shared = self.spark.sparkContext.broadcast((scores, freq, total))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    index = batch.column(0).to_numpy()
                    verdict, loss = unigram.judged(unigram.Lattices.from_arrow(batch), index, *shared.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdict.astype(np.int32)), pa.array(loss)], ["piece", "verdict", "loss"])

        verdict, loss = np.full(self.n_pieces, unigram.GOES), np.zeros(self.n_pieces)
        for r in self.own.mapInArrow(run, "piece bigint, verdict int, loss double").collect():
            verdict[r["piece"] - 1], loss[r["piece"] - 1] = r["verdict"], r["loss"]
        shared.destroy()
        return verdict, loss


def merged(words: DataFrame, trainer: trainers.BpeTrainer) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges, with words as arrays of symbol ids on the cluster: each round counts pairs anew and merges the first."""
    chars = words.select(F.explode(_chars(F.col("word"))).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = trainer.alphabet({r["c"]: r["n"] for r in chars.collect()})
    prefix, suffix = trainer.continuing_subword_prefix, trainer.end_of_word_suffix
    first = lambda c: F.concat(F.lit(prefix), c)
    kept = F.filter(F.transform(_chars(F.col("word")), lambda c, k: F.struct(c.alias("c"), k.alias("k"))), lambda x: F.array_contains(F.lit(alphabet), x["c"]))
    last = F.size(_chars(F.col("word"))) - 1
    shown = F.transform(kept, lambda x: F.concat(F.when(x["k"] > 0, first(x["c"])).otherwise(x["c"]), F.when(x["k"] == last, F.lit(suffix)).otherwise(F.lit(""))))
    spelt = cut(words.select("word", shown.alias("symbols"), "n"))
    # ids in the order in which sorted words bring symbols up, as on the driver
    ids: dict[str, int] = {}
    for t in [*(t.content for t in trainer.special_tokens), *alphabet]:
        ids.setdefault(t, len(ids))
    seen = spelt.select("word", F.posexplode("symbols").alias("k", "s")).groupBy("s").agg(F.min(F.struct("word", "k")).alias("at"))
    for r in sorted(seen.collect(), key=lambda r: (r["at"]["word"], r["at"]["k"])):
        ids.setdefault(r["s"], len(ids))
    table = words.sparkSession.createDataFrame(list(ids.items()), "s string, id int")
    numbered = spelt.withColumn("w", F.monotonically_increasing_id())  # before symbols become rows
    placed = numbered.select("w", "n", F.posexplode("symbols").alias("k", "s")).join(F.broadcast(table), "s", "left")
    state = cut(placed.groupBy("w", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("ids")).select("ids", "n"))
    texts, lengths, merges, pending = list(ids), [1] * len(ids), [], []
    most = trainer.max_token_length
    while len(texts) < trainer.vocab_size:
        counts = state.mapInArrow(_pairs(pending, lengths, most), "a int, b int, n bigint")
        top = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if top is None or top["n"] < max(1, trainer.min_frequency):
            break
        a, b = texts[top["a"]], texts[top["b"]]
        joint = a + (b.removeprefix(prefix) if prefix else b)
        if joint not in ids:
            ids[joint] = len(texts)
            texts.append(joint)
            lengths.append(lengths[top["a"]] + lengths[top["b"]])
        merges.append((a, b))
        pending.append((top["a"], top["b"], ids[joint]))
        if len(pending) == SETTLED:  # what was merged so far is written down
            state, pending = cut(state.mapInArrow(_merged(pending), "ids array<int>, n bigint")), []
    return ids, merges


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a batch of words one after the other, the word of each, and the words' counts."""
    lists = batch.column(0)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy().copy(), np.repeat(np.arange(len(sizes)), sizes), batch.column(1).to_numpy()


def _apply(ids: np.ndarray, word: np.ndarray, pending: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words after merges, one after the other, each from the left."""
    for a, b, new in pending:
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b) & (word[:-1] == word[1:]))
        if not len(at):
            continue
        if a == b:  # of a run every second place
            opens = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(opens, np.diff(np.append(opens, len(at))))) % 2 == 0]
        ids[at] = new
        kept = np.ones(len(ids), bool)
        kept[at + 1] = False
        ids, word = ids[kept], word[kept]
    return ids, word


#: Pairs of symbols that are counted in one array of a worker; of more symbols each batch counts those that it has.
DENSE = 1 << 22


def _pairs(pending: list[tuple[int, int, int]], lengths: list[int], most: int | None):
    """Partial counts of neighbours after `pending`; none of a pair that would reach `most` characters, but for single ones."""
    pending, lengths = list(pending), np.array(lengths, np.int64)
    size = len(lengths)

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        a, b = key // size, key % size
        if most is not None:
            fits = (lengths[a] + lengths[b] < most) | (lengths[a] == 1) & (lengths[b] == 1)
            a, b, n = a[fits], b[fits], n[fits]
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(size * size, np.int64) if size * size <= DENSE else None
        for batch in batches:
            ids, word, weights = _flat(batch)
            ids, word = _apply(ids, word, pending)
            same = np.flatnonzero(word[:-1] == word[1:])
            key, n = ids[same].astype(np.int64) * size + ids[same + 1], weights[word[same]]
            if dense is not None:
                np.add.at(dense, key, n)
                continue
            key, which = np.unique(key, return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, which, n)
            yield rows(key, sums)
        if dense is not None:
            key = np.flatnonzero(dense)
            yield rows(key, dense[key])

    return run


def _merged(pending: list[tuple[int, int, int]]):
    pending = list(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word, _ = _flat(batch)
            ids, word = _apply(ids, word, pending)
            ends = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=batch.num_rows))))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), batch.column(1)], ["ids", "n"])

    return run
