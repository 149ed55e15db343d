"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) and look-alike
signs and digits inside words to Latin letters, so that `1d10t` reads `idiot`; what
stands between white space is cut at other signs, and letters that stand alone or in
twos between such cuts are put together, so that `i.d.i.o.t` reads `idiot` too. This
is the same for chunks of every length. Lexicon entries are words (bounded on both
sides) or stems (bounded on the left). Places covered by an exception phrase don't
count. The score is logistic in two figures: the weight of all hits over the square
root of the number of words, and the logarithm of that weight.

Weights are log odds from a bounded sample of labelled rows (`sample`, dealt by a
hash of the id). Counting is distributed; what comes to the driver are the entries
that reach a support and a purity in this sample, so the sample bounds them."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_map, cut, named, rows, schema_of, table

SAMPLE = 16_000
PREFIXES = (3, 4, 5, 6, 7)
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "idiot proof", "clown fish", "stupid simple")
#: Words that count before anything is learned; learned weights take their place.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown")
SEED_WEIGHT = 3.0

_HOMOGLYPHS = dict(zip("аеорсухікмтвнѕјһԁԛԝɡαορνικτυχςеёıℓ", "aeopcyxikmtbhsjhdqwgaopviktuxceeil")) | {
    chr(0xFF21 + k): chr(97 + k) for k in range(26)
} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
_SIGNS = str.maketrans("0134578@$!|", "oleastbasil")
_LETTERS = {ord(k): v for k, v in _HOMOGLYPHS.items()} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0xAD, 0x2060, 0xFEFF])


#: Where a chunk is cut: signs that stand for no letter.
_CUT = regex.compile(r"[^\p{L}\p{M}\p{N}@$!|]+")
#: Signs that only part words; around a word they need no cutting.
_EDGE = ".,;:?!\"'()[]{}<>*#%&-_/\\~`^+="
#: Pieces of so few letters are put together with their neighbours of the same kind.
SPELT = 2
FOLDS = 100_000


def fold_piece(piece: str) -> str:
    """A piece of a chunk with look-alikes inside it folded; digits alone stay, signs alone go."""
    bare = piece.strip("!")
    if not bare.isalpha():
        if not any(c.isalpha() for c in bare):
            return "".join(c for c in bare if c.isalnum())
        # a one stands for i between consonants more often than for l
        bare = "".join(c for c in bare.replace("1", "i").translate(_SIGNS) if c.isalpha())
    return bare


def fold_chunk(chunk: str) -> str:
    """The folded words of a lower-case chunk without white space, joined by a space."""
    bare = chunk.strip(_EDGE)
    if bare.isascii() and bare.isalpha():
        return bare
    words: list[str] = []
    spelt = False  # whether the last word may go on
    for piece in _CUT.split(chunk if chunk.isascii() else chunk.translate(_LETTERS)):
        if word := fold_piece(piece):
            short = len(word) <= SPELT and word.isalpha()
            if short and spelt:
                words[-1] += word
            else:
                words.append(word)
            spelt = short
    return " ".join(words)


class _Folds(dict):
    """Folded words by chunk, bounded; it changes no result."""

    def __missing__(self, chunk: str) -> str:
        got = fold_chunk(chunk)
        if len(chunk) <= 64:
            if len(self) >= FOLDS:
                self.clear()
            self[chunk] = got
        return got


_folds = _Folds()


def fold(text: str | None) -> tuple[str, int]:
    """The folded words of a text with one space before and after each, and their number."""
    folded = " ".join(w for w in map(_folds.__getitem__, text.lower().split()) if w) if text else ""
    return f" {folded} ", folded.count(" ") + 1 if folded else 0


@dataclass
class Lexicon:
    """Entries: ` word ` or ` stem`, with weights; bias and factors of the logistic score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    factors: tuple[float, float, float] = (-3.0, 2.0, 2.0)
    _matcher: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    def matcher(self):
        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._matcher.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._matcher.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._matcher.make_automaton()
        return self._matcher

    def hits(self, folded: str) -> tuple[float, int]:
        """Weight and number of hits; of entries that start at one place the longest counts."""
        if not len(self.matcher()):
            return 0.0, 0
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.matcher().iter(folded):
            start = end + 1 - size
            if weight is None:
                free.append((start, end))
            else:
                best[start] = (size, weight)  # ends ascend: the longest comes last
        if free:  # where a free phrase ends, by where it starts: of those that start before a hit the furthest end decides
            starts, reach = [a for a, _ in sorted(free)], list(accumulate((b for _, b in sorted(free)), max))
            best = {s: x for s, x in best.items() if not (k := bisect_right(starts, s)) or reach[k - 1] <= s}
        return sum(w for _, w in best.values()), len(best)

    def figures(self, text: str | None) -> tuple[float, float]:
        folded, n = fold(text)
        weight, _ = self.hits(folded)
        weight = max(weight, 0.0)
        return weight / math.sqrt(n + 1), math.log1p(weight)

    def score(self, text: str | None) -> float:
        x, y = self.figures(text)
        z = self.factors[0] + self.factors[1] * x + self.factors[2] * y
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _features(text: str | None) -> Counter:
    """How often each candidate entry occurs: every word, every stem of `PREFIXES` letters."""
    words = Counter(fold(text)[0].split())
    out = Counter({f" {w} ": k for w, k in words.items()})
    for n in PREFIXES:
        for w, k in words.items():
            if len(w) >= n:
                out[f" {w[:n]}"] += k
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, support: int = 6,
) -> Lexicon:
    """Lexicon from documents joined with `labels` (id, label), at most `sample` labelled ids.

    Rows with null ids or labels, and rows that are held out, are left aside. Where an id
    repeats, its largest label and its smallest text count. With no toxic row in the
    sample, an empty table among them, the seed words stay."""
    usable = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = usable.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows_ = rows_.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows_ = cut(rows_.select("text", "label").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, ...] = Counter(), Counter(), Counter()  # toxic, toxic with two or more, clean documents

        def flush() -> pa.RecordBatch:
            names = list(set().union(*sums))
            got = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x[f] for f in names], pa.int64()) for x in sums)], ["f", "t", "t2", "c"])
            for x in sums:
                x.clear()
            return got

        for batch in batches:
            for text, label in zip(rows(batch, "text"), rows(batch, "label")):
                found = _features(text)
                if label:
                    sums[0].update(found.keys())
                    sums[1].update(f for f, k in found.items() if k > 1)
                else:
                    sums[2].update(found.keys())
            if sum(map(len, sums)) > 150_000:
                yield flush()
        yield flush()

    n = {r[0]: r[1] for r in rows_.groupBy(F.col("label") != 0).count().collect()}
    n_tox, n_clean = n.get(True, 0), n.get(False, 0)
    seeds = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS}
    if not n_tox:
        return Lexicon(seeds)
    counted = rows_.mapInArrow(count, "f string, t bigint, t2 bigint, c bigint").groupBy("f").agg(*(F.sum(x).alias(x) for x in ("t", "t2", "c")))
    # an entry that few documents speak for weighs little: near copies of one toxic document share its rare words
    odds = F.log((F.col("t") + 0.5) / (n_tox + 1)) - F.log((F.col("c") + 1.0) / (n_clean + 2))
    # chance alone gives rare entries to few toxic documents, but hardly ever twice to each of them
    enough = (F.col("t") >= support) | (F.col("t2") >= (support + 1) // 2)
    pure = counted.where(enough & (F.col("c") * 20 <= F.col("t"))).withColumn("w", odds)
    weights = {r[0]: float(r[1]) for r in pure.select("f", "w").orderBy("f").collect()}
    # A word or longer stem below a stem says nothing more.
    stems = {f for f in weights if not f.endswith(" ")}
    weights = {f: w for f, w in weights.items() if not any(f[:i] in stems for i in range(2, len(f)))}
    lexicon = Lexicon({f: w for f, w in seeds.items() if not any(f[:i] in weights for i in range(2, len(f)))} | weights)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batch: pa.RecordBatch) -> dict:
        x = [shared.value.figures(t) for t in rows(batch, "text")]
        return {"label": batch.column(batch.schema.get_field_index("label")), "x": [a for a, _ in x], "y": [b for _, b in x]}

    got = sorted(arrow_map(rows_, measure, "label int, x double, y double").collect())  # `sample` rows at most, in one order
    lexicon.factors = _fit(np.array([[1.0, r[1], r[2]] for r in got]), np.array([float(r[0] != 0) for r in got]))
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression with a little shrinkage, by Newton steps; both classes weigh as they are."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.array([0.0, 1, 1]) * len(y)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from `threshold`); one narrow pass.

    Null, empty and wordless texts score as texts without hits; repeated rows are
    scored each; a column named like a new one is replaced; an empty table stays empty."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column(0), "score": [shared.value.score(t) for t in rows(batch, "body")]}

    body = docs.select(F.struct(*named(*kept)).alias("row") if kept else F.struct(F.lit(0)).alias("row"), F.col(text_col).alias("body"))
    found = arrow_map(body, run, schema_of("score double", row=body.schema["row"].dataType))
    return found.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score lies below `threshold`, with all their columns, whatever these are called; one narrow pass.

    Null, empty and wordless texts score as texts without hits; repeated rows are judged each.
    Python gets the texts, once, and gives back scores; the rows stay with Spark, which may spill them."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return docs.where(scores(*named(text_col)) < threshold)


def train(spark: SparkSession, sf_dir: str, **options) -> Lexicon:
    return learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **options)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`; the lexicon is learned from rows that are not held out.

    Null, empty and wordless texts score as texts without hits; repeated ids give a row each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = train(spark, sf_dir)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": [shared.value.score(t) for t in rows(batch, "text")]}

    found = arrow_map(docs, run, "doc_id bigint, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def in_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
