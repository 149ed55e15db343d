"""Unigram training in arrays: lattices of many texts at once.

A lattice has a node before each character of a text and one behind the last; an arc is
a place where a piece stands. Arcs are found once, for the seeds: pruning only takes
pieces away. Piece 0 stands for an unknown character; it is tried where no piece of one
character stands. Sums over texts are whole numbers of 2^-16 or of occurrences, so they
are the same whatever the order and the grouping in which they are added up."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexloom.operators.models import UNKNOWN_PENALTY

SCALE = 1 << 16
_BATCH = 20_000


def arcs_of(texts: list[str], pieces: pa.StringArray, most: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per text the starts, the ends and the pieces of its arcs (`pieces` from 1; 0 for one character that is no piece)."""
    parts, starts, ends, sizes = [], [], [], []
    for text in texts:
        n = len(text)
        at = len(parts)
        for end in range(1, n + 1):
            for start in range(max(0, end - most), end):
                parts.append(text[start:end])
                starts.append(start)
                ends.append(end)
        sizes.append(len(parts) - at)
    found = pc.fill_null(pc.index_in(pa.array(parts, pa.string()), value_set=pieces), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
    starts, ends = np.array(starts, np.int32), np.array(ends, np.int32)
    keep = (found > 0) | (ends - starts == 1)
    bounds = np.concatenate(([0], np.cumsum(keep)))[np.cumsum([0, *sizes])][1:-1] if sizes else []
    return tuple(np.split(x[keep], bounds) for x in (starts, ends, found)) if sizes else ([], [], [])


@dataclass
class Lattices:
    """Arcs of many texts, sorted by end, text and start."""

    sizes: np.ndarray  # characters of each text
    text: np.ndarray  # by arc: text, first node, last node, end in its text, piece
    first: np.ndarray
    last: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    base: np.ndarray  # first node of each text

    @classmethod
    def of(cls, sizes: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: np.ndarray) -> Lattices:
        base = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.repeat(np.arange(len(sizes)), counts)
        order = np.lexsort((starts, text, ends))
        text, starts, ends, pieces = text[order], starts[order], ends[order], pieces[order]
        return cls(sizes, text, base[text] + starts, base[text] + ends, ends, pieces, base)

    @classmethod
    def from_arrow(cls, batch: pa.RecordBatch) -> Lattices:
        lists = [batch.column(batch.schema.get_field_index(c)) for c in ("starts", "ends", "pieces")]
        counts = np.diff(lists[0].offsets.to_numpy())
        return cls.of(batch.column(batch.schema.get_field_index("size")).to_numpy().astype(np.int64), counts, *(x.flatten().to_numpy().astype(np.int64) for x in lists))

    def scored(self, scores: np.ndarray, without: np.ndarray | None = None) -> tuple[Lattices, np.ndarray]:
        """The arcs of living pieces (finite scores) and their scores; unknown ones get the least score less a penalty.

        `without` names, by text, a piece that is not to stand there."""
        value = scores[self.piece]
        single = self.last - self.first == 1
        living = np.isfinite(value) & (self.piece > 0)
        unknown = single & ~living
        if without is not None:
            living &= self.piece != without[self.text]
        value = np.where(unknown, scores[1:][np.isfinite(scores[1:])].min(initial=0.0) - UNKNOWN_PENALTY, value)
        keep = living | unknown
        piece = np.where(unknown, 0, self.piece)
        return Lattices(self.sizes, self.text[keep], self.first[keep], self.last[keep], self.end[keep], piece[keep], self.base), value[keep]

    def _slices(self) -> list[slice]:
        """Arcs by their end, in ascending order."""
        if not len(self.end):
            return []
        bounds = np.flatnonzero(np.diff(self.end)) + 1
        return [slice(a, b) for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(self.end)])]

    def expected(self, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected, in units of 1/SCALE."""
        own, value = self.scored(scores)
        n_nodes = int((self.sizes + 1).sum())
        forward, backward = np.full(n_nodes, -np.inf), np.full(n_nodes, -np.inf)
        forward[self.base] = 0.0
        goal = self.base + self.sizes
        backward[goal] = 0.0
        for s in own._slices():
            np.logaddexp.at(forward, own.last[s], forward[own.first[s]] + value[s])
        turned = np.lexsort((own.last, -(own.first - own.base[own.text])))  # by start, the last ones first
        starts = (own.first - own.base[own.text])[turned]
        for a, b in _runs(starts):
            k = turned[a:b]
            np.logaddexp.at(backward, own.first[k], backward[own.last[k]] + value[k])
        share = np.exp(forward[own.first] + value + backward[own.last] - forward[goal][own.text])
        counts = np.rint(weights[own.text] * share * SCALE).astype(np.int64)
        out = np.zeros(len(scores), np.int64)
        np.add.at(out, own.piece, counts)
        return out

    def best(self, scores: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the score of its best path, and as (text, piece) rows the pieces of these paths; of equal ones the one that starts first."""
        own, value = self.scored(scores, without)
        n_nodes = int((self.sizes + 1).sum())
        forward, back = np.full(n_nodes, -np.inf), np.full(n_nodes, -1, np.int64)
        forward[self.base] = 0.0
        for s in own._slices():
            total, node = forward[own.first[s]] + value[s], own.last[s]
            heads = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1))
            top = np.maximum.reduceat(total, heads)
            spread = np.repeat(top, np.diff(np.append(heads, len(node))))
            at = np.where((total == spread) & (spread > -np.inf), np.arange(len(node)), len(node))
            chosen = np.minimum.reduceat(at, heads)
            ok = chosen < len(node)
            forward[node[heads[ok]]] = top[ok]
            back[node[heads[ok]]] = chosen[ok] + s.start
        texts, pieces = [], []
        text, node = np.arange(len(self.sizes)), self.base + self.sizes
        while len(text):
            going = (node > self.base[text]) & (back[node] >= 0)
            text, arc = text[going], back[node[going]]
            texts.append(text)
            pieces.append(own.piece[arc])
            node = own.first[arc]
        empty = np.zeros(0, np.int64)
        return forward[self.base + self.sizes], np.concatenate([empty, *texts]), np.concatenate([empty, *pieces])


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    bounds = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return list(zip([0, *bounds], [*bounds, len(values)]))


#: What becomes of a piece when pieces are pruned: it stays, it goes, or its loss decides.
STAYS, GOES, RATED = 0, 1, 2


def judged(own: Lattices, index: np.ndarray, scores: np.ndarray, freq: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """A verdict and a loss for each of the pieces `index`, whose texts are those of `own`.

    A piece's alternative is the best path through its text without it. Taking the piece
    away turns its occurrences into ones of that path: the loss is what the log likelihood
    per occurrence of the corpus falls by. A piece of one character has no alternative and
    stays; one that is not the best path of its own text stays as long as it is used."""
    alone = own.sizes == 1
    other, text, piece = own.best(scores, index)
    better = scores[index] >= other
    f, whole = freq[index].astype(np.float64), float(freq.sum())
    members = np.bincount(text, minlength=len(index))
    with np.errstate(divide="ignore", invalid="ignore"):
        log_rest = np.log(whole + f * (members - 1))
        instead = np.bincount(text, np.log(freq[piece] + f[text]) - log_rest[text], len(index)) if len(text) else np.zeros(len(index))
        loss = f / total * (np.log(f) - math.log(whole) - instead) if whole else np.zeros(len(index))
    verdict = np.where(alone, STAYS, np.where(better, np.where(f > 0, RATED, GOES), np.where(f > 0, STAYS, GOES)))
    return verdict, np.where(verdict == RATED, loss, 0.0)


class Local:
    """A corpus of distinct words in this process."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.words = sorted(w for w in counts if w)
        self.weights = np.array([counts[w] for w in self.words], np.float64)

    def chars(self) -> dict[str, int]:
        out: Counter = Counter()
        for w, n in zip(self.words, self.weights.astype(np.int64).tolist()):
            for c in w:
                out[c] += n
        return dict(out)

    def substrings(self, most: int, limit: int) -> list[tuple[str, int]]:
        """Substrings of 2 to `most` characters that more than one character or end follows, with count times length, the largest first.

        Each distinct word counts once."""
        count: Counter = Counter()
        follows: dict[str, str] = {}
        several = set()
        for w in self.words:
            for a in range(len(w)):
                for b in range(a + 2, min(len(w), a + most) + 1):
                    part = w[a:b]
                    if "\0" in part:
                        break
                    count[part] += 1
                    c = w[b : b + 1] or "\0"
                    if follows.setdefault(part, c) != c:
                        several.add(part)
        return sorted(((p, count[p] * len(p)) for p in several), key=lambda x: (x[1], x[0]), reverse=True)[:limit]

    def prepare(self, pieces: list[str], most: int) -> None:
        table = pa.array(pieces, pa.string())
        self.lattices = [self._lattices(self.words[k : k + _BATCH], table, most) for k in range(0, len(self.words), _BATCH)]
        self.own = self._lattices(pieces, table, most)

    @staticmethod
    def _lattices(texts: list[str], table: pa.StringArray, most: int) -> Lattices:
        found = arcs_of(texts, table, most)
        flat = [np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int64) for x in found]
        return Lattices.of(np.array([len(t) for t in texts], np.int64), np.array([len(x) for x in found[0]], np.int64), *flat)

    def _each(self):
        for k, lattices in enumerate(self.lattices):
            yield lattices, self.weights[k * _BATCH : (k + 1) * _BATCH]

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return sum((x.expected(scores, w) for x, w in self._each()), np.zeros(len(scores), np.int64))

    def frequencies(self, scores: np.ndarray) -> np.ndarray:
        out = np.zeros(len(scores), np.int64)
        for x, w in self._each():
            _, text, piece = x.best(scores)
            np.add.at(out, piece, w[text].astype(np.int64))
        return out

    def total(self) -> float:
        return float(self.weights.sum())

    def judged(self, scores: np.ndarray, freq: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
        """Verdicts and losses of all seeds."""
        return judged(self.own, np.arange(1, len(scores)), scores, freq, total)


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function: psi(x) = psi(x + 1) - 1/x up to 10, then the asymptotic series in 1/x^2."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    #: B(2k) / 2k of the Bernoulli numbers.
    series = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)
    return out + np.log(x) - 1 / (2 * x) - sum(c / x ** (2 * k + 2) for k, c in enumerate(series))
