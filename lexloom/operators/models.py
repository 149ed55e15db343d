"""Models: one word in, tokens (id, text, first character, end character) out.

A token may hold part of a character's bytes (byte fallback); it then has the
character's whole range, and `bytes_of` tells which bytes it holds."""

from __future__ import annotations

import heapq
import math
import random
from collections import defaultdict

from lexloom.errors import ConfigError, ModelError

Token = tuple[int, str, int, int]
CACHE = 100_000


class Model:
    """What all models share: the vocabulary both ways, and a bounded cache of whole words."""

    kind = ""
    random = False

    def __init__(self, vocab: dict[str, int]) -> None:
        self.vocab = dict(vocab)
        self.reverse: dict[int, str] = {}
        for token in sorted(vocab, reverse=True):  # of tokens with one id the smallest stays
            self.reverse[vocab[token]] = token
        self._cache: dict[str, list[Token]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def tokenize(self, word: str) -> list[Token]:
        got = self._cache.get(word)
        if got is None:
            got = self.split(word)
            if not self.random and len(word) < 256:
                if len(self._cache) >= CACHE:
                    self._cache.clear()
                self._cache[word] = got
        return got

    def split(self, word: str) -> list[Token]:
        raise NotImplementedError

    def ids(self, word: str) -> list[int]:
        """The ids of `split`, for those who need nothing else."""
        return [t[0] for t in self.split(word)]

    def _id(self, token: str) -> int:
        if token not in self.vocab:
            raise ModelError(f"the unknown token {token!r} is not in the vocabulary")
        return self.vocab[token]


class WordLevel(Model):
    kind = "WordLevel"

    def __init__(self, vocab: dict[str, int], unk_token: str = "<unk>") -> None:
        super().__init__(vocab)
        self.unk_token = unk_token

    def split(self, word: str) -> list[Token]:
        i = self.vocab.get(word)
        return [(i, word, 0, len(word))] if i is not None else [(self._id(self.unk_token), self.unk_token, 0, len(word))]

    def spec(self) -> dict:
        return {"type": self.kind, "vocab": _by_id(self.vocab), "unk_token": self.unk_token}


class WordPiece(Model):
    kind = "WordPiece"

    def __init__(self, vocab: dict[str, int], unk_token: str = "[UNK]", prefix: str = "##", most: int = 100) -> None:
        super().__init__(vocab)
        self.unk_token, self.prefix, self.most = unk_token, prefix, most
        self.longest = max(map(len, vocab), default=0)

    @classmethod
    def from_bpe(cls, bpe: BPE) -> WordPiece:
        return cls(bpe.vocab, bpe.unk_token or "[UNK]", bpe.prefix or "##")

    def split(self, word: str) -> list[Token]:
        if len(word) > self.most:
            return [(self._id(self.unk_token), self.unk_token, 0, len(word))]
        out, at = [], 0
        while at < len(word):
            lead = self.prefix if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                if (i := self.vocab.get(lead + word[at:end])) is not None:
                    out.append((i, lead + word[at:end], at, end))
                    break
            else:
                return [(self._id(self.unk_token), self.unk_token, 0, len(word))]
            at = end
        return out

    def ids(self, word: str) -> list[int]:
        get, n, lead, out, at = self.vocab.get, len(word), "", [], 0
        if n > self.most:
            return [self._id(self.unk_token)]
        while at < n:
            end = min(n, at + self.longest)
            while end > at and (i := get(lead + word[at:end])) is None:
                end -= 1
            if end == at:
                return [self._id(self.unk_token)]
            out.append(i)
            at, lead = end, self.prefix
        return out

    def spec(self) -> dict:
        return {"type": self.kind, "unk_token": self.unk_token, "continuing_subword_prefix": self.prefix, "max_input_chars_per_word": self.most, "vocab": _by_id(self.vocab)}


class BPE(Model):
    kind = "BPE"

    def __init__(
        self, vocab: dict[str, int], merges: list[tuple[str, str]], unk_token: str | None = None, prefix: str | None = None, suffix: str | None = None,
        dropout: float | None = None, fuse_unk: bool = False, byte_fallback: bool = False, ignore_merges: bool = False, seed: int | None = None,
    ) -> None:
        super().__init__(vocab)
        if dropout is not None and not 0 <= dropout <= 1:
            raise ConfigError("dropout lies between 0 and 1")
        self.unk_token, self.prefix, self.suffix = unk_token, prefix or "", suffix or ""
        self.dropout, self.fuse_unk, self.byte_fallback, self.ignore_merges = dropout or 0.0, fuse_unk, byte_fallback, ignore_merges
        self.random = self.dropout > 0
        self.rng = random.Random(seed)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        last = {tuple(m): k for k, m in enumerate(merges)}  # a pair that comes again counts where it comes last
        for (a, b), rank in sorted(last.items(), key=lambda x: x[1]):
            joint = a + (b[len(self.prefix) :] if self.prefix and b.startswith(self.prefix) else b)
            missing = [t for t in (a, b, joint) if t not in vocab]
            if missing:
                raise ConfigError(f"merge ({a!r}, {b!r}) needs {missing[0]!r}, which is not in the vocabulary")
            self.merges[vocab[a], vocab[b]] = rank, vocab[joint]

    def split(self, word: str) -> list[Token]:
        if not word:
            return []
        if self.ignore_merges and not self.random and word in self.vocab:
            return [(self.vocab[word], word, 0, len(word))]
        return [(i, self.reverse[i], a, b) for i, a, b in self._merge(self._symbols(word))]

    def ids(self, word: str) -> list[int]:
        if self.random or self.prefix or not word or len(word) > 64 or self.ignore_merges and word in self.vocab:
            return [t[0] for t in self.split(word)]
        get, merges = self.vocab.get, self.merges.get
        parts = [get(c) for c in word[:-1]] + [get(word[-1] + self.suffix)]
        if None in parts:
            return [t[0] for t in self.split(word)]
        while len(parts) > 1:  # the pair of least rank, of equal ones the first
            found = [m for m in map(merges, zip(parts, parts[1:])) if m is not None]
            if not found:
                break
            best = min(found)
            for at in range(len(parts) - 1):
                if merges((parts[at], parts[at + 1])) == best:
                    parts[at : at + 2] = [best[1]]
                    break
        return parts

    def _symbols(self, word: str) -> list[list[int]]:
        out: list[list[int]] = []
        unknown: list[int] | None = None
        for k, c in enumerate(word):
            s = (self.prefix if k else "") + c + (self.suffix if k == len(word) - 1 else "")
            i = self.vocab.get(s)
            if i is None and self.byte_fallback:
                codes = [self.vocab.get(f"<0x{b:02X}>") for b in s.encode()]
                if None not in codes:
                    if unknown:
                        out.append(unknown)
                        unknown = None
                    out += [[code, k, k + 1] for code in codes]
                    continue
            if i is not None:
                if unknown:
                    out.append(unknown)
                    unknown = None
                out.append([i, k, k + 1])
            elif self.unk_token:
                if unknown and self.fuse_unk:
                    unknown[2] = k + 1
                else:
                    if unknown:
                        out.append(unknown)
                    unknown = [self._id(self.unk_token), k, k + 1]
        if unknown:
            out.append(unknown)
        return out

    def _merge(self, symbols: list[list[int]]) -> list[list[int]]:
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        alive = [True] * n
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := self.merges.get((symbols[i][0], symbols[j][0]))):
                heapq.heappush(queue, (m[0], i, m[1]))

        for i in range(n - 1):
            offer(i)
        skipped = []
        while queue:
            rank, i, joint = heapq.heappop(queue)
            if self.dropout and self.rng.random() < self.dropout:
                skipped.append((rank, i, joint))
                continue
            for x in skipped:
                heapq.heappush(queue, x)
            skipped.clear()
            j = after[i] if alive[i] else -1
            if j < 0 or self.merges.get((symbols[i][0], symbols[j][0])) != (rank, joint):
                continue
            symbols[i] = [joint, symbols[i][1], symbols[j][2]]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive) if a]

    def spec(self) -> dict:
        ranked = sorted((rank, pair) for pair, (rank, _) in self.merges.items())
        return {
            "type": self.kind, "dropout": self.dropout or None, "unk_token": self.unk_token, "continuing_subword_prefix": self.prefix or None,
            "end_of_word_suffix": self.suffix or None, "fuse_unk": self.fuse_unk, "byte_fallback": self.byte_fallback, "ignore_merges": self.ignore_merges,
            "vocab": _by_id(self.vocab), "merges": [[self.reverse[a], self.reverse[b]] for _, (a, b) in ranked],
        }


def _by_id(vocab: dict[str, int]) -> dict[str, int]:
    return dict(sorted(vocab.items(), key=lambda x: (x[1], x[0])))


UNKNOWN_PENALTY = 10.0


class Unigram(Model):
    kind = "Unigram"

    def __init__(
        self, pieces: list[tuple[str, float]], unk_id: int | None = None, byte_fallback: bool = False, fuse_unk: bool = True,
        nbest_size: int = 0, alpha: float = 0.0, seed: int | None = None,
    ) -> None:
        if unk_id is not None and not 0 <= unk_id < len(pieces):
            raise ConfigError("the unknown id is out of range" if pieces else "an empty vocabulary has no unknown id")
        if any(not math.isfinite(s) for _, s in pieces):
            raise ConfigError("scores must be finite")
        if not math.isfinite(alpha) or alpha < 0:
            raise ConfigError("alpha must be finite and not negative")
        super().__init__({p: i for i, (p, _) in reversed(list(enumerate(pieces)))})
        self.pieces, self.unk_id, self.byte_fallback, self.fuse_unk = [(p, float(s)) for p, s in pieces], unk_id, byte_fallback, fuse_unk
        self.least = min((s for _, s in pieces), default=0.0)
        self.by_text = {p: (i, s) for i, (p, s) in enumerate(self.pieces)}
        self.longest = max((len(p) for p, _ in pieces), default=0)
        self.nbest_size, self.alpha, self.seed = nbest_size, alpha, seed
        self.random = alpha > 0 and (nbest_size < 0 or nbest_size > 1)
        # a lookup stops where no piece goes on
        self.prefixes = {p[:k] for p, _ in pieces for k in range(1, len(p) + 1)}

    def matches(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(end, id, score) of every piece at a place; where none is one character long, the unknown piece."""
        out, single = [], False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in self.prefixes:
                break
            found = self.by_text.get(part)
            if found:
                out.append((end, *found))
                single |= end == at + 1
        if not single and self.unk_id is not None:
            out.append((at + 1, self.unk_id, self.least - UNKNOWN_PENALTY))
        return out

    def best(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the best path; of equal ones the path found first."""
        n = len(text)
        score, back = [-math.inf] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            if score[at] == -math.inf:
                continue
            for end, i, s in self.matches(text, at):
                if score[at] + s > score[end]:
                    score[end], back[end] = score[at] + s, (at, end, i)
        if n and back[n] is None:
            raise ModelError(f"no segmentation of {text!r}: the vocabulary has no unknown piece")
        out, at = [], n
        while at:
            out.append(back[at])
            at = back[at][0]
        return out[::-1]

    def split(self, word: str) -> list[Token]:
        if not word:
            return []
        path = self.sample(word) if self.random else self.best(word)
        out: list[Token] = []
        run: tuple[int, int] | None = None
        for a, b, i in [*path, (len(word), len(word), -1)]:
            if i == self.unk_id and self.fuse_unk:
                run = (run[0], b) if run else (a, b)
                continue
            if run:
                out += self._tokens(word, *run)
                run = None
            if i >= 0:
                out += self._tokens(word, a, b)
        return out

    def ids(self, word: str) -> list[int]:
        if self.random or not word:
            return [t[0] for t in self.split(word)]
        n, longest, prefixes, by_text = len(word), self.longest, self.prefixes, self.by_text
        low, none = self.least - UNKNOWN_PENALTY, -math.inf
        score, back = [none] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            base = score[at]
            if base == none:
                continue
            single = False
            for end in range(at + 1, min(n, at + longest) + 1):
                part = word[at:end]
                if part not in prefixes:
                    break
                found = by_text.get(part)
                if found is not None:
                    single |= end == at + 1
                    if base + found[1] > score[end]:
                        score[end], back[end] = base + found[1], (at, found[0])
            if not single:
                if self.unk_id is None:
                    return [t[0] for t in self.split(word)]
                if base + low > score[at + 1]:
                    score[at + 1], back[at + 1] = base + low, (at, self.unk_id)
        out, at = [], n
        while at:
            at, i = back[at]
            out.append(i)
        if self.unk_id in out:
            return [t[0] for t in self.split(word)]
        return out[::-1]

    def _tokens(self, word: str, a: int, b: int) -> list[Token]:
        part = word[a:b]
        if part in self.by_text:
            return [(self.by_text[part][0], part, a, b)]
        if self.byte_fallback:
            names = [f"<0x{x:02X}>" for x in part.encode()]
            if all(x in self.by_text for x in names):
                return [(self.by_text[x][0], x, a, b) for x in names]
        if self.unk_id is None:
            raise ModelError(f"{part!r} is unknown and there is no unknown piece")
        return [(self.unk_id, part, a, b)]

    def nbest(self, text: str, n: int) -> list[list[tuple[int, int, int]]]:
        """The n best paths, best first: exact search backwards from the end, guided by the best score of each prefix."""
        size = len(text)
        ends: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        front = [-math.inf] * (size + 1)
        front[0] = 0.0
        for at in range(size):
            if front[at] > -math.inf:
                for end, i, s in self.matches(text, at):
                    ends[end].append((at, i, s))
                    front[end] = max(front[end], front[at] + s)
        if size and front[size] == -math.inf:
            return []
        out, order = [], 0
        queue: list = [(-front[size], 0, size, 0.0, None)]
        while queue and len(out) < n:
            _, _, at, behind, path = heapq.heappop(queue)
            if not at:
                steps = []
                while path:
                    step, path = path
                    steps.append(step)
                out.append(steps)
                continue
            for start, i, s in ends[at]:
                order += 1
                heapq.heappush(queue, (-(front[start] + s + behind), order, start, behind + s, ((start, at, i), path)))
            if len(queue) > 100_000:
                queue = heapq.nsmallest(min(512, 10 * n), queue)
        return out

    def path_score(self, path: list[tuple[int, int, int]]) -> float:
        return sum(self.least - UNKNOWN_PENALTY if i == self.unk_id else self.pieces[i][1] for _, _, i in path)

    def sample(self, text: str) -> list[tuple[int, int, int]]:
        """One path, drawn by the seed and the text alone."""
        rng = random.Random(None if self.seed is None else f"{self.seed}:{text}")
        if self.nbest_size > 1:
            paths = self.nbest(text, self.nbest_size)
            scores = [self.alpha * self.path_score(p) for p in paths]
            top = max(scores)
            return rng.choices(paths, [math.exp(s - top) for s in scores])[0]
        n = len(text)
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        ends: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for at in range(n):
            for end, i, s in self.matches(text, at):
                ends[end].append((at, i, self.alpha * s))
                forward[end] = _log_add(forward[end], forward[at] + self.alpha * s)
        out, at = [], n
        while at:
            options = [(a, at, i) for a, i, _ in ends[at] if forward[a] > -math.inf]
            weights = [math.exp(forward[a] + s - forward[at]) for a, _, s in ends[at] if forward[a] > -math.inf]
            step = rng.choices(options, weights)[0]
            out.append(step)
            at = step[0]
        return out[::-1]

    def marginals(self, text: str, weight: float, expected: list[float]) -> float:
        """Add the expected count of each piece in `text` to `expected`; the weighted log likelihood."""
        n = len(text)
        forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        forward[0] = backward[n] = 0.0
        arcs = [(at, *m) for at in range(n) for m in self.matches(text, at)]
        for at, end, _, s in arcs:
            forward[end] = _log_add(forward[end], forward[at] + s)
        for at, end, _, s in reversed(arcs):
            backward[at] = _log_add(backward[at], backward[end] + s)
        whole = forward[n]
        for at, end, i, s in arcs:
            x = forward[at] + s + backward[end] - whole
            if x > -700:
                expected[i] += weight * math.exp(x)
        return weight * whole

    def spec(self) -> dict:
        return {"type": self.kind, "unk_id": self.unk_id, "vocab": [list(p) for p in self.pieces], "byte_fallback": self.byte_fallback}


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf or a - b > 50 else a + math.log1p(math.exp(b - a))


def build(spec: dict) -> Model:
    """From the JSON form; an object without a type is told by its fields."""
    kind = spec.get("type")
    if kind is None:
        kind = "Unigram" if isinstance(spec.get("vocab"), list) else "BPE" if "merges" in spec else "WordPiece" if "max_input_chars_per_word" in spec or "continuing_subword_prefix" in spec else "WordLevel"
    if "vocab" not in spec:
        raise ConfigError("the model has no vocabulary")
    if kind == "BPE":
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec.get("merges", [])]
        if any(len(m) != 2 for m in merges):
            raise ConfigError("a merge has two parts")
        return BPE(
            spec["vocab"], merges, spec.get("unk_token"), spec.get("continuing_subword_prefix"), spec.get("end_of_word_suffix"), spec.get("dropout"),
            spec.get("fuse_unk") or False, spec.get("byte_fallback") or False, spec.get("ignore_merges") or False,
        )
    if kind == "WordPiece":
        return WordPiece(spec["vocab"], spec.get("unk_token", "[UNK]"), spec.get("continuing_subword_prefix", "##"), spec.get("max_input_chars_per_word", 100))
    if kind == "WordLevel":
        return WordLevel(spec["vocab"], spec.get("unk_token", "<unk>"))
    if kind == "Unigram":
        return Unigram([tuple(p) for p in spec["vocab"]], spec.get("unk_id"), spec.get("byte_fallback") or False)
    raise ConfigError(f"unknown model {kind!r}")
