"""Encodings: columns of equal length, with overflow, truncation, merging and padding."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from lexloom.errors import PaddingError, TruncationError

COLUMNS = ("ids", "tokens", "offsets", "type_ids", "word_ids", "special_tokens_mask", "attention_mask")


@dataclass
class Encoding:
    ids: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    offsets: list[tuple[int, int]] = field(default_factory=list)
    type_ids: list[int] = field(default_factory=list)
    word_ids: list[int | None] = field(default_factory=list)
    special_tokens_mask: list[int] = field(default_factory=list)
    attention_mask: list[int] = field(default_factory=list)
    ranges: dict[int, tuple[int, int]] = field(default_factory=dict)
    overflowing: list[Encoding] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.ids)

    def push(self, i: int, token: str, offset: tuple[int, int], word: int | None, type_id: int) -> None:
        self.ids.append(i)
        self.tokens.append(token)
        self.offsets.append(offset)
        self.type_ids.append(type_id)
        self.word_ids.append(word)
        self.special_tokens_mask.append(0)  # a special token typed in a text is no added one
        self.attention_mask.append(1)

    @classmethod
    def of_tokens(cls, tokens: list[tuple[int, str, tuple[int, int]]], type_id: int = 0) -> Encoding:
        out = cls()
        for i, token, offset in tokens:
            out.push(i, token, offset, None, type_id)
        return out

    def window(self, a: int, b: int) -> Encoding:
        return Encoding(*(getattr(self, c)[a:b] for c in COLUMNS), dict(self.ranges) if (a, b) == (0, len(self)) else {})

    def truncate(self, most: int, stride: int = 0, direction: str = "right") -> None:
        """Keep the first window of `most` tokens; the others, `stride` tokens of overlap each, become overflow."""
        n = len(self)
        if most >= n:
            return
        if most == 0:
            whole = replace(self, overflowing=[])
            self.__dict__.update(Encoding(overflowing=[whole]).__dict__)
            return
        if stride >= most:
            raise TruncationError("the stride must be less than the length kept")
        step, spans = most - stride, []
        if direction == "right":
            for a in range(0, n, step):
                spans.append((a, min(a + most, n)))
                if spans[-1][1] == n:
                    break
        else:
            for b in range(n, 0, -step):
                spans.append((max(0, b - most), b))
                if spans[-1][0] == 0:
                    break
        first, *rest = (self.window(a, b) for a, b in spans)
        self.__dict__.update((first if not rest else replace(first, overflowing=rest)).__dict__)

    def set_sequence(self, number: int) -> None:
        self.ranges[number] = (0, len(self))
        for o in self.overflowing:
            o.set_sequence(number)

    def set_types(self, type_id: int) -> None:
        self.type_ids = [type_id] * len(self)
        for o in self.overflowing:
            o.set_types(type_id)

    def extended(self, other: Encoding, growing: bool = False) -> Encoding:
        """This encoding, then `other`. Every part of one side's overflow meets the other side and each part of its
        overflow; what is joined so may carry overflow again."""
        columns = {c: getattr(self, c) + getattr(other, c) for c in COLUMNS}
        if growing and self.offsets:
            by = self.offsets[-1][1]
            columns["offsets"] = self.offsets + [(a + by, b + by) for a, b in other.offsets]
        ranges = self.ranges | {k: (a + len(self), b + len(self)) for k, (a, b) in other.ranges.items()}
        others = other.overflowing
        overflow = [o.extended(p, growing) for o in self.overflowing for p in (other, *others)]
        overflow += [self.extended(p, growing) for p in others]
        return Encoding(**columns, ranges=ranges, overflowing=overflow)

    def pad(self, size: int, pad_id: int = 0, pad_type: int = 0, pad_token: str = "[PAD]", direction: str = "right") -> None:
        for o in self.overflowing:
            o.pad(size, pad_id, pad_type, pad_token, direction)
        n = size - len(self)
        if n <= 0:
            return
        fill = {"ids": pad_id, "tokens": pad_token, "offsets": (0, 0), "type_ids": pad_type, "word_ids": None, "special_tokens_mask": 1, "attention_mask": 0}
        for c, v in fill.items():
            own = getattr(self, c)
            setattr(self, c, own + [v] * n if direction == "right" else [v] * n + own)
        if direction == "left":
            self.ranges = {k: (a + n, b + n) for k, (a, b) in self.ranges.items()}

    # What an encoding can tell.

    def n_sequences(self) -> int:
        return max(1, len(self.ranges))

    def sequence_range(self, number: int) -> tuple[int, int]:
        return self.ranges.get(number, (0, len(self)))

    def sequence_ids(self) -> list[int | None]:
        out: list[int | None] = [None] * len(self)
        for k in range(self.n_sequences()):
            a, b = self.sequence_range(k)
            out[a:b] = [k] * (b - a)
        return out

    def token_to_sequence(self, token: int) -> int | None:
        if token >= len(self):
            return None
        if not self.ranges:
            return 0
        return next((k for k, (a, b) in self.ranges.items() if a <= token < b), None)

    def word_to_tokens(self, word: int, sequence: int = 0) -> tuple[int, int] | None:
        a, b = self.sequence_range(sequence)
        own = [i for i in range(a, b) if self.word_ids[i] == word]
        return (own[0], own[-1] + 1) if own else None

    def word_to_chars(self, word: int, sequence: int = 0) -> tuple[int, int] | None:
        own = self.word_to_tokens(word, sequence)
        return own and (self.offsets[own[0]][0], self.offsets[own[1] - 1][1])

    def token_to_chars(self, token: int) -> tuple[int, tuple[int, int]] | None:
        s = self.token_to_sequence(token)
        return None if s is None else (s, self.offsets[token])

    def token_to_word(self, token: int) -> tuple[int, int] | None:
        s = self.token_to_sequence(token)
        return None if s is None or self.word_ids[token] is None else (s, self.word_ids[token])

    def char_to_token(self, at: int, sequence: int = 0) -> int | None:
        a, b = self.sequence_range(sequence)
        return next((i for i in range(a, b) if self.offsets[i][0] <= at < self.offsets[i][1]), None)

    def char_to_word(self, at: int, sequence: int = 0) -> int | None:
        t = self.char_to_token(at, sequence)
        return None if t is None else self.word_ids[t]


@dataclass(frozen=True)
class Truncation:
    max_length: int = 512
    strategy: str = "LongestFirst"
    stride: int = 0
    direction: str = "Right"


@dataclass(frozen=True)
class Padding:
    strategy: object = "BatchLongest"
    direction: str = "Right"
    pad_to_multiple_of: int | None = None
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"


def shares(n: int, m: int | None, most: int, strategy: str) -> tuple[int, int | None]:
    """Lengths that the first and the second sequence keep of a budget."""
    total = n + (m or 0)
    if most == 0:
        return 0, None if m is None else 0
    if total <= most:
        return n, m
    if strategy == "LongestFirst":
        if m is None:
            return most, None
        low, high = min(n, m), max(n, m)
        high = low if low > most else max(low, most - low)
        if low + high > most:
            low, high = most // 2, most // 2 + most % 2
        return (low, high) if n <= m else (high, low)
    own = n if strategy == "OnlyFirst" else m
    if own is None:
        raise TruncationError("OnlySecond needs a second sequence")
    if own <= total - most:
        raise TruncationError("the sequence to cut is too short to make room")
    return (n - (total - most), m) if strategy == "OnlyFirst" else (n, m - (total - most))


def truncate(first: Encoding, second: Encoding | None, how: Truncation, most: int) -> None:
    a, b = shares(len(first), None if second is None else len(second), most, how.strategy)
    for e, size in ((first, a), (second, b)):
        if e is not None and size < len(e):
            if size and how.stride >= size:
                raise TruncationError("the stride must be less than the length kept")
            e.truncate(size, how.stride, how.direction.lower())


def pad_all(batch: list[Encoding], how: Padding) -> None:
    """Pad a batch to one length; overflow is padded along but doesn't set the length."""
    if not batch:
        return
    if isinstance(how.strategy, dict):
        size = how.strategy["Fixed"]
    elif how.strategy == "BatchLongest":
        size = max(map(len, batch))
    else:
        raise PaddingError(f"unknown padding strategy {how.strategy!r}")
    if (k := how.pad_to_multiple_of) and size % k:
        size += k - size % k
    for e in batch:
        e.pad(size, how.pad_id, how.pad_type_id, how.pad_token, how.direction.lower())
