"""Encodings of many texts at once, in arrays.

Where pieces of a text are ranges of its characters, one for one, the model is asked once
for each piece that isn't known yet; ids, tokens and offsets of all texts are then gathered
by index. What can't be told so (other normalizers, overflow of pairs, padding,
components of one's own) is left to the aligned kernel: `of` is None, or a call raises
`Unfit`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex

from lexloom.functions import plain
from lexloom.functions.chars import is_space, utf8_size
from lexloom.functions.patterns import compiled, cuts_of, pieces
from lexloom.operators import models, normalizers, pretokenizers, processors
from lexloom.plans.tokenizer import Tokenizer

#: Characters and tokens of pieces that are kept, some 100 bytes each at most.
KNOWN = 600_000
Spans = Callable[[str], list[tuple[int, int]]]


#: What `\\s` matches, by code point; nothing beyond.
_BLANK = np.array([compiled(r"\s").match(chr(n)) is not None for n in range(0x3001)])


class Unfit(Exception):
    """These texts need the kernel."""


def _found(pattern: regex.Pattern) -> Spans:
    return lambda t: [m.span() for m in pattern.finditer(t)]


def _spans(spec: dict | None) -> Spans | None:
    """The ranges of a splitter's pieces; None where pieces aren't ranges of the text."""
    if spec is None:
        return lambda t: [(0, len(t))]
    kind = spec.get("type") if isinstance(spec, dict) else ""
    if kind == "Whitespace":
        return _found(compiled(pretokenizers.WORD_OR_SIGNS))
    if kind == "WhitespaceSplit":
        return _found(compiled(r"\S+"))
    if kind == "BertPreTokenizer":
        return _found(compiled(rf"[{plain._SIGNS}]|[^\s{plain._SIGNS}]+"))
    if kind == "ByteLevel":
        words = compiled(pretokenizers.WORDS)
        return _found(words) if spec.get("use_regex", True) else _spans(None)
    if kind == "Split":
        what, behavior, invert = pretokenizers.pattern_of(spec), spec["behavior"], spec.get("invert", False)
        return lambda t: pieces(cuts_of(what, t), behavior, invert)
    return None


def _layout(processor: processors.Processor | None, pair: bool, special: bool) -> list[tuple] | None:
    """What a row consists of: (sequence, its type), and (None, type, tokens, ids) for special tokens."""
    n = 2 if pair else 1
    if type(processor) in (type(None), processors.Processor, processors.ByteLevelTrim):
        return [(k, k) for k in range(n)]
    if isinstance(processor, processors.Bert):
        roberta, out = isinstance(processor, processors.Roberta), []
        for k in range(n):
            kind = 0 if roberta else k
            head = ([processor.sep] if roberta else []) if k else [processor.cls]
            around = [(None, kind, [t for t, _ in x], [i for _, i in x]) for x in (head, [processor.sep])]
            out += [around[0], (k, kind), around[1]] if special else [(k, kind)]
        return out
    if type(processor) is processors.Template:
        out = []
        for p in processor.pair if pair else processor.single:
            if "Sequence" in p:
                out.append(("AB".index(p["Sequence"]["id"]), p["Sequence"]["type_id"]))
            elif special:
                token = processor.tokens[p["SpecialToken"]["id"]]
                out.append((None, p["SpecialToken"]["type_id"], token["tokens"], token["ids"]))
        return out if sorted(x[0] for x in out if x[0] is not None) == list(range(n)) else None
    return None


def _words(spec: dict | None) -> tuple[Callable[[str], list[str]], bool] | None:
    """Pieces as strings, where they cover a text but for white space, or (False) all of it; their places follow from their sizes."""
    kind = spec and spec.get("type")
    if kind in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return plain.splitter(spec), True
    if kind == "ByteLevel" and spec.get("use_regex", True):
        return compiled(pretokenizers.WORDS).findall, False
    return None


class _Known(dict):
    """Pieces by number; their tokens lie one after the other in arrays. A piece is a string, or (id, characters) of an added token."""

    def __init__(self, t: Tokenizer, byte_level: bool, trims: bool) -> None:
        self.t, self.byte_level, self.trims = t, byte_level, trims
        self._start()

    def _start(self) -> None:
        self.clear()
        self.cost, self.sizes, self.new = 0, [], ([], [], [], [])
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.starts, self.ends = (np.zeros(0, np.int64) for _ in range(3))
        self.tokens = pa.array([], pa.string())
        self.lead, self.tail = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blanks: dict[str, tuple[int, int]] = {}

    def __missing__(self, piece: str | tuple[int, int]) -> int:
        ids, tokens, starts, ends = self.new
        before = len(ids)
        if isinstance(piece, tuple):
            found, owner = [(piece[0], self.t.added.by_id[piece[0]].content, 0, piece[1])], None
            self.cost += 2
        else:
            found = self.t.model.split(plain.byte_level(piece) if self.byte_level else piece)
            owner = [k for k, c in enumerate(piece) for _ in range(utf8_size(c))] if self.byte_level and not piece.isascii() else None
            self.cost += len(piece) + len(found)
        for i, token, a, b in found:
            if a == b:
                raise Unfit
            ids.append(i)
            tokens.append(token)
            starts.append(owner[a] if owner else a)
            ends.append(owner[b - 1] + 1 if owner else b)
        self.sizes.append(len(ids) - before)
        self[piece] = at = len(self)
        return at

    def settle(self) -> None:
        """New entries go into the arrays."""
        if self.sizes:
            ids, tokens, starts, ends = self.new
            count = np.array(self.sizes, np.int64)
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.ids = np.concatenate((self.ids, np.array(ids, np.int64)))
            self.starts = np.concatenate((self.starts, np.array(starts, np.int64)))
            self.ends = np.concatenate((self.ends, np.array(ends, np.int64)))
            self.tokens = pa.concat_arrays([self.tokens, pa.array(tokens, pa.string())])
            if self.trims:
                lead, tail = zip(*map(self._blank, tokens)) if tokens else ((), ())
                self.lead = np.concatenate((self.lead, np.array(lead, np.int64)))
                self.tail = np.concatenate((self.tail, np.array(tail, np.int64)))
            self.sizes, self.new = [], ([], [], [], [])

    def _blank(self, token: str) -> tuple[int, int]:
        """How many characters of white space stand at either end of a token."""
        got = self.blanks.get(token)
        if got is None:
            test = lambda c: c == processors._SPACE or is_space(c)
            lead = next((i for i, c in enumerate(token) if not test(c)), len(token))
            got = self.blanks[token] = lead, next((i for i, c in enumerate(reversed(token)) if not test(c)), len(token))
        return got

    def fresh(self) -> None:
        if self.cost > KNOWN:
            self._start()


@dataclass
class _Flat:
    """Tokens of many texts: `at` names a token of a known piece, `ends` where each text's tokens end."""

    at: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    words: np.ndarray
    ends: np.ndarray


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of many ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Flat:
    """Encodings of a tokenizer as Arrow columns."""

    def __init__(self, t: Tokenizer, split: Spans, byte_level: bool) -> None:
        self.t, self.split, self.byte_level = t, split, byte_level
        self.words = _words(t.specs["pre_tokenizer"])
        self.normal = plain.normalizer(t.specs["normalizer"]) if t.specs["normalizer"] is not None else None
        prefix = byte_level and t.specs["pre_tokenizer"].get("add_prefix_space", True)
        self.prefix = bool(prefix)
        self.added = [m for m in (t.added._raw, t.added._norm) if m is not None]
        own = t.processor
        trims = isinstance(own, (processors.Roberta, processors.ByteLevelTrim)) and own.trim
        self.trim = own if trims else None
        self.known = _Known(t, byte_level, trims)

    def _part(self, text: str, base: int, keys: list, starts: list) -> None:
        if self.prefix and not text.startswith(" "):
            raise Unfit
        found = [(a, b) for a, b in self.split(text) if b > a]
        keys += [text[a:b] for a, b in found]
        starts += [base + a for a, _ in found]

    def _normal(self, text: str) -> str:
        if self.normal is None:
            return text
        out = self.normal(text)
        if len(out) != len(text):
            raise Unfit
        return out

    def _unit(self, text: str, keys: list, starts: list, whole: list) -> None:
        """Pieces of a text and where they start; of one that `words` cuts only the pieces, with its place noted in `whole`."""
        if not text:
            return
        if not (self.added and any(m[0].search(text) for m in self.added)) and not (self.added and self.normal):
            text = self._normal(text)
            if self.words is None or self.prefix:
                self._part(text, 0, keys, starts)
                return
            found = self.words[0](text)
            whole.append((len(keys), len(found), text))
            keys += found
            starts += [0] * len(found)
            return
        added = self.t.added
        for i, a, b in added.matches(text, added._raw):
            if i is not None:
                keys.append((i, b - a))
                starts.append(a)
                continue
            part = self._normal(text[a:b])
            for j, c, d in added.matches(part, added._norm):
                if j is not None:
                    keys.append((j, d - c))
                    starts.append(a + c)
                else:
                    self._part(part[c:d], a + c, keys, starts)

    def _placed(self, starts: np.ndarray, keys: list, whole: list) -> None:
        """Starts of the pieces of `whole` texts: in these every character but white space is in one piece."""
        counts = np.array([n for _, n, _ in whole], np.int64)
        own = _ranges(np.array([k for k, _, _ in whole], np.int64), counts)
        lengths = np.array(list(map(len, [k for a, n, _ in whole for k in keys[a : a + n]])), np.int64)
        place = np.cumsum(lengths) - lengths
        if self.words[1]:
            code = np.frombuffer("".join(t for _, _, t in whole).encode("utf-32-le", "surrogatepass"), np.uint32)
            shown = np.flatnonzero(~_BLANK[np.minimum(code, len(_BLANK) - 1)] | (code >= len(_BLANK)))
            if len(shown) != int(lengths.sum()):
                raise Unfit
            place = shown[place]
        sizes = np.array([len(t) for _, _, t in whole], np.int64)
        starts[own] = place - np.repeat(np.cumsum(sizes) - sizes, counts)

    def _sequence(self, texts: list, byte_offsets: bool) -> _Flat:
        keys: list = []
        starts: list[int] = []
        whole: list[tuple[int, int, str]] = []
        units, n_units, bounds, word, n_words = [], [], [0], [], []
        for text in texts:
            listed = not isinstance(text, str)
            before = len(keys)
            for k, unit in enumerate(text if listed else (text,)):
                size = len(keys)
                self._unit(unit, keys, starts, whole)
                n_units.append(len(keys) - size)
                units.append(unit)
                if listed:
                    word += [k] * (len(keys) - size)
            if not listed:
                n_words.append(len(keys) - before)
            bounds.append(len(keys))
        if word and n_words:
            raise Unfit
        number = np.array(list(map(self.known.__getitem__, keys)), np.int64)
        self.known.settle()
        counts = self.known.count[number] if len(number) else number
        at = _ranges(self.known.first[number], counts) if len(number) else number
        sizes = np.diff(np.array(bounds, np.int64))
        words = np.array(word, np.int64) if word else _ranges(np.zeros(len(sizes), np.int64), sizes)
        begins = np.array(starts, np.int64)
        if whole:
            self._placed(begins, keys, whole)
        base = np.repeat(begins, counts)
        first, stop = self.known.starts[at] + base, self.known.ends[at] + base
        if byte_offsets and not all(map(str.isascii, units)):
            code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))))
            lengths = np.array(list(map(len, units)), np.int64)
            unit = np.repeat(np.repeat(np.cumsum(lengths) - lengths, np.array(n_units, np.int64)), counts)
            first, stop = place[first + unit] - place[unit], place[stop + unit] - place[unit]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.array(bounds)][1:]
        flat = _Flat(at, first, stop, np.repeat(words, counts), ends)
        if self.trim is not None:
            self._trimmed(flat)
        return flat

    def _trimmed(self, flat: _Flat) -> None:
        """As `processors.trim_offsets`: white space at a token's ends is taken off its range."""
        lead, tail = self.known.lead[flat.at], self.known.tail[flat.at]
        if self.trim.add_prefix_space:
            opening = np.zeros(len(flat.at), bool)
            begins = np.concatenate(([0], flat.ends[:-1]))
            opening[begins[begins < flat.ends]] = True
            lead = np.where((lead == 1) & (opening | (flat.starts == 0)), 0, lead)
        flat.starts = np.minimum(flat.starts + lead, flat.stops)
        cut = (tail > 0) & (flat.stops >= tail)
        flat.stops = np.where(cut, np.maximum(flat.stops - tail, flat.starts), flat.stops)

    def _windows(self, sizes: np.ndarray, most: int, stride: int, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, part, start and stop of each window of texts of so many tokens."""
        step = most - stride
        n = np.where(sizes > most, -(-(sizes - most) // step) + 1, 1)
        row = np.repeat(np.arange(len(sizes)), n)
        part = _ranges(np.zeros(len(n), np.int64), n)
        size = sizes[row]
        if left:
            stop = size - part * step
            return row, part, np.maximum(stop - most, 0), stop
        start = part * step
        return row, part, start, np.minimum(start + most, size)

    def columns(self, texts: list, seconds: list | None, special: bool, offsets: str, overflow: bool, wanted: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """The text of each row, and the `wanted` columns of its encoding."""
        t, how = self.t, self.t.truncation
        layout = _layout(t.processor, seconds is not None, special)
        if layout is None or how is not None and seconds is not None:
            raise Unfit
        self.known.fresh()
        sides = [self._sequence(texts, offsets == "byte")] + ([self._sequence(seconds, offsets == "byte")] if seconds is not None else [])
        begins = [np.concatenate(([0], s.ends[:-1])) for s in sides]
        sizes = [s.ends - b for s, b in zip(sides, begins)]
        row = np.arange(len(texts))
        part, spans = np.zeros(len(texts), np.int64), [(np.zeros(len(texts), np.int64), n) for n in sizes]
        if how is not None:
            room = how.max_length - (t.processor.added(False) if special and t.processor else 0)
            if how.strategy == "OnlySecond" or room < 1 or how.stride >= room:
                raise Unfit
            row, part, start, stop = self._windows(sizes[0], room, how.stride, how.direction.lower() == "left")
            if not overflow:
                row, start, stop, part = (x[part == 0] for x in (row, start, stop, part))
            spans = [(start, stop)]
        # one pool of the tokens of either side and of special ones; a row is a list of ranges of it
        shift, size = [], 0
        for s in sides:
            shift.append(size)
            size += len(s.at)
        froms, counts, kinds, own, sequence = [], [], [], [], []
        extra_ids, extra_tokens = [], []
        for x in layout:
            if x[0] is None:
                froms.append(np.full(len(row), size + len(extra_ids)))
                counts.append(np.full(len(row), len(x[3])))
                extra_ids += x[3]
                extra_tokens += x[2]
            else:
                a, b = spans[x[0]]
                froms.append(shift[x[0]] + begins[x[0]][row] + a)
                counts.append(b - a)
            kinds.append(x[1])
            own.append(x[0] is None)
            sequence.append(-1 if x[0] is None else x[0])
        flat_counts = np.stack(counts, 1).ravel()
        index = _ranges(np.stack(froms, 1).ravel(), flat_counts)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.stack(counts, 1).sum(1)))), pa.int32())
        by_segment = lambda values: np.repeat(np.tile(np.array(values, np.int32), len(row)), flat_counts)
        pool = lambda field, fill: np.concatenate([*(getattr(s, field) for s in sides), np.full(len(extra_ids), fill, np.int64)])[index]
        listed = lambda values: pa.ListArray.from_arrays(ends, values)
        known = np.concatenate((self.known.ids, np.array(extra_ids, np.int64)))
        at = np.concatenate([*(s.at for s in sides), len(self.known.ids) + np.arange(len(extra_ids))]).astype(np.int64)[index]
        n = len(index)

        def made(c: str) -> pa.Array:
            if c == "path":
                return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(part > 0))), pa.int32()), pa.array((part[part > 0] - 1).astype(np.int32)))
            if c == "error":
                return pa.nulls(len(row), pa.string())
            if c == "ids":
                return listed(pa.array(known[at]))
            if c == "tokens":
                return listed(pa.concat_arrays([self.known.tokens, pa.array(extra_tokens, pa.string())]).take(pa.array(at)))
            if c == "offsets":
                sides_ = [pa.array(pool(f, 0).astype(np.int32)) for f in ("starts", "stops")]
                return listed(pa.StructArray.from_arrays(sides_, ["start", "end"]))
            if c == "word_ids":
                words = pool("words", -1).astype(np.int32)
                return listed(pa.array(words, mask=words < 0))
            if c == "sequence_ids":
                ks = by_segment(sequence)
                return listed(pa.array(ks, mask=ks < 0))
            values = {"type_ids": lambda: by_segment(kinds), "special_tokens_mask": lambda: by_segment(own), "attention_mask": lambda: np.ones(n, np.int32)}
            return listed(pa.array(values[c]()))

        return row, {c: made(c) for c in wanted}


def of(t: Tokenizer) -> Flat | None:
    """The arrays' way of a tokenizer; None where the kernel is needed."""
    specs = t.specs
    normal = specs["normalizer"]
    if any(v is not None and not isinstance(v, dict) for v in specs.values()) or not isinstance(t.model, models.Model) or t.model.random or t.padding:
        return None
    if normal is not None and normalizers.untagged(normal)["type"] != "Lowercase":
        return None
    split = _spans(specs["pre_tokenizer"])
    if split is None:
        return None
    byte_level = specs["pre_tokenizer"] is not None and specs["pre_tokenizer"]["type"] == "ByteLevel"
    return Flat(t, split, byte_level)
