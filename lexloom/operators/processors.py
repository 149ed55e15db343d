"""Post-processors: encodings of one or two sequences in, the same with special tokens laid around them out."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from lexloom.errors import ConfigError
from lexloom.functions.chars import byte_alphabet, is_space
from lexloom.operators.encoding import Encoding

_SPACE = byte_alphabet()[0x20]


class Processor:
    """Joins sequences; sequence and type are the position of each."""

    def added(self, pair: bool) -> int:
        return 0

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        for k, e in enumerate(parts):
            e.set_sequence(k)
            e.set_types(k)
        return parts

    def specials(self) -> dict[str, list[int]]:
        return {}


def join(parts: list[Encoding]) -> Encoding:
    return reduce(lambda a, b: a.extended(b), parts) if parts else Encoding()


def _special(tokens: list[tuple[str, int]], type_id: int) -> Encoding:
    e = Encoding.of_tokens([(i, t, (0, 0)) for t, i in tokens], type_id)
    e.special_tokens_mask = [1] * len(e)
    return e


def _around(part: Encoding, head: list, tail: list, type_id: int) -> Encoding:
    """One sequence and its overflow between special tokens."""
    own = part.window(0, len(part))
    own.ranges = dict(part.ranges)
    own.set_types(type_id)
    out = join([x for x in (_special(head, type_id), own, _special(tail, type_id)) if len(x) or x is own])
    out.overflowing = [_around(o, head, tail, type_id) for o in part.overflowing]
    return out


class Bert(Processor):
    def __init__(self, sep: tuple[str, int], cls: tuple[str, int]) -> None:
        self.sep, self.cls = tuple(sep), tuple(cls)

    def added(self, pair: bool) -> int:
        return 3 if pair else 2

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        parts = super().process(parts, special)
        if not special:
            return parts
        return [_around(p, [] if k else [self.cls], [self.sep], k) for k, p in enumerate(parts)]

    def specials(self) -> dict[str, list[int]]:
        return {self.sep[0]: [self.sep[1]], self.cls[0]: [self.cls[1]]}


class Roberta(Bert):
    def __init__(self, sep: tuple[str, int], cls: tuple[str, int], trim: bool = True, add_prefix_space: bool = True) -> None:
        super().__init__(sep, cls)
        self.trim, self.add_prefix_space = trim, add_prefix_space

    def added(self, pair: bool) -> int:
        return 4 if pair else 2

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        for k, p in enumerate(parts):
            if self.trim:
                trim_offsets(p, self.add_prefix_space)
            p.set_sequence(k)
            p.set_types(0)
        if not special:
            return parts
        return [_around(p, [self.sep] if k else [self.cls], [self.sep], 0) for k, p in enumerate(parts)]


def trim_offsets(e: Encoding, add_prefix_space: bool) -> None:
    """Take white space at either end of a token off its range; a lone prefix space at the start stays counted."""
    blank = lambda c: c == _SPACE or is_space(c)
    out = []
    for k, (token, (a, b)) in enumerate(zip(e.tokens, e.offsets)):
        lead = next((i for i, c in enumerate(token) if not blank(c)), len(token))
        tail = next((i for i, c in enumerate(reversed(token)) if not blank(c)), len(token))
        if lead or tail:
            if lead:
                if lead == 1 and add_prefix_space and (k == 0 or a == 0):
                    lead = 0
                a = min(a + lead, b)
            if tail and b >= tail:
                b = max(b - tail, a)
        out.append((a, b))
    e.offsets = out
    for o in e.overflowing:
        trim_offsets(o, add_prefix_space)


class ByteLevelTrim(Processor):
    def __init__(self, trim: bool = True, add_prefix_space: bool = True) -> None:
        self.trim, self.add_prefix_space = trim, add_prefix_space

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        for k, p in enumerate(parts):
            if self.trim:
                trim_offsets(p, self.add_prefix_space)
            p.ranges = {}
            p.set_sequence(k)
        return parts


class Template(Processor):
    def __init__(self, single: list[dict], pair: list[dict], tokens: dict[str, dict]) -> None:
        self.single, self.pair, self.tokens = single, pair, tokens
        names = lambda pieces: [p["Sequence"]["id"] for p in pieces if "Sequence" in p]
        if not single or not pair:
            raise ConfigError("a template has pieces")
        if "B" in names(single):
            raise ConfigError("the template of one sequence uses B")
        if {"A", "B"} - set(names(pair)):
            raise ConfigError("the template of two sequences needs A and B")
        missing = {p["SpecialToken"]["id"] for p in [*single, *pair] if "SpecialToken" in p} - tokens.keys()
        if missing:
            raise ConfigError(f"special tokens {sorted(missing)} are not defined")

    @classmethod
    def of(cls, single: str | list[str], pair: str | list[str], specials: list[tuple[str, int]]) -> Template:
        """From `[CLS] $A [SEP]` notation: $A, $B, $n (a type), and :n for the type of any piece."""
        return cls(_pieces(single), _pieces(pair), {t: {"id": t, "ids": [i], "tokens": [t]} for t, i in specials})

    def added(self, pair: bool) -> int:
        return sum(len(self.tokens[p["SpecialToken"]["id"]]["ids"]) for p in (self.pair if pair else self.single) if "SpecialToken" in p)

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        return self._apply(parts, special)

    def _apply(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        out = []
        for piece in self.pair if len(parts) == 2 else self.single:
            if "Sequence" in piece:
                k = "AB".index(piece["Sequence"]["id"])
                e = parts[k]
                e.set_types(piece["Sequence"]["type_id"])
                e.set_sequence(k)
                out.append(e)
            elif special:
                token = self.tokens[piece["SpecialToken"]["id"]]
                out.append(_special(list(zip(token["tokens"], token["ids"])), piece["SpecialToken"]["type_id"]))
        # Each side's overflow gets the whole layout too, which the pairing of `extended` does piece by piece.
        return out

    def specials(self) -> dict[str, list[int]]:
        return {t: x["ids"] for k in self.tokens.values() for t, x in [(k["id"], k)]}


def _pieces(template: str | list[str]) -> list[dict]:
    out = []
    for word in template.split() if isinstance(template, str) else template:
        body, colon, kind = word.rpartition(":") if re.search(r":\d+$", word) else (word, "", "")
        if body.startswith("$"):
            name = body[1:]
            if name.isdigit():
                name, kind = "A", name
            name = name.upper() or "A"
            if name not in ("A", "B"):
                raise ConfigError(f"bad piece {word!r}")
            out.append({"Sequence": {"id": name, "type_id": int(kind or 0)}})
        else:
            out.append({"SpecialToken": {"id": body, "type_id": int(kind or 0)}})
    return out


class Chain(Processor):
    def __init__(self, steps: list[Processor]) -> None:
        self.steps = steps

    def added(self, pair: bool) -> int:
        return sum(s.added(pair) for s in self.steps)

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]:
        for s in self.steps:
            parts = s.process(parts, special)
        return parts


def around(processor: Processor | None) -> tuple[list[int], list[int]] | None:
    """The special ids before and after a single sequence, or None if that can't be told in advance."""
    if processor is None or type(processor) in (Processor, ByteLevelTrim):
        return [], []
    if isinstance(processor, Bert):
        return [processor.cls[1]], [processor.sep[1]]
    if isinstance(processor, Template):
        at = [k for k, p in enumerate(processor.single) if "Sequence" in p]
        if len(at) == 1:
            ids = [processor.tokens[p["SpecialToken"]["id"]]["ids"] if "SpecialToken" in p else [] for p in processor.single]
            return [i for x in ids[: at[0]] for i in x], [i for x in ids[at[0] :] for i in x]
    return None


def build(spec: dict | None) -> Processor | None:
    if spec is None:
        return None
    makers: dict[str, Callable[[], Processor]] = {
        "BertProcessing": lambda: Bert(spec["sep"], spec["cls"]),
        "RobertaProcessing": lambda: Roberta(spec["sep"], spec["cls"], spec.get("trim_offsets", True), spec.get("add_prefix_space", True)),
        "ByteLevel": lambda: ByteLevelTrim(spec.get("trim_offsets", True), spec.get("add_prefix_space", True)),
        "TemplateProcessing": lambda: Template(spec["single"], spec["pair"], spec.get("special_tokens", {})),
        "Sequence": lambda: Chain([build(s) for s in spec["processors"]]),
    }
    if spec.get("type") not in makers:
        raise ConfigError(f"unknown post-processor {spec.get('type')!r}")
    return makers[spec["type"]]()
