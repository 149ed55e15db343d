"""Added tokens: texts that are cut out before and after normalizing and never reach the model."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import regex

from lexloom.errors import ConfigError
from lexloom.functions.align import Aligned
from lexloom.functions.chars import is_space

_WORD = regex.compile(r"\w")


@dataclass(frozen=True)
class AddedToken:
    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True
    special: bool = False

    @classmethod
    def plain(cls, content: str, special: bool = False, **flags) -> AddedToken:
        return cls(content, special=special, **({"normalized": not special} | flags))


class AddedVocabulary:
    """Tokens by id, and one longest-first matcher for raw and one for normalized text."""

    def __init__(self) -> None:
        self.by_id: dict[int, AddedToken] = {}
        self.ids: dict[str, int] = {}
        self.encode_special_tokens = False
        self._shown: dict[int, str] = {}
        self._raw = self._norm = None

    def __len__(self) -> int:
        return len(self.by_id)

    def specials(self) -> set[str]:
        return {t.content for t in self.by_id.values() if t.special}

    def add(self, tokens: list[AddedToken], model, normalizer=None) -> int:
        """Give each new text an id: its known one, else one above all in use. How many were added."""
        added = 0
        for t in tokens:
            if not t.content or self.by_id.get(self.ids.get(t.content, -1)) == t:
                continue
            i = self.ids.get(t.content)
            if i is None:
                i = model.vocab.get(t.content)
            if i is None:
                i = max([*model.vocab.values(), *self.by_id], default=-1) + 1
            self._insert(i, t)
            added += 1
        self.refresh(normalizer)
        return added

    def load(self, tokens: list[tuple[int, AddedToken]], model, normalizer=None) -> None:
        seen: dict[int, str] = {}
        for i, t in tokens:
            if not t.content:
                continue
            if seen.setdefault(i, t.content) != t.content:
                raise ConfigError(f"two added tokens have the id {i}")
            if model.reverse.get(i, t.content) != t.content:
                raise ConfigError(f"the model uses the id {i} of {t.content!r} for another token")
            self._insert(i, t)
        self.refresh(normalizer)

    def _insert(self, i: int, t: AddedToken) -> None:
        old = self.by_id.get(i)
        if old is not None and old.content != t.content:
            self.ids.pop(old.content, None)
        before = self.ids.get(t.content)
        if before is not None and before != i:
            self.by_id.pop(before, None)
        self.by_id[i] = t
        self.ids[t.content] = i

    def refresh(self, normalizer) -> None:
        raw: dict[str, int] = {}
        norm: dict[str, int] = {}
        self._shown = {}
        for i, t in sorted(self.by_id.items()):
            if t.normalized and normalizer is not None:
                text = Aligned(t.content)
                normalizer(text)
                if text.text:
                    norm[text.text] = i
                    self._shown[i] = text.text
            elif t.normalized:
                norm[t.content] = i
            else:
                raw[t.content] = i
        self._raw, self._norm = map(_matcher, (raw, norm))

    def matches(self, text: str, matcher) -> list[tuple[int | None, int, int]]:
        """A partition of `text`: (id or None, start, end)."""
        out: list[tuple[int | None, int, int]] = []
        end = 0
        if matcher is not None:
            expression, ids = matcher
            for m in expression.finditer(text):
                i = ids[m[0]]
                t = self.by_id[i]
                a, b = m.span()
                if self.encode_special_tokens and t.special:
                    continue
                if t.single_word and (a and _WORD.match(text[a - 1]) or b < len(text) and _WORD.match(text[b])):
                    continue
                while t.lstrip and a > end and is_space(text[a - 1]):
                    a -= 1
                while t.rstrip and b < len(text) and is_space(text[b]):
                    b += 1
                a = max(a, end)
                if a > end:
                    out.append((None, end, a))
                if b > a:
                    out.append((i, a, b))
                    end = b
        if end < len(text):
            out.append((None, end, len(text)))
        return out

    def extract(self, text: str, normalizer=None) -> list[tuple[int | None, Aligned]]:
        """Pieces of a text: added tokens with their id, the rest normalized piece by piece."""
        whole, out = Aligned(text), []
        for i, a, b in self.matches(text, self._raw):
            part = whole.slice(a, b)
            if i is not None:
                out.append((i, part))
                continue
            if normalizer is not None:
                normalizer(part)
            out += [(j, part.slice(c, d)) for j, c, d in self.matches(part.text, self._norm)]
        return out

    def shown(self, i: int) -> str | None:
        """The text by which decoding knows a token: normalized, where the token is."""
        t = self.by_id.get(i)
        return None if t is None else self._shown.get(i, t.content)

    def spec(self) -> list[dict]:
        return [{"id": i} | asdict(t) for i, t in sorted(self.by_id.items())]


def _matcher(texts: dict[str, int]):
    if not texts:
        return None
    ordered = sorted(texts, key=lambda t: (-len(t), t))
    return regex.compile("|".join(map(regex.escape, ordered))), texts
