"""Text that remembers where it came from.

`Aligned` holds the characters of a rewritten text and, for each, the range of the
original it stands for. Ranges are in characters of the original; byte offsets are
made from them at the very end (`byte_starts`), except where a token covers part of a
character's bytes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

Span = tuple[int, int]


class Aligned:
    __slots__ = ("original", "text", "at", "shift")

    def __init__(self, original: str, text: str | None = None, at: list[Span] | None = None, shift: int = 0) -> None:
        self.original = original
        self.text = original if text is None else text
        self.at = [(i, i + 1) for i in range(len(original))] if at is None else at
        self.shift = shift

    def __len__(self) -> int:
        return len(self.text)

    def rewrite(self, marks: Iterable[tuple[str, int]], skip: int = 0) -> None:
        """Replace the whole text. Each new character has a mark: 0 stands for the next old character, 1 is put in beside
        the one before, -n stands for the next old one and swallows n more. `skip` old characters go first."""
        out, at, cursor, old = [], [], skip, self.at
        for c, mark in marks:
            if mark > 0:
                at.append(old[cursor - 1] if cursor else (0, 0))
            else:
                at.append(old[cursor])
                cursor += 1 - mark
            out.append(c)
        self.text, self.at = "".join(out), at

    def keep(self, test: Callable[[str], bool]) -> None:
        flags = [test(c) for c in self.text]
        if all(flags):
            return
        self.at = [a for a, f in zip(self.at, flags) if f]
        self.text = "".join(c for c, f in zip(self.text, flags) if f)

    def each(self, fn: Callable[[str], str]) -> None:
        """Map characters one by one; those that become several share the range of the one they come from."""
        new = [fn(c) for c in self.text]
        self.at = [a for a, n in zip(self.at, new) for _ in n]
        self.text = "".join(new)

    def prepend(self, prefix: str) -> None:
        if self.text:
            self.at = [self.at[0]] * len(prefix) + self.at
            self.text = prefix + self.text

    def append(self, suffix: str) -> None:
        if self.text:
            self.at = self.at + [self.at[-1]] * len(suffix)
            self.text += suffix

    def replace(self, spans: Iterable[Span], content: str) -> None:
        """Put `content` in place of each span; its characters stand for the last character of the span."""
        out, at, end = [], [], 0
        for a, b in spans:
            out += [self.text[end:a], content]
            at += self.at[end:a]
            last = self.at[b - 1] if b > a else self.at[a - 1] if a else (0, 0)
            at += [last] * len(content)
            end = b
        out.append(self.text[end:])
        self.at = at + self.at[end:]
        self.text = "".join(out)

    def clear(self) -> None:
        self.text, self.at = "", []

    def strip(self, left: bool, right: bool, test: Callable[[str], bool]) -> None:
        a, b = 0, len(self.text)
        while left and a < b and test(self.text[a]):
            a += 1
        while right and b > a and test(self.text[b - 1]):
            b -= 1
        self.text, self.at = self.text[a:b], self.at[a:b]

    def unicode_form(self, form: str) -> None:
        if not unicodedata.is_normalized(form, self.text):
            self.rewrite(form_marks(self.text, form))

    def slice(self, a: int, b: int) -> Aligned:
        part = Aligned.__new__(Aligned)
        part.original, part.text, part.at, part.shift = self.original, self.text[a:b], self.at[a:b], self.shift
        return part

    def original_span(self, a: int, b: int) -> Span | None:
        """Where the characters [a, b) come from; an empty range is returned as it is, an invalid one is None."""
        if a > b or b > len(self.text):
            return None
        return (a, b) if a == b else (self.at[a][0], self.at[b - 1][1])


def form_marks(text: str, form: str) -> list[tuple[str, int]]:
    """The characters of a Unicode form with the marks that `Aligned.rewrite` takes."""
    out: list[list] = []
    for c in text:
        parts = unicodedata.normalize("NFKD" if "K" in form else "NFD", c)
        out += [[p, int(i > 0)] for i, p in enumerate(parts)]
    i = 0
    while i < len(out):  # canonical order: runs of combining characters by class, stable
        j = i
        while j < len(out) and unicodedata.combining(out[j][0]):
            j += 1
        if j - i > 1:
            # marks stay in place, so that old characters are used up in their order
            run = sorted(out[i:j], key=lambda x: unicodedata.combining(x[0]))
            marks = [m for _, m in out[i:j]]
            out[i:j] = [[c, m] for (c, _), m in zip(run, marks)]
        i = max(j, i + 1)
    if form.endswith("C"):
        out = _composed(out)
    return [tuple(x) for x in out]


def _composed(chars: list[list]) -> list[list]:
    out: list[list] = []
    starter = -1
    last_class = -1
    for c, mark in chars:
        klass = unicodedata.combining(c)
        if starter >= 0 and (last_class < klass or last_class == -1):
            both = unicodedata.normalize("NFC", out[starter][0] + c)
            if len(both) == 1:
                out[starter] = [both, out[starter][1] + mark - 1]
                continue
        if klass == 0:
            starter, last_class = len(out), -1
        else:
            last_class = klass
        out.append([c, mark])
    return out


def byte_starts(text: str) -> list[int]:
    """The byte offset of each character of a text, and its size."""
    if text.isascii():
        return list(range(len(text) + 1))
    out, at = [0], 0
    for c in text:
        n = ord(c)
        at += 1 if n < 0x80 else 2 if n < 0x800 else 3 if n < 0x10000 else 4
        out.append(at)
    return out
