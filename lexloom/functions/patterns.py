"""Matchers that cut a text into matched and unmatched spans."""

from __future__ import annotations

from collections.abc import Callable

import regex

from lexloom.errors import PatternError

Cut = tuple[int, int, bool]
BEHAVIORS = ("Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous")
#: Either one character class `\\w` and `\\s` has the Unicode meaning; white space is the property of that name.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def compiled(source: str) -> regex.Pattern:
    try:
        return regex.compile(source, regex.V0)
    except regex.error as e:
        raise PatternError(f"bad pattern {source!r}: {e}") from e


def cuts_of(pattern: object, text: str) -> list[Cut]:
    """A partition of `text`: pattern is a one-argument test of a character, a literal, a compiled expression, or an object with `spans`."""
    if hasattr(pattern, "spans") and not isinstance(pattern, (str, regex.Pattern)):
        spans = pattern.spans(text)
    elif callable(pattern) and not isinstance(pattern, regex.Pattern):
        return by_test(pattern, text)
    else:
        spans = literal_spans(pattern, text) if isinstance(pattern, str) else [m.span() for m in pattern.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        if a < end:
            raise PatternError("matches overlap")
        if not a <= b <= len(text):
            raise PatternError(f"a match from {a} to {b} doesn't fit a text of {len(text)} characters")
        if a > end:
            out.append((end, a, False))
        out.append((a, b, True))
        end = b
    if end < len(text) or not out:
        out.append((end, len(text), False))
    return out


def literal_spans(literal: str, text: str) -> list[tuple[int, int]]:
    out, at = [], text.find(literal) if literal else -1
    while at >= 0:
        out.append((at, at + len(literal)))
        at = text.find(literal, at + len(literal))
    return out


def by_test(test: Callable[[str], bool], text: str) -> list[Cut]:
    out, end = [], 0
    for i, c in enumerate(text):
        if test(c):
            if i > end:
                out.append((end, i, False))
            out.append((i, i + 1, True))
            end = i + 1
    if end < len(text) or not out:
        out.append((end, len(text), False))
    return out


def pieces(cuts: list[Cut], behavior: str, invert: bool = False) -> list[tuple[int, int]]:
    """Spans that stay after a split; empty ones are dropped."""
    marked = [(a, b, m != invert) for a, b, m in cuts]
    if behavior == "Removed":
        out = [(a, b) for a, b, m in marked if not m]
    elif behavior == "Isolated":
        out = [(a, b) for a, b, _ in marked]
    elif behavior == "Contiguous":
        out, kind = [], None
        for a, b, m in marked:
            if m is kind:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            kind = m
    elif behavior == "MergedWithPrevious":
        out, before = [], False
        for a, b, m in marked:
            if m and not before and out:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            before = m
    elif behavior == "MergedWithNext":
        out, after = [], False
        for a, b, m in reversed(marked):
            if m and not after and out:
                out[-1] = (a, out[-1][1])
            else:
                out.append((a, b))
            after = m
        out.reverse()
    else:
        raise PatternError(f"unknown behavior {behavior!r}")
    return [(a, b) for a, b in out if b > a]
