"""Character classes and byte tables with the meanings of the Unicode standard."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Property White_Space; Python's str.isspace() also takes U+001C to U+001F.
WHITE_SPACE = frozenset([*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
#: The same blocks for a Java regular expression.
CJK_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _CJK)
#: BERT punctuation for a Java regular expression: ASCII signs and categories P.
PUNCTUATION_CLASS = "\\p{P}$+<=>^`|~"


def is_space(c: str) -> bool:
    return ord(c) in WHITE_SPACE


def is_other(c: str) -> bool:
    """Control, format, private, surrogate and unassigned characters, but for tab and line ends."""
    return c not in "\t\n\r" and unicodedata.category(c)[0] == "C"


def is_cjk(c: str) -> bool:
    n = ord(c)
    return n >= 0x3400 and any(a <= n <= b for a, b in _CJK)


def is_punctuation(c: str) -> bool:
    n = ord(c)
    if n < 128:
        return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126
    return unicodedata.category(c)[0] == "P"


def is_numeric(c: str) -> bool:
    return unicodedata.category(c)[0] == "N"


@lru_cache(1)
def byte_alphabet() -> tuple[str, ...]:
    """The printable character for each byte: itself where it prints, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return tuple(out)


@lru_cache(1)
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def utf8_size(c: str) -> int:
    n = ord(c)
    return 1 if n < 0x80 else 2 if n < 0x800 else 3 if n < 0x10000 else 4
