"""Normalizers: `Aligned` in, `Aligned` rewritten. `build` makes one from its JSON form."""

from __future__ import annotations

import base64
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

from lexloom.errors import ConfigError
from lexloom.functions.align import Aligned
from lexloom.functions.chars import byte_alphabet, is_cjk, is_other, is_space, utf8_size
from lexloom.functions.patterns import compiled, literal_spans

Step = Callable[[Aligned], None]

_NMT_DROP = {*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, 0x8F, 0x9F}
_NMT_SPACE = {0x9, 0xA, 0xC, 0xD, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD}
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def lowercase(t: Aligned) -> None:
    """Character by character, so no rule about the end of a word applies."""
    if "Σ" in t.text or len(low := t.text.lower()) != len(t.text):
        t.each(str.lower)
    else:
        t.text = low


def clean_text(t: Aligned) -> None:
    t.keep(lambda c: c not in "\0�" and not is_other(c))
    t.text = "".join(" " if is_space(c) else c for c in t.text)


def space_cjk(t: Aligned) -> None:
    if not t.text.isascii():
        t.rewrite([x for c in t.text for x in ([(" ", 0), (c, 1), (" ", 1)] if is_cjk(c) else [(c, 0)])])


def strip_accents(t: Aligned) -> None:
    """Decompose, then drop nonspacing marks."""
    t.unicode_form("NFD")
    t.keep(lambda c: unicodedata.category(c) != "Mn")


def drop_marks(t: Aligned) -> None:
    t.keep(lambda c: unicodedata.category(c)[0] != "M")


def nmt(t: Aligned) -> None:
    t.keep(lambda c: ord(c) not in _NMT_DROP)
    t.text = "".join(" " if ord(c) in _NMT_SPACE else c for c in t.text)


def byte_level(t: Aligned) -> None:
    shown = byte_alphabet()
    new = [[shown[b] for b in c.encode()] for c in t.text]
    t.at = [a for a, n in zip(t.at, new) for _ in n]
    t.text = "".join(c for n in new for c in n)


class Charsmap:
    """A SentencePiece double-array of replacements: the shortest rule that matches wins."""

    def __init__(self, data: bytes) -> None:
        size = struct.unpack_from("<I", data)[0] if len(data) >= 4 else -1
        if size < 0 or size % 4 or 4 + size > len(data):
            raise ConfigError("bad precompiled charsmap")
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4)
        self.texts = data[4 + size :]

    def replacement(self, chunk: bytes) -> str | None:
        units, at, n = self.units, 0, len(self.units)
        if not n:
            return None
        u = units[0]
        at ^= (u >> 10) << ((u & (1 << 9)) >> 6)
        for b in chunk:
            if not b:
                return None
            at ^= b
            if at >= n:
                return None
            u = units[at]
            if u & (1 << 31 | 0xFF) != b:
                return None
            at ^= (u >> 10) << ((u & (1 << 9)) >> 6)
            if u >> 8 & 1:
                if at >= n:
                    return None
                start = units[at] & 0x7FFFFFFF
                return self.texts[start : self.texts.find(b"\0", start)].decode("utf-8", "replace")
        return None


def charsmap_of(rules: dict[str, str]) -> str:
    """A charsmap with the given replacements, in base64: each node of the trie has a block of 256 units of its own."""
    children: list[dict[int, int]] = [{}]
    values: dict[int, int] = {}
    texts = bytearray()
    for source, target in sorted(rules.items()):
        node = 0
        for b in source.encode():
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        values[node] = len(texts)
        texts += target.encode() + b"\0"
    units = [0] * (256 * (len(children) + 1))
    base = lambda node: 256 * (node + 1)
    units[0] = base(0) << 10
    for node, own in enumerate(children):
        for b, child in own.items():
            place = base(node) ^ b
            units[place] = (place ^ base(child)) << 10 | (child in values) << 8 | b
        if node in values:
            units[base(node)] = values[node] | 1 << 31
    if base(len(children)) >= 1 << 21:
        raise ConfigError("too many replacements for one charsmap")
    return base64.b64encode(struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + bytes(texts)).decode()


@lru_cache(8)
def _charsmap(data: str) -> Charsmap:
    return Charsmap(base64.b64decode(data))


_GRAPHEME = regex.compile(r"\X")


def precompiled(data: str) -> Step:
    table = _charsmap(data)

    def run(t: Aligned) -> None:
        marks: list[tuple[str, int]] = []
        changed = False

        def put(old: str, new: str) -> None:
            grow = len(new) - len(old)
            part = [(c, 0) for c in new]
            if grow > 0:
                part[len(old) :] = [(c, 1) for c in new[len(old) :]]
            elif grow < 0 and part:
                part[-1] = (part[-1][0], grow)
            elif grow < 0 and marks:
                c, m = marks[-1]
                marks[-1] = (c, min(m, 0) + grow)
            marks.extend(part)

        for g in _GRAPHEME.findall(t.text):
            if sum(map(utf8_size, g)) < 6 and (new := table.replacement(g.encode())) is not None:
                put(g, new)
                changed = True
                continue
            for c in g:
                new = table.replacement(c.encode())
                changed |= new is not None
                put(c, c if new is None else new)
        if changed:
            t.rewrite(marks)

    return run


def bert(clean: bool = True, cjk: bool = True, accents: bool | None = None, lower: bool = True) -> Step:
    def run(t: Aligned) -> None:
        if clean:
            clean_text(t)
        if cjk:
            space_cjk(t)
        if lower if accents is None else accents:
            strip_accents(t)
        if lower:
            lowercase(t)

    return run


def replace(pattern: dict | str, content: str) -> Step:
    literal = pattern if isinstance(pattern, str) else pattern.get("String")
    expression = None if literal is not None else compiled(pattern["Regex"])

    def run(t: Aligned) -> None:
        spans = literal_spans(literal, t.text) if literal is not None else [m.span() for m in expression.finditer(t.text)]
        if spans:
            t.replace(spans, content)

    return run


def sequence(steps: list[Step]) -> Step:
    def run(t: Aligned) -> None:
        for s in steps:
            s(t)

    return run


def untagged(spec: dict) -> dict:
    """Tag a legacy object by its fields, in a fixed order of trial."""
    if "type" in spec:
        return spec
    for fields, kind in (
        (("clean_text", "handle_chinese_chars", "lowercase"), "BertNormalizer"), (("strip_left", "strip_right"), "Strip"),
        (("precompiled_charsmap",), "Precompiled"), (("normalizers",), "Sequence"), (("pattern", "content"), "Replace"), (("prepend",), "Prepend"),
    ):
        if all(f in spec for f in fields):
            return spec | {"type": kind}
    raise ConfigError(f"no normalizer has the fields {sorted(spec)}")


def build(spec: dict | None) -> Step | None:
    if spec is None:
        return None
    spec = untagged(spec)
    kind = spec["type"]
    if kind in FORMS:
        return lambda t: t.unicode_form(kind)
    if kind == "Sequence":
        return sequence([build(s) for s in spec["normalizers"]])
    if kind == "BertNormalizer":
        return bert(spec.get("clean_text", True), spec.get("handle_chinese_chars", True), spec.get("strip_accents"), spec.get("lowercase", True))
    if kind == "Strip":
        left, right = spec.get("strip_left", True), spec.get("strip_right", True)
        return lambda t: t.strip(left, right, is_space)
    if kind == "Replace":
        return replace(spec["pattern"], spec["content"])
    if kind == "Prepend":
        return lambda t: t.prepend(spec["prepend"])
    if kind == "Precompiled":
        return precompiled(spec["precompiled_charsmap"])
    simple = {"Lowercase": lowercase, "StripAccents": drop_marks, "Nmt": nmt, "ByteLevel": byte_level}
    if kind in simple:
        return simple[kind]
    raise ConfigError(f"unknown normalizer {kind!r}")


def apply(spec: dict, text: str) -> str:
    t = Aligned(text)
    build(spec)(t)
    return t.text
