"""Components as functions of strings: the same texts and words as the aligned kernel, where nobody asks for offsets.

Characters go through `str.translate` tables that are filled as they come, words through
one regular expression each. A component without such a form gives None, and the
aligned kernel does it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import regex

from lexloom.errors import ConfigError
from lexloom.functions.chars import WHITE_SPACE, byte_alphabet, is_cjk, is_other, is_space, utf8_size
from lexloom.functions.patterns import compiled, cuts_of, pieces
from lexloom.operators import normalizers, pretokenizers

TextStep = Callable[[str], str]
WordStep = Callable[[str], list[str]]
_CACHED = 200_000


class _Chars(dict):
    """A table for str.translate that asks once for each character; None drops it."""

    def __init__(self, fn: Callable[[str], str | None]) -> None:
        self.fn = fn

    def __missing__(self, code: int) -> str | None:
        got = self[code] = self.fn(chr(code))
        return got


class _Graphemes(dict):
    """What a charsmap makes of a grapheme; bounded."""

    def __init__(self, table: normalizers.Charsmap) -> None:
        self.table = table

    def __missing__(self, g: str) -> str:
        whole = self.table.replacement(g.encode()) if sum(map(utf8_size, g)) < 6 else None
        if whole is None:
            each = ((c, self.table.replacement(c.encode())) for c in g)
            whole = "".join(c if new is None else new for c, new in each)
        if len(self) >= _CACHED:
            self.clear()
        self[g] = whole
        return whole


_SPACES = "".join(map(chr, sorted(WHITE_SPACE)))
_CLEAN = _Chars(lambda c: None if c in "\0�" or is_other(c) else " " if is_space(c) else c)
_NO_NONSPACING = _Chars(lambda c: None if unicodedata.category(c) == "Mn" else c)
_NO_MARKS = _Chars(lambda c: None if unicodedata.category(c)[0] == "M" else c)
_NMT = _Chars(lambda c: None if ord(c) in normalizers._NMT_DROP else " " if ord(c) in normalizers._NMT_SPACE else c)
_CJK = _Chars(lambda c: f" {c} " if is_cjk(c) else c)
_BYTES = {b: c for b, c in enumerate(byte_alphabet())}
_GRAPHEME = regex.compile(r"\X")
#: Where graphemes can be longer than one character: signs beyond ASCII with the ASCII signs beside them, and CR LF.
_JOINED = regex.compile(r"(?:\r\n|[\x00-\x7f])?(?:[^\x00-\x7f]+(?:\r\n|[\x00-\x7f])?)+|\r\n")


def lowercase(text: str) -> str:
    """Character by character: no rule about the end of a word applies."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(_BYTES)


def _precompiled(data: str) -> TextStep:
    found = _Graphemes(normalizers._charsmap(data))
    single = _Chars(lambda c: found[c])
    whole = lambda m: "".join(map(found.__getitem__, _GRAPHEME.findall(m[0])))

    def run(text: str) -> str:
        if text.isascii() and "\r\n" not in text:
            return text.translate(single)
        out, at = [], 0
        for m in _JOINED.finditer(text):
            out += [text[at : m.start()].translate(single), whole(m)]
            at = m.end()
        return "".join([*out, text[at:].translate(single)])

    return run


def _chained(steps: list[TextStep]) -> TextStep:
    def run(text: str) -> str:
        for s in steps:
            text = s(text)
        return text

    return run


def _bert(clean: bool, cjk: bool, accents: bool | None, lower: bool) -> TextStep:
    bare = lambda t: t if t.isascii() else unicodedata.normalize("NFD", t).translate(_NO_NONSPACING)
    steps = [(lambda t: t.translate(_CLEAN), clean), (lambda t: t if t.isascii() else t.translate(_CJK), cjk), (bare, lower if accents is None else accents), (lowercase, lower)]
    return _chained([s for s, on in steps if on])


def normalizer(spec: dict | None) -> TextStep | None:
    """A normalizer of `tokenizer.json` as a function of strings; None if it has no such form."""
    if spec is None:
        return str
    if not isinstance(spec, dict):
        return None
    spec = normalizers.untagged(spec)
    kind = spec["type"]
    if kind in normalizers.FORMS:
        return lambda t: t if t.isascii() else unicodedata.normalize(kind, t)
    if kind == "Sequence":
        steps = [normalizer(s) for s in spec["normalizers"]]
        return None if None in steps else _chained(steps)
    if kind == "BertNormalizer":
        return _bert(spec.get("clean_text", True), spec.get("handle_chinese_chars", True), spec.get("strip_accents"), spec.get("lowercase", True))
    if kind == "Strip":
        left, right = spec.get("strip_left", True), spec.get("strip_right", True)
        strip = str.strip if left and right else str.lstrip if left else str.rstrip if right else None
        return (lambda t: strip(t, _SPACES)) if strip else str
    if kind == "Replace":
        content, pattern = spec["content"], spec["pattern"]
        literal = pattern if isinstance(pattern, str) else pattern.get("String")
        if literal is not None:
            return (lambda t: t.replace(literal, content)) if literal else str
        sub = compiled(pattern["Regex"]).sub
        return lambda t: sub(lambda m: content, t)
    if kind == "Prepend":
        return lambda t: spec["prepend"] + t if t else t
    if kind == "Precompiled":
        return _precompiled(spec["precompiled_charsmap"])
    simple = {"Lowercase": lowercase, "StripAccents": lambda t: t.translate(_NO_MARKS), "Nmt": lambda t: t.translate(_NMT), "ByteLevel": byte_level}
    if kind in simple:
        return simple[kind]
    raise ConfigError(f"unknown normalizer {kind!r}")


#: Patterns that are one class of plain letters and digits.
_CLASS = regex.compile(r"\[([A-Za-z0-9]+)\]")
#: Signs of BERT's punctuation, inside brackets of a regular expression.
_SIGNS = r"!-/:-@\[-`{-~\p{P}"


def _by_class(inside: str, behavior: str) -> WordStep:
    """Split at characters of a class."""
    patterns = {
        "Removed": f"[^{inside}]+", "Isolated": f"[{inside}]|[^{inside}]+", "Contiguous": f"[{inside}]+|[^{inside}]+",
        "MergedWithPrevious": f"[^{inside}]*[{inside}]|[^{inside}]+", "MergedWithNext": f"[{inside}][^{inside}]*|[^{inside}]+",
    }
    if behavior not in patterns:
        raise ConfigError(f"unknown split behavior {behavior!r}")
    return compiled(patterns[behavior]).findall


def _byte_words(prefix: bool, pattern: bool) -> WordStep:
    find = compiled(pretokenizers.WORDS).findall

    def run(text: str) -> list[str]:
        if prefix and text and not text.startswith(" "):
            text = " " + text
        return [byte_level(w) for w in find(text)] if pattern else [byte_level(text)]

    return run


def _metaspace(mark: str, scheme: str, split: bool) -> WordStep:
    if scheme not in ("always", "never") or len(mark) != 1:
        raise ConfigError("bad metaspace options")
    cut = compiled(f"{regex.escape(mark)}[^{regex.escape(mark)}]*|[^{regex.escape(mark)}]+").findall

    def run(text: str) -> list[str]:
        text = text.replace(" ", mark)
        if scheme == "always" and text and not text.startswith(mark):
            text = mark + text
        return cut(text) if split else [text]

    return run


_script = _Chars(pretokenizers.script_of)


def _scripts(text: str) -> list[str]:
    marks, last = [], None
    for i, script in enumerate(map(_script.__getitem__, map(ord, text))):
        if script != "Any" and script != last:
            marks.append(i)
            last = script
    return [text[a:b] for a, b in zip(marks, [*marks[1:], len(text)])]


def splitter(spec: dict | None) -> WordStep | None:
    """A pre-tokenizer of `tokenizer.json` as a function from a string to its pieces; None if it has no such form."""
    if spec is None:
        return lambda t: [t]
    if not isinstance(spec, dict):
        return None
    kind = spec.get("type")
    if kind == "Sequence":
        steps = [splitter(s) for s in spec["pretokenizers"]]
        if None in steps:
            return None

        def run(text: str) -> list[str]:
            parts = [text]
            for step in steps:
                parts = [q for p in parts for q in step(p) if q]
            return parts

        return run
    if kind == "BertPreTokenizer":
        return compiled(rf"[{_SIGNS}]|[^\s{_SIGNS}]+").findall
    if kind == "ByteLevel":
        return _byte_words(spec.get("add_prefix_space", True), spec.get("use_regex", True))
    if kind == "Whitespace":
        return compiled(pretokenizers.WORD_OR_SIGNS).findall
    if kind == "WhitespaceSplit":
        return compiled(r"\S+").findall
    if kind == "Metaspace":
        scheme = spec.get("prepend_scheme") or ("always" if spec.get("add_prefix_space", True) else "never")
        # "first" asks where in the original a piece stands
        return None if scheme == "first" else _metaspace(spec.get("replacement", "▁"), scheme, spec.get("split", True))
    if kind == "Split":
        what, behavior, invert = pretokenizers.pattern_of(spec), spec["behavior"], spec.get("invert", False)
        if isinstance(what, regex.Pattern) and not invert and (inside := _CLASS.fullmatch(what.pattern)) and not what.flags & regex.I:
            return _by_class(inside[1], behavior)
        return lambda t: [t[a:b] for a, b in pieces(cuts_of(what, t), behavior, invert)]
    if kind == "Punctuation":
        return _by_class(_SIGNS, spec.get("behavior", "Isolated"))
    if kind == "Digits":
        return _by_class(r"\p{N}", "Isolated" if spec.get("individual_digits", False) else "Contiguous")
    if kind == "CharDelimiterSplit":
        return lambda t: [p for p in t.split(spec["delimiter"]) if p]
    if kind == "UnicodeScripts":
        return _scripts
    if kind == "FixedLength":
        n = spec.get("length", 5)
        return (lambda t: [t[i : i + n] for i in range(0, len(t), n)]) if n >= 1 else None
    return None
