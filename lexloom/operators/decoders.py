"""Decoders: a list of tokens in, a list of texts out; the result is joined without anything between."""

from __future__ import annotations

import re
from collections.abc import Callable

from lexloom.errors import ConfigError
from lexloom.functions.chars import char_bytes
from lexloom.functions.patterns import compiled, literal_spans

Decoder = Callable[[list[str]], list[str]]
#: Replacements of clean-up, in their order.
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def cleaned(text: str) -> str:
    for old, new in CLEANUP:
        text = text.replace(old, new)
    return text


def bpe(suffix: str = "</w>") -> Decoder:
    return lambda ts: [t.replace(suffix, "" if k == len(ts) - 1 else " ") for k, t in enumerate(ts)]


def byte_level(tokens: list[str]) -> list[str]:
    table, out = char_bytes(), bytearray()
    for t in tokens:
        codes = [table.get(c) for c in t]
        out += t.encode() if None in codes else bytes(codes)
    return [out.decode("utf-8", "replace")]


def wordpiece(prefix: str = "##", cleanup: bool = True) -> Decoder:
    def run(tokens: list[str]) -> list[str]:
        out = []
        for k, t in enumerate(tokens):
            if k:
                t = t[len(prefix) :] if t.startswith(prefix) else " " + t
            out.append(cleaned(t) if cleanup else t)
        return out

    return run


def metaspace(replacement: str = "▁", scheme: str = "always") -> Decoder:
    return lambda ts: [t.replace(replacement, "" if k == 0 and scheme != "never" else " ") for k, t in enumerate(ts)]


def ctc(pad: str = "<pad>", delimiter: str = "|", cleanup: bool = True) -> Decoder:
    def run(tokens: list[str]) -> list[str]:
        out = []
        for k, t in enumerate(tokens):
            if k and tokens[k - 1] == t:
                continue
            t = t.replace(pad, "")
            if cleanup:
                t = cleaned(t).replace(delimiter, " ")
            if t:
                out.append(t)
        return out

    return run


def replace(pattern: dict | str, content: str) -> Decoder:
    literal = pattern if isinstance(pattern, str) else pattern.get("String")
    expression = None if literal is not None else compiled(pattern["Regex"])

    def one(t: str) -> str:
        spans = literal_spans(literal, t) if literal is not None else [m.span() for m in expression.finditer(t)]
        for a, b in reversed(spans):
            t = t[:a] + content + t[b:]
        return t

    return lambda ts: [one(t) for t in ts]


def fuse(tokens: list[str]) -> list[str]:
    return ["".join(tokens)]


def strip(content: str, start: int, stop: int) -> Decoder:
    def one(t: str) -> str:
        a, b = 0, len(t)
        while a < min(start, len(t)) and t[a] == content:
            a += 1
        while len(t) - b < stop and b > a and t[b - 1] == content:
            b -= 1
        return t[a:b]

    return lambda ts: [one(t) for t in ts]


def byte_fallback(tokens: list[str]) -> list[str]:
    """Runs of byte tokens become text; a run that is no UTF-8 gives one replacement character a byte."""
    out, run = [], bytearray()

    def flush() -> None:
        if run:
            try:
                out.append(run.decode())
            except UnicodeDecodeError:
                out.extend("�" * len(run))
            run.clear()

    for t in tokens:
        m = _BYTE.fullmatch(t)
        if m:
            run.append(int(m[1], 16))
        else:
            flush()
            out.append(t)
    flush()
    return out


def untagged(spec: dict) -> dict:
    if "type" in spec:
        return spec
    for fields, kind in ((("suffix",), "BPEDecoder"), (("replacement",), "Metaspace"), (("prefix", "cleanup"), "WordPiece"), (("pad_token",), "CTC"), (("decoders",), "Sequence"), (("pattern", "content"), "Replace"), (("content", "start", "stop"), "Strip")):
        if all(f in spec for f in fields):
            return spec | {"type": kind}
    raise ConfigError(f"no decoder has the fields {sorted(spec)}")


def build(spec: dict | None) -> Decoder | None:
    if spec is None:
        return None
    spec = untagged(spec)
    kind = spec["type"]
    if kind == "BPEDecoder":
        return bpe(spec.get("suffix", "</w>"))
    if kind == "WordPiece":
        return wordpiece(spec.get("prefix", "##"), spec.get("cleanup", True))
    if kind == "Metaspace":
        return metaspace(spec.get("replacement", "▁"), spec.get("prepend_scheme") or ("always" if spec.get("add_prefix_space", True) else "never"))
    if kind == "CTC":
        return ctc(spec.get("pad_token", "<pad>"), spec.get("word_delimiter_token", "|"), spec.get("cleanup", True))
    if kind == "Replace":
        return replace(spec["pattern"], spec["content"])
    if kind == "Strip":
        return strip(spec["content"], spec["start"], spec["stop"])
    if kind == "Sequence":
        steps = [build(s) for s in spec["decoders"]]

        def run(tokens: list[str]) -> list[str]:
            for s in steps:
                tokens = s(tokens)
            return tokens

        return run
    simple = {"ByteLevel": byte_level, "Fuse": fuse, "ByteFallback": byte_fallback}
    if kind in simple:
        return simple[kind]
    raise ConfigError(f"unknown decoder {kind!r}")
