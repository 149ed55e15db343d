"""Native Column forms of components, where built-in functions give exact results.

Texts are string columns, tokens arrays of strings. Nothing here runs Python on
executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.errors import ConfigError, PreTokenizerError
from lexloom.functions.chars import CJK_CLASS, PUNCTUATION_CLASS, byte_alphabet
from lexloom.operators.decoders import CLEANUP
from lexloom.operators.pretokenizers import WORDS


def _java_literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", text)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# Normalizers


def nmt(text: Column) -> Column:
    dropped = F.regexp_replace(text, "[\\x01-\\x08\\x0B\\x0E-\\x1F\\x7F\\x8F\\x9F]", "")
    return F.regexp_replace(dropped, "[\\x09\\x0A\\x0C\\x0D\\x{1680}\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{2581}\\x{FEFF}\\x{FFFD}]", " ")


def space_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"([{CJK_CLASS}])", " $1 ")


def clean_text(text: Column) -> Column:
    dropped = F.regexp_replace(text, "[\\x00\\x{FFFD}\\p{C}&&[^\\t\\n\\r]]", "")
    return F.regexp_replace(dropped, "(?U)\\s", " ")


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    parts = ["^\\s+"] * left + ["\\s+$"] * right
    return F.regexp_replace(text, f"(?U){'|'.join(parts)}", "") if parts else text


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{M}", "")


def lowercase(text: Column) -> Column:
    """Per character: Spark's lower() applies the rule for a final sigma, so sigma is done apart. Other letters agree."""
    return F.lower(F.translate(text, "Σ", "σ"))


def prepend(text: Column, prefix: str) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(prefix), text)).otherwise(text)


def replace_literal(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new)) if old else text


def replace_pattern(text: Column, pattern: str, content: str) -> Column:
    """The content is literal: no group is filled in."""
    return F.regexp_replace(text, pattern, re.sub(r"([\\$])", r"\\\1", content))


def byte_level(text: Column) -> Column:
    """Read as Latin-1 the bytes of a text are one character each; those that don't print are then exchanged."""
    shown = byte_alphabet()
    moved = [b for b in range(256) if shown[b] != chr(b)]
    single = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(single, "".join(map(chr, moved)), "".join(shown[b] for b in moved))


# Splitters


def whitespace(text: Column) -> Column:
    return _matches(text, "(?U)\\w+|[^\\w\\s]+")


def whitespace_split(text: Column) -> Column:
    return _matches(text, "(?U)\\S+")


def bert_split(text: Column) -> Column:
    return _matches(text, f"(?U)[{PUNCTUATION_CLASS}]|[^\\s{PUNCTUATION_CLASS}]+")


def punctuation(text: Column, behavior: str = "Isolated") -> Column:
    p = PUNCTUATION_CLASS
    patterns = {
        "Isolated": f"[{p}]|[^{p}]+", "Removed": f"[^{p}]+", "Contiguous": f"[{p}]+|[^{p}]+",
        "MergedWithPrevious": f"[^{p}]*[{p}]|[^{p}]+", "MergedWithNext": f"[{p}][^{p}]*|[^{p}]+",
    }
    return _matches(text, patterns[behavior])


def digits(text: Column, individual: bool = False) -> Column:
    return _matches(text, "\\p{N}|\\P{N}+" if individual else "\\p{N}+|\\P{N}+")


def char_delimiter(text: Column, delimiter: str) -> Column:
    if len(delimiter) != 1:
        raise ConfigError("a delimiter is one character")
    return _matches(text, f"[^{_java_literal(delimiter)}]+")


def metaspace(text: Column, replacement: str = "▁", scheme: str = "always", split: bool = True) -> Column:
    shown = F.replace(text, F.lit(" "), F.lit(replacement))
    if scheme != "never":
        shown = F.when((F.length(shown) > 0) & ~F.startswith(shown, F.lit(replacement)), F.concat(F.lit(replacement), shown)).otherwise(shown)
    r = _java_literal(replacement)
    return _matches(shown, f"{r}[^{r}]*|[^{r}]+") if split else F.filter(F.array(shown), lambda t: t != "")


def fixed_length(text: Column, n: int = 5) -> Column:
    if n < 1:
        raise PreTokenizerError("a fixed length of 0 splits nothing")
    return _matches(text, f"(?s).{{1,{n}}}")


def gpt_words(text: Column) -> Column:
    return _matches(text, f"(?U){WORDS}")


# Decoders


def decode_bpe(tokens: Column, suffix: str = "</w>") -> Column:
    last = F.size(tokens) - 1
    return F.transform(tokens, lambda t, i: F.when(i == last, F.replace(t, F.lit(suffix), F.lit(""))).otherwise(F.replace(t, F.lit(suffix), F.lit(" "))))


def cleanup(text: Column) -> Column:
    for old, new in CLEANUP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_wordpiece(tokens: Column, prefix: str = "##", clean: bool = True) -> Column:
    def one(t: Column, i: Column) -> Column:
        bare = F.substring(t, F.lit(len(prefix) + 1), F.length(t))
        out = F.when(i == 0, t).when(F.startswith(t, F.lit(prefix)), bare).otherwise(F.concat(F.lit(" "), t))
        return cleanup(out) if clean else out

    return F.transform(tokens, one)


def decode_metaspace(tokens: Column, replacement: str = "▁", scheme: str = "always") -> Column:
    gone = F.lit("" if scheme != "never" else " ")
    return F.transform(tokens, lambda t, i: F.when(i == 0, F.replace(t, F.lit(replacement), gone)).otherwise(F.replace(t, F.lit(replacement), F.lit(" "))))


def decode_ctc(tokens: Column, pad: str = "<pad>", delimiter: str = "|", clean: bool = True) -> Column:
    kept = F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))
    bare = F.transform(kept, lambda t: F.replace(t, F.lit(pad), F.lit("")))
    if clean:
        bare = F.transform(bare, lambda t: F.replace(cleanup(t), F.lit(delimiter), F.lit(" ")))
    return F.filter(bare, lambda t: t != "")


def decode_replace(tokens: Column, old: str, new: str) -> Column:
    return F.transform(tokens, lambda t: F.replace(t, F.lit(old), F.lit(new)))


def decode_fuse(tokens: Column) -> Column:
    return F.array(F.array_join(tokens, ""))


def decode_strip(tokens: Column, content: str, start: int, stop: int) -> Column:
    c = _java_literal(content)
    return F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, f"^{c}{{0,{start}}}", ""), f"{c}{{0,{stop}}}$", ""))


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, "")


# Arrays of an encoding


def padded(values: Column, size: Column | int, fill: object, direction: str = "right") -> Column:
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(values), F.lit(0)).cast("int"))
    return F.concat(values, more) if direction == "right" else F.concat(more, values)


def windows(n: Column, most: int, stride: int = 0, direction: str = "right") -> Column:
    """array<struct<start, stop>> of the windows of a sequence of n tokens; the first one is kept, the rest overflow."""
    step = most - stride
    if most < 1 or step < 1:
        raise ConfigError("the stride must be less than the length kept")
    k = F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("int")
    each = F.sequence(F.lit(0), k)
    if direction == "right":
        return F.transform(each, lambda i: F.struct((i * step).alias("start"), F.least(i * step + most, n).alias("stop")))
    return F.transform(each, lambda i: F.struct(F.greatest(n - i * step - most, F.lit(0)).alias("start"), (n - i * step).alias("stop")))


def shares(n: Column, m: Column, most: int) -> tuple[Column, Column]:
    """Lengths that two sequences keep of a budget under LongestFirst."""
    low, high = F.least(n, m), F.greatest(n, m)
    second = F.when(low > most, low).otherwise(F.greatest(low, most - low))
    over = low + second > most
    a = F.when(over, F.lit(most // 2)).otherwise(low)
    b = F.when(over, F.lit(most // 2 + most % 2)).otherwise(second)
    fits = n + m <= most
    return F.when(fits, n).when(n <= m, a).otherwise(b), F.when(fits, m).when(n <= m, b).otherwise(a)


def template(pieces: list[dict], sequences: dict[str, Column], tokens: dict[str, list], field: str) -> Column:
    """One array of a template: sequences by name, special tokens by name, or their types."""
    out = []
    for p in pieces:
        if "Sequence" in p:
            own, type_id = sequences[p["Sequence"]["id"]], p["Sequence"]["type_id"]
            out.append(F.array_repeat(F.lit(type_id), F.size(own)) if field == "type_ids" else own)
        else:
            values = tokens[p["SpecialToken"]["id"]]
            out.append(F.array(*(F.lit(p["SpecialToken"]["type_id"] if field == "type_ids" else v) for v in values)))
    return F.concat(*out)
