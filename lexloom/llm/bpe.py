"""BPE encoding by backtracking over Aho-Corasick matches, decoding by an offset table.

For each pre-token one Aho-Corasick pass gives every vocabulary entry that starts
at each place. The encoder takes the longest, keeps it if it may stand after the
token before it, and else tries the next shorter or steps back. Whether two tokens
may stand side by side is read from the pair-compatibility table, which follows
both tokens' merge trees: no merge of lower rank may cross their border. The
sequence found is the one that the merges give, in time linear in the length.

The backtracking encoder is a published public algorithm. Decoding gathers slices of
one byte string by an offset table. Texts are split and equal chunks found in Arrow,
and a bounded memo of chunks saves repeated work; neither changes a result, since
normalization and splitting don't look across white space."""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
import weakref
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.memo import Memo, joined, lists_of, portions
from lexloom.llm.common import arrow_map, rows, table

END = "\x00"  # stands for the end-of-word suffix inside the kernel
#: Pairs of the compatibility table that are kept.
COMPATIBLE = 300_000
#: Bytes of text that a worker encodes at once.
PORTION = 4 << 20
_SPACED = "\t a\n  .\v1\f\r \x85b\xa0\u2003.\u3000 '"  # white space around signs of each kind: no word may hold any
_BREAK = 0xFFFFFFFF  # stands for the end of a chunk among ids


def byte_chars() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Layout:
    """How a tokenizer file takes texts apart: added tokens, normalizers and the pattern of its words."""

    def __init__(self, spec: dict) -> None:
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with matching flags are not supported")
        steps = lambda part, key: (part.get(key) or [part]) if part else []
        self.normalizers, self.pattern, byte_level = [], None, False
        for n in steps(spec.get("normalizer"), "normalizers"):
            if n["type"] in ("NFC", "Lowercase"):
                self.normalizers.append({"NFC": "nfc", "Lowercase": "lower"}[n["type"]])
            elif n["type"] != "Replace" or n["pattern"].get("Regex") != r"\s+" or not n["content"].isspace():
                raise ValueError(f"normalizer {n['type']} is not supported")
        for p in steps(spec.get("pre_tokenizer"), "pretokenizers"):
            if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]:
                self.pattern = p["pattern"]["Regex"]
            elif p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p.get("use_regex", True):
                byte_level = True
            else:
                raise ValueError(f"pre-tokenizer {p['type']} is not supported in this form")
        if not byte_level or not self.pattern or spec.get("post_processor") or any(regex.search(r"\s", m) for m in regex.findall(self.pattern, _SPACED)):
            raise ValueError("the file's splitter or post-processor is not supported")


class Tables(Layout):
    """What the kernel needs of a tokenizer file; built once on the driver and broadcast."""

    def __init__(self, spec: dict) -> None:
        super().__init__(spec)
        model = spec["model"]
        if model.get("type") not in (None, "BPE") or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        if spec.get("decoder"):
            raise ValueError("the file's decoder is not supported")
        vocab: dict[str, int] = model["vocab"]
        inner = lambda t: t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else t
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = {}
        for rank, (a, b) in enumerate(pairs):
            left = a  # a left part never carries the suffix
            if (text := left + b) in made:
                raise ValueError(f"two merges make {text!r}")
            made[text] = rank
        base = sorted((t for t in vocab if t not in made and len(inner(t).rstrip(END)) == 1), key=vocab.get)
        order = base + sorted(made, key=made.get)
        number = {t: k for k, t in enumerate(order)}
        self.n_base = len(base)
        self.ids = [vocab[t] for t in order]
        self.split = [(k, k) for k in range(len(base))] + [(number[a], number[b]) for a, b in pairs]
        self.pair = {(number[a], number[b]): number[a + b] for a, b in pairs}
        self.texts = [inner(t) for t in order]
        symbol = {self.texts[k]: k for k in range(len(base))}
        self.reachable = [k < len(base) or self.merge(self.texts[k], symbol) == [k] for k in range(len(order))]
        self.tokens: dict[int, str] = {i: t for t, i in sorted(vocab.items(), reverse=True)}
        self.tokens.update((i, t) for t, i in self.added)

    def merge(self, text: str, symbol: dict[str, int]) -> list[int]:
        """Plain merging by rank: the meaning that the backtracking encoder has to match."""
        parts = [symbol[s] for s in symbols(text) if s in symbol]
        while len(parts) > 1:
            best = min(((self.pair.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts


def symbols(text: str) -> list[str]:
    """Characters; the last one together with the end mark."""
    return [*text[:-2], text[-2:]] if text.endswith(END) else list(text)


class Pieces:
    """Texts cut at white space into chunks, chunks into added tokens and words; `word` gives a word's ids.

    A chunk's ids don't depend on what stands around it, since no normalizer and no
    pattern of a `Layout` looks across white space. What is kept of chunks and words
    is bounded."""

    def __init__(self, layout: Layout, word) -> None:
        self.words = Memo(lambda words: lists_of([(_BREAK,) if w == "\n" else word(w) for w in words.to_numpy(zero_copy_only=False)]))
        self.chunks = Memo(self._make)
        self.normalizers = layout.normalizers
        self.find = regex.compile(f"(?:{layout.pattern})|\n").findall
        self.added = regex.compile("|".join(regex.escape(c) for c, _ in sorted(layout.added, key=lambda x: -len(x[0])))) if layout.added else None
        self.added_ids = dict(layout.added)

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text's words; a line end gives `_BREAK`. White space is not replaced, since no word holds any."""
        for kind in self.normalizers:
            if kind == "lower":  # character by character: only a capital sigma's lower case depends on what stands around it
                text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
            elif not text.isascii():
                text = unicodedata.normalize("NFC", text)
        return self.words.take(pa.array(self.find(text), pa.string())).flatten().to_numpy()

    def _make(self, chunks: pa.StringArray) -> pa.ListArray:
        """Ids of chunks that hold no white space, from all of them at once, a line each."""
        text = "\n".join([*chunks.to_numpy(zero_copy_only=False), ""])
        parts, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            parts += [self._plain(text[at : m.start()]), np.array([self.added_ids[m[0]]], np.uint32)]
            at = m.end()
        flat = np.concatenate([*parts, self._plain(text[at:])])
        breaks = np.flatnonzero(flat == _BREAK)
        ends = np.concatenate(([0], breaks - np.arange(len(breaks))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[flat != _BREAK]))

    def encode(self, data: bytes | None) -> np.ndarray:
        """Ids of one UTF-8 text (none for null)."""
        return self.encode_all(pa.array([data], pa.binary()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of a binary array of UTF-8 texts, one after the other, and the places where texts start and the last ends."""
        text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
        split = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        found = self.chunks.take(split.flatten())
        ends, offsets = found.offsets.to_numpy(), split.offsets.to_numpy()
        return found.flatten().to_numpy(), (ends[offsets - offsets[0]] - ends[0]).astype(np.int64)


class Coder(Pieces):
    """Encoder and decoder over `Tables`, one per Python worker."""

    def __init__(self, tables: Tables) -> None:
        super().__init__(tables, self._word)
        self.pair, self.split, self.ids = tables.pair, tables.split, tables.ids
        self.matcher = ahocorasick.Automaton()
        for k, text in enumerate(tables.texts):
            if tables.reachable[k]:
                self.matcher.add_word(text, (k, len(text)))
        self.matcher.make_automaton()
        number = {t: k for k, t in enumerate(tables.texts) if tables.reachable[k]}
        self.sizes = [len(t) for t in tables.texts]
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = [next((number[t[:i]] for i in range(len(t) - 1, 0, -1) if t[:i] in number), -1) for t in tables.texts]
        self.compatible: dict[int, bool] = {}
        self.end = END if tables.suffix else ""
        self.chars = byte_chars()
        top = max(tables.tokens) + 1
        texts = [tables.tokens.get(i, "").encode() for i in range(top)]
        #: The offset table: token i is the bytes from offset i to offset i + 1 of one buffer.
        self.slices = pa.array(texts, pa.binary())
        self.decimals = pa.array([b"%d" % i for i in range(top)], pa.binary())
        self.known = np.array([i in tables.tokens for i in range(top)])

    def _may_follow(self, a: int, b: int) -> bool:
        """Pair-compatibility: encoding the two tokens' joint text gives these two tokens."""
        key = a << 32 | b
        got = self.compatible.get(key)
        if got is not None:
            return got
        x, y, limit, pair, split = a, b, 1 << 40, self.pair, self.split
        while True:
            whole = pair.get((x, y))
            if whole is not None and whole < limit:
                ok = False
                break
            if x > y:
                limit, x = x, split[x][1]
                if x == limit:
                    limit, y = y + 1, split[y][0]
                    if y + 1 == limit:
                        ok = True
                        break
            else:
                limit, y = y + 1, split[y][0]
                if y + 1 == limit:
                    limit, x = x, split[x][1]
                    if x == limit:
                        ok = True
                        break
        if len(self.compatible) > COMPATIBLE:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def tokens_of(self, text: str) -> list[int]:
        """Internal tokens of one pre-token whose characters are all in the alphabet."""
        greedy = [k for _, (k, _) in self.matcher.iter_long(text)]
        if all(map(self._may_follow, greedy, greedy[1:])) and sum(map(self.sizes.__getitem__, greedy)) == len(text):
            return greedy  # the longest token at each place, and none had to be taken back
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (k, size) in self.matcher.iter(text):
            longest[end + 1 - size] = k  # ends ascend, so the longest comes last
        compatible, may, sizes, shorter = self.compatible.get, self._may_follow, self.sizes, self.shorter
        at, out, last, ruled_out, k = 0, [], -1, None, longest[0]
        while at < n:
            while k >= 0:
                if ruled_out is None or not ruled_out[at + sizes[k]]:
                    if last < 0:
                        break
                    ok = compatible(last << 32 | k)
                    if may(last, k) if ok is None else ok:
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                last = k
                at += sizes[k]
                k = longest[at]
            else:
                if not out:
                    raise ValueError(f"no tokens for {text!r}")
                if ruled_out is None:
                    ruled_out = bytearray(n + 1)
                ruled_out[at] = 1  # no way on from here, whatever came before
                k = out.pop()
                at -= sizes[k]
                k = shorter[k]
                last = out[-1] if out else -1
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        text = word if word.isascii() and word.isprintable() and " " not in word else "".join(self.chars[b] for b in word.encode())
        text += self.end
        return tuple(self.ids[k] for k in self.tokens_of(text))

    def decode_all(self, ids: np.ndarray, ends: np.ndarray, skip: frozenset[int] = frozenset()) -> pa.Array:
        """Binary array of texts: tokens joined by a space, in UTF-8; unknown ids and those of `skip` drop out."""
        good = (ids < len(self.known)) & (ids >= 0)
        if not self.known.all():
            good &= self.known[np.where(good, ids, 0)]
        if skip:
            good &= ~np.isin(ids, list(skip))
        if not good.all():
            ends = np.concatenate(([0], np.cumsum(good)))[ends]
            ids = ids[good]
        return joined(self.slices, ids, ends)


def digests(texts: pa.Array) -> list[str]:
    """SHA-256 of each value of a binary array without nulls."""
    offsets, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].tolist(), texts.buffers()[2]
    view = memoryview(data) if data is not None else b""
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])]


@lru_cache(4)
def tables_of(path: str) -> Tables:
    with open(path, encoding="utf-8") as f:
        return Tables(json.load(f))


_coders: dict[str, Coder] = {}


def coder(path: str, tables: Tables) -> Coder:
    """This worker's coder, kept from task to task until Spark takes back the broadcast that `tables` came with.

    Workers outlive a job; what later ones run in them needs the memory. A coder holds
    no reference to `tables` itself, so these go as soon as the broadcast does."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = Coder(tables)
        weakref.finalize(tables, _forget).atexit = False
    return _coders[path]


def _forget() -> None:
    _coders.clear()
    gc.collect()  # memos refer to their coder
    pa.default_memory_pool().release_unused()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, ids: bool = True, digest: bool = True
) -> DataFrame:
    """Per row of `docs`: id, n_tokens and, as asked for, ids (array<int>) and SHA-256 digests of the ids and of their decoding.

    Null, empty and blank texts have no tokens. Repeated rows are encoded each.
    Only the two named columns are read. `path` names the tokenizer file on the
    driver; its tables are broadcast (their size is that of the vocabulary)."""
    path = path or default_path()
    shared = docs.sparkSession.sparkContext.broadcast(tables_of(path))

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    fields = [f"id {dict(thin.dtypes)['id']}", "n_tokens bigint"]
    fields += ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, shared.value)
        for part in (p for batch in batches for p in portions(batch, "data", PORTION)):
            found, ends = c.encode_all(part.column(1))
            out = [part.column(0), pa.array(np.diff(ends))]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32))))
            if digest:
                out += [pa.array(digests(joined(c.decimals, found, ends)), pa.string()), pa.array(digests(c.decode_all(found, ends)), pa.string())]
            yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in fields])
            pa.default_memory_pool().release_unused()  # else Arrow keeps the most that any step took

    return thin.mapInArrow(run, ", ".join(fields)).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", path: str | None = None, skip_special_tokens: bool = False) -> DataFrame:
    """(id, text) from an array of ids; null gives an empty text, null and unknown ids drop out."""
    path = path or default_path()
    tables = tables_of(path)
    skip = frozenset(i for _, i in tables.added) if skip_special_tokens else frozenset()
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batch: pa.RecordBatch) -> dict:
        c = coder(path, shared.value)
        lists = [[i for i in x or [] if i is not None] for x in rows(batch, "ids")]
        ends = np.cumsum([0, *map(len, lists)])
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(ends[-1]))
        return {"id": batch.column(0), "text": c.decode_all(flat, ends, skip).cast(pa.string())}

    thin = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return arrow_map(thin, run, f"id {dict(thin.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
